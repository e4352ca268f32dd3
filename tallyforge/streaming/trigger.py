"""Reconciles uploads as they arrive: a file stream of line items, one batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.readers import LINE_ITEM


def on_upload(spark: SparkSession, folder: str, reconcile: Callable[[DataFrame, int], None], checkpoint: str, schema: str = LINE_ITEM) -> StreamingQuery:
    """Starts a query that hands each batch of new line items under folder to reconcile(items, batch_id) and ends.

    Files seen before are skipped by the checkpoint; a batch that failed runs again with
    its id, so reconcile should overwrite by batch_id.
    """
    items = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(folder)
    return items.writeStream.foreachBatch(reconcile).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
