"""Edit logs as streams: the state of every key in a stored table that each batch brings up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.functions.lineage import cut


def last_edits(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that is last by order, from a stored log or a stream: an aggregation, so Spark keeps the state."""
    rest = [c for c in log.columns if c not in key and c != order]
    return log.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("last")).select(*key, "last.*")


def toggle_counts(log: DataFrame, key: list[str]) -> DataFrame:
    """How often each key was toggled, and whether it is on; from a stored log or a stream."""
    return log.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("on", F.col("n") % 2 == 1)


@dataclass
class KeyedTable:
    """A table of one row for each key, in buckets of keys: an update writes the buckets of its keys and no others.

    An update carries its keys' whole state, so one that is repeated changes nothing.
    """

    folder: str
    key: list[str]
    buckets: int = 64

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        new = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # self.buckets at most
        if not touched:
            return
        stored = self._stored(new.sparkSession, new.schema).filter(F.col("bucket").isin(touched))
        here = new.select(*(F.col(c).alias(f"_{c}") for c in self.key))
        same = F.lit(True)
        for c in self.key:
            same = same & stored[c].eqNullSafe(here[f"_{c}"])
        kept = stored.join(here, same, "left_anti")
        whole = cut(kept.unionByName(new))
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder).drop("bucket")

    def _stored(self, spark: SparkSession, schema) -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(self.folder)
        return spark.createDataFrame([], schema)


def follow(spark: SparkSession, folder: str, schema, state: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes what is new in folder's JSON log, brings state(log) up to date and writes the keys that changed to table.

    The state lives in the checkpoint, one row for each key of the log; files seen before are
    skipped, and a batch that failed runs again with the same state.
    """
    log = spark.readStream.schema(schema).json(folder)
    return state(log).writeStream.outputMode("update").foreachBatch(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
