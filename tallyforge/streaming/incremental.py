"""A run that recomputes only what an upload changed: page and candidate stores in buckets of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut
from tallyforge.operators import candidates, overlays
from tallyforge.sources.readers import bucket_of

BUCKETS = 256


@dataclass
class IncrementalRun:
    """Takes batches of pages(doc, page, text, entities), keeps candidates of items up to date.

    folder holds pages and results, both partitioned by a bucket of the document, and the ids of batches
    that are done. Of a batch only pages whose content hash differs from the stored one count;
    only the buckets that hold their documents are written again, and only those documents are
    matched again. Results are written before pages, and the batch's id last: a batch that failed
    anywhere finds its pages unlike the stored ones and does the same again. A batch that is
    done, or one without changes, writes nothing but its id.

    items as candidates.generate() has them; words, where given, are those of all pages.
    """

    folder: str
    items: DataFrame
    words: DataFrame | None = None
    buckets: int = BUCKETS

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._path(spark, f"{self.folder}/done/{batch_id}")
        if done[1].exists(done[0]):
            return
        key = ["doc", "page"]
        # of rows of one page the last by hash: repeated uploads of a batch agree
        hashed = self._hashed(batch)
        new = overlays.latest(hashed, key, "content")
        stored = self._stored(spark, "pages", hashed.schema)
        changed = cut(overlays.stale(new, stored, key, "content"))
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            kept = stored.filter(F.col("bucket").isin(touched)).join(changed.select(*key), key, "left_anti")
            pages = cut(kept.unionByName(changed))
            docs = cut(changed.select("doc", "bucket").distinct())
            self._replace(self._results(spark, pages, docs, touched), "results")
            self._replace(pages, "pages")
        done[1].create(done[0]).close()

    def candidates(self, spark) -> DataFrame:
        """The candidates of all items whose documents have pages, as generate() gives them."""
        return self._stored(spark, "results", None).filter("row_id IS NOT NULL").drop("bucket")

    def _results(self, spark, pages: DataFrame, docs: DataFrame, touched: list[int]) -> DataFrame:
        own = cut(pages.join(docs.select("doc"), "doc", "left_semi").select("doc", "page", "text", "entities"))
        each = own.select("doc", "page", F.posexplode("entities.amounts").alias("pos", "a"))
        values = each.select("doc", "page", "pos", "a.value", "a.budget_item").filter("value IS NOT NULL")
        among = lambda df: df.join(docs.select("doc"), "doc", "left_semi")
        made = candidates.generate(among(self.items), own, values, None if self.words is None else among(self.words)).join(docs, "doc")
        # a document's mark, so that a bucket is replaced even where its documents have no candidates left
        marks = docs.select("doc", "bucket")
        made = made.unionByName(marks, allowMissingColumns=True)
        old = self._stored(spark, "results", made.schema).filter(F.col("bucket").isin(touched)).join(docs.select("doc"), "doc", "left_anti")
        return cut(old.unionByName(made))

    def _hashed(self, pages: DataFrame) -> DataFrame:
        both = overlays.with_hashes(pages.select("doc", "page", "text", "entities"))
        content = F.sha2(F.concat_ws(":", F.coalesce("text_sha256", F.lit("")), F.coalesce("entities_sha256", F.lit(""))), 256)
        return both.select("doc", "page", "text", "entities", content.alias("content"), bucket_of(F.col("doc"), self.buckets).alias("bucket"))

    def _path(self, spark, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self, spark, name: str, schema) -> DataFrame:
        path, files = self._path(spark, f"{self.folder}/{name}")
        if files.exists(path):
            read = spark.read if schema is None else spark.read.schema(schema)
            return read.parquet(f"{self.folder}/{name}")
        if schema is None:
            raise FileNotFoundError(f"{self.folder} holds no results")
        return spark.createDataFrame([], schema)

    def _replace(self, rows: DataFrame, name: str) -> None:
        """Writes the buckets that rows are of, each as a whole; the others stay as they are."""
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
