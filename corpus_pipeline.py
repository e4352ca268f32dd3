"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.

docs has doc_id, text, source and any other columns; all stages but the last return the
columns of docs, whatever their names. Null, empty and very short texts go in the first
stage. A null doc_id or source is a value like any other; rows that share a doc_id are judged
by their own texts, and exact repeats of a row count as copies. Ties are broken by doc_id,
then digests, so reruns agree. Empty tables go through. Texts are held whole, one row at a
time, and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import common, line_templates, minhash, mixing, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that lost too much."""
    return quality.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in three documents go, but from the first, and documents that have nothing else."""
    return line_templates.without_emptied(docs, whole_docs=line_templates.LEAST_DOCS, keep_first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays; then lines that two of the rest share go, but from the first.

    Not before: near copies would come here without the lines they share, and what is left
    of them would stay.
    """
    kept = common.staged(minhash.keep_one(docs), "kept-one")
    return line_templates.without_emptied(kept, fields=False, keep_first=True)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mixing_weights),
    ("best-fit packing", best_fit_packing),
]

#: Shingle signatures and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
