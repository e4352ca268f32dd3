"""Token-id files: Simple-8b shards of whole documents in ascending doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common, simple8b, tokens

SHARDS = "part int, seq int, start_in_part long, n_docs long, n_ids long, path string"


def write_token_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1, shard_ids: int = 1 << 20) -> DataFrame:
    """Encodes docs(doc_id, text) and writes its ids as Simple-8b files under folder; returns their list.

    folder is a URI that all executors can write to (file, hdfs, s3, gs: what Arrow's file
    systems open). Documents are dealt to partitions by ranges of doc_id and sorted within, so
    files in (part, seq) order hold ascending doc_id. A file closes once it holds shard_ids
    ids; a document is never cut. An executor writes a file under a name of its own attempt
    and reports it; the list of the attempts that counted is committed by Spark as a table
    under folder/list. So a lost executor, or a task that runs twice, leaves at most files
    that no list names.

    Null or empty text: only the end id. Null doc_id: first. Equal doc_ids: by the hash of
    their text, then the text. No rows: an empty list. Other columns are ignored.
    """
    common.ship(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()
    folder = folder.rstrip("/")

    def encode(batches):
        where, base = _open(f"{folder}/files")
        where.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        seq, start, held = 0, 0, 0
        keys: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close():
            nonlocal seq, start, held, keys, lengths, ids
            name = f"{part:06d}-{seq:06d}-{attempt}.s8b"
            with where.open_output_stream(f"{base}/{name}") as f:
                f.write(simple8b.write_shard(keys, np.concatenate(lengths), np.concatenate(ids)))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start]), pa.array([len(keys)]), pa.array([held]), pa.array([f"{folder}/files/{name}"])], ["part", "seq", "start_in_part", "n_docs", "n_ids", "path"])
            seq, start, held, keys, lengths, ids = seq + 1, start + held, 0, [], [], []
            return row

        for whole in batches:
            for batch in tokens.batches(whole):
                got, n = tokens.encoder(vocabulary).encode(batch.column("text"))
                ends = np.cumsum(n)
                out = np.insert(got, ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                doc_ids = batch.column("doc_id").to_pylist()
                a = 0
                while a < len(n):
                    before = int(ends[a - 1]) if a else 0
                    b = min(len(n), int(np.searchsorted(ends, before + shard_ids - held)) + 1)
                    keys += doc_ids[a:b]
                    lengths.append(n[a:b])
                    ids.append(out[before : int(ends[b - 1])])
                    held += int(ends[b - 1]) - before
                    a = b
                    if held >= shard_ids:
                        yield close()
        if keys:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("salt", F.xxhash64("text"))
    dealt = texts.repartitionByRange(common.partitions(docs), "doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text")
    dealt.select("doc_id", "text").mapInArrow(encode, SHARDS).write.parquet(f"{folder}/list")
    return docs.sparkSession.read.schema(SHARDS).parquet(f"{folder}/list")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_token_shards(shards: DataFrame, schema: str, rows: Callable[[list, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """Reads and decodes listed files; rows(doc_ids, starts, lengths, ids) gives the arrays of one file's result.

    The ids before each part are summed from the list's counts: one number for each write
    partition comes to the driver, never more. A task holds one file at a time.
    """
    common.ship(shards.sparkSession)
    base, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r["part"]], total = total, total + r["n"]

    def read(batches):
        for batch in batches:
            for part, start, path in zip(*(batch.column(c).to_pylist() for c in ("part", "start_in_part", "path"))):
                where, name = _open(path)
                with where.open_input_stream(name) as f:
                    shard = simple8b.read_shard(f.read())
                starts = base[part] + start + np.cumsum(shard.lengths) - shard.lengths
                yield pa.RecordBatch.from_arrays(rows(shard.doc_ids, starts, shard.lengths, shard.ids()), names)

    names = [x.split()[0] for x in schema.split(", ")]
    # a list is small and would be read in few tasks; its files are dealt out
    return shards.select("part", "start_in_part", "path").repartition(2 * common.partitions(shards), "path").mapInArrow(read, schema)


def document_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document's ids, read back from the shards."""
    def rows(doc_ids, starts, lengths, ids):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))]

    return read_token_shards(shards, "doc_id long, start long, ids array<long>", rows)


def digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards."""
    def rows(doc_ids, starts, lengths, ids):
        data = memoryview(ids.astype("<u4").tobytes())
        ends = np.cumsum(lengths) * 4
        crc = [zlib.crc32(data[e - 4 * n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
        return [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]

    return read_token_shards(shards, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return digests(write_token_shards(docs, common.staged_path(spark, "token-shards")))
