"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common, tokens

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank_in_part long"


@dataclass
class Plan:
    """Runs of slots: pieces of one length and consecutive ranks, `each` to a sequence."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def seats(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by length and rank within the length."""
        key = (self.length.astype(np.int64) << 48) | self.rank
        at = np.searchsorted(key, (length.astype(np.int64) << 48) | rank, "right") - 1
        past = rank - self.rank[at]
        return self.first[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


def plan_best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: lengths from the longest, each into the fullest sequences that hold it.

    Sequences that are alike form runs of consecutive ids, so the work and the plan depend
    on the number of distinct lengths (capacity at most), not on the number of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def seat(first: int, n: int, free: int):
            """Puts pieces into n alike sequences with free tokens left."""
            nonlocal left, rank
            each = free // size
            full = min(n, left // each)
            for bins, k in ((full, each), (1 if full < n else 0, left - full * each)):
                if bins and k:
                    runs.append((size, rank, first, k, capacity - free))
                    room[free - k * size].append((first, bins))
                    first, n, left, rank = first + bins, n - bins, left - bins * k, rank + bins * k
            if n:
                room[free].append((first, n))

        free = size
        while left and free <= capacity:
            if room[free]:
                seat(*room[free].pop(), free)
            else:
                free += 1
        if left:
            n = -(-left // (capacity // size))
            first, made = made, made + n
            seat(first, n, capacity)
    runs.sort()
    return Plan(*(np.array(x, np.int64) for x in (zip(*runs) if runs else [[]] * 5)))


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank_in_part): every document's pieces.

    A piece's rank counts the pieces of its length that its partition made before it. Null or
    empty text: one piece with the end id. Every row has its pieces, repeated doc_ids and rows
    too. No rows: none out. Other columns are ignored.
    """
    common.ship(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in tokens.batches(whole):
                got, n = tokens.encoder(vocabulary).encode(batch.column("text"))
                ids = np.insert(got, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                data = memoryview(ids.tobytes())
                per = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.flatnonzero(np.diff(by, prepend=-1))
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by)))) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.record_batch(
                    [pa.array(np.full(len(doc), part, np.int32)), batch.column("doc_id").take(pa.array(doc)), *(pa.array(x) for x in (piece.astype(np.int32), start, length)), pa.array(crc, pa.int64()), pa.array(rank)],
                    ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank_in_part"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces(part, length, rank_in_part, ...).

    The histogram of lengths, at most capacity rows, comes to the driver; best-fit
    decreasing is planned on it. Pieces then take slots by rank within their length: the
    rank within a partition plus the pieces of that length in earlier partitions. No
    length's pieces are gathered anywhere, so a length may hold most of all pieces: they
    meet their base by (part, length), in a join that is never a broadcast, as the bases
    grow with the partitions. pieces must be a stored table, read the same each time, with
    lengths of 1 to capacity; its other columns stay as they are, but sequence_id, offset,
    base and rank_in_length must not be among them. Pieces alike in length and rank don't
    occur; repeated rows have ranks of their own. No rows: none out.
    """
    common.ship(pieces.sparkSession)
    names = pieces.columns
    counts = common.staged(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    plan = plan_best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), ["length", "part"]).select(*names, (F.col("base") + F.col("rank_in_part")).alias("rank_in_length"))

    def seat(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.seats(batch.column("length").to_numpy(), batch.column("rank_in_length").to_numpy())
                batch = batch.drop_columns(["rank_in_length"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
                yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(seat, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs whole documents(doc_id, text) into sequences of at most capacity tokens.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Only documents longer than capacity are cut. Null or empty text: a piece that
    holds the end id. Null and repeated doc_ids: every row is packed. No rows: none out.
    Other columns are ignored.
    """
    pieces = common.staged(cut_pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
