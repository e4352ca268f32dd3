"""Nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common

BITS, SUBSTRINGS = 48, 4
#: Rows the codes are fitted on, about, chosen by hash, and rows of them whose neighbours set the radius.
FIT_ROWS, FIT_QUERIES = 8192, 256
#: Share of the sample's true neighbours that the radius must reach.
REACH = 0.965
#: Rows that are indexed together, and queries that are reranked together.
DATA_BLOCK, QUERIES = 8192, 128


@dataclass
class Codes:
    """Rotated codes: a bit for each direction, and the radius that reaches the near ones."""

    mean: np.ndarray
    turn: np.ndarray
    most: float  # the largest component, by which vectors are scaled
    limit: float  # the largest norm of scaled vectors
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors whose inner products with a query order like those of scaled x: one more component fills each up to the largest norm."""
        x = x / self.limit
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    def code(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            y = np.column_stack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))])
        else:
            y = self.lifted(x / self.most)
        on = (y - self.mean) @ self.turn > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fit_codes(sample: np.ndarray, most: float, limit: float, rows: int, k: int, bits: int = BITS) -> Codes:
    """Iterative quantisation of a scaled sample: principal directions, rotated so that signs lose least.

    The radius is the least that reaches REACH of the nearest sample rows of FIT_QUERIES
    sample rows; as many neighbours count as k of all rows amount to in the sample.
    """
    codes = Codes(np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, 1)), most, limit, 0)
    y = codes.lifted(sample)
    codes.mean = y.mean(axis=0)
    centred = y - codes.mean
    bits = min(bits, sample.shape[1])
    directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    flat = centred @ directions
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(30):
        u, _, v = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
        rotation = (u @ v).T
    codes.turn = directions @ rotation
    queries = sample[:FIT_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = max(1, min(round(k * len(sample) / max(rows, 1)), len(sample) - 1))
    if len(sample) < 2:
        codes.radius = bits
        return codes
    nearest = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    apart = np.bitwise_count(codes.code(queries, True)[:, None] ^ codes.code(sample * most, False)[nearest])
    codes.radius = int(np.quantile(apart, REACH, method="higher"))
    return codes


class SubstringIndex:
    """The codes of a block, indexed by each of their substrings.

    A code within radius r of a query has a substring within r // SUBSTRINGS of the query's
    (else every substring would be further, and the sum above r), so probing the values
    around the query's substrings meets every such code.
    """

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        edges = np.linspace(0, bits, min(SUBSTRINGS, bits) + 1).astype(int)
        self.parts = [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]
        self.order, self.first, self.values = [], [], []
        for at, width in self.parts:
            value = self.value(codes, at, width)
            self.values.append(value.astype(np.uint16) if width <= 16 else value)
            self.order.append(np.argsort(value, kind="stable"))
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))]))
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def value(codes, at: int, width: int):
        return (codes >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)

    def masks(self, width: int, within: int) -> np.ndarray:
        if (width, within) not in self._masks:
            self._masks[width, within] = np.array([sum(1 << b for b in bits) for n in range(min(within, width) + 1) for bits in combinations(range(width), n)], np.int64)
        return self._masks[width, within]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from code in radius bits at most, ascending.

        A ball of few probes visits its buckets; a ball of many marks them, and each row looks its own up.
        """
        hit = np.zeros(len(self.codes), bool)
        for (at, width), order, first, values in zip(self.parts, self.order, self.first, self.values):
            probes = int(self.value(code, at, width)) ^ self.masks(width, radius // len(self.parts))
            if 8 * len(probes) > len(hit):
                marked = np.zeros(1 << width, bool)
                marked[probes] = True
                hit |= marked[values]
                continue
            begin, n = first[probes], first[probes + 1] - first[probes]
            full = n > 0
            begin, n = begin[full], n[full]
            ends = np.cumsum(n)
            if len(ends):
                hit[order[np.repeat(begin - ends + n, n) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by inner product.

    Queries are the rows of vectors(vec_id, embedding) whose vec_id is divisible by every;
    candidates are all rows of other vec_ids. Codes are fitted on a sample of FIT_ROWS rows
    (by hash); every row is coded and indexed. Rows are dealt into blocks of about DATA_BLOCK.
    A task sorts a block before the queries, indexes it once by substrings and streams all
    queries through it; what lies within the radius, and nothing else, is scored, in double
    precision on the original vectors, and the radius widens where a block finds fewer than k. Each block
    passes on its k best, so candidates never pile up, whatever many rows lie near a query.

    Null, zero, non-finite vectors, those with null components, null vec_ids and vectors
    whose length isn't the most frequent one take no part. Equal scores: the smaller
    vec_id. Sums beyond the range of a double are infinite and order as such; one that is no
    number comes last. Fewer candidates than k: all. Repeated vec_ids: each row is
    a candidate once, and the rows of a query's vec_id ask together: a candidate's score is
    the best it has with any of them. No rows: none out. Other columns are ignored.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("x", lambda v: v != 0)
    fit = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).filter(F.col("vec_id").isNotNull() & sound).withColumn("d", F.size("x"))
    sizes = fit.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # codes are made of scaled vectors, whose squares don't overflow
    fit = fit.filter(F.col("d") == sizes["d"]).drop("d")
    place = F.xxhash64("vec_id")
    chosen = fit.filter(F.pmod(place, F.lit(1 << 30)) <= int((1 << 30) * min(1.0, FIT_ROWS / sizes["n"])))
    rows = sorted((r["vec_id"], r["x"]) for r in chosen.limit(2 * FIT_ROWS).collect() or fit.limit(1).collect())
    sample = np.array([x for _, x in rows]) / sizes["most"]
    norm = fit.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / sizes["most"]) * (v / sizes["most"])))).first()[0]
    codes = fit_codes(sample, sizes["most"], float(np.sqrt(norm)), sizes["n"], k)
    blocks = max(1, -(-sizes["n"] // DATA_BLOCK))

    def coded(batches):
        common.forget()
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("x"))
                ids = batch.column("vec_id").to_numpy()
                code = codes.code(rows, False)
                asked = ids % every == 0
                query = np.zeros(len(ids), np.uint64)
                query[asked] = codes.code(rows[asked], True)
                yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(code.view(np.int64)), pa.array(query.view(np.int64))], ["vec_id", "x", "code", "query_code"])

    index = fit.mapInArrow(coded, "vec_id long, x array<double>, code long, query_code long")
    index = common.staged(index.withColumn("row", F.monotonically_increasing_id()), "codes")

    def side(kind: int, block: Column, code: str) -> list[Column]:
        return [block.alias("block"), F.lit(kind).alias("kind"), F.col("vec_id"), F.col("row"), F.col("x"), F.col(code).alias("code")]

    data = index.select(*side(0, F.pmod(place, F.lit(blocks)).cast("int"), "code"))
    queries = index.filter(F.col("vec_id") % every == 0).select(*side(1, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "query_code"))

    def search(batches):
        """Rows of a block, by kind and vec_id: first its data, then all queries."""
        at, table, ids, places, rows = None, None, [], [], []
        for batch in batches:
            block, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if block[a] != at:
                    at, table, ids, places, rows, held = block[a], None, [], [], [], []
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    places.append(part.column("row").to_numpy())
                    rows.append(_matrix(part.column("x")))
                    held.append(part.column("code").to_numpy().view(np.uint64))
                elif ids:
                    if table is None:
                        ids, places, rows = ([np.concatenate(v)] for v in (ids, places, rows))
                        table = SubstringIndex(np.concatenate(held), codes.bits)
                    for c in range(0, part.num_rows, QUERIES):
                        yield _found(part.slice(c, QUERIES), ids[0], places[0], rows[0], table, codes, k)

    met = data.unionByName(queries).repartition(max(blocks, common.partitions(vectors)), "block").sortWithinPartitions("block", "kind", "vec_id")
    found = met.mapInArrow(search, "query_id long, vec_id long, row long, score double")
    # of a candidate that several rows of a query found, the best; a score that is no number is the least
    found = found.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max(F.struct((~F.isnan("score")).alias("number"), "score")).alias("best")).select("query_id", "vec_id", "best.score")
    number = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc(number), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(asked: pa.RecordBatch, ids: np.ndarray, places: np.ndarray, rows: np.ndarray, table: SubstringIndex, codes: Codes, k: int) -> pa.RecordBatch:
    """(query_id, vec_id, row, score): the k best rows of a block for each query, of those within its radius."""
    got_q, got_v, got_p, got_s = [], [], [], []
    queries = _matrix(asked.column("x"))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = (np.abs(rows).max(axis=0) @ np.abs(queries).T) * 1e-12  # over what the order of a sum can change
        for j, (q, x, code) in enumerate(zip(asked.column("vec_id").to_numpy(), queries, asked.column("code").to_numpy().view(np.uint64))):
            radius = codes.radius
            while True:
                near = table.within(code, radius)
                near = near[ids[near] != q]
                if len(near) >= k or radius >= codes.bits:
                    break
                radius = min(codes.bits, radius + 4)
            mine = rows[near]
            about = mine @ x
            if len(near) > k and np.isfinite(about).all() and np.isfinite(bound[j]):
                best = about >= np.partition(about, len(about) - k)[len(about) - k] - 2 * bound[j]
                near, mine = near[best], mine[best]
            score = (mine * x).sum(axis=1)
            best = np.lexsort((ids[near], -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.isnan(score)))[:k]
            got_q.append(np.full(len(best), q))
            got_v.append(ids[near[best]])
            got_p.append(places[near[best]])
            got_s.append(score[best])
    return pa.record_batch([pa.array(np.concatenate(got_q), pa.int64()), pa.array(np.concatenate(got_v), pa.int64()), pa.array(np.concatenate(got_p), pa.int64()), pa.array(np.concatenate(got_s), pa.float64())], ["query_id", "vec_id", "row", "score"])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
