"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common, minhash, tokens

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 20
#: Fingerprints under a trie node that one task walks with those of another; levels that Spark descends at once.
BLOCK, STRIDE = 1 << 14, 4
#: In a task: node pairs that are walked together, and pairs of fingerprints under a node pair that are compared outright.
FRONTIER, OUTRIGHT = 1 << 17, 48

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """SimHash of a text's bytes: a bit is 1 if more than half of the shingles' XXH64 have it set; without words zero."""
    ones, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        gap = _GAP.search(data, at + STRETCH)
        end = gap.start() if gap else len(data)
        # bytes.lower() changes A-Z alone, and bytes.split() cuts at the six gaps alone
        words = carry + data[at:end].lower().split()
        at = end
        if len(words) < width:
            carry = words
            continue
        text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-width].tolist()]
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
        ones += _ones(hashes)
        n += len(hashes)
        carry = words[len(words) - width + 1 :]
    if not n:
        return digest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, print) of docs(doc_id, text); print is the fingerprint as a signed long. Null text: zero."""
    def made(batches):
        common.forget()
        for batch in batches:
            for part in tokens.batches(batch):
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                yield pa.record_batch([part.column("doc_id"), pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))], ["doc_id", "print"])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, print long")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("print", 64 - depth) if depth else F.lit(0).cast("long")


def block_pairs(prints: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs of trie nodes (depth, a, b, diff) that cover all pairs of prints within budget, and the nodes' (depth, node, prints).

    The trie of prints(print) is walked from the pair of its root with itself, STRIDE levels a
    round. A pair of nodes carries the bits in which its paths differ and goes no further once
    they exceed the budget. It is done when both nodes hold at most block fingerprints; others
    descend. So blocks are bounded however fingerprints cluster, and a node meets only those
    nodes of its depth that differ in few bits.
    """
    since = common.mark()
    spark = prints.sparkSession
    root = prints.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("diff"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    depth, reached, found = 0, common.staged(root, "node-pairs"), []
    small = (F.col("n_a") <= block) & (F.col("n_b") <= block)
    while True:
        found.append(reached.filter(small).select(F.lit(depth).alias("depth"), "a", "b", "diff"))
        large = reached.filter(~small)
        if large.isEmpty():
            break
        depth += STRIDE
        parents = large.select(F.col("a").alias("parent")).union(large.select("b")).distinct()
        kids = prints.groupBy(_prefix(depth).alias("kid")).agg(F.count(F.lit(1)).alias("n")).withColumn("parent", F.shiftrightunsigned("kid", STRIDE)).join(parents, "parent", "left_semi")
        kids = common.staged(kids, "trie-nodes")
        first, second = (kids.select(F.col("parent").alias(c), F.col("kid").alias(f"kid_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
        met = large.select("a", "b", "diff").join(first, "a").join(second, "b").filter("a <> b OR kid_a <= kid_b")
        diff = F.col("diff") + F.bit_count(F.col("kid_a").bitwiseXOR(F.col("kid_b"))) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        reached = common.staged(met.select(F.col("kid_a").alias("a"), F.col("kid_b").alias("b"), diff.alias("diff"), "n_a", "n_b").filter(F.col("diff") <= budget), "node-pairs")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = common.staged(pairs, "block-pairs")
    used = pairs.select("depth", F.col("a").alias("node")).union(pairs.select("depth", "b")).distinct()
    own = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("node")) for d in range(0, depth + 1, STRIDE)))
    held = prints.select("print", F.explode(own).alias("x")).select("print", "x.*").join(used, ["depth", "node"], "left_semi")
    blocks = common.staged(held.groupBy("depth", "node").agg(F.collect_list("print").alias("prints")), "trie-blocks")
    common.clear(spark, since, pairs, blocks)
    return pairs, blocks


class _Trie:
    """Sorted fingerprints as a binary trie: a node is a range of them, and a running sum of a bit tells where it parts."""

    def __init__(self, prints: np.ndarray):
        self.prints = np.sort(prints)
        self._ones: dict[int, np.ndarray] = {}

    def middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in self._ones:
            bit = (self.prints >> np.uint64(63 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        ones = self._ones[depth]
        return hi - (ones[hi] - ones[lo])


def close(first: _Trie, second: _Trie, depth: int, diff: int, budget: int = BUDGET):
    """Yields index arrays (i, j) of all fingerprints within budget bits, under two nodes of one depth; i < j where both are one.

    Pairs of nodes are walked together, level by level; the frontier is cut into pieces that
    are walked one after the other, so what is held grows with the depth alone.
    """
    same = first is second
    whole = lambda n: np.array([n])
    todo = [(depth, whole(0), whole(len(first.prints)), whole(0), whole(len(second.prints)), np.array([diff], np.int8))]
    while todo:
        depth, a0, a1, b0, b1, d = todo.pop()
        if len(d) > FRONTIER:
            for at in range(0, len(d), FRONTIER):
                todo.append((depth, *(x[at : at + FRONTIER] for x in (a0, a1, b0, b1, d))))
            continue
        few = (a1 - a0) * (b1 - b0) <= OUTRIGHT if depth < 64 else np.ones(len(d), bool)
        if few.any():
            i, j = _outright(first.prints, second.prints, a0[few], a1[few], b0[few], b1[few], budget)
            ordered = i < j if same else slice(None)
            yield i[ordered], j[ordered]
        if few.all():
            continue
        a0, a1, b0, b1, d = (x[~few] for x in (a0, a1, b0, b1, d))
        am, bm = first.middle(a0, a1, depth), second.middle(b0, b1, depth)
        both = np.concatenate
        grown = [both(x) for x in ((a0, am, a0, am), (am, a1, am, a1), (b0, bm, bm, b0), (bm, b1, b1, bm), (d, d, d + 1, d + 1))]
        keep = (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)
        if same:  # of a node's two crossings with itself one is enough
            keep &= grown[0] <= grown[2]
        if keep.any():
            todo.append((depth + 1, *(x[keep] for x in grown)))


def _outright(first, second, a0, a1, b0, b1, budget) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within budget of each pair of ranges."""
    size = a1 - a0
    of = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(of)) + (a0 - np.cumsum(size) + size)[of]
    wide = (b1 - b0)[of]
    begin = np.cumsum(wide) - wide
    j = np.arange(int(wide.sum())) + np.repeat(b0[of] - begin, wide)
    near = np.flatnonzero(np.bitwise_count(np.repeat(first[i], wide) ^ second[j]) <= budget)
    return i[np.searchsorted(begin + wide, near, "right")], j[near]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union-find on whole arrays: label holds each one's least known companion."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def links(prints: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of prints(print) within budget bits.

    A task walks a pair of blocks and hands on one edge for each fingerprint it joined, never
    the pairs themselves.
    """
    pairs, blocks = block_pairs(prints, budget, block)

    def walked(batches):
        common.forget()
        for batch in batches:
            for row in range(batch.num_rows):
                depth, a, b, diff = (batch.column(c)[row].as_py() for c in ("depth", "a", "b", "diff"))
                first, second = (_Trie(batch.column(c)[row].values.to_numpy().view(np.uint64)) for c in ("first", "second"))
                if a == b:
                    second, own = first, first.prints
                else:
                    own = np.concatenate([first.prints, second.prints])
                shift = 0 if a == b else len(first.prints)
                label = np.arange(len(own))
                for i, j in close(first, second, depth, diff, budget):
                    _joined(label, i, j + shift)
                linked = np.flatnonzero(label != np.arange(len(own)))
                yield pa.record_batch([pa.array(own[linked].view(np.int64)), pa.array(own[label[linked]].view(np.int64))], ["a", "b"])

    common.ship(prints.sparkSession)
    first, second = (blocks.select("depth", F.col("node").alias(c), F.col("prints").alias(name)) for c, name in (("a", "first"), ("b", "second")))
    met = pairs.join(first.hint("merge"), ["depth", "a"]).join(second.hint("merge"), ["depth", "b"])
    # a pair is much work for few bytes, so pairs are dealt by number
    return met.repartition(4 * common.partitions(prints), "depth", "a", "b").select("depth", "a", "b", "diff", "first", "second").mapInArrow(walked, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text).

    Words are runs without white space, A-Z lower-cased; shingles are width words joined by a
    space, repeats included; a shorter text is one shingle. Documents link whose fingerprints
    differ in at most budget bits; component_id is the smallest doc_id reachable. Equal
    fingerprints are one before any are compared.

    Null or empty text, or one without words: fingerprint zero, linked like any other. Null
    doc_id: component_id null, and a fingerprint that only such rows have links nothing.
    Repeated doc_ids: each row belongs to its own fingerprint's component. Repeated rows all
    stay. No rows: none out. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = common.staged(fingerprints(docs, width).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    since = common.mark()
    kinds = common.staged(rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("docs")), "distinct-fingerprints")
    known = kinds.filter("first_id IS NOT NULL")
    roots = minhash.components(common.staged(links(known.select("print"), budget, block), "fingerprint-links"))
    labelled = known.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    labelled = common.staged(labelled, "rooted-fingerprints")
    least = common.staged(labelled.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "components")
    grouped = common.staged(common.dealt(labelled, least, "root", "size", F.col("print")).select("print", "component_id", "docs"), "grouped-fingerprints")
    common.clear(spark, since, grouped)
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return common.dealt(rows, grouped, "print", "docs", F.col("row")).select("doc_id", shown.alias("fingerprint"), component.alias("component_id"))


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
