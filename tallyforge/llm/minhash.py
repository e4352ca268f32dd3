"""Near-duplicate groups by SuperMinHash, banding, full verification and union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common

#: Words of a shingle: by the contract of op10, and for documents of the pipeline.
SHINGLE, STAGE_SHINGLE = 4, 5
THRESHOLD = 80
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree on fewer than this many of SLOTS values are not verified: at a
#: similarity of 0.8 the expected number is 77 with a deviation of 3.9, so 53 is 6 deviations off.
LEAST_AGREED = 53
STAR_ROUNDS = 2
#: Members of a bucket, and shingles of theirs, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
#: Members of a bucket that meet its leader in one place; the rest of a large bucket meets copies of it.
SPLIT = 2000
#: Bytes of texts that a worker signs at once, and bytes of a text whose words are hashed at once.
BATCH, STRETCH = 500_000, 500_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _STEP)])
    return _powers[:n]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word in the bytes of a text, A-Z lower-cased.

    A word's hash is a polynomial over random byte values, taken for all words at once from
    running sums and mixed with the length afterwards. Long data is taken in stretches of
    whole words, so that what is needed for each byte at once stays small.
    """
    found, at = [], 0
    while at < len(data):
        end = at + STRETCH
        while end < len(data) and not _IS_GAP[data[end]]:
            after = np.flatnonzero(_IS_GAP[data[end : end + STRETCH]])
            end += int(after[0]) if len(after) else STRETCH
        start, h = _stretch(data[at:end])
        found.append((start + at, h))
        at = end
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _stretch(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[data]
    word = ~_IS_GAP[low]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    size = end - start
    # each byte is weighted by its place in its word, so that equal words give equal sums
    inside = np.flatnonzero(word)
    first = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(first, size)
    sums = np.add.reduceat(_BYTE[low[inside]] * _power(int(size.max()))[place], first)
    return start, _mix(_mix(sums) + size.astype(np.uint64) * _MUL[0])


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their numbers."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # a gap after each text keeps its last word from running into the next
    spaced = np.full(len(data) + len(texts), 32, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        spaced[a + i : b + i] = data[a:b]
    start, h = _words(spaced)
    begins = offsets[:-1] + np.arange(len(texts))
    n_words = np.diff(np.append(np.searchsorted(start, begins), len(start)))
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = (np.cumsum(n_words) - n_words)[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    held = n_words[doc]
    s = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for k in range(width):
        s = _mix(s + np.where(k < held, padded[at + k], _U(k + 1)) * _MUL[k % 4] + _U(k + 1))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(texts))


def super_minhash(shingles: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures: one row of slots values for each non-empty set (empty: the maximum).

    Element d walks a random permutation p of the slots: in step j it offers j + r, r
    random in [0, 1), to slot p[j]. A slot keeps the least offer. Once step j exceeds all of a
    set's slots no offer can lower any, so the set stops: large sets need a step or two.
    All elements of all sets go through a step at once; only unfinished sets go on. A value
    is j in the upper 8 bits and r in the lower 24.
    """
    n = len(counts)
    out = np.full((n, slots), 0xFFFFFFFF, np.uint32)
    live = np.arange(len(shingles))
    owner = np.repeat(np.arange(n), counts)
    perm: np.ndarray | None = None
    for j in range(slots):
        d = shingles[live]
        x = _mix(d + _U((j + 1) * int(_MUL[1]) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (x >> _U(40)) % _U(slots - j)).astype(np.int64)
        offer = (_U(j) << _U(24) | (x & _U(0xFFFFFF))).astype(np.uint32)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(live))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out.reshape(-1), owner[live] * slots + slot, offer)
        open_sets = (out.max(axis=1) >> 24) > j
        going = open_sets[owner[live]]
        if not going.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8), (int(going.sum()), 1))
            kept = k[going]
            perm[np.arange(len(kept)), kept] = 0  # what step 0 swapped away
        elif not going.all():
            perm = perm[going]
        live = live[going]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        h = _mix(h + signatures.reshape(-1, bands, rows)[:, :, r].astype(np.uint64) * _MUL[r % 4] + _U(r + 1))
    return _mix(h + np.arange(bands, dtype=np.uint64) * _MUL[3])


def _parts(batch: pa.RecordBatch):
    from tallyforge.llm import tokens

    return tokens.batches(batch, limit=BATCH)


def _sets_of(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    return shingle_sets(pc.fill_null(part.column("text"), "").cast(pa.string()), width)


def _digests(sets: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    data = memoryview(sets.astype("<u8").tobytes())
    ends = np.cumsum(counts) * 8
    return [hashlib.blake2b(data[e - 8 * n : e], digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist())]


def signed(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, hash, n_shingles, digest, signature, short, bands) of docs(doc_id, text), by shingles of width words.

    hash tells texts apart, digest shingle sets; short holds the lowest byte of each value of the signature.
    """
    def sign(batches):
        common.forget()
        for batch in batches:
            for part in _parts(batch):
                sets, counts = _sets_of(part, width)
                s = super_minhash(sets, counts)
                keys = band_keys(s).astype(np.int64)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("hash"), pa.array(counts.astype(np.int64)), pa.array(_digests(sets, counts), pa.binary()), pa.array([r.tobytes() for r in s.astype("<u4")], pa.binary()), pa.array([r.tobytes() for r in s.astype(np.uint8)], pa.binary()), bands],
                    ["doc_id", "hash", "n_shingles", "digest", "signature", "short", "bands"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    return texts.select("doc_id", "hash", "text").mapInArrow(sign, "doc_id long, hash long, n_shingles long, digest binary, signature binary, short binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): union-find over edges(a, b) by alternating large-star and small-star.

    Each round points the neighbours of a node at the least one, larger ones first, then
    smaller ones, until nothing changes; every node ends at the least node it reaches. A
    round is two aggregations with partial minima and joins on the node, so a hub's links
    never meet in one place. Rounds grow with the logarithm of the longest path.
    """
    spark, since = edges.sparkSession, common.mark()
    links = common.staged(edges.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        links = common.staged(small.filter("a <> b").distinct(), "links")
        common.clear(spark, since, links)
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Groups docs(doc_id, text) by chains of shingle-set similarity of at least THRESHOLD %.

    A shingle is width words.

    Returns one row for each row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id reachable, itself included), kept (doc_id = component_id).

    Equal sets form a class; classes, not copies, are compared. A class's signature puts it
    into BANDS buckets. Within a bucket classes are first compared with one of them, the
    choice changing by round, which joins most of a group. What is left in different
    components is compared in blocks of at most BLOCK x BLOCK members, inside a task that
    keeps its own union-find, compares likely pairs first, skips those already joined and
    hands on only the links that join components. So no link between components is lost
    and pairs are never rows. Every link is confirmed on the full sets. A pair at 80 %
    shares no bucket with a probability of 3e-6.

    Null or empty text, or one without words: an empty set, linked with nothing. Null
    doc_id: component_id null, kept false; a text that only such rows hold links nothing.
    Repeated doc_ids: each row belongs to its own text's group. No rows: none
    out. Other columns are ignored.
    """
    rows, found = _grouped(docs, width)
    joined = rows.select("doc_id", "n_shingles", "digest").join(found.select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _grouped(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows of docs, and (digest, root, component_id) of the classes of groups."""
    common.ship(docs.sparkSession)
    rows = common.staged(signed(docs, width), "signed")
    since = common.mark()
    found = common.staged(classes(rows, docs, width), "grouped")
    common.clear(docs.sparkSession, since, found)
    return rows, found


def classes(rows: DataFrame, docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(digest, root, component_id) of every class that holds several rows or links to another class."""
    grouped = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct("n_shingles", "signature", "short", "bands")).alias("any"))
    held = common.staged(grouped.select("digest", "first_id", "n", "any.*"), "classes")
    places = held.select("digest", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1")
    members = common.staged(places.join(shared, "bucket"), "members")
    involved = members.select("digest").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    sets = common.staged(class_sets(texts, rows, involved, width), "sets")
    signatures = held.select("digest", "signature", "short")

    roots: DataFrame | None = None
    for turn in range(STAR_ROUNDS):
        open_members = members if roots is None else unsettled(members, roots)
        roots = contracted(common.staged(verified(stars(open_members, turn), signatures, sets), "verified"), roots)
    roots = contracted(common.staged(swept(unsettled(members, roots), signatures, sets), "swept"), roots)
    labelled = held.select("digest", "first_id", "n").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("members")).filter("members > 1")
    return labelled.join(least, "root").select("digest", "root", "component_id")


def contracted(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) under new links(a, b): what is joined already stands as one link from each node to its root."""
    if roots is None:
        return components(links)
    if links.isEmpty():
        return roots
    return components(links.union(roots.select("node", "root")))


def beside_buckets(members: DataFrame, ofs: DataFrame) -> DataFrame:
    """members joined with ofs(bucket, ...), one row for each of their buckets.

    A bucket of more than SPLIT members (in_bucket) is spread over as many keys as it needs,
    and its row of ofs is copied to each, so no bucket meets in one place.
    """
    parts = F.ceil(F.col("in_bucket") / SPLIT).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("digest", F.lit(7)), parts).cast("int"))
    return dealt.join(ofs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("in_bucket"), ["bucket", "part"]).drop("part")


def class_sets(texts: DataFrame, rows: DataFrame, involved: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(digest, n, shingles) of the involved classes, from one row's text each."""
    one = rows.join(involved, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))

    def gather(batches):
        common.forget()
        for batch in batches:
            for part in _parts(batch):
                sets, counts = _sets_of(part, width)
                data, ends = memoryview(sets.astype("<u8").tobytes()), np.cumsum(counts) * 8
                shingles = [data[e - 8 * n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.record_batch([pa.array(_digests(sets, counts), pa.binary()), pa.array(counts.astype(np.int64)), pa.array([bytes(x) for x in shingles], pa.binary())], ["digest", "n", "shingles"])

    picked = texts.join(one.select("doc_id"), "doc_id", "left_semi").select("text")
    return picked.mapInArrow(gather, "digest binary, n long, shingles binary").join(involved, "digest", "left_semi").dropDuplicates(["digest"])


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their root, of the buckets that hold several components."""
    rooted = members.select("digest", "size", "bucket", "in_bucket").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    mixed = rooted.groupBy("bucket").agg(F.max("in_bucket").alias("in_bucket"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket", "in_bucket")
    return common.staged(beside_buckets(rooted, mixed), "unsettled")


def stars(members: DataFrame, turn: int) -> DataFrame:
    """Each member with its bucket's leader; the leader is another one each turn."""
    rank = F.xxhash64("digest", F.lit(turn)) if turn == 0 else F.xxhash64("digest", "bucket", F.lit(turn))
    own = members if "root" in members.columns else members.withColumn("root", F.col("digest"))
    first = F.min(F.struct(rank.alias("rank"), F.col("digest").alias("leader"), F.col("root").alias("leader_root"))).alias("x")
    leaders = own.groupBy("bucket").agg(F.max("in_bucket").alias("in_bucket"), first).select("bucket", "in_bucket", "x.leader", "x.leader_root")
    met = beside_buckets(own, leaders).filter("root <> leader_root")
    return met.select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct()


def blocked(members: DataFrame) -> DataFrame:
    """Members of buckets of three or more, once for each block of their bucket that they meet.

    (In a bucket of two the star has compared the only pair.) Blocks are bounded in members
    and in shingles.
    """
    sizes = members.groupBy("bucket").agg(F.max("in_bucket").alias("in_bucket"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).filter("n > 2")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sized = beside_buckets(members, sizes.select("bucket", "in_bucket", blocks.alias("blocks")))
    placed = sized.withColumn("own", F.pmod(F.xxhash64("digest", "bucket"), F.col("blocks")).cast("int"))
    met = placed.select("digest", "root", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("digest", "root", "bucket", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _close(signatures: np.ndarray, roots: np.ndarray, own: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows after i that may link with row i across components, likeliest first, and their agreement."""
    across = own[i] != own[i + 1 :] if own[0] != own[-1] else np.ones(len(own) - i - 1, bool)
    agreed = (signatures[i + 1 :] == signatures[i]).sum(axis=1)
    rows = np.flatnonzero(across & (roots[i + 1 :] != roots[i]) & (agreed >= LEAST_AGREED))
    return rows + i + 1, agreed[rows]


def _block(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    table = table.sort_by([("own", "ascending"), ("digest", "ascending")])
    signatures = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, SLOTS)
    _, roots = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)
    return table, signatures, roots, table.column("own").to_numpy()


def swept(members: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Links(a, b) that join components within a bucket; of pairs already joined none are handed on.

    First signatures alone tell which members have a likely partner in another component;
    only their full sets travel.
    """
    def likely(table: pa.Table) -> pa.Table:
        table, signature, roots, own = _block(table)
        hit = np.zeros(len(roots), bool)
        for i in range(len(roots) - 1):
            rows, _ = _close(signature, roots, own, i)
            hit[rows] = True
            hit[i] |= len(rows) > 0
        return table.filter(pa.array(hit)).select(["digest", "root", "bucket", "own", "lo", "hi", "short"])

    def link(table: pa.Table) -> pa.Table:
        table, signature, roots, own = _block(table)
        digests = table.column("digest").to_pylist()
        values = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        size = np.array([len(v) for v in values])
        names, local = np.unique(np.concatenate(values), return_inverse=True)
        end = np.cumsum(size)
        parent = np.arange(len(digests))
        found = []

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        first_of: dict[int, int] = {}
        for i, r in enumerate(roots.tolist()):
            parent[i] = first_of.setdefault(r, i)
        mark = np.zeros(len(names), bool)
        for i in range(len(digests) - 1):
            rows, agreed = _close(signature, roots, own, i)
            rows = rows[np.argsort(-agreed, kind="stable")]
            if not len(rows):
                continue
            own_values = local[end[i] - size[i] : end[i]]
            mark[own_values] = True
            for j in rows.tolist():
                if top(i) != top(j):
                    shared = int(mark[local[end[j] - size[j] : end[j]]].sum())
                    if 100 * shared >= THRESHOLD * (size[i] + size[j] - shared):
                        parent[top(j)] = top(i)
                        found.append((min(digests[i], digests[j]), max(digests[i], digests[j])))
            mark[own_values] = False
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    brief = signatures.join(members.select("digest").distinct(), "digest", "left_semi").select("digest", "short")
    key = ("bucket", "lo", "hi")
    schema = "digest binary, root binary, bucket long, own int, lo int, hi int, short binary"
    near = blocked(members).join(brief, "digest").groupBy(*key).applyInArrow(likely, schema)
    return near.join(sets.select("digest", "shingles"), "digest").groupBy(*key).applyInArrow(link, "a binary, b binary")


def verified(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) those with 100 * shared >= THRESHOLD * united on the full sets."""
    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SLOTS) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_AGREED))

    def compare(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= THRESHOLD * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def beside(p: DataFrame, values: DataFrame, value: str) -> DataFrame:
        one = p.join(values.select(F.col("digest").alias("a"), F.col(value).alias("x")), "a")
        return one.join(values.select(F.col("digest").alias("b"), F.col(value).alias("y")), "b")

    judged = common.staged(beside(pairs, signatures, "signature").select("a", "b", "x", "y").mapInArrow(agree, "a binary, b binary"), "judged")
    near = beside(judged, sets.select("digest", "n"), "n").filter(100 * F.least("x", "y") >= THRESHOLD * F.greatest("x", "y")).select("a", "b")
    return beside(near, sets, "shingles").select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")


def op10_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, width: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of docs that stay: one of each group; other columns as they are.

    The row with the smallest doc_id stays (a null one last); of rows alike in doc_id the one
    that comes first by its shingles' digest, then its text's hash; of rows alike in doc_id
    and text any one. So rows that share a doc_id but not the group are judged apart, and
    repeated rows count as copies, with or without a doc_id. Null, empty and wordless texts
    belong to no group and stay. No rows: none out.
    """
    since = common.mark()
    rows, found = _grouped(docs.select("doc_id", "text"), width)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("digest").alias("d"), F.col("hash").alias("h"))
    best = rows.join(found.select("digest", "root"), "digest").groupBy("root").agg(F.min(order).alias("best"))
    grouped = rows.join(found.select("digest", "root"), "digest").join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.d")) & (F.col("hash") == F.col("best.h"))
    judged = common.staged(grouped.groupBy("doc_id", "hash").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("copies")), "judged")
    common.clear(docs.sparkSession, since, judged)

    def met(verdicts: DataFrame, how: str) -> DataFrame:
        v = verdicts.select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h"))
        return docs.join(v, docs["doc_id"].cast("long").eqNullSafe(v["_d"]) & (F.xxhash64(docs["text"].cast("string")) == v["_h"]), how)

    kept = met(judged.filter("NOT stays OR copies > 1"), "left_anti")
    repeated = judged.filter("stays AND copies > 1")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(met(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


ORACLE_SQL = None
