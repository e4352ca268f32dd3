"""Conversation prefix trie: members, leaves and savings of every shared prefix, by pointer jumping."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.common import WORD

#: Conversations whose first turns are taken from a common one, and how many turns at most are: the query's rebuilding.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that are summed in one place.
STRETCH = 1024
#: Conversation ids of a node that are written out together.
CHUNK = 1 << 14


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) with pos from 1 in the order of turn, then role, then text; null turns first.

    Rows are ranged over tasks by all of these and numbered by what the ranges before hold, so a
    conversation of any length is spread over as many tasks as its rows need.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    n = common.partitions(conversations)
    ranged = common.staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranged-turns")
    held = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = held.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "range").orderBy(*order[1:])
    return ranged.withColumn("nth", F.row_number().over(within)).join(begun, ["conv_id", "range"]).select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "role", "text")


def facts(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, words): turns by the SHA-256 of role and text, and the words of the text."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return turns.select("conv_id", "pos", key.alias("turn_key"), F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"))).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations, from facts(): (conv_id, pos, turn_key, words), and (conv_id, n) with their lengths, 0 included.

    Of conversation c the first h turns come from conversation c - c % FAMILY, all others
    from c behind its own first h; h = crc32(c) % HEADS.
    """
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    lengths = common.staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": c - c % FAMILY}), "lengths")
    bases = lengths.filter(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    sizes = lengths.join(bases, "base", "left").withColumn("taken", F.least(F.coalesce("base_n", F.lit(0)), "h"))
    sizes = common.staged(sizes.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "rebuilt-lengths")
    heads = turns.filter((F.col("pos") < HEADS) & (c % FAMILY == 0)).withColumnRenamed("conv_id", "base").join(sizes.select("conv_id", "base", "taken"), "base").filter("pos <= taken")
    # only conversations that got fewer than h turns shift their own; these are looked up by a stretch of turns, which bounds a key
    stretch = F.floor((F.col("pos") - 1) / STRETCH)
    short = sizes.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + F.col("h")) / STRETCH))).alias("stretch"))
    own = turns.filter(F.col("pos") > h).withColumn("stretch", stretch).join(short, ["conv_id", "stretch"], "left")
    rows = heads.select("conv_id", "pos", "turn_key", "words").union(own.select("conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "turn_key", "words"))
    return rows, sizes.select("conv_id", "n")


def _node(depth: Column, *sums: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", depth.cast("string"), *(s.cast("string") for s in sums)), 256), 1, 32)


ROOT = hashlib.sha256(b"0:0:0").hexdigest()[:32]


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words): of each turn the digest of all turns up to it and of all before it.

    Each turn is hashed with its place to two numbers of 60 bits; a prefix is known by their
    exact sums and its depth. So digests of all prefixes come from running sums, taken by
    stretches of STRETCH turns and placed by the sums of the stretches before.
    """
    hashed = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "turn_key"), 256)
    number = lambda at: F.conv(F.substring("x", at, 15), 16, 10).cast("decimal(20,0)")
    each = rows.withColumn("x", hashed).select("conv_id", F.col("pos").alias("depth"), "words", F.floor((F.col("pos") - 1) / STRETCH).alias("stretch"), number(1).alias("x1"), number(16).alias("x2"))
    each = common.staged(each, "hashed-turns")
    sums = each.groupBy("conv_id", "stretch").agg(*(F.sum(x).cast("decimal(38,0)").alias(f"s{x}") for x in ("x1", "x2")))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("conv_id", "stretch", *(F.coalesce(F.sum(f"s{x}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"b{x}") for x in ("x1", "x2")))
    upto = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.join(begun, ["conv_id", "stretch"]).withColumns({f"p{x}": (F.col(f"b{x}") + F.sum(x).over(upto)).cast("decimal(38,0)") for x in ("x1", "x2")})
    own, parent = (_node(F.col("depth") - k, *((F.col(f"p{x}") - k * F.col(x)).cast("decimal(38,0)") for x in ("x1", "x2"))) for k in (0, 1))
    return placed.select("conv_id", "depth", own.alias("node"), parent.alias("parent"), "words")


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends(node, conv_id): SHA-256 of the ascending ids, joined by commas.

    A hash of one text is taken in order by nature. So ids are first joined to chunks of at
    most CHUNK, by ranges of ids; then a task reads the chunks of a node in order and keeps
    nothing but the hash's state.
    """
    ids = ends.withColumn("chunk", F.floor(F.col("conv_id") / CHUNK)).groupBy("node", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    common.ship(ends.sparkSession)
    return ids.repartition(common.partitions(ends), "node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(hashed, "node string, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """nodes(node, parent, values) with each value summed over the node's subtree: (node, values).

    Pointer jumping: at first a node points at its parent and holds its own value. In each
    round it hands its sum to the node it points at and then points where that one pointed. After
    k rounds it holds the sum of all descendants nearer than 2 ** k, so the rounds grow with
    the logarithm of the depth. Sums are aggregated before they meet, and a node that a large
    share of all nodes points at is dealt over tasks.
    """
    spark, since = nodes.sparkSession, common.mark()
    now = common.staged(nodes.select("node", F.col("parent").alias("at"), *values), "pointers")
    while not now.filter("at IS NOT NULL").isEmpty():
        given = now.filter("at IS NOT NULL").groupBy(F.col("at").alias("node")).agg(*(F.sum(v).alias(f"more_{v}") for v in values), F.count(F.lit(1)).alias("fan"))
        met = now.join(given, "node", "left")
        grown = common.staged(met.select("node", "at", "fan", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values)), "grown")
        jump = grown.filter("fan > 0").select(F.col("node").alias("at"), F.col("at").alias("next"), "fan")
        jumped = common.dealt(grown.select("node", "at", *values), jump, "at", "fan", F.col("node"))
        following = common.staged(jumped.select("node", F.col("next").alias("at"), *values), "pointers")
        common.clear(spark, since, following)
        now = following
    return now.select("node", *values)


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of conversations, the empty one included.

    rows: (conv_id, pos, turn_key, words), pos from 1 without gaps; lengths: (conv_id, n) of all
    conversations, also of those without turns. Returns conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens ((n_convs - 1) * words of the last turn, summed over the subtree)
    and ends_sha256 (of the members that end here). No conversations: no rows.

    Only digests, numbers and ids are shuffled. Members are counted by partial aggregation.
    """
    spark, since = rows.sparkSession, common.mark()
    path = common.staged(prefixes(rows), "prefixes")
    grouped = path.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words")
    )
    nodes = common.staged(root.unionByName(grouped), "nodes")
    fan = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = common.staged(nodes.join(fan, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-with-children")
    own = known.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = common.staged(rolled_up(own, ("n_leaves", "saved_tokens")), "subtree-sums")
    above = known.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("fan"))
    placed = common.dealt(known, above, "parent", "fan", F.col("node"))
    last = path.select("node", "conv_id", "depth").join(lengths.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"], "left_semi").select("node", "conv_id")
    turnless = lengths.filter("n = 0").select(F.lit(ROOT).alias("node"), "conv_id")
    ends = end_digests(last.union(turnless))
    found = placed.join(sums, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
    out = common.staged(found, "prefix-trie")
    common.clear(spark, since, out)
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations(conv_id, turn, role, text) as they stand.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of
    their own. Null role or text: empty. Rows with a null conv_id belong to no conversation and are left out.
    No rows: none out. Other columns are ignored.
    """
    turns = common.staged(facts(ordered(conversations)), "turns")
    return trie(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trie() of the rebuilt conversations; nulls, ties and repeated rows as in conversation_trie()."""
    turns = common.staged(facts(ordered(common.table(spark, sf_dir, "conversations"))), "turns")
    return trie(*rebuilt(turns))


#: CRC-32 of an id's decimal digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
ORACLE_SQL = rf"""
    WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM o GROUP BY conv_id),
    h AS (SELECT *, {_CRC} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS base FROM l),
    b AS (SELECT h.conv_id, list_concat(coalesce(g.turns, [])[:h], h.turns[h + 1:]) AS turns FROM h LEFT JOIN l g ON g.conv_id = base),
    p AS (SELECT conv_id, d, turns[:d] AS node, turns[:d - 1] AS parent, len(turns) = d AS ends, turns FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
    n AS (SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ends,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(node)[d].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY d, node),
    k AS (SELECT parent, count(*) AS c FROM n WHERE d > 0 GROUP BY parent),
    m AS (SELECT n.*, coalesce(c, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.parent),
    a AS (SELECT *, unnest(range(0, d + 1)) AS up FROM m),
    s AS (SELECT up AS d, node[:up] AS node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM a GROUP BY up, node[:up])
    SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
    FROM m JOIN s ON s.d = m.d AND s.node = m.node LEFT JOIN n q ON m.d > 0 AND q.d = m.d - 1 AND q.node = m.parent
"""
