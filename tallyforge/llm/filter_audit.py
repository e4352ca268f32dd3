"""Filter interaction audit: what each filter takes in every order, from the edges of the subset lattice."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.common import GAP, let

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
#: Counts of a lattice edge and of a step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bits(flags: list[Column]) -> Column:
    """The flags as one number, the first in the lowest bit."""
    return sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags[1:], 1)), F.when(flags[0], 1).otherwise(0))


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: too short, too repetitive, too many capitals, symbols."""
    def judged(words: Column) -> Column:
        n = F.size(words)
        few = (F.size(F.array_distinct(words)).cast("long") * 100) < n.cast("long") * LEAST_DISTINCT
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        return _bits([n < LEAST_WORDS, few, capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS, F.rlike(text, F.lit(SYMBOLS))])

    return let(F.array_remove(F.split(text, GAP), ""), judged)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents, and labelled ones, of each part and set of failed filters.

    docs has doc_id, text, source; labels has doc_id, quality, toxic. Texts are compared by
    their SHA-256. Nothing but facts of fixed width is shuffled. Rows are merged by document
    before they meet the labels and by part before they meet their text's first document, so
    neither a doc_id nor a text that a third of all rows share is a hot key; the number of rows
    of one text that meet is bounded by the parts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # rows without a doc_id have no label; their text's digest spreads them
    facts = facts.groupBy("doc_id", "part", "fails", "digest").agg(F.count(F.lit(1)).alias("n")).withColumns({"no_id": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.xxhash64("digest", "part"))})
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = facts.join(known.withColumn("no_id", F.lit(False)), ["key", "no_id"], "left")
    # a part's documents of a text that are alike in their labels; of these the one with the least doc_id, which may be several rows
    alike = labelled.groupBy("digest", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.first("fails").alias("fails"), F.sum("n").alias("n"), F.min("doc_id").alias("first_id"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id")
    )
    alike = common.staged(alike, "texts-by-part")
    first = alike.groupBy("digest").agg(F.min("first_id").alias("least_id"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    met = alike.join(first.hint("merge"), "digest", "left")
    # rows without an id are neither before nor after any
    own = F.when(F.col("least_id").isNull(), F.col("n")).otherwise(F.col("n_no_id") + F.when(F.col("first_id") == F.col("least_id"), F.col("n_first")).otherwise(0))
    split = F.array(F.struct(F.col("fails"), own.alias("n")), F.struct((F.col("fails") + (1 << FILTERS.index("E"))).alias("fails"), (F.col("n") - own).alias("n")))
    each = met.select("part", "good", "toxic", F.explode(split).alias("x")).filter("x.n > 0")
    return each.groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def edges(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, applied, filter, COUNTS): the lattice's edges, from counted(part, fails, n, good, toxic).

    An edge leads from a subset of already applied filters (bits) to the one that goes next:
    80 edges for five filters. A part has at most 2 ** filters rows in counted, whatever its
    documents, and each contributes to every edge once.
    """
    pairs = [(s, f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    each = counted.withColumn("edge", F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in pairs)))).select("*", "edge.*")
    bit = F.element_at(F.array(*(F.lit(1 << f) for f in range(filters))), F.col("filter") + 1)
    gone = F.col("fails").bitwiseAND(F.col("applied")) != 0
    fails = F.col("fails").bitwiseAND(bit) != 0
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0))
    return each.groupBy("part", "applied", "filter").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("fails") == bit).alias("unique_fails"), total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost")
    )


def steps(spark: SparkSession, names: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, filter): every permutation of names as a path of edges."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        for i, f in enumerate(order):
            rows.append(("".join(names[k] for k in order), i + 1, sum(1 << k for k in order[:i]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def paths(lattice: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley) of all orders, from edges().

    shapley: what the step's filter removes, summed over all orders. An edge lies on
    |applied|! * (rest)! of them. The steps' table is as large as the number of filters makes
    it (600 rows for five), so it is broadcast.
    """
    n = len(names)
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n))), F.bit_count("applied") + 1)
    shares = lattice.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    return lattice.join(shares, ["part", "filter"]).join(F.broadcast(steps(lattice.sparkSession, names)), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters A to E and step of it: part, filter_order, step, COUNTS, shapley.

    A document fails A with fewer than LEAST_WORDS words, B if less than LEAST_DISTINCT % of
    its words are distinct, C if more than MOST_CAPITALS % of its code points are A-Z, D if it
    holds one of SYMBOLS, E if a smaller doc_id has the same text. A part is a source.

    Null or empty text: no words, so it fails A alone, and E after the first of them. Null
    source: the part named by the empty string. Null doc_id: neither smaller nor larger than
    any, so it never fails E, nor does another because of it; it has no label. Repeated rows
    and doc_ids: each row counts; rows that share the smallest doc_id of their text all pass E.
    Repeated labels: one that says 1 decides. Labels of unknown documents and null labels count
    for nothing. No documents: no rows. Other columns are ignored.
    """
    lattice = common.staged(edges(cells(docs, labels)), "lattice-edges")
    return paths(lattice)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM d LEFT JOIN l USING (doc_id)),
    n(i) AS (SELECT unnest(range(5))),
    o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS p FROM n a, n b, n c, n e, n g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
    s AS (SELECT array_to_string(list_transform(p, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, step, p[step] AS k, (1 << p[step])::INT AS own, list_sum(list_transform(p[:step - 1], lambda x: 1 << x))::INT AS applied
        FROM o, range(1, 6) t(step)),
    q AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    r AS (SELECT part, filter_order, step::INT AS step, k,
        coalesce(sum(n) FILTER (fails & coalesce(applied, 0) = 0 AND fails & own = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & coalesce(applied, 0) = 0 AND fails & own > 0), 0) AS removed,
        coalesce(sum(n) FILTER (fails & coalesce(applied, 0) > 0 AND fails & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (fails & coalesce(applied, 0) = 0 AND fails & own > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & coalesce(applied, 0) = 0 AND fails & own > 0), 0) AS toxic_lost
        FROM q, s GROUP BY ALL)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
"""
