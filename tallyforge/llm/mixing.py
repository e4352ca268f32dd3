"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.common import WORD

#: Sources, in code-point order with null last, weigh these in turn.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Leading digits of a document's hash: buckets of a source, so that no source is sorted in one task.
BUCKET_DIGITS = 3
#: Rounds of refilling that the SQL writes out; the operator goes on until nothing fits.
ROUNDS = 16


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, source_size, weight) with target added.

    All sizes are shared by weight. Targets stop at max_epochs times their source's size;
    the excess is reshared by weight among the rest until none is above. Sources fill in
    ascending order of cap / weight: at level t each holds min(cap, weight * t), so the
    level follows from running sums over that order, with no loop. A source without words
    has target 0. Sources alike in cap / weight fill together.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    caps = sources.withColumns({"cap": F.lit(float(max_epochs)) * F.col("source_size")}).withColumn("fill", F.col("cap") / F.col("weight"))
    sums = caps.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "all_weight": F.sum("weight").over(everything),
            "full": F.coalesce(F.sum(F.col("source_size") * max_epochs).over(order), F.lit(0)).cast("double"),
            "light": F.coalesce(F.sum("weight").over(order), F.lit(0)),
        }
    )
    # the level that fits the total if all sources before this one are full and none from here on is
    level = (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("light"))
    reached = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    filled = sums.withColumn("level", level).withColumn("reached", reached)
    return filled.select(*sources.columns, F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("reached"), F.lit(float("inf")))).alias("target"))


def source_targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, place, target) of sized(source, size): one row for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    return water_fill(ranked.withColumn("weight", weight.cast("long")), max_epochs)


def refilled(marked: DataFrame) -> DataFrame:
    """(source, bucket, nth) of documents that fit what marked leaves of their source's rest.

    Each round takes, of the documents that fit the gap by themselves, those in the order of
    the hash until the next would pass it, as the first pass does with all documents; the
    rounds end when none fits in any source. A round holds only what still fits, and every
    round leaves a source less than the document that ended it, so few rounds are needed.
    """
    within = Window.partitionBy("source", "bucket").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    now = marked.filter((F.col("size") > 0) & (F.col("rest") > 0)).select("source", "bucket", "nth", "size", F.col("rest").alias("gap"), "in")
    taken: DataFrame | None = None
    spark, since, keep = marked.sparkSession, common.mark(), []
    while True:
        used = now.groupBy("source", "bucket").agg(F.max("gap").alias("gap"), F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("used"))
        gaps = used.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("gap") - F.sum("used").over(Window.partitionBy("source"))).alias("gap"))
        open_ = now.filter(~F.col("in")).drop("gap")
        fit = open_.join(gaps, open_["source"].eqNullSafe(gaps["s"]) & (open_["bucket"] == gaps["b"])).filter(F.col("size") <= F.col("gap")).drop("s", "b", "in")
        fit = common.staged(fit, "fitting")
        if fit.isEmpty():
            return taken if taken is not None else fit.select("source", "bucket", "nth")
        begun = fit.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("begun", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        begun = begun.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "begun")
        placed = fit.withColumn("upto", F.sum("size").over(within)).join(begun, fit["source"].eqNullSafe(begun["s"]) & (fit["bucket"] == begun["b"]))
        now = common.staged(placed.select("source", "bucket", "nth", "size", "gap", (F.col("begun") + F.col("upto") <= F.col("gap")).alias("in")), "refill")
        keep.append(now)
        common.clear(spark, since, *keep)
        new = now.filter("in").select("source", "bucket", "nth")
        taken = new if taken is None else taken.union(new)


def mix(docs: DataFrame, *carry: str, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """How often the mix takes each row of docs(doc_id, text, source).

    Returns doc_id, source, size, source_size, target, repeats and the columns carry.
    A document's size is its number of words. Its source's target is so many whole
    repetitions of the source and a fraction: every document is taken for each whole one;
    the fraction takes documents in the order of a seeded hash until the next would pass
    the target, goes on in the same way over the documents that still fit what is left, until
    none does (a long document alone doesn't end it far from the target), and then takes the
    one remaining document that comes nearest to what is left.

    A source is never gathered or sorted whole: its documents fall into 16**BUCKET_DIGITS
    buckets by hash, bucket sizes are summed first, and only a bucket's own documents are
    ordered among themselves.

    Null or empty text: size 0, taken with the whole repetitions only. Null source: a
    source of its own, last in order. Repeated rows and doc_ids: each row is taken by
    itself, alike rows in either order. Null doc_id: the text's digest stands for it in the
    hash. Empty table: no rows. One row for each source is ordered in one task; documents
    never are.
    """
    since = common.mark()
    # a generator is computed once; a projected count would be computed anew for each use
    counted = docs.select(
        F.struct("doc_id", *carry).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.explode(F.array(F.struct(F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string")), F.lit("")))).alias("hash")))).alias("x"),
    ).select("row", "source", "x.size", "x.hash")
    sized = common.staged(counted.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS)), "sizes")

    targets = common.staged(source_targets(sized, max_epochs), "targets")
    share = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    share = share.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest")

    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = buckets.withColumn("begun", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = begun.join(share, begun["source"].eqNullSafe(share["s"])).drop("s", "n")
    keys = placed.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "begun", "source_size", "target", "whole", "rest")

    within = Window.partitionBy("source", "bucket").orderBy("hash", "row.doc_id", "size")
    ordered = sized.withColumns({"upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(within)})
    reached = ordered.join(keys, ordered["source"].eqNullSafe(keys["s"]) & (ordered["bucket"] == keys["b"])).drop("s", "b").withColumn("upto", F.col("begun") + F.col("upto"))
    marked = common.staged(reached.withColumn("in", (F.col("size") > 0) & (F.col("upto") <= F.col("rest"))), "marked")

    # never a broadcast, however small the stored table is: what is taken grows with the documents
    more = refilled(marked).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("nth").alias("k")).hint("merge")
    again = marked.join(more, marked["source"].eqNullSafe(more["s"]) & (marked["bucket"] == more["b"]) & (marked["nth"] == more["k"]), "left")
    marked = common.staged(again.withColumn("in", F.col("in") | F.col("k").isNotNull()).drop("s", "b", "k"), "marked")

    gap = marked.groupBy(F.col("source").alias("s")).agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))), F.lit(0))).alias("gap"))
    left = marked.filter(~F.col("in") & (F.col("size") > 0) & (F.col("rest") > 0)).select("source", "bucket", "hash", "nth", "size")
    # by source and bucket, like all joins here: a source alone may hold most rows
    gaps = begun.join(gap, begun["source"].eqNullSafe(gap["s"])).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "gap")
    near = left.join(gaps, left["source"].eqNullSafe(gaps["s"]) & (left["bucket"] == gaps["b"])).filter(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    last = near.groupBy(F.col("source").alias("s")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "bucket", "hash", "nth")).alias("extra"))
    taken = marked.join(last, marked["source"].eqNullSafe(last["s"]) & (marked["bucket"] == last["extra.bucket"]), "left")
    is_extra = F.coalesce((F.col("bucket") == F.col("extra.bucket")) & (F.col("nth") == F.col("extra.nth")), F.lit(False))
    repeats = F.col("whole") + F.when(F.col("in") | is_extra, 1).otherwise(0)
    mixed = common.staged(taken.select("row.doc_id", "source", "size", "source_size", "target", repeats.cast("long").alias("repeats"), *(F.col("row")[c].alias(c) for c in carry)), "mixed")
    common.clear(docs.sparkSession, since, mixed)
    return mixed


def repeated(docs: DataFrame) -> DataFrame:
    """Each row of docs as often as the mix takes it, its columns as they are; rows taken no time go.

    The mix is made on sizes alone; texts move once, to meet their number of repetitions.
    Nulls, ties, repeated rows and empty tables as in mix; other columns keep their names and
    values, also where they are named like the mix's own.
    """
    key = ("doc_id", "source", "digest")
    digest = F.xxhash64(F.col("text").cast("string"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), digest.alias("digest"), F.struct(*(F.col(c) for c in docs.columns)).alias("row")).withColumn("nth", nth)
    mixed = mix(docs.select("doc_id", "text", "source", digest.alias("digest")), "digest").withColumn("nth", nth).select(*(F.col(c).alias(f"m_{c}") for c in (*key, "nth")), "repeats")
    met = rows["nth"] == mixed["m_nth"]
    for c in key:
        met = met & rows[c].eqNullSafe(mixed[f"m_{c}"])
    again = rows.join(mixed.hint("merge"), met).filter("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("k"))
    return again.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL of mix(): one row for each document; ROUNDS rounds of refilling, written out."""
    fits = "NOT inside AND size > 0 AND rest > 0 AND size <= gap"
    rounds = ",\n    ".join(
        f"""fit{k} AS (SELECT *, {fits} AND sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap AS taken FROM gp{k}),
    gp{k + 1} AS (SELECT * EXCLUDE (taken) REPLACE (inside OR taken AS inside, gap - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap) FROM fit{k})"""
        for k in range(ROUNDS)
    )
    return rf"""
    WITH sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS hash FROM {documents}),
    src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
    cap AS (SELECT source, source_size, place, [1, 2, 3][((place - 1) % 3 + 1)::INT] AS weight, {MAX_EPOCHS}.0::DOUBLE * source_size AS cap FROM src),
    run AS (SELECT *, cap / weight AS fill, (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::BIGINT AS all_weight,
        coalesce(sum(source_size * {MAX_EPOCHS}) OVER w, 0)::DOUBLE AS full_size, coalesce(sum(weight) OVER w, 0)::BIGINT AS light
        FROM cap WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lev AS (SELECT *, (total - full_size) / (all_weight - light) AS level FROM run),
    tgt AS (SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN level <= fill THEN level END) OVER (), 'infinity'::DOUBLE)) AS target FROM lev),
    shr AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM tgt),
    run2 AS (SELECT sized.*, source_size, target, whole, target - whole * source_size AS rest,
        (sum(size) OVER (PARTITION BY sized.source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, row_number() OVER (PARTITION BY sized.source ORDER BY hash, doc_id, size) AS nth
        FROM sized JOIN shr ON sized.source IS NOT DISTINCT FROM shr.source),
    mk AS (SELECT *, size > 0 AND upto <= rest AS inside FROM run2),
    gp0 AS (SELECT *, rest - sum(CASE WHEN inside THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM mk),
    {rounds},
    ex AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT inside AND size > 0 AND rest > 0 AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), hash, nth) = 1
        AND NOT inside AND size > 0 AND rest > 0 AND abs(size - gap) < gap AS extra FROM gp{ROUNDS})
    SELECT *, whole + CASE WHEN inside OR extra THEN 1 ELSE 0 END AS repeats FROM ex
    """


ORACLE_SQL = f"SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken FROM ({mix_sql()})"
