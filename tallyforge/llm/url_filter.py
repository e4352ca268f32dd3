"""URL rules by a sort-merge range join on reversed hosts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import common

RULES = "host string, path string, verdict string"
#: Rows that are looked at, about, to place range bounds; they only balance the tasks.
BOUND_SAMPLE = 4096
_LAST = chr(0x10FFFF)


def parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url; both empty without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return common.lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host):
    """Reversed labels, each followed by a dot: a host and its subdomains share this prefix."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url).

    A rule(host, path, verdict) fits its host and all subdomains if the page's path starts
    with the rule's. The longest host + path wins; equal rules: block wins. No rule fits:
    null and default. Null url or one without '://': empty host and path, which no rule with
    a host fits. Rules with a null or empty host are ignored; a null path is empty. Repeated
    rows and page_ids: each row is judged. Empty tables: no rows, or default throughout.
    Other columns are ignored.

    A rule's host is an interval of canonical keys. Pages are ranged by (key, path, hash of
    page_id), so one host or url may hold any share of them; a rule goes to every range its
    interval meets. Each task then sweeps its sorted rows once and keeps a stack of the
    nested rule hosts that are open.
    """
    common.ship(pages.sparkSession)
    n = common.partitions(pages)
    host, path = parts(F.col("url").cast("string"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"key": canonical(F.col("host")), "salt": F.xxhash64("page_id")})
    # key, path and salt as one text that orders like them; no key holds the separator
    order = F.concat_ws("\0", F.substring("key", 1, 256), F.substring("path", 1, 256), F.hex("salt"))
    share = min(1.0, BOUND_SAMPLE / max(1, pages.count()))
    seen = sorted(r[0] for r in keyed.sample(False, share, 5).select(order).limit(2 * BOUND_SAMPLE).collect())
    bounds = np.array(sorted({seen[i * len(seen) // (2 * n)] for i in range(1, 2 * n)}) if seen else [], object)

    @F.pandas_udf("int")
    def range_of(place):
        return type(place)(np.searchsorted(bounds, place.to_numpy(object), "right").astype(np.int32))

    @F.pandas_udf("array<int>")
    def ranges_of(key):
        first, last = (np.searchsorted(bounds, (key + end).to_numpy(object), "right") for end in ("", _LAST))
        return type(key)([list(range(a, b + 1)) for a, b in zip(first.tolist(), last.tolist())])

    own = rules.select(common.lower_ascii(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict").filter("host <> ''")
    opened = own.withColumn("key", canonical(F.col("host"))).withColumn("range", F.explode(ranges_of(F.substring("key", 1, 256))))
    events = opened.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast(keyed.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict").unionByName(
        keyed.withColumn("range", range_of(order)).select("range", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    )
    swept = events.repartition(n, "range").sortWithinPartitions("range", "key", "kind")
    kind = keyed.schema["page_id"].dataType.simpleString()
    return swept.mapInArrow(lambda batches: _sweep(batches, default), f"page_id {kind}, host string, path string, rule string, verdict string")


def _sweep(batches, default: str):
    stack: list[tuple[str, dict, list[int]]] = []  # key; path -> (rule, verdict); path lengths, longest first
    place = None
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")}
        kept, found, verdicts = [], [], []
        for i, (at, key, kind) in enumerate(zip(rows["range"], rows["key"], rows["kind"])):
            if at != place:
                stack, place = [], at
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            host, path = rows["host"][i], rows["path"][i]
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, by_path, lengths = stack[-1]
                if by_path.get(path, ("", ""))[1] != "block":
                    by_path[path] = (host + path, rows["verdict"][i])
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, by_path, lengths in stack:
                for size in lengths:
                    if (rule := by_path.get(path[:size])) and len(path) >= size:
                        if best is None or (len(rule[0]), rule[1] == "block") >= (len(best[0]), best[1] == "block"):
                            best = rule
                        break
            kept.append(i)
            found.append(best and best[0])
            verdicts.append(best[1] if best else default)
        if kept:
            take = pa.array(kept)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("page_id", "host", "path")), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])


#: The rules of the query.
RULE_ROWS = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), spark.createDataFrame(RULE_ROWS, RULES))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULE_ROWS)
ORACLE_SQL = rf"""
    WITH r(rhost, rpath, verdict) AS (VALUES {_VALUES}),
    u AS (SELECT row_number() OVER () AS rn, page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
    h AS (SELECT rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    f AS (SELECT h.*, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY rn ORDER BY length(rhost || rpath) DESC) AS nth
        FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE nth = 1
"""
