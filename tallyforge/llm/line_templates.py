"""Line dedup by a log-template tree: lines that recur across documents up to variable fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.common import GAP, WORD, let

#: Leading tokens on the path to a leaf, and tokens that a template with fields leaves standing, at least.
LEAD = 3
#: Share of a line's tokens that a template with fields leaves standing, at least.
STANDING = 2, 3
#: Numbers of documents that differ by less than this factor stand on one level.
LEVEL = 1.5
#: Documents that a template recurs in, at least: with fields, which chance can make, and of all tokens, which it can't.
LEAST_DOCS, WHOLE_DOCS = 3, 2


def tokens_of(line: Column) -> Column:
    """Tokens with digit runs generalised: numbers are variable fields wherever they stand."""
    return F.array_remove(F.split(F.regexp_replace(line, "[0-9]+", "0"), GAP), "")


def plain_lines(text: Column) -> Column:
    """A text's lines with their tokens (as tokens_of has them) a single space apart, and one at either end perhaps."""
    plain = F.regexp_replace(text, "[0-9]+", "0")
    # most texts have single spaces only, which a search for bytes tells at once
    odd = F.lit(False)
    for gap in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(text, F.lit(gap))
    return F.split(F.when(odd, F.regexp_replace(plain, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(plain), "\n", -1)


def line_keys(fields: bool):
    """Of a plain line and its place: struct(whole, pos, leaf0 .. leaf3); null without a token.

    whole is a 128-bit digest of all tokens. The tree's path is the number of tokens, then
    the LEAD leading ones; leaf0 is where the line's own path ends. On the others one of these
    tokens takes the wildcard child, and the token after them stands in for it on the path.
    Lines of LEAD tokens or fewer have no leaf, nor has any without fields.
    """
    def leaves(t: Column) -> Column:
        def paths(head: Column) -> Column:
            lead = [F.get(head["tokens"], F.lit(j)) for j in range(LEAD + 1)]
            own = [F.xxhash64(F.lit(-1), head["n"], *lead[:LEAD])] + [F.xxhash64(F.lit(k), head["n"], *(x for j, x in enumerate(lead) if j != k)) for k in range(LEAD)]
            return F.when(F.size(head["tokens"]) > LEAD, F.array(*own))

        n = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
        return let(F.struct(F.split(t, " ", LEAD + 2).alias("tokens"), n.alias("n")), paths)

    def keys(line: Column, pos: Column) -> Column:
        def of(t: Column) -> Column:
            none = F.lit(None).cast("array<long>")
            made = lambda p: F.struct(F.md5(t).alias("whole"), pos.alias("pos"), *(F.get(p, F.lit(k)).alias(f"leaf{k}") for k in range(LEAD + 1)))
            return F.when(t != "", let(leaves(t), made) if fields else made(none))

        return let(F.trim(line), of)

    return keys


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _once(lines: Column) -> Column:
    """Of a document's sorted lines one of each kind."""
    return F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1)["whole"] != x["whole"]))


def field_templates(docs: DataFrame, keyed: DataFrame, kinds: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(whole, first_id): lines under a template with fields that least_docs documents or more share.

    kinds: whole, n (its documents), leaf0 ..: one row for each distinct line, so a line that
    recurs is looked at once, weighing its documents. In a leaf it is counted how many
    documents have a token at a place; the numbers are put on levels, each LEVEL times the one
    below. A line falls under one template for each level that its tokens have: tokens of
    that level or a higher one stand, all others are fields, at any places, as long as STANDING
    of the tokens and LEAD of them stand. The constant tokens of a template have at least as
    many documents as the template itself, so all its lines share the one template of the
    lowest level of theirs, in whatever order they come (but for values that nearly as many
    documents share, which count as constant). A line has few templates, whatever the size of
    its group, as levels grow with the logarithm of the documents. A template is the set of its standing tokens with their places and leaf, kept as two 64-bit sums of
    their hashes; it covers two different lines at least.
    """
    each_leaf = kinds.filter("leaf0 IS NOT NULL").select("whole", "n", F.posexplode(F.array(*(f"leaf{k}" for k in range(LEAD + 1)))).alias("k", "leaf"))
    shared = each_leaf.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lines")).filter((F.col("docs") >= least_docs) & (F.col("lines") > 1)).select("leaf", "lines")
    # a wildcard's leaf that holds no other lines than the line's own leaf has the same templates
    grown = F.transform(F.filter("leaves", lambda x: (x["k"] == 0) | (x["lines"] > F.col("own"))), lambda x: x["leaf"])
    own = F.coalesce(F.max(F.when(F.col("k") == 0, F.col("lines"))), F.lit(1))
    met = each_leaf.join(shared, "leaf").groupBy("whole").agg(F.max("n").cast("int").alias("n"), own.alias("own"), F.collect_list(F.struct("k", "leaf", "lines")).alias("leaves"))
    leaved = common.staged(met.select("whole", F.monotonically_increasing_id().alias("id"), "n", grown.alias("leaves")).filter(F.size("leaves") > 0), "leaved")
    needed = leaved.select("whole", "id")
    lines = keyed.select("doc_id", "hash", F.explode(_once(F.col("lines"))).alias("x")).select("doc_id", "hash", "x.whole", "x.pos")
    # repeated rows have the same places: each counts as a document
    held = common.staged(lines.join(needed, "whole").groupBy("id", "doc_id", "hash").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies")), "held-lines")

    asked = held.dropDuplicates(["id"]).groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.collect_list(F.struct("pos", "id")).alias("places"))
    own = docs.select("doc_id", F.xxhash64(_text()).alias("hash"), F.split(_text(), "\n", -1).alias("split"))
    # no side is small by rule, so none is broadcast, here and below
    met = own.join(asked.hint("merge"), own["doc_id"].eqNullSafe(asked["d"]) & (own["hash"] == asked["h"]))
    tokens = met.select(F.explode(F.transform("places", lambda p: F.struct(p["id"].alias("id"), tokens_of(F.col("split")[p["pos"]]).alias("tokens")))).alias("x")).select("x.*").dropDuplicates(["id"])
    placed = leaved.join(tokens, "id").select("id", "n", F.size("tokens").alias("size"), F.explode("leaves").alias("leaf"), "tokens").select("id", "n", "size", "leaf", F.posexplode("tokens").alias("i", "token"))
    each = common.staged(placed.select("id", "n", "size", "leaf", F.xxhash64("leaf", "i", "token").alias("token")), "line-tokens")

    counts = each.groupBy("token").agg(F.sum("n").alias("c")).filter(F.col("c") >= least_docs)
    counts = counts.select("token", F.floor(F.log(F.col("c") / F.lit(float(least_docs))) / F.log(F.lit(LEVEL))).cast("int").alias("level"))
    upto = Window.partitionBy("id", "leaf").orderBy(F.desc("level"))
    levels = each.drop("n").join(counts, "token").select("id", "size", F.count(F.lit(1)).over(upto).alias("standing"), *(F.bit_xor(F.xxhash64(F.lit(k), "token")).over(upto).alias(f"k{k}") for k in (1, 2)))
    fits = levels.filter((F.col("standing") >= LEAD) & (F.col("standing") * STANDING[1] >= F.col("size") * STANDING[0]) & (F.col("standing") < F.col("size")))
    made = common.staged(fits.select("id", "k1", "k2").distinct(), "templates")
    several = made.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("k1", "k2")
    under = common.staged(made.join(several, ["k1", "k2"]), "templates-of-several")
    once = held.join(under, "id").groupBy("k1", "k2", "doc_id", "hash").agg(F.max("copies").alias("copies"))
    recurring = once.groupBy("k1", "k2").agg(F.sum("copies").alias("docs"), F.min("doc_id").alias("first_id")).filter(F.col("docs") >= least_docs)
    return under.join(recurring, ["k1", "k2"]).join(needed, "id").select("whole", "first_id")


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, whole_docs: int = WHOLE_DOCS, fields: bool = True, keep_first: bool = False) -> DataFrame:
    """(doc_id, hash, dropped): places of the lines to drop, for documents that have any, as a staged table.

    A template of all tokens recurs when whole_docs documents have it, one with fields when
    least_docs do; a document that repeats a line counts once. All lines of a recurring
    template are dropped; with keep_first they stay in the document that is the first, by
    doc_id, of all templates they fall under. Digests, never texts, are compared; a line that
    very many documents hold is one row with their number before templates are looked for,
    and its places meet it in a sort-merge join, whose hot keys Spark splits.
    """
    # sorted, equal lines of a document stand side by side
    since = common.mark()
    lines = F.sort_array(F.filter(F.transform(plain_lines(_text()), line_keys(fields)), lambda x: x.isNotNull()))
    keyed = common.staged(docs.select("doc_id", F.xxhash64(_text()).alias("hash"), lines.alias("lines")), "line-keys")
    once = keyed.select("doc_id", F.explode(_once(F.col("lines"))).alias("x"))
    kinds = once.groupBy("x.whole").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), *(F.min(f"x.leaf{k}").alias(f"leaf{k}") for k in range(LEAD + 1)))
    kinds = common.staged(kinds, "line-kinds")
    gone = kinds.filter(F.col("n") >= whole_docs).select("whole", "first_id")
    if fields:
        gone = gone.unionByName(field_templates(docs, keyed, kinds, least_docs))
    # staged, so that both sides of the join below are plain shuffles, whose hot keys Spark can split
    gone = common.staged(gone.groupBy("whole").agg(F.min("first_id").alias("lo"), F.max("first_id").alias("hi")), "gone")
    places = keyed.select("doc_id", "hash", F.explode("lines").alias("x")).select("doc_id", "hash", "x.whole", "x.pos")
    met = places.join(gone.hint("merge"), "whole")
    if keep_first:
        met = met.filter(~(F.col("doc_id").eqNullSafe(F.col("lo")) & F.col("doc_id").eqNullSafe(F.col("hi"))))
    found = common.staged(met.groupBy("doc_id", "hash").agg(F.collect_set("pos").alias("dropped")), "recurring-lines")
    common.clear(docs.sparkSession, since, found)
    return found


def _marked(docs: DataFrame, **rules) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each row of docs as a struct, and its text without recurring lines."""
    found = recurring_lines(docs, **rules).select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "dropped")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.xxhash64(_text()).alias("hash"))
    joined = rows.join(found.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)
    kept = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n"))
    return joined.select(
        "row",
        kept.alias("kept"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_recurring(docs: DataFrame, **rules) -> DataFrame:
    """docs(doc_id, text, ...) with the text's recurring lines dropped, and n_lines, n_dropped.

    rules as in recurring_lines. Other columns stay as they are; the two new ones go last and
    replace columns of their names. Null text: stays null, no lines. Empty lines never recur.
    Null doc_id: its lines count and are dropped like others; with keep_first it is the first
    only where all documents lack an id. Repeated rows: alike rows are treated alike, and each
    counts as a document. No rows: none out.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _marked(docs, **rules).select(*((F.col("kept") if c == "text" else F.col("row")[c]).alias(c) for c in own), "n_lines", "n_dropped")


def without_emptied(docs: DataFrame, **rules) -> DataFrame:
    """docs without recurring lines, and without the rows that lost all their words; the columns of docs.

    rules as in recurring_lines; nulls, ties, repeated rows and empty tables as in
    drop_recurring. A row that had no words to begin with stays.
    """
    left = _marked(docs, **rules).filter((F.col("n_dropped") == 0) | F.col("kept").rlike(WORD))
    return left.select(*((F.col("kept") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_sql(documents: str = "documents", least_docs: int = LEAST_DOCS, whole_docs: int = WHOLE_DOCS, fields: bool = True, keep_first: bool = False) -> str:
    """DuckDB SQL of drop_recurring(): one row for each document, with its row number rn."""
    path = lambda k: " || ' ' || ".join([f"'{k}'", "len(t)", *(f"t[{j + 1}]" for j in range(LEAD + (k >= 0)) if j != k)])
    leaves = ", ".join(path(k) for k in (-1, *range(LEAD)))
    first = "AND NOT (o.doc_id IS NOT DISTINCT FROM lo AND o.doc_id IS NOT DISTINCT FROM hi)" if keep_first else ""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rn, * FROM {documents}),
    l AS (SELECT rn, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
    o AS (SELECT *, array_to_string(t, ' ') AS whole FROM (SELECT *, list_filter(string_split_regex(regexp_replace(line, '[0-9]+', '0', 'g'), '{GAP}'), lambda x: x <> '') AS t FROM l) WHERE len(t) > 0),
    wh AS (SELECT whole, any_value(t) AS t, count(DISTINCT rn) AS n, min(doc_id) AS first_id FROM o GROUP BY whole),
    lf AS (SELECT whole, t, n, unnest([{leaves}]) AS leaf FROM wh WHERE len(t) > {LEAD} AND {str(fields).lower()}),
    sh AS (SELECT leaf FROM lf GROUP BY leaf HAVING sum(n) >= {least_docs} AND count(*) > 1),
    ea AS (SELECT whole, leaf, n, len(t) AS size, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM lf JOIN sh USING (leaf)),
    ct AS (SELECT leaf, i, token, floor(ln(sum(n) / {float(least_docs)}::DOUBLE) / ln({LEVEL}::DOUBLE))::INT AS c FROM ea GROUP BY leaf, i, token HAVING sum(n) >= {least_docs}),
    st AS (SELECT whole, leaf, size, i, token, c FROM ea JOIN ct USING (leaf, i, token)),
    tp AS (SELECT a.whole, a.leaf, string_agg(b.i || ' ' || b.token, chr(10) ORDER BY b.i) AS template FROM (SELECT DISTINCT whole, leaf, size, c FROM st) a JOIN st b ON a.whole = b.whole AND a.leaf = b.leaf AND b.c >= a.c
        GROUP BY a.whole, a.leaf, a.c, a.size HAVING count(*) >= {LEAD} AND count(*) * {STANDING[1]} >= a.size * {STANDING[0]} AND count(*) < a.size),
    rc AS (SELECT leaf, template, min(doc_id) AS first_id FROM (SELECT DISTINCT * FROM tp) JOIN (SELECT DISTINCT rn, doc_id, whole FROM o) USING (whole) GROUP BY leaf, template HAVING count(DISTINCT rn) >= {least_docs} AND count(DISTINCT whole) > 1),
    gn AS (SELECT whole, min(first_id) AS lo, max(first_id) AS hi FROM (SELECT whole, first_id FROM wh WHERE n >= {whole_docs} UNION ALL SELECT whole, first_id FROM tp JOIN rc USING (leaf, template)) GROUP BY whole),
    x AS (SELECT rn, pos FROM o JOIN gn USING (whole) WHERE true {first}),
    r AS (SELECT l.rn, count(*)::BIGINT AS n_lines, count(x.pos)::BIGINT AS n_dropped, coalesce(string_agg(CASE WHEN x.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS kept FROM l LEFT JOIN x ON l.rn = x.rn AND l.pos = x.pos GROUP BY l.rn)
    SELECT d.* REPLACE (CASE WHEN text IS NULL THEN NULL ELSE kept END AS text), CASE WHEN text IS NULL THEN 0 ELSE r.n_lines END AS n_lines, r.n_dropped FROM d JOIN r USING (rn)
    """


ORACLE_SQL = f"SELECT doc_id, text, n_lines, n_dropped FROM ({drop_sql()})"
