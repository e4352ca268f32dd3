"""Registered queries for sources, sinks, small functions and overlays, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import geometry, text, vocab
from tallyforge.functions.lineage import scratch
from tallyforge.operators import candidates, overlays, review, tables
from tallyforge.plans import queries as Q
from tallyforge.plans.reconcile import reconcile
from tallyforge.plans.registry import query
from tallyforge.plans.views import budget, keep, pick, view, with_views
from tallyforge.sources import readers, sinks
from tallyforge.streaming.edits import KeyedTable, follow, last_edits, toggle_counts
from tallyforge.streaming.incremental import IncrementalRun
from tallyforge.streaming.trigger import on_upload

_NORM = Q._NORM


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# sources and sinks

_HEADER = "Budget Item,Amount,Employee First-Name,Employee/Last Name,Explanation,Extra"
_RAW = ("SALARY_TOTAL", " Fringe ", "Telecom", "supplies", "Mystery", "")
_READ = {"SALARY_TOTAL": "Salary", " Fringe ": "Fringe", "Telecom": "Telecom", "supplies": "Supplies", "Mystery": "Mystery"}
_NAMES = ("Ann", " Bob ", "NA", "", "n/a")


def _invoice_lines(spark: SparkSession, d: str) -> DataFrame:
    """An invoice's lines (n, value): an order a line, with $, commas, quotes and line breaks in quotes."""
    k = F.col("o_orderkey")
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (k % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 5 + 1).cast("int"))
    amount = F.when(k % 4 == 3, "invalid").otherwise(F.concat(F.lit('"$'), F.format_number("o_totalprice", 2), F.lit('"')))
    why = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('\nsays ""'), k.cast("string"), F.lit('"", twice"'))
    return _table(spark, d, "orders").select(k.alias("n"), F.concat_ws(",", raw, amount, name, F.lit("Doe"), why, k.cast("string")).alias("value"))


def _written(spark: SparkSession, head: str, lines: DataFrame) -> str:
    path = scratch(spark, "invoice")
    top = spark.createDataFrame([(-1, head)], "n long, value string")
    # an invoice is one file; its parts are sorted one by one
    top.unionByName(lines).orderBy("n").select("value").coalesce(1).write.text(path)
    return path


_FIRST = "CASE o_orderkey % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' END"
_ITEM = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {chr(39) + _READ[r] + chr(39) if r in _READ else 'NULL'}" for i, r in enumerate(_RAW)) + " END"
_INVOICE = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, {_ITEM} AS b, {_FIRST} AS f, CASE WHEN o_orderkey % 4 <> 3 THEN o_totalprice::DECIMAL(18,2) END AS a, o_orderpriority || chr(10) || 'says "' || o_orderkey || '", twice' AS e FROM orders)
    SELECT 'row_' || n || '_' || substr(sha256(concat(n, '||', coalesce(b, 'None'), '|', coalesce(f, 'None'), '|Doe|', coalesce(a::VARCHAR, 'None'), '|', e)), 1, 8) AS row_id, n::INT AS row_index, b AS budget_item, a AS amount, f AS employee_first_name, 'Doe' AS employee_last_name, e AS explanation, o_orderkey::VARCHAR AS extra FROM o"""


def _shown(items: DataFrame) -> DataFrame:
    return items.select("row_id", "row_index", "budget_item", "amount", "employee_first_name", "employee_last_name", "explanation", F.col("raw")["extra"].alias("extra"))


@query(_INVOICE)
def invoice_scan(spark, d):
    """A byte-order mark and the header in the first line."""
    return _shown(readers.read_invoice(spark, _written(spark, "﻿" + _HEADER, _invoice_lines(spark, d))))


@query(_INVOICE)
def invoice_preamble(spark, d):
    """Two lines of a title, one of them with a comma, before the header."""
    return _shown(readers.read_invoice(spark, _written(spark, f"﻿Invoice of the year\nfor all, and more\n{_HEADER}", _invoice_lines(spark, d))))


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages in the stored shape; 'f<orderkey>' files, local pages."""
    empty = F.array().cast("array<string>")
    entities = F.struct(
        F.col("page").alias("page_number"), "doc_type", F.array().cast("array<struct<full_name:string,first_name:string,last_name:string>>").alias("people"), F.array("brand").alias("organizations"), empty.alias("periods"), empty.alias("dates"),
        F.array().cast("array<struct<raw:string,value:double,currency:string,context:string,budget_item:string,source:string,table_row_index:int>>").alias("amounts"), empty.alias("keywords"),
    )
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), (i / 10).alias("left"), F.lit(0.5).alias("top"), F.lit(0.1).alias("width"), F.lit(0.02).alias("height")))
    source = F.element_at(F.array(*map(F.lit, ("pymupdf", "pymupdf_table", "textract", "textract_table"))), (F.col("orderkey") % 4 + 1).cast("int"))
    return view(spark, d, "page_texts").select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc_id"), F.col("page").cast("int").alias("page_number"), source.alias("text_source"), "text", entities.alias("entities"), words.alias("words"))


_PT = with_views("page_texts")


@query(f"{_PT} SELECT 'd' || doc AS doc_id, page AS page_number, text, doc_type, len(string_split(text, ' '))::INT AS n_words FROM page_texts")
def page_json(spark, d):
    """Written as JSON and read again."""
    path = scratch(spark, "pages")
    sinks.write_pages(_page_rows(spark, d), path)
    return readers.read_pages(spark, path).select("doc_id", "page_number", "text", "entities.doc_type", F.size("words").alias("n_words"))


@query(f"""{_PT} SELECT 'd' || doc AS doc_id, page AS page_number, sha256(text) AS text_sha256, sha256('{{"brand":"' || brand || '","doc_type":"' || doc_type || '"}}') AS entities_sha256 FROM page_texts""")
def page_store(spark, d):
    """Stored with the hashes of text and key-sorted entities, and read in order."""
    path = scratch(spark, "page-store")
    pages = view(spark, d, "page_texts").select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc_id"), F.col("page").alias("page_number"), "text", F.struct("doc_type", "brand").alias("entities"))
    sinks.write_page_store(overlays.with_hashes(pages), path)
    return readers.stored_pages(spark, path).select("doc_id", "page_number", "text_sha256", "entities_sha256")


@query(f"{_PT} SELECT 'd' || doc AS doc_id, page AS page_number, md5(text) AS text_md5 FROM page_texts WHERE doc = (SELECT min(o_custkey) FROM orders)")
def page_lookup(spark, d):
    """The pages of one document, by its bucket."""
    path = scratch(spark, "page-store")
    sinks.write_page_store(_page_rows(spark, d), path)
    doc = _table(spark, d, "orders").agg(F.min("o_custkey")).first()[0]
    return readers.stored_pages(spark, path, f"d{doc}").select("doc_id", "page_number", F.md5("text").alias("text_md5"))


@query(f"{_PT} SELECT 'PAGE#' || doc AS pk, '#' || page AS sk, orderkey FROM page_texts WHERE doc = (SELECT max(o_custkey) FROM orders) AND ('#' || page) LIKE '#1%'")
def cache_prefix(spark, d):
    """One partition key, by a prefix of the sort key."""
    items = view(spark, d, "page_texts").select(F.concat(F.lit("PAGE#"), F.col("doc").cast("string")).alias("pk"), F.concat(F.lit("#"), F.col("page").cast("string")).alias("sk"), "orderkey")
    return readers.items_by_key(items, f"PAGE#{_table(spark, d, 'orders').agg(F.max('o_custkey')).first()[0]}", "#1")


@query("SELECT 'job_' || event_id AS job_id, event_type AS status, ts AS created_at FROM events ORDER BY ts DESC, 'job_' || event_id LIMIT 50")
def job_listing(spark, d):
    """The newest fifty."""
    jobs = _table(spark, d, "events").select(F.concat(F.lit("job_"), F.col("event_id").cast("string")).alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return readers.read_jobs(jobs, 50)


@query("SELECT 's' || s_suppkey AS row_id, 'd' || s_nationkey AS doc_id, s_nationkey || ',' || (s_nationkey + 1) AS pages FROM supplier")
def edits_round_trip(spark, d):
    """The overlay written as a whole and read again; a missing file is an empty overlay."""
    path = scratch(spark, "edits")
    key, n = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_nationkey")
    entry = F.struct(key.alias("k"), F.struct(F.concat(F.lit("d"), n.cast("string")).alias("doc_id"), F.array(n, n + 1).alias("page_numbers")).alias("v"))
    edits = _table(spark, d, "supplier").agg(F.map_from_entries(F.collect_list(entry)).alias("overrides"))
    sinks.write_edits(edits, path)
    both = readers.read_edits(spark, path).unionByName(readers.read_edits(spark, path + "-missing"))
    return both.select(F.explode("overrides").alias("row_id", "v")).select("row_id", "v.doc_id", F.array_join("v.page_numbers", ",").alias("pages"))


_UPLOADS = {0: "Salary/{y} + feb.pdf", 1: "Supplies/{y}.pdf", 2: "indirect costs/x {y}.pdf", 3: "Unknown/{y}.pdf", 4: "Other/{y}.pdf", 5: "notes/{y}.txt", 6: "salary.pdf", 7: "Utilities.pdf", 8: "Contractual Service.PDF", 9: "Indirect_Costs.pdf", 10: "Other/deep/{y}.pdf", 11: "Unknown.pdf"}


@query(
    "WITH f AS (SELECT DISTINCT CASE o_custkey % 12 " + " ".join(f"WHEN {k} THEN replace('{p}', '{{y}}', strftime(o_orderdate, '%Y'))" for k, p in _UPLOADS.items()) + """ END AS path FROM orders),
    p AS (SELECT path, len(path) - len(replace(path, '/', '')) AS deep, regexp_replace(split_part(path, '/', 1), '\\.[^.]*$', '') AS top, trim(regexp_replace(lower(regexp_replace(split_part(path, '/', -1), '\\.pdf$', '')), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM f WHERE path LIKE '%.pdf'),
    b AS (SELECT *, CASE trim(regexp_replace(lower(top), '[^a-z0-9]+', '_', 'g'), '_') WHEN 'salary' THEN 'Salary' WHEN 'supplies' THEN 'Supplies' WHEN 'indirect_costs' THEN 'Indirect Costs' WHEN 'other' THEN 'Other' WHEN 'utilities' THEN 'Utilities' END AS budget_item FROM p),
    s AS (SELECT *, trim(regexp_replace(lower(budget_item), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM b WHERE budget_item IS NOT NULL)
    SELECT budget_item, slug || '__' || name AS doc_id, path, true AS full_path FROM s WHERE deep = 1 UNION ALL SELECT budget_item, slug, path, true FROM s WHERE deep = 0 AND budget_item NOT IN (SELECT budget_item FROM s WHERE deep = 1)"""
)
def key_discovery(spark, d):
    """Files under a folder, in folders, flat, too deep and of other kinds: Spark writes every order into its customer's file or its year's; listed with their full paths."""
    folder, k = scratch(spark, "uploads"), F.col("o_custkey") % 12
    path = F.element_at(F.array(*(F.replace(F.lit(p), F.lit("{y}"), F.date_format("o_orderdate", "yyyy")) for p in _UPLOADS.values())), (k + 1).cast("int"))
    sinks.write_files(_table(spark, d, "orders").select(path.alias("path"), F.col("o_orderkey").cast("string").alias("value")), folder)
    return readers.discovered_order(readers.discovered_in(spark, folder)).select("budget_item", "doc_id", "path", F.col("uri").startswith("file:/").alias("full_path"))


@query("SELECT s_nationkey AS nation, true AS relative, true AS has_bytes, count(*)::BIGINT AS suppliers FROM supplier GROUP BY s_nationkey")
def key_listing(spark, d):
    """Keys under a folder that Spark wrote, one file for each nation, by suffix; other files there don't fit it."""
    folder = scratch(spark, "keys")
    rows = _table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    rows.repartition("nation").write.partitionBy("nation").json(folder)
    rows.repartition("nation").write.mode("append").partitionBy("nation").parquet(folder)
    keys = readers.list_keys(spark, folder, "*.json").select("path", F.regexp_extract("key", "^nation=([0-9]+)/[^/]+[.]json$", 1).cast("int").alias("nation"), "length")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder).select(F.col("_metadata.file_path").alias("path"))
    held = lines.groupBy("path").agg(F.count(F.lit(1)).alias("suppliers"))
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    met = keys.withColumn("path", plain).join(held.withColumn("path", plain), "path")
    return met.select("nation", F.col("nation").isNotNull().alias("relative"), (F.col("length") > 0).alias("has_bytes"), "suppliers")


@query(with_views("items") + "SELECT row_id, row_index::INT AS row_index, budget_item, CAST(amount AS DECIMAL(18,2))::VARCHAR AS amount, first_name, last_name, explanation, doc::VARCHAR AS raw_doc FROM items")
def line_items_json(spark, d):
    """Line items written as JSON and read again with their schema; fields that the file lacks are null."""
    path = scratch(spark, "line-items")
    items = view(spark, d, "items")
    raw = F.create_map(F.lit("doc"), F.col("doc").cast("string"))
    items.select("row_id", F.col("row_index").cast("int").alias("row_index"), "budget_item", F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("first_name").alias("employee_first_name"), F.col("last_name").alias("employee_last_name"), "explanation", raw.alias("raw")).write.option("compression", "gzip").json(path)
    read = readers.read_line_items(spark, path).filter("hourly_rate IS NULL AND employee_title IS NULL")
    return read.select("row_id", "row_index", "budget_item", F.col("amount").cast("string").alias("amount"), F.col("employee_first_name").alias("first_name"), F.col("employee_last_name").alias("last_name"), "explanation", F.col("raw")["doc"].alias("raw_doc"))


@query(with_views("files") + """, o AS (SELECT *, coalesce(sum(page_count) OVER (PARTITION BY doc ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM files),
    a AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'f' || o_orderkey ELSE o_custkey::VARCHAR END AS doc, (o_orderkey % 11)::INT AS page FROM orders)
    SELECT a.doc, a.page, a.doc AS doc_id, a.page AS page_number FROM a JOIN files f ON f.path = a.doc AND a.page BETWEEN 1 AND f.page_count
    UNION ALL SELECT a.doc, a.page, path, (a.page - off)::INT FROM a JOIN o ON o.doc::VARCHAR = a.doc AND a.page > off AND a.page <= off + page_count""")
def virtual_page_load(spark, d):
    """Single pages: a file's own, and through the offsets of a document's files."""
    files = view(spark, d, "files").withColumn("doc", F.col("doc").cast("string"))
    pages = files.select(F.col("path").alias("doc_id"), F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))
    key = F.col("o_orderkey")
    refs = _table(spark, d, "orders").select(F.when(key % 5 == 0, F.concat(F.lit("f"), key.cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("doc"), (key % 11).cast("int").alias("page"))
    return readers.load_pages(pages, files, refs)


_EV, _TG, _DONE = Q._EV, Q._TG, Q._DONE


@query(Q.SQL_REPORT.replace("SELECT row_index, sub::INT AS sub, concat_ws(", "SELECT concat_ws(") + f" UNION ALL SELECT '{review.REPORT_HEADER}'")
def report_file(spark, d):
    """K4: the report as a file, with its header."""
    path = scratch(spark, "report")
    sinks.write_report(Q.report_rows(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# extraction

@query("""WITH t AS (SELECT doc_id, length(trim(coalesce(text, ''))) >= 40 AS enough, doc_id % 3 > 0 AS png FROM documents)
    SELECT doc_id, enough, 'pymupdf' AS never, CASE WHEN png THEN 'textract' ELSE 'pymupdf' END AS always, CASE WHEN enough THEN 'pymupdf' WHEN png THEN 'textract' ELSE 'pymupdf' END AS auto, CASE WHEN enough THEN 'pymupdf_table' WHEN png THEN 'textract_table' ELSE 'pymupdf' END AS auto_table FROM t""")
def extraction_tiers(spark, d):
    """F3, F5."""
    docs = _table(spark, d, "documents").withColumn("png", F.col("doc_id") % 3 > 0)
    tier = lambda **c: readers.extraction_tier(readers.EngineConfig(**c), F.lit(None), F.col("png"), F.col("text"))
    return docs.select("doc_id", readers.text_sufficient(F.col("text")).alias("enough"), tier(ocr_mode="never").alias("never"), tier(ocr_mode="always").alias("always"), tier().alias("auto"), tier(table_detection=True).alias("auto_table"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM (SELECT doc_id, trim(line) AS line, n FROM l) WHERE line <> '')
    SELECT doc_id AS doc, md5(string_agg(line, chr(10) ORDER BY r) FILTER (r <= 3)) AS text_md5, count(*)::INT AS n_words, round(min(r / 100.0::DOUBLE), 6) AS first_top FROM k GROUP BY doc_id""")
def ocr_blocks(spark, d):
    """LINE blocks, here three at most, and WORD blocks; each line is a word block too."""
    lines = _table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    full = lines.filter(F.trim("text") != "")
    from pyspark.sql import Window

    top = F.row_number().over(Window.partitionBy("doc").orderBy("n")) / 100
    box = F.struct(F.lit(None).cast("double").alias("left"), top.alias("top"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    words = full.select("doc", "page", F.col("n").alias("ord"), F.lit("WORD").alias("type"), "text", box.alias("bbox"))
    blank = F.lit(None).cast(words.schema["bbox"].dataType).alias("bbox")
    blocks = lines.select("doc", "page", F.col("n").alias("ord"), F.lit("LINE").alias("type"), "text", blank).unionByName(words)
    return readers.ocr_pages(blocks, 3).select("doc", F.md5("text").alias("text_md5"), F.size("words").alias("n_words"), F.round(F.col("words")[0]["top"], 6).alias("first_top"))


@query("SELECT p_partkey, p_name AS text, round(p_size / 612.0, 6) AS \"left\", round(p_size / 792.0, 6) AS top, round(10 / 612.0, 6) AS width, round(12 / 792.0, 6) AS height FROM part")
def scaled_boxes(spark, d):
    """A word box in points over a page's media box; a blank word goes."""
    s = F.col("p_size").cast("double")
    box = lambda t: F.struct(s.alias("x0"), s.alias("y0"), (s + 10).alias("x1"), (s + 12).alias("y1"), t.alias("text"))
    made = _table(spark, d, "part").select("p_partkey", readers.scaled_words(F.array(box(F.lit(" ")), box(F.col("p_name"))), F.lit(612.0), F.lit(792.0)).alias("w"))
    one = made.select("p_partkey", F.explode("w").alias("w")).select("p_partkey", "w.*")
    return one.select("p_partkey", "text", *(F.round(c, 6).alias(c) for c in ("left", "top", "width", "height")))


@query("""SELECT p_partkey AS doc, r AS row_index, c AS col_index, CASE WHEN c = 1 THEN p_name WHEN r = 1 THEN p_brand ELSE '' END AS text FROM part, (VALUES (1), (2)) t(r), (VALUES (1), (2)) u(c)""")
def embedded_tables(spark, d):
    """Grids of cells to cells with indices from 1."""
    name, brand = F.col("p_name"), F.col("p_brand")
    grids = _table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.lit("t").alias("table_id"), F.lit(0).alias("table_index"), F.array(F.array(name, brand), F.array(name, F.lit(None))).alias("rows"))
    return readers.embedded_cells(grids).select("doc", "row_index", "col_index", "text")


@query(f"""{_PT} SELECT 'd' || doc AS doc_id, count(*) FILTER (orderkey % 4 = 0) AS pymupdf, count(*) FILTER (orderkey % 4 = 1) AS pymupdf_table, count(*) FILTER (orderkey % 4 = 2) AS textract, count(*) FILTER (orderkey % 4 = 3) AS textract_table FROM page_texts GROUP BY doc""")
def source_counts(spark, d):
    """G12."""
    return readers.source_counts(_page_rows(spark, d))


# tables

_C = with_views("cells")


def _nested(spark: SparkSession, d: str) -> DataFrame:
    cells = view(spark, d, "cells")
    return cells.groupBy("doc", "page", "table_id").agg(F.array_sort(F.collect_list(F.struct("seq", "row_index", "col_index", "text"))).alias("cells"))


@query(f"""{_C}, t AS (SELECT doc, page, table_id, count(*) AS n, count(DISTINCT row_index) AS r, count(*) FILTER (trim(text) <> '' AND text <> 'see note') AS f FROM cells GROUP BY doc, page, table_id)
    SELECT doc, page, table_id, r >= 2 AND n >= 4 AND f / n >= 0.5 AS default_gate, r >= 1 AND n >= 2 AND f / n >= 0.75 AS own_gate FROM t""")
def table_gate(spark, d):
    """F4; a note counts as blank here."""
    blank = F.transform("cells", lambda c: F.struct(c["row_index"].alias("row_index"), F.when(c["text"] != "see note", c["text"]).otherwise("").alias("text")))
    return _nested(spark, d).select("doc", "page", "table_id", tables.sufficient(blank).alias("default_gate"), tables.sufficient(blank, 1, 2, 0.75).alias("own_gate"))


@query(f"{_C}, m AS (SELECT doc, page, table_id, min(row_index) AS r FROM cells GROUP BY doc, page, table_id) SELECT c.doc, c.page, c.table_id, string_agg(text, '|' ORDER BY col_index) AS row_cells FROM cells c JOIN m ON m.doc = c.doc AND m.page = c.page AND m.table_id = c.table_id AND row_index = r GROUP BY c.doc, c.page, c.table_id")
def table_first_row(spark, d):
    """the cells of a table's first row, from nested cells."""
    first = F.array_min(F.transform("cells", lambda c: c["row_index"]))
    row = F.transform(tables.cells_of_row(F.col("cells"), first), lambda c: c["text"])
    return _nested(spark, d).select("doc", "page", "table_id", F.array_join(row, "|").alias("row_cells"))


@query(f"{_C} SELECT doc, page, table_id, arg_min(text, seq) AS text FROM cells WHERE row_index <= 5 AND 5 < row_index + row_span AND col_index <= 1 AND 1 < col_index + col_span GROUP BY doc, page, table_id")
def cell_lookup(spark, d):
    """The cell that covers row 5, column 1; the one above may span into it."""
    return tables.cell_at(view(spark, d, "cells"), 5, 1)


_GENERIC = "w = '' OR w = 'other' OR contains('other', w) OR contains(w, 'other')"


@query(f"""{_C}, w AS (SELECT doc, page, row_index, unnest(list_transform(regexp_extract_all(regexp_replace(text, '[&\\-]', '', 'g'), '[a-zA-Z][a-zA-Z0-9]+'), lambda x: lower(x))) AS w FROM cells WHERE trim(text) <> '' AND NOT regexp_full_match(regexp_replace(text, '[$,.\\s]', '', 'g'), '[0-9]+'))
    SELECT doc, page, row_index, array_to_string(list_sort(list(DISTINCT w)), ',') AS words FROM w WHERE NOT ({_GENERIC}) GROUP BY doc, page, row_index""")
def row_words(spark, d):
    """Words of each row that aren't numbers or just the budget item Other."""
    return tables.row_words(view(spark, d, "cells"), F.lit("Other"), F.lit("other")).select("doc", "page", "row_index", F.array_join("words", ",").alias("words"))


@query(f"""SELECT p_partkey, t = '' OR t = b OR t = s OR contains(b, t) OR contains(t, b) AS generic FROM (SELECT p_partkey, lower(trim(p_name)) AS t, lower({budget('p_partkey')}) AS b, trim(regexp_replace(lower({budget('p_partkey')}), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN ' SUPPLIES ' WHEN 2 THEN 'indirect_costs' ELSE '' END AS p_name FROM part))""")
def generic_text(spark, d):
    """P20."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, " SUPPLIES ").when(k % 4 == 2, "indirect_costs").otherwise("")
    item = F.expr(budget("p_partkey"))
    return _table(spark, d, "part").select("p_partkey", text.is_generic(name, item, text.slugify(item)).alias("generic"))


@query(with_views("page_amounts") + """SELECT doc, page, 'T' || page AS table_id, 0 AS table_index, (pos)::INT AS seq, pos + 1 AS row_index, 1 AS row_span, CAST(value AS VARCHAR) || ' ' || line_number AS text FROM page_amounts""")
def block_graph(spark, d):
    """A table a page, a cell an amount, two words a cell."""
    a = view(spark, d, "page_amounts").select("doc", "page", "pos", F.col("value").cast("string").alias("v"), F.col("line_number").cast("string").alias("n"))
    shape = "ord int, id string, type string, row_index int, col_index int, row_span int, col_span int, text string, child_ids array<string>"
    null = F.lit(None)
    kind = "struct<" + shape.replace(" ", ":").replace(",:", ",") + ">"
    block = lambda *values: F.struct(*values).cast(kind)
    name = lambda k, x: F.concat(F.lit(k), x["pos"].cast("string"))
    table = block(F.lit(0), F.concat(F.lit("T"), F.col("page").cast("string")), F.lit("TABLE"), null, null, null, null, null, F.transform("said", lambda x: name("C", x)))
    cell = lambda x: block(x["pos"] + 1, name("C", x), F.lit("CELL"), x["pos"] + 1, F.lit(1), null, F.lit(1), null, F.array(name("V", x), name("N", x)))
    word = lambda k, x, c: block(F.lit(1000), name(k, x), F.lit("WORD"), null, null, null, null, x[c], null)
    pages = a.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "n"))).alias("said"))
    own = F.flatten(F.transform("said", lambda x: F.array(cell(x), word("V", x, "v"), word("N", x, "n"))))
    blocks = pages.select("doc", "page", F.explode(F.concat(F.array(table), own)).alias("b")).select("doc", "page", "b.*")
    return tables.resolve_blocks(blocks).select("doc", "page", "table_id", "table_index", "seq", "row_index", "row_span", "text")


# text and boxes

@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: t <> ''))), ' ') AS tokens FROM documents")
def name_tokens(spark, d):
    """P10."""
    return _table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.name_tokens(F.col("text"))), " ").alias("tokens"))


_TERMS = f"""list_concat(v, list_filter([trim(last_name)], lambda x: x IS NOT NULL AND x <> ''), CASE WHEN coalesce(trim(last_name), '') <> '' THEN list_transform(v, lambda x: x || ' ' || trim(last_name)) ELSE [] END,
    CASE WHEN amount IS NOT NULL AND amount <> 0 THEN [amount::VARCHAR, '$' || amount::VARCHAR, format('{{:,.2f}}', amount), '$' || format('{{:,.2f}}', amount)] ELSE [] END)"""


@query(with_views("items") + f"SELECT row_id, array_to_string({_TERMS}, '|') AS terms FROM (SELECT *, {Q._VARIANTS} AS v FROM items)")
def search_terms(spark, d):
    """P13."""
    return view(spark, d, "items").select("row_id", F.array_join(text.search_terms(F.col("first_name"), F.col("last_name"), F.col("amount")), "|").alias("terms"))


@query("SELECT doc_id, (doc_id % 50)::INT AS page_number, 'unknown' AS doc_type, 0 AS n FROM documents")
def default_entities(spark, d):
    """P16."""
    e = _table(spark, d, "documents").select("doc_id", text.default_entities(F.col("doc_id") % 50).alias("e"))
    return e.select("doc_id", "e.page_number", "e.doc_type", sum((F.size(f"e.{c}") for c in ("organizations", "periods", "dates", "people", "amounts", "keywords")), F.lit(0)).alias("n"))


@query("""SELECT p_partkey, r, round(CASE r WHEN 90 THEN 1 - t - h WHEN 180 THEN 1 - l - w WHEN 270 THEN t ELSE l END, 6) AS "left", round(CASE r WHEN 90 THEN l WHEN 180 THEN 1 - t - h WHEN 270 THEN 1 - l - w ELSE t END, 6) AS top, true AS back
    FROM (SELECT p_partkey, (p_partkey % 4 * 90)::INT AS r, p_size / 100.0::DOUBLE AS l, p_size / 200.0::DOUBLE AS t, 0.1::DOUBLE AS w, 0.05::DOUBLE AS h FROM part)""")
def display_rotation(spark, d):
    """P29, and that P28 turns it back."""
    size = F.col("p_size").cast("double")
    own = geometry.box(size / 100, size / 200, F.lit(0.1), F.lit(0.05))
    turned = _table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4 * 90).cast("int").alias("r"), own.alias("b")).withColumn("u", geometry.rotate(F.col("b"), F.col("r"))).withColumn("v", geometry.unrotate(F.col("u"), F.col("r")))
    back = (F.abs(F.col("v.left") - F.col("b.left")) < 1e-9) & (F.abs(F.col("v.top") - F.col("b.top")) < 1e-9)
    return turned.select("p_partkey", "r", F.round("u.left", 6).alias("left"), F.round("u.top", 6).alias("top"), back.alias("back"))


@query("""SELECT p_partkey, round(CASE p_partkey % 4 WHEN 1 THEN t WHEN 2 THEN 1 - l - 0.1 WHEN 3 THEN 1 - t - 0.05 ELSE l END, 6) AS word_left, round(CASE p_partkey % 4 WHEN 1 THEN 0.05 WHEN 3 THEN 0.05 ELSE 0.1 END, 6)::DOUBLE AS cell_width, p_name AS text FROM (SELECT *, p_size / 100.0::DOUBLE AS l, p_size / 200.0::DOUBLE AS t FROM part)""")
def rotated_page(spark, d):
    """All words and cells of a page."""
    size = F.col("p_size").cast("double")
    b = geometry.box(size / 100, size / 200, F.lit(0.1), F.lit(0.05))
    word = F.struct(F.col("p_name").alias("text"), *(b[c].alias(c) for c in ("left", "top", "width", "height")))
    cell = F.struct(F.col("p_name").alias("text"), b.alias("bbox"))
    r = (F.col("p_partkey") % 4 * 90).cast("int")
    page = _table(spark, d, "part").select("p_partkey", geometry.unrotate_words(F.array(word), r).alias("w"), geometry.unrotate_cells(F.array(cell), r).alias("c"))
    return page.select("p_partkey", F.round(F.col("w")[0]["left"], 6).alias("word_left"), F.round(F.col("c")[0]["bbox"]["width"], 6).alias("cell_width"), F.col("c")[0]["text"].alias("text"))


@query("""SELECT o_orderkey, substr(sha256('["job", ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"s' || o_orderkey || '"' END || ', "d' || o_custkey || '", "' || o_orderkey || '.50", ["' || least(o_orderpriority, o_orderstatus) || '", "' || greatest(o_orderpriority, o_orderstatus) || '"], [], ["1.00", "say \\"x\\""]]'), 1, 16) AS request_id FROM orders""")
def request_ids(spark, d):
    """P31."""
    k = F.col("o_orderkey")
    sub = F.when(k % 3 != 0, F.concat(F.lit("s"), k.cast("string")))
    made = text.request_id(F.lit("job"), sub, F.concat(F.lit("d"), F.col("o_custkey").cast("string")), F.concat(k.cast("string"), F.lit(".50")), F.array("o_orderpriority", "o_orderstatus"), F.lit(None).cast("array<string>"), F.array(F.lit('say "x"'), F.lit("1.00")))
    return _table(spark, d, "orders").select("o_orderkey", made.alias("request_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount, NULL::DOUBLE AS hourly_rate, o_orderstatus AS explanation, NULL::VARCHAR AS employee_title FROM orders")
def normalized_items(spark, d):
    """Zero amounts and rates are null, missing columns too."""
    orders = _table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("amount"), F.lit(0).alias("hourly_rate"), F.col("o_orderstatus").alias("explanation"))
    n = orders.select("o_orderkey", sinks.normalized_fields(orders).alias("n"))
    return n.select("o_orderkey", "n.amount", "n.hourly_rate", "n.explanation", "n.employee_title")


@query("""WITH k AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w, string_split(p_name, ' ')[1] AS f FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_append(list_filter(w, lambda x: x <> f), 'new word')), ',') AS keywords, len(w)::INT AS n FROM k""")
def keyword_edits(spark, d):
    """One added twice, one there already, a blank, one removed."""
    own = F.array_distinct(F.split("p_name", " "))
    first = F.split("p_name", " ")[0]
    added = text.add_keyword(text.add_keyword(text.add_keyword(text.add_keyword(own, F.lit(" New Word ")), F.lit("new word")), F.upper(first)), F.lit("  "))
    return _table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.remove_keyword(added, F.concat(F.lit(" "), F.upper(first)))), ",").alias("keywords"), F.size(own).alias("n"))


@query("SELECT p_partkey, replace(p_name, ' ', '|') || '|' || p_brand AS keywords, replace(lower(p_name), ' ', '|') AS terms FROM (SELECT p_partkey, p_brand, array_to_string(list_filter(string_split(p_name, ' '), lambda x: len(x) >= 2), ' ') AS p_name FROM part)")
def manual_keywords(spark, d):
    """Comma-separated entries; search terms need two characters."""
    words = F.array_join(F.filter(F.split("p_name", " "), lambda x: F.length(x) >= 2), " , ")
    return _table(spark, d, "part").select("p_partkey", F.array_join(text.manual_keywords(F.concat(F.lit(" ,"), words, F.lit(",, "), F.col("p_brand"))), "|").alias("keywords"), F.array_join(text.search_words(F.concat(words, F.lit(",x, "))), "|").alias("terms"))


@query(f"SELECT p_name || p_partkey AS filename, CASE WHEN p_partkey % 13 < 12 THEN {budget('(p_partkey % 13)')} END AS budget_item FROM part")
def checked_assignments(spark, d):
    """P39."""
    said = F.when(F.col("p_partkey") % 13 < 12, F.expr(budget("(p_partkey % 13)"))).otherwise("Snacks")
    return overlays.accepted_assignments(_table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("filename"), said.alias("budget_item")))


@query(Q._RV + "SELECT row_id, concat_ws('; ', CASE WHEN amount > 0 THEN '$' || format('{:,.2f}', amount) END, first_name || ' ' || last_name) AS labels FROM reviewed")
def highlight_labels(spark, d):
    """P42."""
    return view(spark, d, "reviewed").select("row_id", F.array_join(text.highlight_labels(F.col("amount"), F.col("first_name"), F.col("last_name")), "; ").alias("labels"))


@query("SELECT doc_id, md5(substr(coalesce(text, ''), 1, 6000)) AS page_md5, md5(substr(coalesce(text, ''), 1, 4000)) AS table_md5, substr(coalesce(text, ''), 1, 50) AS context FROM documents")
def prompt_texts(spark, d):
    """What of a text goes into prompts and contexts; cutting is the operator."""
    c = F.col("text")
    return _table(spark, d, "documents").select("doc_id", F.md5(text.shortened(c, 6000)).alias("page_md5"), F.md5(text.shortened(c, 4000)).alias("table_md5"), text.shortened(c, 50).alias("context"))


# review

_RV = Q._RV
_CAND = "c AS (SELECT row_id, k AS rank, doc_id, round(score / k, 6) AS score, strategy FROM reviewed, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= n_candidates), f AS (SELECT row_id, count(*) AS had, count(*) FILTER (score >= 0.2) AS kept, min(rank) FILTER (score >= 0.2) AS first_rank, any_value(doc_id) AS fd FROM c GROUP BY row_id)"
_SHOWN = "sw AS (SELECT r.row_id, r.row_index, r.budget_item, r.amount, r.doc_id, CASE WHEN had > 0 AND kept = 0 AND fd IS NOT NULL THEN 0 ELSE n_pages END AS n_pages, coalesce(kept, 0) AS n_candidates, c.score, c.strategy FROM reviewed r LEFT JOIN f USING (row_id) LEFT JOIN c ON c.row_id = r.row_id AND c.rank = f.first_rank)"
_TYPED = f"ty AS (SELECT *, {Q._MT.replace('score < 0.4', 'coalesce(score, 0) < 0.4')} AS match_type FROM sw)"


@query(f"{with_views('reviewed', 'evidence_log', 'sub_items')}, {_TG}, {_DONE}, {_CAND}, {_SHOWN}, {_TYPED} SELECT ty.row_id, match_type FROM ty WHERE budget_item = 'Supplies' AND match_type = 'low-confidence' AND row_id NOT IN (SELECT row_id FROM done WHERE payment AND invoice)")
def review_filters(spark, d):
    """A4 with F6, F7, F8 and F9."""
    shown = review.review_list(Q._reviewed(spark, d), Q._candidates(spark, d), Q._done(spark, d), 0.2, "Supplies", "low-confidence", True)
    return shown.select("row_id", "match_type")


@query(f"{_RV}, {_CAND}, {_SHOWN}, {_TYPED} SELECT row_id, match_type, n_candidates FROM ty")
def review_types(spark, d):
    """A4 without a filter but the slider."""
    return review.review_list(Q._reviewed(spark, d), Q._candidates(spark, d), Q._done(spark, d), 0.2).select("row_id", "match_type", "n_candidates")


@query(_RV + "SELECT row_id, CASE WHEN n_candidates = 0 THEN 'none' WHEN strategy IN ('exact', 'component') THEN 'amount' WHEN strategy = 'cross-page' THEN 'cross-page' WHEN score < 0.4 THEN 'low-confidence' ELSE 'keyword' END AS match_type FROM reviewed")
def sub_item_type(spark, d):
    """A2."""
    return view(spark, d, "reviewed").select("row_id", review.sub_match_type().alias("match_type"))


def _seconds(ts: F.Column) -> F.Column:
    """A time's seconds, rounded to whole ones and to even ones on ties, as epoch(ts)::BIGINT has them."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


@query("SELECT event_id AS request_id FROM events WHERE (SELECT max(epoch(ts)::BIGINT) FROM events) - epoch(ts)::BIGINT <= 120")
def live_markers(spark, d):
    """F11."""
    from tallyforge.operators import subitems

    marks = _table(spark, d, "events").select(F.col("event_id").alias("request_id"), _seconds(F.col("ts")).alias("started_at"))
    now = marks.agg(F.max("started_at")).first()[0]
    return subitems.in_progress(marks, F.lit(now)).select("request_id")


@query(f"""{_RV}, d AS (SELECT unnest(['salary', 'fringe', 'x1', 'x2', 'x3']) AS doc_id, unnest(['Salary', 'Fringe', 'Supplies', 'Supplies', 'Other']) AS budget_item)
    SELECT row_id, coalesce(CASE WHEN r.budget_item IN ('Salary', 'Fringe') THEN lower(r.budget_item) END, n.doc_id) AS doc_id FROM reviewed r LEFT JOIN (SELECT budget_item, min(doc_id) AS doc_id FROM d GROUP BY budget_item) n ON n.budget_item = r.budget_item""")
def documents_by_id(spark, d):
    """J16."""
    docs = spark.createDataFrame([("salary", "Salary"), ("fringe", "Fringe"), ("x1", "Supplies"), ("x2", "Supplies"), ("x3", "Other")], "doc_id string, budget_item string")
    return overlays.documents_of(view(spark, d, "reviewed").select("row_id", "budget_item"), docs).select("row_id", "doc_id")


@query(f"""{with_views('sub_items', 'reviewed')} SELECT sub_item_id AS row_id, row_index, budget_item, amount, 'of ' || parent_row_id AS explanation, chr((97 + ord % 26)::INT) AS suffix FROM sub_items s JOIN (SELECT row_id, row_index, budget_item FROM reviewed) r ON r.row_id = parent_row_id""")
def sub_items_as_items(spark, d):
    """A6, A7."""
    subs = view(spark, d, "sub_items")
    shaped = subs.select("sub_item_id", "parent_row_id", F.concat(F.lit("of "), F.col("parent_row_id")).alias("label"), F.array("amount").alias("amounts"))
    made = review.as_line_item(shaped, view(spark, d, "reviewed"))
    return made.join(subs.select(F.col("sub_item_id").alias("row_id"), review.next_suffix(F.col("ord") % 26).alias("suffix")), "row_id")


# overlays

_EDITS = "e AS (SELECT user_id AS r, (event_id % 4)::INT AS idx, CASE WHEN event_type IN ('purchase', 'signup') THEN 'remove' ELSE 'add' END AS op, (event_id % 7 + 1)::INT AS page, event_id AS seq FROM events)"


@query(f"""WITH {_EDITS}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY r, idx, page ORDER BY seq DESC) = 1),
    c AS (SELECT c_custkey AS r, idx, 0.5::DOUBLE AS score FROM (SELECT DISTINCT c_custkey FROM customer), (SELECT unnest([0, 1]) AS idx)),
    p AS (SELECT r, idx, page FROM c, (SELECT unnest([1, 2]) AS page) UNION SELECT l.r, l.idx, page FROM l JOIN c ON c.r = l.r AND c.idx = l.idx WHERE op = 'add'),
    k AS (SELECT p.* FROM p LEFT JOIN l ON l.r = p.r AND l.idx = p.idx AND l.page = p.page WHERE coalesce(l.op, 'add') = 'add'),
    g AS (SELECT r, idx, array_to_string(list_sort(list(page)), ',') AS pages, 0.5::DOUBLE AS score FROM k GROUP BY r, idx)
    SELECT 'row_' || r AS row_id, idx, pages, score FROM g UNION ALL SELECT 'row_' || r, idx, array_to_string(list_sort(list(page)), ','), NULL FROM l WHERE op = 'add' AND NOT EXISTS (SELECT 1 FROM c WHERE c.r = l.r AND c.idx = l.idx) GROUP BY r, idx""")
def page_edits(spark, d):
    """Adds and removes; pages added where there is no candidate make a manual one."""
    key = lambda c: F.concat(F.lit("row_"), c.cast("string")).alias("row_id")
    events = _table(spark, d, "events")
    log = events.select(key(F.col("user_id")), (F.col("event_id") % 4).cast("int").alias("idx"), F.when(F.col("event_type").isin("purchase", "signup"), "remove").otherwise("add").alias("op"), (F.col("event_id") % 7 + 1).cast("int").alias("page"), F.col("event_id").alias("seq"))
    rows = _table(spark, d, "customer").select("c_custkey").distinct()
    made = rows.select(key(F.col("c_custkey")), F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"), F.array(F.lit(1), F.lit(2)).alias("pages"), F.lit(0.5).alias("score"))
    return overlays.edit_pages(made, log).select("row_id", "idx", F.array_join("pages", ",").alias("pages"), "score")


def _followed(spark: SparkSession, log: DataFrame, halves, state, key: list[str]) -> DataFrame:
    """What a stream makes of log that comes in two uploads."""
    folder = scratch(spark, "edit-log")
    table = KeyedTable(f"{folder}/table", key)
    for half in (halves, ~halves):
        log.filter(half).write.mode("append").json(f"{folder}/log")
        follow(spark, f"{folder}/log", log.schema, state, table, f"{folder}/checkpoint").awaitTermination()
    return table.read(spark)


@query(f"WITH {_EDITS} SELECT 'row_' || r AS row_id, idx, page, op, seq FROM e QUALIFY row_number() OVER (PARTITION BY r, idx, page ORDER BY seq DESC) = 1")
def edit_stream(spark, d):
    """The last edit of each page of a candidate, followed as a stream; later uploads hold earlier edits too."""
    seq = F.col("event_id")
    log = _table(spark, d, "events").select(F.concat(F.lit("row_"), F.col("user_id").cast("string")).alias("row_id"), (seq % 4).cast("int").alias("idx"), (seq % 7 + 1).cast("int").alias("page"), F.when(F.col("event_type").isin("purchase", "signup"), "remove").otherwise("add").alias("op"), seq.alias("seq"))
    key = ["row_id", "idx", "page"]
    return _followed(spark, log, F.col("seq") % 3 > 0, lambda x: last_edits(x, key, "seq"), key).select(*key, "op", "seq")


@query(with_views("evidence_log") + "SELECT item_id, field, page, doc_id, count(*) AS n, count(*) % 2 = 1 AS \"on\" FROM evidence_log GROUP BY ALL")
def toggle_stream(spark, d):
    """Evidence toggled over two uploads."""
    key = ["item_id", "field", "page", "doc_id"]
    log = view(spark, d, "evidence_log")
    return _followed(spark, log, F.col("seq") % 2 == 0, lambda x: toggle_counts(x, key), key).select(*key, "n", "on")


@query(f"{_RV} SELECT row_id, (n_pages % 2)::INT AS idx, CASE WHEN row_index % 3 = 0 THEN NULL ELSE score END AS score, CASE WHEN row_index % 3 = 0 THEN '9' ELSE '1,2' END AS pages, 'h' || row_id AS highlights FROM reviewed")
def candidate_edits(spark, d):
    """Edits by key win, an edited score may be null, highlights stay."""
    base = view(spark, d, "reviewed").select("row_id", "row_index", (F.col("n_pages") % 2).alias("idx"), F.array(F.lit(1), F.lit(2)).alias("pages"), "score", F.concat(F.lit("h"), F.col("row_id")).alias("highlights"))
    edits = base.filter("row_index % 3 = 0").select(F.concat_ws("_", "row_id", F.col("idx").cast("string")).alias("key"), F.array(F.lit(9)).alias("pages"), F.lit(None).cast("double").alias("score"))
    done = overlays.edited_candidates(base.drop("row_index"), edits)
    return done.select("row_id", "idx", "score", F.array_join("pages", ",").alias("pages"), "highlights")


@query(f"{with_views('sub_items', 'evidence_log')}, gone AS (SELECT DISTINCT sub_item_id FROM sub_items WHERE ord % 3 = 0) SELECT 'sub' AS kind, sub_item_id AS id, 1::BIGINT AS n FROM sub_items WHERE sub_item_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'evidence', item_id, count(*) FROM evidence_log WHERE item_id NOT IN (SELECT DISTINCT parent_row_id FROM sub_items WHERE ord % 3 = 0) GROUP BY item_id")
def removed_sub_items(spark, d):
    """Removed sub-items go, and evidence of removed ids."""
    subs, log = view(spark, d, "sub_items"), view(spark, d, "evidence_log")
    gone = subs.filter("ord % 3 = 0")
    left = overlays.without_items(subs, gone.select("sub_item_id").distinct(), "sub_item_id").select(F.lit("sub").alias("kind"), F.col("sub_item_id").alias("id"), F.lit(1).cast("long").alias("n"))
    marks = overlays.without_items(log, gone.select("parent_row_id").distinct(), "item_id").groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return left.unionByName(marks.select(F.lit("evidence").alias("kind"), "id", "n"))


@query("""SELECT c_custkey AS job_id, coalesce(n.name, c_name) AS job_name FROM customer LEFT JOIN (SELECT user_id, trim(name) AS name FROM (SELECT user_id, CASE WHEN event_type = 'click' THEN '  ' ELSE ' job ' || event_id END AS name, event_id FROM events) WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) n ON n.user_id = c_custkey""")
def job_names(spark, d):
    """E4."""
    jobs = _table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"))
    names = _table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "click", "  ").otherwise(F.concat(F.lit(" job "), F.col("event_id").cast("string"))).alias("job_name"), F.col("event_id").alias("seq"))
    return overlays.rename_jobs(jobs, names)


@query("""SELECT 'row_' || event_id AS row_id, least(a, b) AS "left", least(c, e) AS top, abs(b - a) AS width, abs(e - c) AS height FROM (SELECT event_id, (event_id % 30)::DOUBLE AS a, (user_id % 30)::DOUBLE AS b, (event_id % 17)::DOUBLE AS c, (event_id % 23)::DOUBLE AS e FROM events) WHERE abs(b - a) >= 5 AND abs(e - c) >= 5""")
def drawn_boxes(spark, d):
    """E5: rectangles drawn either way, of five or more both ways."""
    n = lambda c, m: (F.col(c) % m).cast("double")
    log = _table(spark, d, "events").select(F.concat(F.lit("row_"), F.col("event_id").cast("string")).alias("row_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page"), n("event_id", 30).alias("x1"), n("user_id", 30).alias("x2"), n("event_id", 17).alias("y1"), n("event_id", 23).alias("y2"))
    return overlays.annotations(log, 5).select("row_id", "left", "top", "width", "height")


@query(f"""SELECT c_nationkey AS job_id, min(c_name) AS job_name, sum(c_custkey % 4)::BIGINT AS pdf_count, array_to_string(list_sort(list(DISTINCT {budget('c_custkey')})), '|') AS budget_items, 'UPLOADING' AS status, (1700000000 + 365 * 86400)::BIGINT AS ttl FROM customer GROUP BY c_nationkey""")
def created_jobs(spark, d):
    """E6, G15."""
    paths = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("c_custkey") % 4).cast("int"))
    uploads = _table(spark, d, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_name").alias("job_name"), F.lit("x.csv").alias("csv_filename"), F.expr(budget("c_custkey")).alias("budget_item"), paths.alias("paths"))
    jobs = overlays.new_jobs(uploads, F.timestamp_seconds(F.lit(1_700_000_000)))
    return jobs.select("job_id", "job_name", F.col("pdf_count").cast("long").alias("pdf_count"), F.array_join("budget_items", "|").alias("budget_items"), "status", "ttl")


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 OR epoch(ts)::BIGINT + 30 * 86400 > (SELECT max(epoch(ts)::BIGINT) FROM events)")
def live_cache(spark, d):
    """K7: rows past their time to live go; those without one stay."""
    rows = _table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, _seconds(F.col("ts")) + overlays.CACHE_DAYS * 86_400).alias("ttl"))
    now = _table(spark, d, "events").agg(F.max(_seconds(F.col("ts")))).first()[0]
    return overlays.alive(rows, F.lit(now)).select("event_id")


# runs

@query(f"{Q._M14} SELECT row_id, doc, ordinal, {Q.joined('pages')} AS pages, round(score, 6) AS score, strategy, rank FROM m14")
def incremental_run(spark, d):
    """Two uploads, the second of what was missing or wrong in the first, end where a full run does."""
    keep(spark, d, "page_amounts", "page_facts")
    folder = scratch(spark, "incremental")
    pages, n = Q._pages_of_run(spark, d).select("doc", "page", "text", "entities"), F.col("doc")
    early = F.transform("entities.amounts", lambda a: a.withField("value", a["value"] + 1))
    first = pages.filter((n % 5 > 0) | (F.col("page") == 1)).withColumn("entities", F.when(n % 7 == 0, F.col("entities").withField("amounts", early)).otherwise(F.col("entities")))
    run = IncrementalRun(f"{folder}/store", view(spark, d, "items"), view(spark, d, "page_words"))
    for batch in (first, pages.filter((n % 5 == 0) | (n % 7 == 0))):
        batch.write.mode("append").json(f"{folder}/in")
        on_upload(spark, f"{folder}/in", run, f"{folder}/checkpoint", pages.schema).awaitTermination()
    return run.candidates(spark).select("row_id", "doc", "ordinal", F.array_join("pages", ",").alias("pages"), F.round("score", 6).alias("score"), "strategy", "rank")


@query(f"""{Q._M14}, ok AS (SELECT * FROM m14 WHERE score >= 0.1), sl0 AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rank) = 1)
    SELECT i.row_id, i.doc AS doc_id, coalesce({Q.joined('s.pages')}, '') AS pages, 'auto' AS selection_source FROM items i LEFT JOIN sl0 s ON s.row_id = i.row_id""")
def reconciled_selection(spark, d):
    """The run as a whole, to the default selection: M6, M14, F2, M15."""
    keep(spark, d, "page_amounts", "page_facts")
    run = reconcile(Q._items_of_run(spark, d), Q._pages_of_run(spark, d), view(spark, d, "page_words"))
    return run.selected.select("row_id", "doc_id", F.array_join("pages", ",").alias("pages"), "selection_source")


@query(f"""{Q._M14}, ok AS (SELECT * FROM m14 WHERE score >= 0.1), jb AS (SELECT i.*, (doc % 10)::BIGINT AS job_id FROM items i)
    , sm AS (SELECT * FROM ok WHERE strategy IN ('component', 'cross-page')),
    sv AS (SELECT sm.row_id, ordinal, c.size, p.value, p.pos AS place, p.page FROM sm JOIN component c ON c.row_id = sm.row_id AND c.page = sm.pages[1] JOIN page_amounts p ON p.doc = sm.doc AND p.page = c.page AND list_contains(c.positions, p.pos) WHERE strategy = 'component'
        UNION ALL SELECT sm.row_id, ordinal, len(pages), l.value, l.page, l.page FROM sm JOIN largest l ON l.doc = sm.doc AND list_contains(sm.pages, l.page) WHERE strategy = 'cross-page'),
    wh AS (SELECT row_id, string_agg(printf('$%.2f', value), ' + ' ORDER BY place) AS said, string_agg(printf('$%.2f (p%d)', value, page), ' + ' ORDER BY place) AS across FROM sv GROUP BY row_id),
    wj AS (SELECT job_id, md5(string_agg(CASE WHEN strategy = 'component' THEN said ELSE across END, ',' ORDER BY row_index)) AS sums_md5 FROM wh JOIN sm USING (row_id) JOIN jb USING (row_id) GROUP BY job_id),
    pw0 AS (SELECT (doc % 10)::BIGINT AS job_id, count(*) AS n FROM page_words WHERE doc IN (SELECT doc FROM items) GROUP BY 1)
    SELECT jb.job_id, any_value(sums_md5) AS sums_md5, any_value(pw0.n) AS words, count(*) AS items, count(DISTINCT doc) AS documents, md5(string_agg(row_id, ',' ORDER BY row_index)) AS rows_md5, count(*) FILTER (amount = 0 OR amount IS NULL) AS null_amounts, round(sum(amount), 2) AS amount, (sum(coalesce(c.n, 0)))::BIGINT AS candidates, (count(DISTINCT budget_item) + count(DISTINCT CASE WHEN budget_item IN ('Salary', 'Fringe') THEN budget_item || first_name || coalesce(last_name, '') END))::BIGINT AS groups
    FROM jb LEFT JOIN (SELECT row_id, count(*) AS n FROM ok GROUP BY row_id) c USING (row_id) LEFT JOIN wj ON wj.job_id = jb.job_id LEFT JOIN pw0 ON pw0.job_id = jb.job_id GROUP BY jb.job_id""")
def reconciliation_document(spark, d):
    """K1 with P35: each job's JSON, read again; sums_md5 is of the amounts that summed candidates name in their rationale."""
    keep(spark, d, "page_amounts", "page_facts")
    items = Q._items_of_run(spark, d).withColumn("job_id", F.col("doc") % 10)
    jobs = items.select("job_id").distinct().withColumn("inputs", F.struct(F.lit("x.csv").alias("csv_path")))
    made = reconcile(items, Q._pages_of_run(spark, d), view(spark, d, "page_words"), jobs=jobs).documents
    part = "struct<row_id:string,row_index:long,normalized:struct<amount:double>,candidates:array<struct<rank:int,strategy:string,rationale:array<string>>>,selected_evidence:struct<selection_source:string>>"
    read = made.select("job_id", F.from_json("value", f"struct<job:struct<job_id:long>,documents:array<struct<doc_id:long,page_count:int,pages_data:map<string,struct<words:array<struct<text:string>>>>>>,navigation_groups:array<struct<group_id:string>>,line_items:array<{part}>>").alias("v"))
    amounts = F.transform("v.line_items", lambda x: x["normalized"]["amount"])
    count = lambda c: F.size(c).cast("long")
    sums = F.filter(F.flatten(F.transform("v.line_items", lambda x: x["candidates"])), lambda c: c["strategy"].isin("component", "cross-page"))
    summed = F.transform(sums, lambda c: F.regexp_extract(c["rationale"][1], "^[^:]+: (.*) = ", 1))
    return read.select(
        F.col("v.job.job_id").alias("job_id"),
        count("v.line_items").alias("items"),
        count("v.documents").alias("documents"),
        F.aggregate("v.documents", F.lit(0).cast("long"), lambda a, x: a + F.aggregate(F.map_values(x["pages_data"]), F.lit(0).cast("long"), lambda b, p: b + F.size(p["words"]))).alias("words"),
        F.md5(F.array_join(summed, ",")).alias("sums_md5"),
        F.md5(F.array_join(F.transform("v.line_items", lambda x: x["row_id"]), ",")).alias("rows_md5"),
        count(F.filter(amounts, lambda x: x.isNull())).alias("null_amounts"),
        F.round(F.aggregate(F.filter(amounts, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 2).alias("amount"),
        F.aggregate("v.line_items", F.lit(0).cast("long"), lambda a, x: a + F.size(x["candidates"])).alias("candidates"),
        count("v.navigation_groups").alias("groups"),
    )


def _amount_terms(x: str) -> str:
    return f"[{x}::VARCHAR, '$' || {x}::VARCHAR, format('{{:,.2f}}', {x}), '$' || format('{{:,.2f}}', {x})]"


@query(f"""{Q._M14}, ok AS (SELECT row_id, doc, ordinal, strategy, unnest(pages) AS page FROM m14 WHERE score >= 0.1),
    tm AS (SELECT DISTINCT ok.row_id, ok.doc, ordinal, page, unnest({_TERMS}) AS term FROM ok JOIN (SELECT *, {Q._VARIANTS} AS v FROM items) i USING (row_id) WHERE strategy NOT IN ('exact', 'component', 'cross-page')
        UNION SELECT ok.row_id, ok.doc, ordinal, page, unnest({_amount_terms('i.amount')}) FROM ok JOIN items i USING (row_id) WHERE strategy = 'exact'
        UNION SELECT ok.row_id, ok.doc, ordinal, ok.page, unnest({_amount_terms('p.value')}) FROM ok JOIN component c ON c.row_id = ok.row_id AND c.page = ok.page JOIN page_amounts p ON p.doc = ok.doc AND p.page = ok.page AND list_contains(c.positions, p.pos) WHERE strategy = 'component'
        UNION SELECT ok.row_id, ok.doc, ordinal, ok.page, unnest({_amount_terms('l.value')}) FROM ok JOIN largest l ON l.doc = ok.doc AND l.page = ok.page WHERE strategy = 'cross-page'),
    nt AS (SELECT *, string_split({_NORM.format('term')}, ' ') AS w FROM tm),
    pq AS (SELECT doc, page, pos, w, lead(w) OVER o AS w2 FROM (SELECT doc, page, pos, {_NORM.format('text')} AS w FROM page_words) WINDOW o AS (PARTITION BY doc, page ORDER BY pos)),
    h1 AS (SELECT n.row_id, n.ordinal, n.page, pq.pos FROM nt n JOIN pq ON pq.doc = n.doc AND pq.page = n.page AND len(n.w) = 1 AND n.w[1] <> '' AND pq.w = n.w[1]),
    h2 AS (SELECT n.row_id, n.ordinal, n.page, min(pq.pos) AS pos FROM nt n JOIN pq ON pq.doc = n.doc AND pq.page = n.page AND len(n.w) = 2 AND pq.w = n.w[1] AND pq.w2 = n.w[2] GROUP BY n.row_id, n.ordinal, n.page, n.term)
    SELECT row_id, ordinal, page, array_to_string(list_sort(list(pos)), ',') AS places FROM (SELECT row_id, ordinal, page, pos, 1 AS k FROM h1 UNION SELECT row_id, ordinal, page, pos, 2 FROM h2) GROUP BY row_id, ordinal, page""")
def run_highlights(spark, d):
    """M7 on a run's candidates: all boxes of single words, the first of phrases; amounts that were summed where a sum was found."""
    keep(spark, d, "page_amounts", "page_facts")
    run = reconcile(Q._items_of_run(spark, d), Q._pages_of_run(spark, d), view(spark, d, "page_words"))
    return run.highlights.select("row_id", "ordinal", "page", F.array_join(F.transform("boxes", lambda b: b["pos"]), ",").alias("places"))


@query(f"""{Q._M14}, ok AS (SELECT * FROM m14 WHERE score >= 0.1), sl0 AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rank) = 1),
    ov AS (SELECT 'row_' || o_orderkey AS row_id, o_custkey AS doc_id, [(o_orderkey % 40)::INT] AS pages FROM orders WHERE o_orderstatus = 'F'),
    fn AS (SELECT coalesce(ov.row_id, i.row_id) AS row_id, coalesce(ov.doc_id, i.doc) AS doc_id, coalesce(ov.pages, s.pages, []) AS pages FROM items i LEFT JOIN sl0 s ON s.row_id = i.row_id FULL JOIN ov ON ov.row_id = i.row_id),
    pc AS (SELECT doc AS doc_id, max(page)::INT AS page_count FROM page_texts GROUP BY doc)
    SELECT row_id, doc_id, page, coalesce(page_count, 0) AS page_count FROM (SELECT row_id, doc_id, unnest(pages) AS page FROM fn) LEFT JOIN pc USING (doc_id) WHERE page < 1 OR page > coalesce(page_count, 0)""")
def run_validation(spark, d):
    """F18 on a run's selection under overrides (J13): pages that the document hasn't."""
    keep(spark, d, "page_amounts", "page_facts")
    own = _table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("row_"), F.col("o_orderkey").cast("string")).alias("row_id"), F.col("o_custkey").alias("doc_id"), F.array((F.col("o_orderkey") % 40).cast("int")).alias("pages"), F.lit(1).alias("seq"))
    return reconcile(Q._items_of_run(spark, d), Q._pages_of_run(spark, d), view(spark, d, "page_words"), overrides=own).invalid
