"""Readers: invoice CSV, PDF listings, page and line-item JSON, stored tables, edits, and the extractor hook."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text, vocab

BOX = "struct<text:string,left:double,top:double,width:double,height:double>"
ENTITIES = (
    "struct<page_number:int,doc_type:string,people:array<struct<full_name:string,first_name:string,last_name:string>>,"
    "organizations:array<string>,periods:array<string>,dates:array<string>,"
    "amounts:array<struct<raw:string,value:double,currency:string,context:string,budget_item:string,source:string,table_row_index:int>>,keywords:array<string>>"
)
PAGE = f"doc_id string, page_number int, text_source string, text string, entities {ENTITIES}, words array<{BOX}>"
LINE_ITEM = "row_id string, row_index int, budget_item string, amount decimal(18,2), hourly_rate decimal(18,2), employee_first_name string, employee_last_name string, employee_title string, reporting_period string, agency_invoice_date string, explanation string, raw map<string,string>"
EDITS = "overrides map<string,struct<doc_id:string,page_numbers:array<int>>>, sub_items map<string,array<struct<sub_item_id:string,label:string,amounts:array<double>>>>, completion_status map<string,struct<payment:array<struct<page:int,doc_id:string>>,invoice:array<struct<page:int,doc_id:string>>>>"
INVOICE_COLUMNS = ("budget_item", "amount", "hourly_rate", "employee_first_name", "employee_last_name", "employee_title", "reporting_period", "agency_invoice_date", "explanation")


@dataclass(frozen=True)
class EngineConfig:
    """Fixed settings of a run, handed to plan builders."""

    text_min_chars: int = 40
    ocr_mode: str = "auto"
    ocr_max_lines: int = 300
    table_detection: bool = False
    min_table_rows: int = 2
    min_table_cells: int = 4
    min_table_coverage: float = 0.5
    min_candidate_score: float = 0.1
    min_auto_select_score: float = 0.5


def header_of(spark: SparkSession, path: str, look: int = 21) -> list[str]:
    """The header's cells: of the first line, or of the first of the next that says 'Budget Item' (Q32)."""
    lines = [r[0].lstrip("\ufeff") for r in spark.read.text(path).limit(look).collect()]
    parsed = lambda line: next(csv.reader([line]), [])
    if not lines or "budget_item" in [text.column_name(c) for c in parsed(lines[0])]:
        return parsed(lines[0]) if lines else []
    return parsed(next((x for x in lines if "Budget Item" in x), lines[0]))


def read_invoice(spark: SparkSession, path: str) -> DataFrame:
    """Line items of an invoice CSV.

    Names are normalized, missing columns null, unknown ones kept in raw. row_index is the
    row's place in the file. A preamble of a few lines is found and skipped. The JVM reader
    parses the file whole, by the header's width, so quoted line breaks and quotes stay what
    they are; rows up to the header are left out by their place. No header: no items.
    """
    header = header_of(spark, path)
    cells = [f"c{i}" for i in range(max(1, len(header)))]
    frame = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    placed = frame.withColumn("at", F.monotonically_increasing_id())
    own = F.lit(bool(header))
    for c, h in zip(cells, header):
        own = own & F.regexp_replace(F.col(c), "^\ufeff", "").eqNullSafe(F.lit(h if h != "" else None))
    names = [text.column_name(h) or c for h, c in zip(header, cells)]
    return line_items(placed.select("at", *(F.col(c).alias(n) for c, n in zip(cells, names)), own.alias(_OWN)), "at", _OWN)


#: The column that marks the header's row.
_OWN = "\0own"
#: monotonically_increasing_id() counts a partition's rows from 0 and has the partition's number above these bits.
_BITS = 33


def line_items(frame: DataFrame, at: str, head: str | None = None) -> DataFrame:
    """Line items of a frame of strings with normalized column names, in the order of the column at, a monotonically_increasing_id().

    head: a boolean column; the rows up to the first where it holds are left out, all if there is
    none. Rows are numbered by their place in their partition and the number of rows in those before
    it, so none is held for another.
    """
    columns = [c for c in frame.columns if c not in (at, head)]
    begin = F.min(F.when(F.col(head), F.col(at))) if head else F.lit(-1).cast("long")
    parts = frame.groupBy(F.shiftright(F.col(at), _BITS).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("least"), begin.alias("begin")).collect()  # a row for each partition
    start = min((r["begin"] for r in parts if r["begin"] is not None), default=None)
    if start is None:
        frame, start = frame.filter(F.lit(False)), -1
    # where a partition's rows are after the header's, counted from 0
    before, offsets = 0, {}
    for r in sorted(parts, key=lambda r: r["part"]):
        skipped = 0 if start < r["least"] else min(start - r["least"] + 1, r["n"])
        offsets[r["part"]] = before - skipped - r["least"]
        before += r["n"] - skipped
    own = {c: (F.col(c) if c in columns else F.lit(None).cast("string")) for c in INVOICE_COLUMNS}
    pairs = [x for c in dict.fromkeys(columns) for x in (F.lit(c), F.col(c).cast("string"))]
    raw = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    spark = frame.sparkSession
    shift = F.broadcast(spark.createDataFrame(sorted(offsets.items()) or [(0, 0)], "_part long, _shift long"))
    placed = frame.filter(F.col(at) > start).join(shift, F.shiftright(F.col(at), _BITS) == F.col("_part"))
    base = placed.select((F.col(at) + F.col("_shift")).cast("int").alias("row_index"), *(text.safe_string(own[c]).alias(c) for c in INVOICE_COLUMNS if c not in ("amount", "hourly_rate")), text.currency(own["amount"]).alias("amount"), text.currency(own["hourly_rate"]).alias("hourly_rate"), raw.alias("raw"))
    placed = base.withColumn("budget_item", text.canonical_budget_item(F.col("budget_item")))
    fields = (F.lit(""), F.col("budget_item"), F.col("employee_first_name"), F.col("employee_last_name"), F.col("amount"), F.col("explanation"))
    return placed.select(text.row_id(F.col("row_index"), *fields).alias("row_id"), "row_index", "budget_item", "amount", "hourly_rate", "employee_first_name", "employee_last_name", "employee_title", "reporting_period", "agency_invoice_date", "explanation", "raw")


def discovered(paths: DataFrame) -> DataFrame:
    """(budget_item, doc_id, path) of paths(path), relative to the upload folder.

    Only files that end in .pdf, in lower case, and stand in the folder itself or in a folder
    directly below count. Files in a budget item's folder come first; flat files count for
    budget items without a folder. Names that match nothing are dropped. In the order of
    discovered_order() they come as a listing has them.
    """
    pdf = paths.filter(F.col("path").endswith(".pdf"))
    parts = F.split("path", "/")
    in_folder = pdf.filter(F.size(parts) == 2).select(vocab.by_slug(text.slugify(F.regexp_replace(F.get(parts, F.lit(0)), r"\.[^.]*$", ""))).alias("budget_item"), "path").filter("budget_item IS NOT NULL")
    flat = pdf.filter(F.size(parts) == 1).select(text.file_budget_item(F.col("path")).alias("budget_item"), "path").filter("budget_item IS NOT NULL")
    slug = text.slugify(F.col("budget_item"))
    name = text.slugify(F.regexp_replace(F.element_at(parts, -1), r"\.pdf$", ""))
    foldered = in_folder.select("budget_item", F.concat(slug, F.lit("__"), name).alias("doc_id"), "path")
    rest = flat.join(in_folder.select("budget_item").distinct(), "budget_item", "left_anti").select("budget_item", slug.alias("doc_id"), "path")
    return foldered.unionByName(rest)


def discovered_order(found: DataFrame) -> DataFrame:
    """Foldered files first, by folder and name, then flat ones by name."""
    return found.orderBy(~F.contains("path", F.lit("/")), "path")


def list_keys(spark: SparkSession, folder: str, suffix: str = "*.pdf") -> DataFrame:
    """(path, key, length) of the files under folder whose name fits; key is relative to folder; contents aren't read. Spark lists no empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(folder)
    bare = re.sub(r"^[a-z0-9]+:/+", "/", folder).rstrip("/") + "/"
    # the listing's paths carry a scheme, and escapes for what a URI can't hold
    key = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return found.select("path", F.substring(key, F.instr(key, bare) + len(bare), F.length(key)).alias("key"), "length")


def discovered_in(spark: SparkSession, folder: str) -> DataFrame:
    """discovered() over the files under folder, with their full paths as `uri`."""
    keys = list_keys(spark, folder)
    return discovered(keys.select(F.col("key").alias("path"))).join(keys.select(F.col("key").alias("path"), F.col("path").alias("uri")), "path").select("budget_item", "doc_id", "path", "uri")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S8."""
    return spark.read.schema(PAGE).option("recursiveFileLookup", True).json(path)


def read_line_items(spark: SparkSession, path: str) -> DataFrame:
    """S9."""
    return spark.read.schema(LINE_ITEM).json(path)


def stored_pages(spark: SparkSession, path: str, doc_id: str | None = None, page_number: int | None = None) -> DataFrame:
    """Stored pages in order, of one document, or one page of it; the document's bucket prunes the folders read."""
    pages = spark.read.parquet(path)
    if doc_id is not None:
        pages = pages.filter((F.col("bucket") == bucket_of(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
    if page_number is not None:
        pages = pages.filter(F.col("page_number") == page_number)
    return pages.drop("bucket").orderBy("doc_id", "page_number")


def bucket_of(doc_id: Column, buckets: int = 256) -> Column:
    """The folder of a document in a page store: a hash, so that folders don't grow with documents."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(buckets)).cast("int")


def items_by_key(items: DataFrame, pk: str, prefix: str = "") -> DataFrame:
    """Cache items(pk, sk, ...) of a partition key whose sort key begins with prefix, by sort key as a number where it is one."""
    number = F.regexp_replace("sk", "^#+", "").try_cast("long")
    return items.filter((F.col("pk") == pk) & F.startswith("sk", F.lit(prefix))).orderBy(number, "sk")


def read_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first."""
    ordered = jobs.orderBy(F.desc("created_at"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Saved edits; no file: an empty overlay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], EDITS)
    return spark.read.schema(EDITS).option("multiLine", True).json(path)


def load_pages(pages: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """refs(doc, page) with the stored page they name: the document's own, else through the offsets of its physical files.

    pages: doc_id, page_number, ...; files: doc, path, page_count. A reference that names no page is
    left out, and one that is repeated comes once.
    """
    from tallyforge.operators.amounts import page_offsets, resolve_pages

    asked = refs.select("doc", "page").distinct()
    own = [c for c in pages.columns if c not in ("doc", "page")]
    direct = asked.join(pages.select(*own), (F.col("doc") == F.col("doc_id")) & (F.col("page") == F.col("page_number")))
    rest = asked.join(direct.select("doc", "page"), ["doc", "page"], "left_anti")
    placed = resolve_pages(rest, page_offsets(files)).filter("path IS NOT NULL").select("doc", "page", F.col("path").alias("doc_id"), F.col("local_page").cast("int").alias("page_number"))
    return direct.select("doc", "page", *own).unionByName(placed.join(pages.select(*own), ["doc_id", "page_number"]).select("doc", "page", *own))


def single_page(pages: DataFrame, files: DataFrame, doc: str, page: int) -> DataFrame:
    """One virtual page."""
    asked = pages.sparkSession.createDataFrame([(doc, page)], "doc string, page int")
    return load_pages(pages, files, asked).select(*pages.columns).limit(1)


class Extractor(Protocol):
    """What reads a page outside the engine: text, boxes, tables, entities. Retries belong inside."""

    def extract(self, pages: pd.DataFrame) -> pd.DataFrame: ...


def extracted(pages: DataFrame, extractor: Extractor, schema: str = PAGE) -> DataFrame:
    """Pages through an extractor, in batches within each partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor.extract(batch)

    return pages.mapInPandas(run, schema)


def ocr_pages(blocks: DataFrame, most: int = EngineConfig.ocr_max_lines) -> DataFrame:
    """(doc, page, text, words) of OCR blocks(doc, page, ord, type, text, bbox).

    The first `most` LINE blocks that aren't blank make the text, all WORD blocks that aren't the
    word boxes; both in the order of the blocks, trimmed. A missing coordinate is 0.
    """
    own = blocks.filter(F.col("type").isin("LINE", "WORD")).withColumn("text", F.trim("text")).filter("text <> ''")
    zero = lambda c: F.coalesce(F.col("bbox")[c], F.lit(0.0)).alias(c)
    box = F.struct("ord", F.struct("text", *(zero(c) for c in ("left", "top", "width", "height"))).alias("box"))
    line = F.struct("ord", "text")
    of = lambda kind, x: F.array_sort(F.collect_list(F.when(F.col("type") == kind, x)), lambda a, b: (a["ord"] - b["ord"]).cast("int"))
    grouped = own.groupBy("doc", "page").agg(of("LINE", line).alias("lines"), of("WORD", box).alias("boxes"))
    return grouped.select("doc", "page", ocr_text(F.transform("lines", lambda x: x["text"]), most).alias("text"), F.transform("boxes", lambda x: x["box"]).alias("words"))


def scaled_words(words: Column, width: Column, height: Column) -> Column:
    """Word boxes of array<struct<x0,y0,x1,y1,text>> in points, divided by the media box; blank words go."""
    def one(w: Column) -> Column:
        return F.struct(w["text"].alias("text"), (w["x0"] / width).alias("left"), (w["y0"] / height).alias("top"), ((w["x1"] - w["x0"]) / width).alias("width"), ((w["y1"] - w["y0"]) / height).alias("height"))

    return F.transform(F.filter(words, lambda w: F.trim(w["text"]) != ""), one)


def embedded_cells(tables: DataFrame) -> DataFrame:
    """cells(doc, page, table_id, table_index, seq, row_index, col_index, row_span, col_span, text) of tables(doc, page, table_id, table_index, rows).

    rows: array<array<string>>; indices from 1; a null cell is an empty one.
    """
    rows = tables.select("doc", "page", "table_id", "table_index", F.posexplode("rows").alias("r", "cells"))
    each = rows.select("doc", "page", "table_id", "table_index", "r", F.size("cells").alias("n"), F.posexplode("cells").alias("c", "text"))
    return each.select("doc", "page", "table_id", "table_index", (F.col("r") * 10_000 + F.col("c")).alias("seq"), (F.col("r") + 1).alias("row_index"), (F.col("c") + 1).alias("col_index"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.coalesce("text", F.lit("")).alias("text"))


def text_sufficient(c: Column, least: int = EngineConfig.text_min_chars) -> Column:
    """F3."""
    return F.length(F.trim(F.coalesce(c, F.lit("")))) >= least


def extraction_tier(config: EngineConfig, words: Column, png_ok: Column, body: Column) -> Column:
    """which extraction a page takes: own text or OCR, with tables or without."""
    own, ocr = F.lit("pymupdf"), F.lit("textract")
    if config.ocr_mode == "never":
        return own
    plain = F.when(text_sufficient(body, config.text_min_chars), F.lit("pymupdf_table") if config.table_detection else own)
    if config.ocr_mode == "always":
        return F.when(png_ok, F.lit("textract_table") if config.table_detection else ocr).otherwise(own)
    return F.coalesce(plain, F.when(png_ok, F.lit("textract_table") if config.table_detection else ocr), own)


def ocr_text(lines: Column, most: int = EngineConfig.ocr_max_lines) -> Column:
    """The first lines of a page, joined."""
    return F.array_join(F.slice(lines, 1, most), "\n")


def source_counts(pages: DataFrame) -> DataFrame:
    """Pages of each document by extraction source."""
    return pages.groupBy("doc_id").agg(*(F.count_if(F.col("text_source") == s).alias(s) for s in ("pymupdf", "pymupdf_table", "textract", "textract_table")))
