"""Overlays and stored tables: overrides, edit logs, toggles, upserts, content-hash validity, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tallyforge.functions import text, vocab

CACHE_DAYS, JOB_DAYS = 30, 365


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """K2/K3/U4: the last row of each key by the order columns."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K2: new rows replace stored ones of their key; of several new ones the last by `seq`."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(latest(new, key, "seq").select(*stored.columns))


def with_hashes(pages: DataFrame) -> DataFrame:
    """K3: pages with the hash of their text and of their entities' JSON, keys sorted at every level."""
    ordered = sorted_fields(F.col("entities"), pages.schema["entities"].dataType)
    return pages.withColumns({"text_sha256": text.content_hash(F.col("text")), "entities_sha256": text.content_hash(F.to_json(ordered))})


def sorted_fields(c: Column, kind: DataType) -> Column:
    """c with the fields of its structs in the order of their names, so that equal content has equal JSON."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(sorted_fields(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    return c


def stale(current: DataFrame, stored: DataFrame, key: list[str], hash_column: str) -> DataFrame:
    """rows of current whose key isn't stored or whose hash differs; only keys and hashes are read from the store."""
    held = stored.select(*key, F.col(hash_column).alias("_held"), F.lit(True).alias("_there"))
    return current.join(held, key, "left").filter(F.col("_there").isNull() | ~F.col("_held").eqNullSafe(F.col(hash_column))).drop("_held", "_there")


def alive(rows: DataFrame, now: Column) -> DataFrame:
    """K7: rows whose ttl (epoch seconds) isn't reached."""
    return rows.filter(F.col("ttl").isNull() | (F.col("ttl") > now))


def apply_overrides(selected: DataFrame, overrides: DataFrame) -> DataFrame:
    """selections(row_id, doc_id, pages, selection_source) under overrides(row_id, doc_id, pages, seq): the last one wins, also for unknown rows."""
    last = latest(overrides, ["row_id"], "seq").select("row_id", F.col("doc_id").alias("o_doc"), F.col("pages").alias("o_pages"), F.lit(True).alias("own"))
    met = selected.join(last, "row_id", "full")
    return met.select("row_id", F.when(F.col("own"), F.col("o_doc")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("own"), F.col("o_pages")).otherwise(F.col("pages")).alias("pages"), F.when(F.col("own"), "user").otherwise(F.col("selection_source")).alias("selection_source"))


def toggled(log: DataFrame) -> DataFrame:
    """evidence(item_id, field, page, doc_id) that was toggled an odd number of times."""
    return log.groupBy("item_id", "field", "page", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 1).drop("n")


def edit_pages(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """candidates(row_id, idx, pages, score) under a log(row_id, idx, op, page, seq) of adds and removes.

    The last edit of a page decides. A candidate without pages left goes. Pages added to an
    idx that has no candidate make a manual one, with a null score.
    """
    last = latest(log, ["row_id", "idx", "page"], "seq")
    known = candidates.select("row_id", "idx")
    # pages added to a candidate that isn't there
    loose = last.filter("op = 'add'").join(known, ["row_id", "idx"], "left_anti").groupBy("row_id", "idx").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    last = last.join(known, ["row_id", "idx"], "left_semi")
    edits = last.groupBy("row_id", "idx").agg(F.collect_set(F.when(F.col("op") == "add", F.col("page"))).alias("added"), F.collect_set(F.when(F.col("op") == "remove", F.col("page"))).alias("removed"))
    met = candidates.join(edits, ["row_id", "idx"], "left")
    none = F.array().cast("array<int>")
    pages = F.array_sort(F.array_union(F.array_except(F.coalesce("pages", none), F.coalesce("removed", none)), F.coalesce("added", none)))
    left = met.select("row_id", "idx", pages.alias("pages"), "score").filter(F.size("pages") > 0)
    return left.unionByName(loose.select("row_id", "idx", "pages", F.lit(None).cast("double").alias("score")))


def edited_candidates(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """candidates(row_id, idx, pages, score, highlights) with edits(key, pages, score) by '<row_id>_<idx>'; highlights stay the original's."""
    own = edits.select("key", F.col("pages").alias("e_pages"), F.col("score").alias("e_score"), F.lit(True).alias("edited"))
    met = candidates.withColumn("key", F.concat_ws("_", "row_id", F.col("idx").cast("string"))).join(own, "key", "left")
    return met.select("row_id", "idx", F.when(F.col("edited"), F.col("e_pages")).otherwise(F.col("pages")).alias("pages"), F.when(F.col("edited"), F.col("e_score")).otherwise(F.col("score")).alias("score"), "highlights")


def without_items(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows less those of removed ids; the same for a sub-item's evidence."""
    return rows.join(removed.select(F.col(removed.columns[0]).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def rename_jobs(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Jobs under names(job_id, job_name, seq): existing jobs only, blank names ignored, the last one wins."""
    wanted = latest(names.filter(F.trim("job_name") != ""), ["job_id"], "seq").select("job_id", F.trim("job_name").alias("new_name"))
    return jobs.join(wanted, "job_id", "left").withColumn("job_name", F.coalesce("new_name", "job_name")).drop("new_name")


def new_jobs(uploads: DataFrame, now: Column) -> DataFrame:
    """One job row for uploads(job_id, job_name, csv_filename, budget_item, paths)."""
    return uploads.groupBy("job_id").agg(F.min("job_name").alias("job_name"), F.min("csv_filename").alias("csv_filename"), F.sum(F.size("paths")).alias("pdf_count"), F.array_sort(F.collect_set("budget_item")).alias("budget_items")).withColumns({"status": F.lit("UPLOADING"), "created_at": now, "ttl": F.unix_timestamp(now) + JOB_DAYS * 86_400})


def annotations(log: DataFrame, least: float) -> DataFrame:
    """E5: rectangles of at least `least` in both directions, normalized so that width and height are positive."""
    box = log.select("row_id", "doc_id", "page", F.least("x1", "x2").alias("left"), F.least("y1", "y2").alias("top"), F.abs(F.col("x2") - F.col("x1")).alias("width"), F.abs(F.col("y2") - F.col("y1")).alias("height"))
    return box.filter((F.col("width") >= least) & (F.col("height") >= least))


def upload_paths(files: DataFrame) -> DataFrame:
    """(budget_item, name, size, path): duplicates by name and size go; one file of an item stands as its slug, several in its folder, equal names numbered."""
    slug = text.slugify(F.col("budget_item"))
    own = files.dropDuplicates(["budget_item", "name", "size"])
    by_name = Window.partitionBy("budget_item", F.lower("name"))
    counted = own.withColumns({"files": F.count(F.lit(1)).over(Window.partitionBy("budget_item")), "nth": F.row_number().over(by_name.orderBy("name", "size"))})
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    numbered = F.when(F.col("nth") > 1, F.concat(stem, F.lit("_"), (F.col("nth") - 1).cast("string"), ext)).otherwise(F.col("name"))
    return counted.select("budget_item", "name", "size", F.when(F.col("files") == 1, F.concat(slug, F.lit(".pdf"))).otherwise(F.concat(slug, F.lit("/"), numbered)).alias("path"))


def accepted_assignments(answers: DataFrame) -> DataFrame:
    """answers(filename, budget_item): a budget item outside the vocabulary becomes null."""
    return answers.withColumn("budget_item", F.when(F.col("budget_item").isin(*vocab.BUDGET_ITEMS), F.col("budget_item")))


def classify_files(files: DataFrame, slugs: DataFrame) -> DataFrame:
    """(name, budget_item): PDF names by the longest slug that equals or begins their own.

    A name meets slugs by its own leading parts, so this is an equi-join on at most as many
    keys as the name has parts.
    """
    stem = text.slugify(F.regexp_replace("name", r"(?i)\.pdf$", ""))
    parts = F.split(stem, "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    pdfs = files.filter(F.lower("name").endswith(".pdf")).select("name", F.explode(prefixes).alias("slug"))
    met = pdfs.join(slugs, "slug").groupBy("name").agg(F.max_by("budget_item", F.length("slug")).alias("budget_item"))
    return files.select("name").join(met, "name", "left")


def documents_of(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Items with the document of their slug, else of their budget item."""
    by_id = documents.select(F.col("doc_id").alias("slug"), F.col("doc_id").alias("by_slug"))
    by_name = documents.groupBy("budget_item").agg(F.min("doc_id").alias("by_name"))
    return items.withColumn("slug", text.slugify(F.col("budget_item"))).join(by_id, "slug", "left").join(by_name, "budget_item", "left").withColumn("doc_id", F.coalesce("by_slug", "by_name")).drop("slug", "by_slug", "by_name")
