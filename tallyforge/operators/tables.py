"""Table cells: row texts, budget items of rows, where an amount stands.

cells: doc, page, table_id, table_index (the table's place on its page), seq (scan order in the
table), row_index, col_index, row_span, col_span, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text, vocab


def dimensions(cells: DataFrame) -> DataFrame:
    """G10."""
    return cells.groupBy("doc", "page", "table_id").agg(F.max(F.col("row_index") + F.col("row_span") - 1).alias("row_count"), F.max(F.col("col_index") + F.col("col_span") - 1).alias("col_count"))


def row_texts(cells: DataFrame) -> DataFrame:
    """Each row's cells, joined in scan order."""
    return cells.groupBy("doc", "page", "table_id", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), " ").alias("row_text"))


def budget_of(row_text: Column) -> Column:
    """The budget item a row names, in three tiers: equal, contained either way, a shared word of four letters.

    Within a tier the vocabulary's order decides; the vocabulary is fixed, so this is one
    expression and no join.
    """
    row = text.table_text(row_text)
    words = F.split(row, " ")
    names = [(b, _table_text(b)) for b in vocab.BUDGET_ITEMS]
    equal = [F.when(row == n, F.lit(b)) for b, n in names]
    inside = [F.when(F.contains(row, F.lit(n)) | ((F.length(row) >= 3) & F.contains(F.lit(n), row)), F.lit(b)) for b, n in names]
    shared = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, long))), F.lit(b)) for b, n in names if (long := [w for w in n.split() if len(w) >= 4])]
    return F.coalesce(*equal, *inside, *shared)


def _table_text(name: str) -> str:
    return " ".join("".join(c for c in name.lower() if c.isascii() and (c.isalnum() or c == " ")).split())


def row_budgets(cells: DataFrame) -> DataFrame:
    return row_texts(cells).withColumn("budget_item", budget_of(F.col("row_text")))


def associate(amounts: DataFrame, cells: DataFrame) -> DataFrame:
    """amounts(doc, page, pos, raw) with budget_item, source and table_row_index.

    The first cell in scan order (tables by their place on the page) that is the amount's text, or contains it in one line and one
    row, is its place; only without one, the first cell that has it in one of several lines (the
    line gives the row) or spans rows. A row without a budget item is Other. An amount
    without a place has the document as its budget item.
    """
    # all that is told of a page is told where its cells stand: they are sent once, by page, and meet its amounts as one row
    cell = cells.select("doc", "page", "table_id", "table_index", "seq", "row_index", "row_span", "text").repartition("doc", "page")
    scanned = F.array_sort(F.collect_list(F.struct("seq", "text", "table_index", "row_span")))
    rows = cell.groupBy("doc", "page", "table_id", "row_index").agg(scanned.alias("cells"))
    named = rows.withColumn("budget_item", budget_of(F.array_join(F.transform("cells", lambda c: c["text"]), " ")))
    by_page = named.groupBy("doc", "page").agg(F.collect_list(F.struct("table_id", "row_index", "budget_item", "cells")).alias("rows"))

    def place(row: Column, c: Column) -> Column:
        bare = F.trim(c["text"])
        broken = F.contains(bare, F.lit("\n"))
        lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(x))
        line = F.array_position(F.transform(lines, lambda x: F.contains(x, F.col("raw"))), F.lit(True)) - 1
        direct = (bare == F.col("raw")) | (~broken & (c["row_span"] <= 1))
        at = F.when(direct | ~broken, row["row_index"]).when(line >= 0, row["row_index"] + line).cast("int")
        return F.struct(F.when(direct, 0).otherwise(1).alias("class"), c["table_index"].alias("table_index"), c["seq"].alias("seq"), row["table_id"].alias("table_id"), at.alias("row"))

    hits = F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r["cells"], lambda c: F.contains(c["text"], F.col("raw"))), lambda c: place(r, c))))
    best = amounts.drop("budget_item").join(by_page, ["doc", "page"], "left").withColumn("b", F.array_min(F.filter(hits, lambda h: h["row"].isNotNull())))
    own = F.filter("rows", lambda r: (r["table_id"] == F.col("b.table_id")) & (r["row_index"] == F.col("b.row")))
    out = best.withColumn("row", F.col("b.row")).withColumn("budget_item", F.get(own, F.lit(0))["budget_item"])
    found = F.col("row").isNotNull()
    return out.select(
        *amounts.drop("budget_item").columns,
        F.when(found, F.coalesce("budget_item", F.lit("Other"))).otherwise(F.col("doc").cast("string")).alias("budget_item"),
        F.when(found, "table_row").otherwise("page_default").alias("source"),
        F.col("row").alias("table_row_index"),
    )


def cell_at(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The first cell that covers (row, col), spans honoured."""
    covers = (F.col("row_index") <= row) & (row < F.col("row_index") + F.col("row_span")) & (F.col("col_index") <= col) & (col < F.col("col_index") + F.col("col_span"))
    return cells.filter(covers).groupBy("doc", "page", "table_id").agg(F.min_by("text", "seq").alias("text"))


def cells_of_row(cells: Column, row: Column) -> Column:
    """a row's cells in nested form, by column."""
    own = F.filter(cells, lambda c: c["row_index"] == row)
    return F.transform(F.array_sort(F.transform(own, lambda c: F.struct(c["col_index"].alias("k"), c.alias("c")))), lambda x: x["c"])


def sufficient(cells: Column, rows: int = 2, least: int = 4, coverage: float = 0.5) -> Column:
    """enough rows and cells, and enough of them with text."""
    n = F.size(cells)
    full = F.size(F.filter(cells, lambda c: F.trim(c["text"]) != ""))
    row_count = F.size(F.array_distinct(F.transform(cells, lambda c: c["row_index"])))
    return F.coalesce((row_count >= rows) & (n >= least) & (full / n >= coverage), F.lit(False))


def row_words(cells: DataFrame, budget_item: Column, slug: Column) -> DataFrame:
    """(doc, page, row_index, words): words of a row's cells that are no numbers and don't just name the budget item."""
    own = cells.filter((F.trim("text") != "") & ~F.regexp_replace("text", r"[$,.\s]", "").rlike("^[0-9]+$"))
    word = own.select("doc", "page", "row_index", F.explode(text.text_words(F.col("text"))).alias("w"))
    return word.filter(~text.is_generic(F.col("w"), budget_item, slug)).groupBy("doc", "page", "row_index").agg(F.array_sort(F.collect_set("w")).alias("words"))


def resolve_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, page, table_id, table_index, seq, row_index, col_index, row_span, col_span, text) of a block graph.

    blocks: doc, page, ord (place in the list), id, type, row_index, col_index, row_span, col_span,
    text, child_ids. TABLE lists CELLs, CELL lists WORDs; words keep the order of the list, tables
    that of the blocks.
    """
    # one order by page numbers the tables; all that follows groups within a page, so blocks are sent once
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.coalesce(F.col("type") != "TABLE", F.lit(True)), "ord")) - 1
    none = F.array().cast("array<string>")
    edge = F.transform(F.when(F.col("type").isin("TABLE", "CELL"), F.coalesce("child_ids", none)).otherwise(none), lambda c, i: F.struct(c.alias("key"), F.col("id").alias("parent"), F.col("type").alias("kind"), i.alias("seq"), F.col("table_index").alias("table_index")))
    told = blocks.withColumn("table_index", place).select("doc", "page", "id", "type", "row_index", "col_index", "row_span", "col_span", "text", edge.alias("edges"))
    facts = F.struct("type", "row_index", "col_index", "row_span", "col_span", "text")
    own = F.struct(F.col("id").alias("key"), facts.alias("facts"), F.lit(None).cast(told.schema["edges"].dataType.elementType).alias("edge"))
    lists = F.transform("edges", lambda e: F.struct(e["key"].alias("key"), F.lit(None).cast(facts_type(told)).alias("facts"), e.alias("edge")))
    node = told.select("doc", "page", F.explode(F.concat(F.array(own), lists)).alias("x")).select("doc", "page", "x.*")
    node = node.groupBy("doc", "page", "key").agg(F.max("facts").alias("facts"), F.collect_list("edge").alias("edges"))
    # a word goes to the cells that list it, a cell to the tables that do
    said = F.transform(F.filter("edges", lambda e: (e["kind"] == "CELL") & (F.col("facts.type") == "WORD")), lambda e: F.struct(e["parent"].alias("key"), F.struct(e["seq"].alias("seq"), F.col("facts.text").alias("text")).alias("word")))
    listed = F.filter("edges", lambda e: e["kind"] == "TABLE")
    nothing = F.lit(None).cast("struct<seq:int,text:string>")
    cell = F.array(F.struct("key", nothing.alias("word"), F.when(F.col("facts.type") == "CELL", F.struct("facts", listed.alias("tables"))).alias("cell")))
    up = F.transform(said, lambda w: F.struct(w["key"].alias("key"), w["word"].alias("word"), F.lit(None).cast(node.select(F.struct("facts", listed.alias("tables")).alias("c")).schema["c"].dataType).alias("cell")))
    each = node.select("doc", "page", F.explode(F.concat(cell, up)).alias("x")).select("doc", "page", "x.*")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("word")), lambda x: x["text"]), " ")
    whole = each.groupBy("doc", "page", "key").agg(F.max("cell").alias("cell"), texts.alias("said")).filter("cell IS NOT NULL")
    out = whole.select("doc", "page", "cell.facts.*", "said", F.explode("cell.tables").alias("t"))
    return out.select("doc", "page", F.col("t.parent").alias("table_id"), "t.table_index", "t.seq", "row_index", "col_index", F.coalesce("row_span", F.lit(1)).alias("row_span"), F.coalesce("col_span", F.lit(1)).alias("col_span"), F.col("said").alias("text"))


def facts_type(told: DataFrame):
    """The type of a block's own facts."""
    return told.select(F.struct("type", "row_index", "col_index", "row_span", "col_span", "text").alias("f")).schema["f"].dataType
