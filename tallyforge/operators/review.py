"""Review: match types, filters, completion, statistics, report, search, navigation, validation.

reviewed: row_id, row_index, budget_item, amount, doc_id, pages, score, strategy, n_candidates,
first_name, last_name; doc_id null: no document; strategy and score: of the first candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text, vocab

LOW, MANY = 0.4, 8


def match_type() -> Column:
    """A1: the first rule that holds."""
    return (
        F.when(F.col("amount").isNull() | (F.col("amount") == 0), "zero-amount")
        .when(F.col("doc_id").isNull(), "no-pdf")
        .when(F.col("n_candidates") == 0, "none")
        .when(F.col("strategy").isin("exact", "component"), "amount")
        .when(F.col("strategy") == "cross-page", "cross-page")
        .when(F.size("pages") == 0, "none")
        .when((F.coalesce("score", F.lit(0.0)) < LOW) | F.col("strategy").isin("neighbors", "cluster"), "low-confidence")
        .when(F.size("pages") > MANY, "too-many")
        .otherwise("keyword")
    )


def sub_match_type() -> Column:
    """A2."""
    return (
        F.when(F.col("n_candidates") == 0, "none")
        .when(F.col("strategy").isin("exact", "component"), "amount")
        .when(F.col("strategy") == "cross-page", "cross-page")
        .when(F.col("score") < LOW, "low-confidence")
        .otherwise("keyword")
    )


def quality(kind: Column, score: Column) -> Column:
    """A3."""
    by_amount = F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").otherwise("partial")
    return F.when(kind.isin("amount", "cross-page"), by_amount).otherwise(F.element_at(F.create_map(*map(F.lit, ("low-confidence", "poor", "too-many", "poor", "zero-amount", "zero", "no-pdf", "no-pdf", "none", "none", "keyword", "partial"))), kind))


def viewer_quality(kind: Column) -> Column:
    """A8."""
    return F.when(kind.isin("amount", "cross-page"), "excellent").when(kind.isin("low-confidence", "too-many"), "poor").when(kind == "none", "none").otherwise("partial")


def confidence(candidates: DataFrame, least: float) -> DataFrame:
    """F6 on long candidates(row_id, rank, doc, pages, score, strategy)."""
    return candidates.filter(F.col("score") >= least)


def apply_confidence(items: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """reviewed items under a confidence slider; where all candidates fall, the document stays without pages."""
    kept = confidence(candidates, least).groupBy("row_id").agg(F.count(F.lit(1)).alias("kept"), F.min_by(F.struct("score", "strategy"), "rank").alias("best"))
    first = candidates.groupBy("row_id").agg(F.count(F.lit(1)).alias("had"), F.min_by("doc", "rank").alias("first_doc"))
    met = items.drop("score", "strategy", "n_candidates").join(first, "row_id", "left").join(kept, "row_id", "left")
    blank = F.col("kept").isNull() & (F.col("had") > 0) & F.col("first_doc").isNotNull()
    empty = F.slice("pages", 1, 0)
    return met.withColumns({"doc_id": F.when(blank, F.col("first_doc")).otherwise(F.col("doc_id")), "pages": F.when(blank, empty).otherwise(F.col("pages")), "n_candidates": F.coalesce("kept", F.lit(0)), "score": F.col("best.score"), "strategy": F.col("best.strategy")}).drop("kept", "best", "had", "first_doc")


def completion(items: DataFrame, sub_items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(row_id, payment, invoice): own evidence without sub-items, else every sub-item's.

    evidence: item_id, field, page, doc_id.
    """
    own = evidence.groupBy("item_id").agg(F.max(F.col("field") == "payment").alias("payment"), F.max(F.col("field") == "invoice").alias("invoice"))
    no = F.lit(False)
    of_subs = sub_items.join(own, sub_items["sub_item_id"] == own["item_id"], "left").groupBy("parent_row_id").agg(F.bool_and(F.coalesce("payment", no)).alias("sub_payment"), F.bool_and(F.coalesce("invoice", no)).alias("sub_invoice"))
    met = items.select("row_id").join(own, items["row_id"] == own["item_id"], "left").join(of_subs, items["row_id"] == of_subs["parent_row_id"], "left")
    return met.select("row_id", F.coalesce("sub_payment", "payment", no).alias("payment"), F.coalesce("sub_invoice", "invoice", no).alias("invoice"))


def verified_counts(sub_items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(row_id, payment, invoice) as 'n/total' of the sub-items."""
    own = evidence.groupBy("item_id").agg(F.max(F.col("field") == "payment").alias("p"), F.max(F.col("field") == "invoice").alias("i"))
    met = sub_items.join(own, sub_items["sub_item_id"] == own["item_id"], "left").groupBy(F.col("parent_row_id").alias("row_id"))
    share = lambda c: F.concat_ws("/", F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("string"), F.count(F.lit(1)).cast("string"))
    return met.agg(share("p").alias("payment"), share("i").alias("invoice"))


def review_list(items: DataFrame, candidates: DataFrame, done: DataFrame, least: float = 0.5, budget_item: str | None = None, kind: str | None = None, open_only: bool = False) -> DataFrame:
    """A4: F6, then F7, A1/F8 and F9."""
    shown = apply_confidence(items, candidates, least)
    if budget_item is not None:
        shown = shown.filter(F.col("budget_item") == budget_item)
    shown = shown.withColumn("match_type", match_type())
    if kind is not None:
        shown = shown.filter(F.col("match_type") == kind)
    if open_only:
        shown = shown.join(done.filter("payment AND invoice").select("row_id"), "row_id", "left_anti")
    return shown


def stats(items: DataFrame) -> DataFrame:
    """One row of totals (Q27: zero is exactly 0, null amounts count as non-zero)."""
    zero = F.coalesce(F.col("amount") == 0, F.lit(False))
    no_doc = ~zero & F.col("doc_id").isNull()
    matched = ~zero & F.col("doc_id").isNotNull() & (F.size("pages") > 0)
    low = (F.coalesce("score", F.lit(0.0)) < LOW) | F.coalesce(F.col("strategy").isin("neighbors", "cluster"), F.lit(False))
    sums = items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(zero).alias("zero_amount"),
        F.count_if(no_doc).alias("no_pdf"),
        F.count_if(matched).alias("matched"),
        F.count_if(F.coalesce(F.col("strategy").isin("exact", "component"), F.lit(False))).alias("amount_based"),
        F.count_if(low).alias("low_confidence"),
    )
    needing = F.col("total") - F.col("zero_amount") - F.col("no_pdf")
    return sums.withColumn("needing", needing).withColumn("match_rate", F.when(F.col("needing") > 0, F.round(F.col("matched") * 100 / F.col("needing"), 1)).otherwise(0.0))


def report_split(items: DataFrame, done: DataFrame) -> DataFrame:
    """(row_id, row_index, complete): incomplete before complete, each by row index."""
    return items.join(done, "row_id").select("row_id", "row_index", (F.col("payment") & F.col("invoice")).alias("complete"))


def report_rows(items: DataFrame, sub_items: DataFrame, done: DataFrame | None, refs: DataFrame) -> DataFrame:
    """K4: the report's lines (row_index, sub, line), one for each item and its sub-items as n.k.

    sub_items: sub_item_id, parent_row_id, ord, label, amounts; refs: item_id, field, labels (joined).
    Without done an item's status is told by refs, as completion() tells it. Sub-items meet their refs, then their
    parents, once: an item's own line comes out beside that of its first sub-item.
    """
    labels = refs.groupBy("item_id").pivot("field", ["payment", "invoice"]).agg(F.first("labels"))
    evidence = labels.select("item_id", F.col("payment").alias("payment_refs"), F.col("invoice").alias("invoice_refs"))
    blank = F.lit("")
    refs_of = lambda *cs: [F.coalesce(c, blank).alias(c) for c in cs]
    base = items.select("row_id", "row_index", "budget_item", "amount", "first_name", "last_name").join(evidence, F.col("row_id") == F.col("item_id"), "left")
    if done is not None:
        base = base.drop("item_id").join(done.select("row_id", F.col("payment").alias("paid"), F.col("invoice").alias("invoiced")), "row_id", "left")
    own = base.select("row_id", "row_index", "budget_item", "amount", "first_name", "last_name", *([F.col("payment_refs").isNotNull().alias("paid"), F.col("invoice_refs").isNotNull().alias("invoiced")] if done is None else ["paid", "invoiced"]), *refs_of("payment_refs", "invoice_refs"))
    family = Window.partitionBy("parent_row_id").orderBy("ord")
    whole = family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    subs = sub_items.join(evidence, F.col("sub_item_id") == F.col("item_id"), "left").select(
        "parent_row_id",
        F.row_number().over(family).alias("sub"),
        *(F.min(F.col(c).isNotNull()).over(whole).alias(f"sub_{c}") for c in ("payment_refs", "invoice_refs")),
        F.struct(F.coalesce(F.nullif("label", blank), "sub_item_id").alias("label"), F.col("amounts"), *refs_of("payment_refs", "invoice_refs")).alias("s"),
    )
    met = own.join(subs, F.col("row_id") == F.col("parent_row_id"), "left")
    status = (F.col("paid"), F.col("invoiced")) if done is not None else (F.coalesce("sub_payment_refs", "paid"), F.coalesce("sub_invoice_refs", "invoiced"))
    # 0: the item's own line
    nth = F.when(F.col("sub").isNull(), F.array(F.lit(0))).when(F.col("sub") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("sub"))
    each = met.select("row_index", "budget_item", "amount", "first_name", "last_name", *(c.alias(n) for c, n in zip(status, ("paid", "invoiced"))), "payment_refs", "invoice_refs", "s", F.explode(nth).alias("sub"))
    own_line, s, number = F.col("sub") == 0, F.col("s"), (F.col("row_index") + 1).cast("string")
    either = lambda of_item, of_sub: F.when(own_line, of_item).otherwise(of_sub)
    shown = each.select(
        "row_index",
        "sub",
        either(number, F.concat(number, F.lit("."), F.col("sub").cast("string"))).alias("number"),
        "budget_item",
        either(blank, s["label"]).alias("label"),
        either(text.amount_text(F.col("amount")), text.amounts_text(s["amounts"])).alias("money"),
        either(F.trim(F.concat_ws(" ", "first_name", "last_name")), blank).alias("employee"),
        *(either(F.col(c), s[r] != "").alias(c) for c, r in (("paid", "payment_refs"), ("invoiced", "invoice_refs"))),
        *(either(F.col(r), s[r]).alias(r) for r in ("payment_refs", "invoice_refs")),
    )
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "Yes").otherwise("No")
    fields = ["number", text.csv_field(F.col("budget_item")), text.csv_field(F.col("label")), "money", text.csv_field(F.col("employee")), yes("paid"), text.csv_field(F.col("payment_refs")), yes("invoiced"), text.csv_field(F.col("invoice_refs"))]
    return shown.select("row_index", "sub", F.concat_ws(",", *fields).alias("line"))


REPORT_HEADER = "Row,Budget Item,Label,Amount,Employee,Payment Status,Payment Evidence,Invoice Status,Invoice Evidence"


#: Rows of an invoice whose ids are gathered before those of a group are.
STRETCH = 4096


def _row_ids(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, row_ids, name): of each group its ids in the order of row_index, and its first row's name where rows have one.

    Ids are gathered by stretches of the invoice, anywhere, and a group puts its stretches together: it never holds its rows one by one.
    """
    first = F.min(F.struct("row_index", "name")) if "name" in items.columns else F.min(F.struct("row_index", F.lit(None).cast("string").alias("name")))
    part = items.groupBy(*keys, F.floor(F.col("row_index") / STRETCH).alias("stretch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_id"))), lambda x: x["row_id"]).alias("ids"), first.alias("first"))
    both = part.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "ids"))), lambda x: x["ids"])).alias("row_ids"), F.min("first").alias("first"))
    return both.select(*keys, "row_ids", "first.name")


def navigation(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, group_id, label, budget_item, employee_key, row_ids): by budget item, and by employee for employee items, within keys."""
    by_item = _row_ids(items.select(*keys, "budget_item", "row_index", "row_id"), *keys, "budget_item").select(*keys, text.slugify(F.col("budget_item")).alias("group_id"), F.col("budget_item").alias("label"), "budget_item", F.lit(None).cast("string").alias("employee_key"), "row_ids")
    key = text.employee_slug(F.col("first_name"), F.col("last_name"))
    named = items.filter(vocab.is_employee_item(F.col("budget_item"))).select(*keys, "budget_item", key.alias("employee_key"), "row_index", "row_id", F.concat_ws(" ", "first_name", "last_name").alias("name")).filter("employee_key <> ''")
    by_employee = _row_ids(named, *keys, "budget_item", "employee_key").select(*keys, F.concat_ws("__", text.slugify(F.col("budget_item")), "employee_key").alias("group_id"), F.concat_ws(" - ", "budget_item", "name").alias("label"), "budget_item", "employee_key", "row_ids")
    return by_item.unionByName(by_employee)


def navigation_order(groups: DataFrame, *keys: str) -> DataFrame:
    """Groups in the order of their ids, numbered by place from 1 within keys; a job has few of them.

    Groups of many jobs need keys: without any all are numbered in one place.
    """
    order = Window.partitionBy(*keys).orderBy("group_id") if keys else Window.orderBy("group_id")
    return groups.withColumn("place", F.row_number().over(order)).orderBy(*keys, "place")


def invalid_pages(selected: DataFrame, documents: DataFrame) -> DataFrame:
    """(row_id, doc_id, page, page_count): selected pages outside 1..page_count; an unknown document has none."""
    asked = selected.select("row_id", "doc_id", F.explode("pages").alias("page"))
    known = documents.select("doc_id", "page_count")
    return asked.join(known, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0))).filter((F.col("page") < 1) | (F.col("page") > F.col("page_count"))).select("row_id", "doc_id", "page", "page_count")


def search(words: DataFrame, query: str, every: bool = False) -> DataFrame:
    """(doc, page, hits): pages with words that contain any of the query's terms; with every, all terms must occur."""
    terms = [t for t in (x.strip().lower() for x in query.split(",")) if len(t) >= 2]
    low = F.lower("text")
    flags = [F.contains(low, F.lit(t)) for t in terms]
    if not terms:
        return words.select("doc", "page", F.lit(0).cast("long").alias("hits")).limit(0)
    anyhow = flags[0]
    for f in flags[1:]:
        anyhow = anyhow | f
    found = words.filter(anyhow).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("hits"), *(F.max(f).alias(f"t{i}") for i, f in enumerate(flags)))
    if every:
        for i in range(len(terms)):
            found = found.filter(F.col(f"t{i}"))
    return found.select("doc", "page", "hits")


def search_totals(found: DataFrame) -> DataFrame:
    """(doc, pages, boxes, listed): the first five page numbers, then '...'."""
    sums = found.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum("hits").alias("boxes"), F.array_sort(F.collect_list("page")).alias("all"))
    listed = F.concat(F.array_join(F.slice("all", 1, 5), ", "), F.when(F.size("all") > 5, "...").otherwise(""))
    return sums.select("doc", "pages", "boxes", listed.alias("listed"))


def job_status(jobs: DataFrame, runs: DataFrame, newest: int = 50) -> DataFrame:
    """A5: jobs(job_id) with the status of the newest run whose name contains the id; only the newest runs are looked at (Q34)."""
    recent = F.broadcast(runs.orderBy(F.desc("started_at"), "name").limit(newest))
    met = jobs.join(recent, F.contains(F.col("name"), F.col("job_id")), "left")
    return met.groupBy("job_id").agg(F.max_by("status", F.struct("started_at", "name")).alias("status"))


def as_line_item(sub_items: DataFrame, items: DataFrame) -> DataFrame:
    """Sub-items in the shape of items: own amounts, label and selection, the parent's budget item."""
    parent = items.select(F.col("row_id").alias("parent_row_id"), "row_index", "budget_item")
    amount = F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x)
    return sub_items.join(parent, "parent_row_id").select(F.col("sub_item_id").alias("row_id"), "row_index", "budget_item", amount.alias("amount"), F.col("label").alias("explanation"))


def next_suffix(n: Column) -> Column:
    """A, b, c ... by the number of sub-items."""
    return F.char(n + 97)
