"""Matching, tables, sub-items, review and sources on small fixtures."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import amounts, candidates, containment, overlays, review, scoring, subitems, tables
from tallyforge.sources import readers, sinks
from tallyforge.streaming.trigger import on_upload

ITEM = "row_id string, doc string, amount double, budget_item string, first_name string, last_name string, explanation string"
AMOUNT = "doc string, page int, pos int, value double, budget_item string"
ENT = readers.ENTITIES
PAGE = f"doc string, page int, text string, entities {ENT}"


def entity(doc_type="unknown", people=(), orgs=(), values=()):
    return (None, doc_type, [(f"{f} {l}", f, l) for f, l in people], list(orgs), [], [], [(str(v), float(v), "USD", "", None, None, None) for v in values], [])


@pytest.mark.parametrize("values, target, score, size", [([100.0], 100.0, 0.95, 1), ([50.0, 75.0, 25.0], 150.0, 0.85, 3), ([88.25, 30.0, 1486.91], 1605.16, 0.85, 3), ([6000.0, 7000.0], 13000.0, None, 0), ([0.05], 0.06, 0.95, 1), ([100.01], 100.0, None, 0)])
def test_amount_scores(spark, values, target, score, size):
    items = spark.createDataFrame([("r", "d", target, "Supplies", None, None, None)], ITEM)
    vals = spark.createDataFrame([("d", 9, i, v, None) for i, v in enumerate(values)], AMOUNT)
    got = amounts.amount_page_scores(items, vals).collect()
    assert [(r["score"], len(r["values"])) for r in got] == ([] if score is None else [(score, size)])


def test_first_sum_equals_combinations(spark):
    random.seed(3)
    rows, want = [], {}
    for g in range(60):
        values = [random.randint(1, 30) / 4 for _ in range(random.randint(1, 7))]
        target = random.randint(4, 60) / 4
        rows += [(g, target, p, v) for p, v in enumerate(values)]
        hit = next((c for n in (2, 3, 4) for c in itertools.combinations(range(len(values)), n) if abs(sum(values[i] for i in c) - target) < 0.01), None)
        if hit:
            want[g] = list(hit)
    got = amounts.first_sum(spark.createDataFrame(rows, "g int, target double, pos int, value double"), ("g",), "pos")
    assert {r["g"]: r["positions"] for r in got.collect()} == want


def test_other_budget_items_stay_out(spark):
    items = spark.createDataFrame([("r", "d", 30.0, "Supplies", None, None, None)], ITEM)
    vals = spark.createDataFrame([("d", 1, 0, 10.0, "Salary"), ("d", 1, 1, 20.0, None), ("d", 2, 0, 10.0, None), ("d", 2, 1, 20.0, "Supplies")], AMOUNT)
    assert [r["page"] for r in amounts.component_hits(items, vals).collect()] == [2]


def people_score(spark, item, people, doc_type="timecard", values=()):
    items = spark.createDataFrame([("r", "d", item[2], "Salary", item[0], item[1], None)], ITEM)
    pages = spark.createDataFrame([("d", 1, "", entity(doc_type, people, values=values))], PAGE)
    return scoring.employee_scores(items, pages).first()


def test_employee_scores(spark):
    assert people_score(spark, ("John", "Doe", 5.0), [("John", "Doe")])["score"] == pytest.approx(0.85)
    got = people_score(spark, ("John", "Doe", 5.0), [("Jane", "Smith")], "unknown")
    assert got["score"] == 0 and got["rationale"] == ["No matching person"]
    assert people_score(spark, ("J", "Doe", 5.0), [("John", "Doe")])["score"] == pytest.approx(0.60)
    assert people_score(spark, ("John", None, 5.0), [("John", "Doe")])["score"] == 0
    john = people_score(spark, ("John", "Smith", 5000.0), [("John", "Smith")], values=[5000])["score"]
    jane = people_score(spark, ("Jane", "Smith", 6000.0), [("John", "Smith")], values=[5000])["score"]
    assert john >= 0.9 and john > jane + 0.3 and jane < 0.65
    # a later person adds first-name evidence whatever the last name, an earlier one doesn't
    assert people_score(spark, ("Ann", "Doe", 1.0), [("Bob", "Doe"), ("Ann", "Roe")])["score"] == pytest.approx(0.35 + 0.30 + 0.10)
    assert people_score(spark, ("Ann", "Doe", 1.0), [("Ann", "Roe"), ("Bob", "Doe")])["score"] == pytest.approx(0.45)


def test_proximity_counts(spark):
    items = spark.createDataFrame([("r", "d", 1.0, "Salary", "John", "Doe", None)], ITEM)
    pages = spark.createDataFrame([("d", 1, "", entity("timecard", [("John", "Doe")])), ("d", 2, "", entity("timecard", [("John", "Doe")]))], PAGE)
    words = spark.createDataFrame([("d", 1, 0, "John,", 0.1, 0.5, 0.05, 0.02), ("d", 1, 1, "Doe", 0.2, 0.5, 0.05, 0.02), ("d", 2, 0, "John", 0.1, 0.1, 0.05, 0.02), ("d", 2, 1, "Doe", 0.1, 0.9, 0.05, 0.02)], "doc string, page int, pos int, text string, left double, top double, width double, height double")
    got = {r["page"]: r["score"] for r in scoring.employee_scores(items, pages, words).collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(0.65)


def test_keyword_scores(spark):
    items = spark.createDataFrame([("r", "d", 1.0, "Insurance", None, None, "Acme liability insurance plan")], ITEM)
    pages = spark.createDataFrame([("d", 1, "ACME Liability", entity("invoice", orgs=["Acme, Inc", "ACME"])), ("d", 2, "", entity())], PAGE)
    got = {r["page"]: r["score"] for r in scoring.keyword_scores(items, pages).collect()}
    assert got == {1: pytest.approx(0.10 + 0.15 + 0.10), 2: 0.0}


def test_clusters_and_neighbours(spark):
    scores = spark.createDataFrame([("r", "d", p, 0.5 if p in (1, 2, 5, 6, 7, 9) else 0.0) for p in range(1, 11)], "row_id string, doc string, page int, score double")
    assert [r["pages"] for r in candidates.clusters(scores).orderBy("nth").collect()] == [[1, 2], [5, 6, 7]]
    near = candidates.top_neighbours(scores).first()
    assert near["pages"] == [1, 2, 3, 4, 5, 6, 7, 8] and near["score"] == pytest.approx(0.45)


def test_three_pages(spark):
    items = spark.createDataFrame([("r", "d", 5000.0, "Salary", "John", "Doe", None)], ITEM)
    pages = spark.createDataFrame([("d", 1, "", entity("timecard", [("John", "Doe")])), ("d", 2, "", entity("paystub", [("John", "Doe")])), ("d", 3, "", entity("timecard", [("John", "Smith")]))], PAGE)
    vals = spark.createDataFrame([], AMOUNT)
    best = candidates.generate(items, pages, vals).orderBy("rank").first()
    assert {1, 2} <= set(best["pages"]) and best["score"] > 0.7
    chosen = candidates.select_default(items, pages, candidates.generate(items, pages, vals)).first()
    assert chosen["doc_id"] == "d" and set(chosen["pages"]) == set(best["pages"])


CELL = "doc string, page int, table_id string, table_index int, seq int, row_index int, col_index int, row_span int, col_span int, text string"


def test_association(spark):
    cells = spark.createDataFrame([("d", 1, "t", 0, 0, 7, 1, 1, 1, "Salary"), ("d", 1, "t", 0, 1, 7, 3, 1, 1, "2.68\n72.00\n20.60"), ("d", 1, "t", 0, 2, 8, 1, 1, 1, "unrelated"), ("d", 1, "t", 0, 3, 8, 3, 1, 1, "72.00"), ("d", 1, "t", 0, 4, 9, 1, 1, 1, "Office Supplies")], CELL)
    raws = spark.createDataFrame([("d", 1, i, r) for i, r in enumerate(("2.68", "72.00", "20.60", "999.99"))], "doc string, page int, pos int, raw string")
    got = {r["raw"]: (r["table_row_index"], r["budget_item"], r["source"]) for r in tables.associate(raws, cells).collect()}
    assert got == {"2.68": (7, "Salary", "table_row"), "72.00": (8, "Other", "table_row"), "20.60": (9, "Supplies", "table_row"), "999.99": (None, "d", "page_default")}
    assert tables.cell_at(cells, 7, 3).first()["text"].startswith("2.68")
    # the second table comes before the eleventh, whatever their names
    two = spark.createDataFrame([("d", 1, "t10", 10, 0, 1, 1, 1, 1, "Supplies"), ("d", 1, "t10", 10, 1, 1, 2, 1, 1, "5.00"), ("d", 1, "t2", 2, 0, 1, 1, 1, 1, "Salary"), ("d", 1, "t2", 2, 1, 1, 2, 1, 1, "5.00")], CELL)
    assert tables.associate(spark.createDataFrame([("d", 1, 0, "5.00")], "doc string, page int, pos int, raw string"), two).first()["budget_item"] == "Salary"


def test_blocks(spark):
    blocks = [("t", "TABLE", None, None, None, ["c1", "c2"]), ("c1", "CELL", 1, 1, None, ["w2", "w1"]), ("c2", "CELL", 2, 1, None, []), ("w1", "WORD", None, None, "Costs", []), ("w2", "WORD", None, None, "Salary", [])]
    df = spark.createDataFrame([("d", 1, n, i, k, r, c, None, None, t, ch) for n, (i, k, r, c, t, ch) in enumerate(blocks)], "doc string, page int, ord int, id string, type string, row_index int, col_index int, row_span int, col_span int, text string, child_ids array<string>")
    cells = tables.resolve_blocks(df)
    assert [(r["row_index"], r["text"]) for r in cells.orderBy("seq").collect()] == [(1, "Salary Costs"), (2, "")]
    assert {r["row_index"]: r["budget_item"] for r in tables.row_budgets(cells).collect()}[1] == "Salary"


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_and_amounts_are_sent_once(spark):
    """both sides by page, nothing after."""
    cells = spark.createDataFrame([("d", 1, "t", 0, 0, 7, 1, 1, 1, "Salary"), ("d", 1, "t", 0, 1, 7, 3, 1, 1, "5.00")], CELL)
    raws = spark.createDataFrame([("d", 1, 0, "5.00"), ("d", 1, 1, None), (None, 1, 0, "5.00")], "doc string, page int, pos int, raw string")
    found = tables.associate(raws, cells)
    assert _shuffles(found) <= 2
    assert {tuple(r)[4:] for r in found.collect()} == {("Salary", "table_row", 7), ("d", "page_default", None), (None, "page_default", None)}


def test_blocks_are_sent_once(spark):
    """words listed by two cells, cells listed by two tables, an id that isn't there, a page without tables."""
    kind = "doc string, page int, ord int, id string, type string, row_index int, col_index int, row_span int, col_span int, text string, child_ids array<string>"
    rows = [("t1", "TABLE", None, ["c1", "c2", "gone"]), ("c1", "CELL", None, ["w1", "w2", "gone"]), ("c2", "CELL", None, ["w2"]), ("x", None, None, ["c1"]), ("w1", "WORD", "a", None), ("w2", "WORD", "b", None), ("t2", "TABLE", None, ["c2"])]
    blocks = [("d", 1, n, i, k, 1, 1, None, 2, t, ch) for n, (i, k, t, ch) in enumerate(rows)] + [("d", 2, 0, "c1", "CELL", 1, 1, 1, 1, None, ["w1"])]
    found = tables.resolve_blocks(spark.createDataFrame(blocks, kind))
    assert _shuffles(found) == 1
    assert {(r["page"], r["table_id"], r["table_index"], r["seq"], r["row_span"], r["col_span"], r["text"]) for r in found.collect()} == {(1, "t1", 0, 0, 1, 2, "a b"), (1, "t1", 0, 1, 1, 2, "b"), (1, "t2", 1, 0, 1, 2, "b")}


def test_near_duplicate_classes(spark, monkeypatch):
    """copies are compared as one; all pairs are the same as those of a comparison of everything."""
    random.seed(9)
    base = [random.sample([f"w{i}" for i in range(60)], 20) for _ in range(6)]
    said = [w if k == 0 else w[k:] + [f"x{k}"] if k < 4 else list(reversed(w)) for w in base for k in range(6)] + [[]]
    pages = spark.createDataFrame([(d, p + 1, " ".join(w)) for d in "ab" for p, w in enumerate(said)], "doc string, page int, text string")
    stored, cut = [], subitems.cut
    monkeypatch.setattr(subitems, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    sources = pages.filter("page % 2 = 1").select(F.concat_ws("#", "doc", "page").alias("row_id"), "doc", F.col("page").alias("source_page"))
    got = {(r["row_id"], r["page"]): round(r["similarity"], 9) for r in subitems.near_duplicate_pages(sources, pages).collect()}
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    want = {(f"{d}#{p + 1}", q + 1): round(s, 9) for d in "ab" for p, a in enumerate(said) for q, b in enumerate(said) if p % 2 == 0 and (s := alike(a, b)) >= 0.85}
    assert got == want and len(want) > len(said)
    # of three copies of a set one is compared, and no token is listed but the rare ones
    classes = next(df for df in stored if df.columns == ["doc", "class", "words"])
    assert classes.count() == 2 * len({frozenset(w) for w in said if w})


def test_recovery_and_filters(spark):
    pages = spark.createDataFrame([("d", p, "granite telecom $72.00" if p == 3 else f"telecom page {p}") for p in range(1, 13)], "doc string, page int, text string")
    tokens = spark.createDataFrame([("d", "granite"), ("d", "telecom")], "doc string, token string")
    assert [r["token"] for r in subitems.filter_tokens(tokens, pages).collect()] == ["granite"]
    cands = spark.createDataFrame([("r", "d", 1, [4], 0.5, "cluster"), ("r", "d", 2, [3], 0.6, "strong")], "row_id string, doc string, ordinal int, pages array<int>, score double, strategy string")
    assert [r["ordinal"] for r in subitems.filter_by_row_texts(cands, tokens, pages).collect()] == [2]
    asked = spark.createDataFrame([("r", "d", 72.0)], "row_id string, doc string, amount double")
    got = subitems.recover_combined(asked, cands, pages, spark.createDataFrame([], AMOUNT), tokens).collect()
    assert {(tuple(r["pages"]), r["score"]) for r in got} == {((3,), 0.95), ((4,), 0.5)}


def test_overlays(spark):
    cands = spark.createDataFrame([("r", 0, [1, 2], 0.9), ("r", 1, [3], 0.5)], "row_id string, idx int, pages array<int>, score double")
    log = spark.createDataFrame([("r", 0, "add", 5, 1), ("r", 0, "remove", 1, 2), ("r", 1, "remove", 3, 3), ("r", 2, "add", 8, 4)], "row_id string, idx int, op string, page int, seq int")
    got = {r["idx"]: (r["pages"], r["score"]) for r in overlays.edit_pages(cands, log).collect()}
    assert got == {0: ([2, 5], 0.9), 2: ([8], None)}
    jobs = spark.createDataFrame([("j", "old")], "job_id string, job_name string")
    names = spark.createDataFrame([("j", " new ", 1), ("j", " ", 2), ("k", "x", 3)], "job_id string, job_name string, seq int")
    assert [tuple(r) for r in overlays.rename_jobs(jobs, names).collect()] == [("j", "new")]


def test_virtual_pages(spark):
    files = amounts.page_offsets(spark.createDataFrame([("d", "att.pdf", 5), ("d", "verizon.pdf", 3)], "doc string, path string, page_count int"))
    refs = spark.createDataFrame([("d", p) for p in (0, 1, 5, 6, 8, 9)], "doc string, page int")
    got = {r["page"]: (r["path"], r["local_page"]) for r in amounts.resolve_pages(refs, files).collect()}
    assert got == {0: (None, None), 1: ("att.pdf", 1), 5: ("att.pdf", 5), 6: ("verizon.pdf", 1), 8: ("verizon.pdf", 3), 9: (None, None)}


def test_invoice_csv(spark, tmp_path):
    plain = tmp_path / "a.csv"
    plain.write_text('﻿Budget Item,Amount,Employee First Name,Employee Last Name,Memo\nSALARY_TOTAL,"$5,000.00",John,Doe,m\nSupplies,,,,\n', encoding="utf-8")
    rows = readers.read_invoice(spark, str(plain)).orderBy("row_index").collect()
    assert [(r["budget_item"], r["amount"] and str(r["amount"]), r["employee_last_name"]) for r in rows] == [("Salary", "5000.00", "Doe"), ("Supplies", None, None)]
    assert rows[0]["raw"]["memo"] == "m" and rows[0]["row_id"].startswith("row_0_")
    odd = tmp_path / "b.csv"
    odd.write_text("Report\nfor May\nBudget Item,Amount\nFringe,10.5\n")
    assert [(r["row_index"], r["budget_item"]) for r in readers.read_invoice(spark, str(odd)).collect()] == [(0, "Fringe")]
    broken = tmp_path / "c.csv"
    broken.write_text('Report\nBudget Item,Amount,Explanation\nSalary,"1,000.00","two\nlines, ""quoted"""\nFringe,5,x\n')
    got = [(r["row_index"], r["budget_item"], r["amount"] and str(r["amount"]), r["explanation"]) for r in readers.read_invoice(spark, str(broken)).orderBy("row_index").collect()]
    assert got == [(0, "Salary", "1000.00", 'two\nlines, "quoted"'), (1, "Fringe", "5.00", "x")]
    none = tmp_path / "d.csv"
    none.write_text("")
    assert readers.read_invoice(spark, str(none)).count() == 0


def test_stores_and_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("a", 2, "pymupdf", "x", None, None), ("a", 1, "textract", "y", None, None), ("b", 1, "pymupdf", "z", None, None)], readers.PAGE)
    sinks.write_page_store(pages, str(tmp_path / "s"))
    assert [r["page_number"] for r in readers.stored_pages(spark, str(tmp_path / "s"), "a").collect()] == [1, 2]
    sinks.write_pages(pages, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert readers.read_edits(spark, str(tmp_path / "none.json")).count() == 0
    hashed = overlays.with_hashes(pages)
    assert overlays.stale(hashed, hashed.filter("doc_id = 'a'"), ["doc_id", "page_number"], "text_sha256").count() == 1
    job = spark.createDataFrame([("j", "a.csv"), ("k", "b.csv")], "job_id string, inputs string")
    docs = spark.createDataFrame([("j", "d", 1)], "job_id string, doc_id string, page_count int")
    groups = spark.createDataFrame([("j", "g", ["r"])], "job_id string, group_id string, row_ids array<string>")
    items = spark.createDataFrame([("j", 1, "é"), ("j", 0, None), ("k", 0, "x")], "job_id string, row_index int, label string")
    made = {r["job_id"]: r["value"] for r in sinks.reconciliation_json(job, docs, groups, items).collect()}
    assert '"line_items":[{"row_index":0,"label":null},{"row_index":1,"label":"é"}]' in made["j"]
    assert made["k"] == '{"job":{"job_id":"k"},"inputs":"b.csv","documents":[],"navigation_groups":[],"line_items":[{"row_index":0,"label":"x"}]}'


def test_tiers(spark):
    cfg = readers.EngineConfig()
    df = spark.createDataFrame([("x" * 40, True), ("x" * 39, True), ("x" * 39, False)], "t string, ok boolean")
    got = [r[0] for r in df.select(readers.extraction_tier(cfg, F.lit(0), F.col("ok"), F.col("t"))).collect()]
    assert got == ["pymupdf", "textract", "pymupdf"]


def test_extractor_hook(spark):
    class Upper:
        def extract(self, pages):
            return pages.assign(text=pages["text"].str.upper())

    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    assert readers.extracted(df, Upper(), "doc_id string, text string").first()["text"] == "X"


def test_discovery(spark):
    df = spark.createDataFrame([("Salary/b.pdf",), ("salary.pdf",), ("Supplies.pdf",), ("other/readme.txt",), ("nothing.pdf",)], "path string")
    assert {(r["doc_id"], r["path"]) for r in readers.discovered(df).collect()} == {("salary__b", "Salary/b.pdf"), ("supplies", "Supplies.pdf")}


def test_trigger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"row_id": "r1"}\n')
    seen = []
    for _ in range(2):
        on_upload(spark, str(tmp_path / "in"), lambda df, i: seen.append([r["row_id"] for r in df.collect()]), str(tmp_path / "c")).awaitTermination()
    assert seen == [["r1"]]


def test_review_search(spark):
    words = spark.createDataFrame([("d", 1, "The"), ("d", 1, "cat"), ("d", 2, "other")], "doc string, page int, text string")
    assert {(r["page"], r["hits"]) for r in review.search(words, "the").collect()} == {(1, 1), (2, 1)}
    assert [r["page"] for r in review.search(words, "the,cat", every=True).collect()] == [1]
    assert review.search(words, "x").count() == 0


def test_reconcile(spark):
    from tallyforge.plans.reconcile import reconcile

    items = spark.createDataFrame([("r0", 0, "d", "Supplies", 150.0, None, None, "paper"), ("r1", 1, "d", "Supplies", 0.0, None, None, None), ("r2", 2, "none", "Salary", 5.0, "John", "Doe", None)], "row_id string, row_index int, doc string, budget_item string, amount double, first_name string, last_name string, explanation string")
    pages = spark.createDataFrame([("d", 1, "paper", entity("invoice", values=[7.0])), ("d", 2, "", entity(values=[100.0, 50.0]))], PAGE)
    overrides = spark.createDataFrame([("r1", "d", [1], 1)], "row_id string, doc_id string, pages array<int>, seq int")
    done = reconcile(items, pages, overrides=overrides)
    got = {r["row_id"]: (r["doc_id"], r["pages"], r["selection_source"]) for r in done.selected.collect()}
    assert got == {"r0": ("d", [2], "auto"), "r1": ("d", [1], "user"), "r2": (None, [], "auto")}
    assert {r["group_id"] for r in done.navigation.collect()} == {"supplies", "salary", "salary__john_doe"}
    # the item's amount is a sum of the page's, so its parts are shown, not the amount itself
    words = spark.createDataFrame([("d", 2, 0, "100.00", 0.1, 0.1, 0.1, 0.1), ("d", 2, 1, "$50.00", 0.3, 0.1, 0.1, 0.1), ("d", 2, 2, "150.00", 0.1, 0.1, 0.1, 0.1), ("d", 1, 0, "100.00", 0.1, 0.1, 0.1, 0.1)], "doc string, page int, pos int, text string, left double, top double, width double, height double")
    marks = candidates.highlights(done.candidates.filter("rank = 1"), items, words).collect()
    assert [(m["row_id"], m["page"], len(m["boxes"])) for m in marks] == [("r0", 2, 2)]


def test_component_highlights(spark):
    """FX3: 88.25 + 30.00 + 1486.91 against 1605.16: one candidate, three boxes on page 9, in the job's document too."""
    from tallyforge.plans.reconcile import reconcile

    items = spark.createDataFrame([("r", 0, "t", "Supplies", 1605.16, None, None, "Test supplies", "j")], "row_id string, row_index int, doc string, budget_item string, amount double, first_name string, last_name string, explanation string, job_id string")
    pages = spark.createDataFrame([("t", 9, "Invoice components: $88.25, $30.00, $1486.91", entity(values=[88.25, 30.0, 1486.91]))], PAGE)
    words = spark.createDataFrame([("t", 9, i, w, 0.1 * (i + 1), 0.2, 0.05, 0.02) for i, w in enumerate(("$88.25", "$30.00", "$1486.91", "other"))], "doc string, page int, pos int, text string, left double, top double, width double, height double")
    jobs = spark.createDataFrame([("j", "x.csv")], "job_id string, inputs string")
    done = reconcile(items, pages, words, jobs=jobs)
    first = done.candidates.filter("rank = 1").first()
    assert first["score"] == 0.85 and [(e["page"], e["value"]) for e in first["evidence"]] == [(9, 88.25), (9, 30.0), (9, 1486.91)]
    job = json.loads(done.documents.first()["value"])
    made = job["line_items"][0]["candidates"][0]
    assert made["rationale"] == ["Amount-based match", "Component match: $88.25 + $30.00 + $1486.91 = $1605.16", "Multiple amounts sum to target"]
    assert [(b["left"], b["top"]) for b in made["highlights"]["9"]] == [(0.1, 0.2), (0.2, 0.2), (pytest.approx(0.3), 0.2)]
    shown = job["documents"][0]["pages_data"]["9"]
    assert [w["text"] for w in shown["words"]] == ["$88.25", "$30.00", "$1486.91", "other"] and shown["text"].startswith("Invoice")


def test_highlights_only_where_asked(spark, monkeypatch):
    """A selection makes no highlights; what is stored for them is a row a candidate, not one a page and term."""
    from tallyforge.plans.reconcile import reconcile

    items = spark.createDataFrame([("r", 0, "d", "Salary", 5.0, "John", "Doe", None)], "row_id string, row_index int, doc string, budget_item string, amount double, first_name string, last_name string, explanation string")
    pages = spark.createDataFrame([("d", p, "x", entity("invoice", [("John", "Doe")])) for p in range(1, 21)], PAGE)
    words = spark.createDataFrame([("d", p, i, w, 0.1 * i, 0.1, 0.1, 0.1) for p in range(1, 21) for i, w in enumerate(("John", "Doe", "John", "Doe", "$5.00"))], "doc string, page int, pos int, text string, left double, top double, width double, height double")
    stored, cut = [], candidates.cut
    done = reconcile(items, pages, words)
    monkeypatch.setattr(candidates, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    assert done.selected.count() == 1 and not stored
    marks = {(m["ordinal"], m["page"]): [b["pos"] for b in m["boxes"]] for m in done.highlights.collect()}
    shown = {(c["ordinal"], p) for c in done.candidates.collect() for p in c["pages"]}
    # single words wherever they stand, the phrase where it stands first, the amount
    assert shown and set(marks) == shown and set(map(tuple, marks.values())) == {(0, 0, 1, 2, 3, 4)}
    assert sum(df.count() for df in stored) == done.candidates.count()


def test_cross_page_evidence(spark):
    items = spark.createDataFrame([("r", "d", 60.0, "Supplies", None, None, None)], ITEM)
    vals = spark.createDataFrame([("d", p, i, v, None) for p, vs in ((1, [5.0, 10.0]), (2, [20.0]), (3, [30.0]), (4, [1.0])) for i, v in enumerate(vs)], AMOUNT)
    got = amounts.amount_route(items, vals).first()
    assert (got["pages"], got["strategy"], [tuple(e) for e in got["evidence"]]) == ([1, 2, 3], "cross-page", [(1, 10.0), (2, 20.0), (3, 30.0)])
    closed = spark.createDataFrame([("r", "d", 3)], "row_id string, doc string, page int")
    assert amounts.amount_route(items, vals, closed).count() == 0


def test_containment_equals_contains(spark):
    """Terms and texts of all lengths, without a pair of them compared but through their grams."""
    random.seed(5)
    word = lambda n: "".join(random.choice("abé1") for _ in range(n))
    terms = {(d, word(random.randint(1, 6))) for d in "xy" for _ in range(60)} | {("x", ""), ("z", "a")}
    texts = {(d, word(random.randint(0, 12))) for d in "xy" for _ in range(80)}
    got = containment.containing(spark.createDataFrame(sorted(terms), "doc string, term string"), spark.createDataFrame(sorted(texts), "doc string, held string"))
    assert {tuple(r) for r in got.collect()} == {(d, t, h) for d, t in terms for e, h in texts if d == e and t and t in h}
    none = spark.createDataFrame([], "doc string, term string")
    assert containment.containing(none, spark.createDataFrame(sorted(texts), "doc string, held string")).count() == 0


def test_tokens_across_white_space(spark):
    """Letters and digits may stand apart on the page."""
    pages = spark.createDataFrame([("d", 1, "see PP 21 and q3x"), ("d", 2, "pp21"), ("d", 3, "pp 2 1"), ("d", 4, None), ("d", 5, "q\n3 x")], "doc string, page int, text string")
    tokens = spark.createDataFrame([("d", "pp21"), ("d", "q3x"), ("d", "nd"), ("d", "zz")], "doc string, token string")
    got = {(r["token"], r["page"]) for r in subitems.token_pages(tokens, pages).collect()}
    low = pages.crossJoin(tokens.drop("doc")).filter(text.token_in_page(F.col("token"), F.lower("text")))
    assert got == {(r["token"], r["page"]) for r in low.collect()} == {("pp21", 1), ("pp21", 2), ("q3x", 1), ("q3x", 5), ("nd", 1)}


def test_amounts_in_texts(spark):
    """D.dd anywhere, $d where it is whole, neither of which has to be an entity; closed pages don't count."""
    said = ["telecom granite 172.00", "granite $72", "granite $ 72.", "granite $720", "granite 1.234.72.00", "granite -72.00", "telecom"] + ["telecom"] * 80
    pages = spark.createDataFrame([("d", p + 1, t) for p, t in enumerate(said)], "doc string, page int, text string")
    tokens = spark.createDataFrame([("r", "d", "granite"), ("r", "d", "telecom")], "row_id string, doc string, token string")
    none = spark.createDataFrame([], "row_id string, doc string, ordinal int, pages array<int>, score double, strategy string")
    asked = spark.createDataFrame([("r", "d", 72.0)], "row_id string, doc string, amount double")
    closed = spark.createDataFrame([("r", "d", 6)], "row_id string, doc string, page int")
    got = subitems.recover_combined(asked, none, pages, spark.createDataFrame([], AMOUNT), tokens, closed)
    assert sorted(r["pages"][0] for r in got.collect()) == [1, 2, 5]


def test_scores_are_sparse(spark):
    """Pages without evidence are no rows; asked for page by page they are 0."""
    items = spark.createDataFrame([("r", "d", 1.0, "Insurance", None, None, "liability plan")], ITEM)
    pages = spark.createDataFrame([("d", p, "liability" if p == 7 else "none", entity()) for p in range(1, 21)], PAGE)
    assert [(r["page"], r["score"]) for r in scoring.routed_scores(items, pages).collect()] == [(7, pytest.approx(0.05))]
    assert scoring.keyword_scores(items, pages).count() == 20
    near = [r for r in candidates.generate(items, pages, spark.createDataFrame([], AMOUNT)).collect() if r["strategy"] == "neighbors"]
    assert [r["pages"] for r in near] == [[6, 7, 8]]


def test_pages_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(amounts, "STRETCH", 4)
    files = [("d", f"f{i:02}", n) for i, n in enumerate((3, 0, 1, 9, 4, 2))] + [("e", "g", 5)]
    offsets, refs, want = amounts.page_offsets(spark.createDataFrame(files, "doc string, path string, page_count int")), [], {}
    for doc in "de":
        at = 1
        for _, path, n in (f for f in files if f[0] == doc):
            want |= {(doc, at + k): (path, k + 1) for k in range(n)}
            at += n
        refs += [(doc, p) for p in range(-1, at + 3)]
    refs += [("d", None), (None, 1), ("d", 2)]
    got = amounts.resolve_pages(spark.createDataFrame(refs, "doc string, page int"), offsets).collect()
    assert len(got) == len(refs) and all((r["path"], r["local_page"]) == want.get((r["doc"], r["page"]), (None, None)) for r in got)


def test_incremental_run(spark, tmp_path):
    """Only changed buckets are written again; a repeated batch, one without changes and one that failed halfway end alike."""
    from tallyforge.streaming.incremental import IncrementalRun

    items = spark.createDataFrame([(f"r{i}", f"d{i}", 10.0, "Supplies", None, None, "paper") for i in range(12)], ITEM)
    page = lambda i, *values, text="": (f"d{i}", 1, text, entity(values=values))
    make = lambda *rows: spark.createDataFrame(list(rows), PAGE)
    run = IncrementalRun(f"file://{tmp_path}/s", items, buckets=4)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("part-*.parquet")}
    found = lambda: {r["row_id"]: (r["strategy"], r["pages"]) for r in run.candidates(spark).filter("rank = 1").collect()}
    run(make(*(page(i, 10.0) for i in range(12))), 0)
    assert found() == {f"r{i}": ("exact", [1]) for i in range(12)}
    before = files()
    run(make(page(3, 10.0), page(4, 10.0)), 1)
    run(make(page(3, 99.0)), 0)
    assert files() == before
    change = make(page(3, 4.0, 6.0), page(3, 4.0, 6.0))
    run(change, 2)
    after = files()
    same = {p for p in before if after.get(p) == before[p]}
    buckets = {p.parent.name for p in set(after) - set(before)}
    assert len(buckets) == 1 and {p.parent.name for p in same}.isdisjoint(buckets) and len(same) > 0
    assert found() == {f"r{i}": ("component" if i == 3 else "exact", [1]) for i in range(12)}
    # a document whose candidates all go leaves none behind
    run(make(*(page(i, 1.0) for i in range(12))), 3)
    assert found() == {}
    # results were written, pages and the batch's id not: the batch runs again
    failing = IncrementalRun(run.folder, items, buckets=4)
    plain = failing._replace
    failing._replace = lambda rows, name: plain(rows, name) if name == "results" else (_ for _ in ()).throw(OSError("lost"))
    again = make(page(5, 10.0))
    with pytest.raises(OSError):
        failing(again, 4)
    run(again, 4)
    assert found() == {"r5": ("exact", [1])}
    full = candidates.generate(items, make(*(page(i, 10.0 if i == 5 else 1.0) for i in range(12))), spark.createDataFrame([(f"d{i}", 1, 0, 10.0 if i == 5 else 1.0, None) for i in range(12)], AMOUNT))
    assert {r["row_id"]: (r["strategy"], r["pages"]) for r in full.filter("rank = 1").collect()} == found()


def test_edit_stream_equals_batch(spark, tmp_path):
    """Keys with nulls, an edit that comes late, a repeated batch; only touched buckets are written again."""
    from tallyforge.streaming import edits

    schema = "row_id string, page int, op string, seq int"
    first = spark.createDataFrame([("a", 1, "add", 5), ("b", None, "add", 2), (None, 3, "add", 1)] + [(f"k{i}", i, "add", 0) for i in range(30)], schema)
    second = spark.createDataFrame([("a", 1, "remove", 4), ("b", None, "remove", 9), ("c", 2, "add", 7)], schema)
    key, folder = ["row_id", "page"], f"file://{tmp_path}"
    table = edits.KeyedTable(f"{folder}/t", key, buckets=8)
    state = lambda log: edits.last_edits(log, key, "seq")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}
    for rows in (first, second):
        before = files() if (tmp_path / "t").exists() else {}
        rows.coalesce(1).write.mode("append").json(f"{folder}/log")
        edits.follow(spark, f"{folder}/log", schema, state, table, f"{folder}/c").awaitTermination()
    assert set(before) & set(files())
    rows = lambda df: sorted(map(tuple, df.select("row_id", "page", "op", "seq").collect()), key=str)
    assert rows(table.read(spark)) == rows(state(first.union(second)))
    table(state(first.union(second)), 99)
    assert rows(table.read(spark)) == rows(state(first.union(second)))
    on = {r["row_id"]: r["on"] for r in edits.toggle_counts(first.union(second), ["row_id"]).collect()}
    assert not on["a"] and on["c"] and not on["b"]


def test_spark_plans_of_views_give_their_rows(spark, tmp_path):
    """Orders without lines or a customer, and lines without an order or a part; an order that two customers have is a tie that the SQL leaves open."""
    import duckdb

    from tallyforge.plans import views

    orders = [(k, c, 100.0 * k) for k, c in ((1, 1), (2, 1), (3, 1), (4, 2), (5, None), (6, 2), (8, 2), (9, 1), (14, 1))]
    lines = [(k, n, p, n + k, float(n), 91.37 * n + k, 0.1, 0.0) for k, ns in ((1, 3), (3, 2), (4, 1), (5, 2), (6, 2), (7, 1), (8, 5), (9, 2), (14, 1)) for n in range(1, ns + 1) for p in (n % 4,)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").selectExpr("*", "date'1995-01-01' AS l_shipdate").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "red pin", "B1"), (2, "nut", "B2"), (0, "cap", None)], "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("page_amounts", "page_texts", "page_word_texts", "items"):
        views.free()
        con.register("got", views.view(spark, str(tmp_path), name).toArrow())
        con.execute(f"CREATE OR REPLACE TABLE want AS {views.with_views(name)} SELECT * FROM {name}")
        cols = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE want").fetchall())
        for a, b in (("got", "want"), ("want", "got")):
            assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == [], name


def test_views_are_kept_only_where_asked(spark):
    """Words are many times their texts: search over them keeps nothing."""
    from tallyforge.plans import queries, views

    views.free()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    queries.search_any(spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("name", ["search_all", "proximity_score"])
def test_searches_read_texts_not_kept_words(spark, name):
    """a task reads its part of the texts, and of its shuffle few rows a document."""
    from tallyforge.plans import queries, registry  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "FileScan parquet" in plan


def test_sums_leave_out_what_cannot_be_reached(spark):
    """Brute force on places with negative, equal and missing values, foreign owners and pages that are gone; few rows go to the joins."""
    import itertools
    import random

    rng, rows, goals = random.Random(5), [], []
    for doc in range(12):
        for page in range(3):
            rows += [(doc, page, i, rng.choice([None, -4.25, 0.0, 3.1, 7.77, 12.5, round(rng.uniform(-9, 30), 2)]), rng.choice([None, None, "a", "b"])) for i in range(rng.randint(1, 8))]
        own_values = [v for d, _, _, v, _ in rows if d == doc and v is not None]
        goals += [(doc, own, round(sum(rng.sample(own_values, min(len(own_values), n))), 2)) for own in ("a", "c") for n in (2, 3, 3, 4, 4)] + [(doc, "a", t) for t in (10.87, 23.37, 15.6)]
    want = set()
    for doc, own, target in set(goals):
        for page in range(3):
            here = [(p, v) for d, g, p, v, o in rows if (d, g) == (doc, page) and v is not None and o in (None, own)]
            for n in (2, 3, 4):
                found = [tuple(p for p, _ in c) for c in itertools.combinations(here, n) if abs(sum(v for _, v in c) - target) < 0.01]
                if found:
                    want.add((doc, own, target, page, n, min(found)))
                    break
    values = spark.createDataFrame(rows, "doc int, page int, pos int, value double, owner string")
    got = amounts.first_sums(spark.createDataFrame(sorted(set(goals)), "doc int, own string, target double"), values, ["doc", "own", "target"], ["page"]).collect()
    assert {(r["doc"], r["own"], r["target"], r["page"], r["size"], tuple(r["positions"])) for r in got} == want and len(got) == len(want) > 20
    told = {(r["doc"], r["page"], r["pos"]): r["n_after"] for r in amounts.placed(values, ["page"]).collect()}
    assert all(n == sum(1 for d, g, p, v, _ in rows if (d, g) == (doc, page) and p > pos and v is not None) for (doc, page, pos), n in told.items())


def test_sums_of_small_places_are_listed_in_their_rows(spark, monkeypatch):
    """pairs of values are stored only for places too long to list their sums, or documents that ask for too much; the rows are the same."""
    import random

    rng = random.Random(13)
    rows = [(doc, page, i, round(rng.uniform(-9, 30), 2), rng.choice([None, None, "a", "b"])) for doc in range(6) for page in range(3) for i in range(rng.randint(1, 9))]
    values = spark.createDataFrame(rows, "doc int, page int, pos int, value double, owner string")
    goals = [(doc, own, round(sum(rng.sample([r[3] for r in rows if r[0] == doc], n)), 2), [0, 7]) for doc in range(6) for own in ("a", "c") for n in (2, 3, 4)]
    asked = spark.createDataFrame(goals, "doc int, own string, target double, gone array<int>")
    key = ["doc", "own", "target", "gone"]
    found = lambda place, **limits: sorted(map(str, amounts.first_sums(asked, values, key, place, **limits).collect()))
    middle = [found(p, listed=5) for p in (["page"], [])], [found(p, most=2) for p in (["page"], [])]
    monkeypatch.setattr(amounts, "pair_sums", None)
    small = [found(p) for p in (["page"], [])]
    assert [small, small] == list(middle) and all(small)


def test_a_person_is_looked_for_once(spark, monkeypatch):
    """items of one person share the walk over a page's people and the search for the boxes; each keeps its own amount."""
    asked = []
    near = scoring.name_proximity
    monkeypatch.setattr(scoring, "name_proximity", lambda words, names, on: asked.extend(names.collect()) or near(words, names, on))
    items = spark.createDataFrame([("r1", "d", "Ann", "Doe", 5.0), ("r2", "d", "Ann", "Doe", 7.0), ("r3", "d", "Bo", "Doe", 7.0), ("r4", "d", "Ann", None, 5.0)], "row_id string, doc string, first_name string, last_name string, amount double")
    pages = spark.createDataFrame([("d", 1, ([("Ann Doe", "Ann", "Doe")], [(5.0,)], "payroll"))], "doc string, page int, entities struct<people:array<struct<full_name:string,first_name:string,last_name:string>>,amounts:array<struct<value:double>>,doc_type:string>")
    words = spark.createDataFrame([("d", 1, 0, "Ann", 0.0, 0.0, 0.1, 0.01), ("d", 1, 1, "Doe", 0.11, 0.0, 0.1, 0.01)], "doc string, page int, pos int, text string, left double, top double, width double, height double")
    got = {r["row_id"]: r["rationale"] for r in scoring.employee_evidence(items, pages, words).collect()}
    assert sorted((r["last"], r["variants"]) for r in asked) == [("", ["ann"]), ("doe", ["ann"]), ("doe", ["bo"])]
    assert "Amount: $5.00" in got["r1"] and [w for w in got["r1"] if w != "Amount: $5.00"] == got["r2"]
    assert "First name" in got["r2"] and "First name" not in got["r3"]


def test_sub_items_find_filter_pages_once(spark, monkeypatch):
    """the row-text filter and combined recovery share the pages that hold a filter token."""
    asked = []
    made = subitems.token_pages
    monkeypatch.setattr(subitems, "token_pages", lambda *a: asked.append(a) or made(*a))
    requests = spark.createDataFrame([("r1", "d", "Travel", [5.0], ["blue kite"], 1)], "row_id string, doc string, budget_item string, amounts array<double>, texts array<string>, source_page int")
    pages = spark.createDataFrame([("d", p, t, ([], [], [], "invoice")) for p, t in ((1, "own"), (2, "blue kite 5.00"), (3, "red"), (4, "green"))], "doc string, page int, text string, entities struct<people:array<struct<full_name:string,first_name:string,last_name:string>>,amounts:array<struct<value:double>>,organizations:array<string>,doc_type:string>")
    values = spark.createDataFrame([("d", 2, 0, 9.0, None)], "doc string, page int, pos int, value double, budget_item string")
    got = subitems.match_sub_items(requests, pages, values).filter("rank = 1").first()
    assert len(asked) == 1 and (got["pages"], got["score"], got["strategy"], got["selected"]) == ([2], 0.95, "combined", True)


def test_terms_meet_a_text_once(spark):
    """a gram that recurs in a text, or two of one kind, make no second pair, so pairs aren't dealt out to be made distinct."""
    terms = spark.createDataFrame([("d", t) for t in ("ana", "an", "n", "nan", "x")], "doc string, term string")
    texts = spark.createDataFrame([("d", t) for t in ("bananana", "an", "banana", "n")], "doc string, held string")
    met = containment.containing(terms, texts)
    want = {(t, h) for t in ("ana", "an", "n", "nan", "x") for h in ("bananana", "an", "banana", "n") if t in h}
    got = [(r["term"], r["held"]) for r in met.collect()]
    assert set(got) == want and len(got) == len(want)
    assert not met._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_navigation_gathers_ids_by_stretches(spark):
    items = spark.range(9000).selectExpr("(id * 7919) % 9000 AS row_index", "concat('r', (id * 7919) % 9000) AS row_id", "'Salary' AS budget_item", "CASE WHEN (id * 7919) % 9000 = 0 THEN 'Ann' ELSE 'ann' END AS first_name", "'Doe' AS last_name")
    got = review.navigation(items).collect()
    assert len(got) == 2 and all(r["row_ids"] == [f"r{i}" for i in range(9000)] for r in got) and {r["label"] for r in got} == {"Salary", "Salary - Ann Doe"}
    plan = review.navigation(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "stretch" in plan


def test_invoice_rows_are_numbered_without_a_window(spark, tmp_path):
    """Several files, in one of them the header after a preamble; rows keep their places, and no window gathers them."""
    head = "Invoice of May\nBudget Item,Amount,Explanation\n"
    (tmp_path / "a.csv").write_text(head + "".join(f"Travel,{i},n{i}\n" for i in range(40)))
    (tmp_path / "b.csv").write_text("".join(f"Travel,{i},n{i}\n" for i in range(40, 45)))
    read = readers.read_invoice(spark, str(tmp_path))
    assert [(r["row_index"], r["explanation"]) for r in read.orderBy("row_index").collect()] == [(i, f"n{i}") for i in range(45)]
    assert "Window" not in read._jdf.queryExecution().optimizedPlan().toString()


def test_pages_that_words_share_are_sent_on_once(spark):
    """a term inside many words of the same pages: each page once, gathered as sets before the exchange."""
    from tallyforge.operators import containment

    pages = spark.createDataFrame([("d", p, " ".join(f"x{i}same" for i in range(30))) for p in range(1, 6)], "doc string, page int, text string")
    words = containment.page_words(pages, F.split("text", " "))
    met = containment.held_on(spark.createDataFrame([("d", "same"), ("d", "x7s")], "doc string, term string"), words)
    assert {(r["term"], tuple(sorted(r["pages"]))) for r in met.collect()} == {("same", (1, 2, 3, 4, 5)), ("x7s", (1, 2, 3, 4, 5))}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in plan and "collect_list" not in plan


def test_report_lines_are_made_once(spark, tmp_path):
    """neither the sample for the report's order nor an item's status has them made again."""
    made = spark.sparkContext.accumulator(0)

    def told(row):
        made.add(1)
        return row

    rows = [(i * 7 % 50, k, f"{i * 7 % 50}.{k}") for i in range(50) for k in range(3)]
    lines = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(told), "row_index int, sub int, line string")
    sinks.write_report(lines, str(tmp_path / "report"))
    got = [line for f in sorted((tmp_path / "report").glob("part-*")) for line in f.read_text().splitlines()]
    assert got == [review.REPORT_HEADER] + [r[2] for r in sorted(rows)] and made.value == len(rows)


def test_report_tells_status_by_sub_items(spark):
    """without done, as completion() tells it; sub-items are read once."""
    items = spark.createDataFrame([(f"r{i}", i, "Salary, other", 5.0 * i, "Ann", None) for i in range(6)], "row_id string, row_index int, budget_item string, amount double, first_name string, last_name string")
    subs = spark.createDataFrame([("a", "r1", 2, None, [1.0]), ("b", "r1", 1, "B", [2.0, 3.0]), ("c", "r2", 1, "", []), ("d", "r2", 2, None, None), ("e", "r9", 1, None, [1.0]), ("f", None, 1, None, [1.0]), (None, "r3", 1, "x", [0.0])], "sub_item_id string, parent_row_id string, ord int, label string, amounts array<double>")
    log = spark.createDataFrame([("a", "payment", 1, "d"), ("b", "payment", 2, "d"), ("b", "invoice", 3, "d"), ("c", "invoice", 1, "d"), ("r2", "payment", 4, "d"), ("r4", "invoice", 5, "d"), ("r3", "payment", 6, "d"), ("r0", "payment", 7, "d")], "item_id string, field string, page int, doc_id string")
    refs = log.groupBy("item_id", "field").agg(F.concat(F.lit("vp "), F.first("page")).alias("labels"))
    told, given = (review.report_rows(items, subs, done, refs) for done in (None, review.completion(items, subs, log)))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, given.collect())) == [
        (0, 0, '1,"Salary, other",,,Ann,Yes,vp 7,No,'),
        (1, 0, '2,"Salary, other",,5.00,Ann,Yes,,No,'),
        (1, 1, '2.1,"Salary, other",B,2.00 / 3.00,,Yes,vp 2,Yes,vp 3'),
        (1, 2, '2.2,"Salary, other",a,1.00,,Yes,vp 1,No,'),
        (2, 0, '3,"Salary, other",,10.00,Ann,No,vp 4,No,'),
        (2, 1, '3.1,"Salary, other",c,,,No,,Yes,vp 1'),
        (2, 2, '3.2,"Salary, other",d,,,No,,No,'),
        (3, 0, '4,"Salary, other",,15.00,Ann,No,vp 6,No,'),
        (3, 1, '4.1,"Salary, other",x,,,No,,No,'),
        (4, 0, '5,"Salary, other",,20.00,Ann,No,,Yes,vp 5'),
        (5, 0, '6,"Salary, other",,25.00,Ann,No,,No,'),
    ]
