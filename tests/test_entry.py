"""The driver's contract, with and without the training-data half."""

import importlib
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tallyforge.plans import registry, views

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.SQL) <= set(registry.QUERIES) and "best_page_per_item" in registry.QUERIES


def test_works_without_the_training_half(tmp_path):
    """In a copy without the folders and the pipeline's file."""
    for name in ("__spark_entry__.py", "tallyforge"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    # what a deletion may leave behind
    (tmp_path / "tallyforge/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert 'best_page_per_item' in e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0


def test_views_know_their_needs():
    assert views.with_views("items").index("page_amounts AS") < views.with_views("items").index("items AS")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["exact_amount_match", "largest_amount_per_page", "match_type", "report_rows", "navigation_groups", "table_row_budget"])
def test_queries_match_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "documents", "events", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = importlib.import_module("__spark_entry__").queries()[name](spark, folder).toArrow()
    con.register("got", got)
    con.execute("CREATE TABLE want AS " + registry.SQL[name])
    cols = ", ".join(f'"{c}"' for c in got.column_names)
    assert got.num_rows
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def _same_as_sql(spark, folder, name):
    """Whether a query's rows are those of its SQL over the tables that stand in folder."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(os.path.join(folder, f)) else ''}')")
    con.register("got", importlib.import_module("__spark_entry__").queries()[name](spark, str(folder)).toArrow())
    con.execute("CREATE TABLE want AS " + registry.SQL[name])
    cols = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE got").fetchall())
    return [con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() for a, b in (("got", "want"), ("want", "got"))] == [[], []]


@pytest.mark.parametrize("name", ["live_markers", "live_cache"])
def test_seconds_are_rounded(spark, tmp_path, name):
    """Times at the border, with parts of a second that round up, down and to even."""
    last = 10_000_000
    at = [last + x for x in (0.0, 0.5, 0.4)] + [last - age + x for age in (120, 30 * 86_400) for x in (-1.5, -0.5, -0.4, 0.0, 0.5, 0.6, 1.5)]
    rows = [(i * 4 + 1, x) for i, x in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, s double").selectExpr("event_id", "cast(timestamp_micros(cast(s * 1000000 as long)) as timestamp_ntz) as ts").write.parquet(str(tmp_path / "events.parquet"))
    assert _same_as_sql(spark, tmp_path, name)


def test_every_file_is_discovered(spark, tmp_path):
    """F16: a file a year in folders, flat ones only without a folder, none that is deep or of another kind."""
    import datetime

    rows = [(k + 12 * m, k, datetime.datetime(2020 + m, 5, 5)) for k in range(12) for m in range(3)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    assert _same_as_sql(spark, tmp_path, "key_discovery")
    found = {tuple(r) for r in importlib.import_module("__spark_entry__").queries()["key_discovery"](spark, str(tmp_path)).select("budget_item", "doc_id", "path").collect()}
    years = ("2020", "2021", "2022")
    want = {("Utilities", "utilities", "Utilities.pdf")}
    for y in years:
        want |= {("Salary", f"salary__{y}_feb", f"Salary/{y} + feb.pdf"), ("Supplies", f"supplies__{y}", f"Supplies/{y}.pdf"), ("Indirect Costs", f"indirect_costs__x_{y}", f"indirect costs/x {y}.pdf"), ("Other", f"other__{y}", f"Other/{y}.pdf")}
    assert found == want


def test_kept_views_are_read_again_from_the_store(spark):
    """Views made over a kept one don't let go of it; what is made of it reads no table again."""
    views.free()
    folder = "/root/testdata/sf0.001"
    views.keep(spark, folder, "page_amounts", "page_facts")
    for name in ("page_texts", "items"):
        read = views.view(spark, folder, name).inputFiles()
        assert read and not [f for f in read if "/testdata/" in f], name
    views.free()


def test_json_is_stored_compressed(spark, tmp_path):
    """F28, F31."""
    from tallyforge.sources import sinks

    pages = spark.range(50).selectExpr("cast(id as string) AS doc_id", "1 AS page_number", "repeat('word ', 50) AS text")
    sinks.write_pages(pages, str(tmp_path / "p"))
    files = [f for _, _, fs in os.walk(tmp_path / "p") for f in fs if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
