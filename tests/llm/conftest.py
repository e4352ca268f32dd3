import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Ties, repeats, nulls, empty and long texts, several sources, copies and near copies."""
    base = " ".join(f"word{i % 90} and more{i % 37}." for i in range(120))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace("word5", "other5", 1), "en", "b", 1),
        (4, None, None, None, None),
        (5, "", "fr", "b", 0),
        (6, "one two", "en", None, 7),
        (7, "Le chat est sur la table. " * 3 + "\nLe chien dort dans la maison verte ce soir.", "fr", "c", 5),
        (8, "x | y | z | home | about\nclick here to log in", "en", "c", 5),
        (9, "héllo\tWÖRLD it's 2024 — don't! <|endoftext|> 中文 Σς", "en", "a", 3),
        (10, " ".join(f"tok{i}" for i in range(5000)), "en", "a", 9),
        (None, "null id text with a few words here to see", "en", "b", 1),
        (11, "Order 17 shipped to the main dock on day 3 at noon.\nunique eleven line", "en", "a", 1),
        (12, "Order 99 shipped to the main dock on day 8 at noon.\nunique twelve line", "en", "b", 1),
        (13, "Order 5 shipped to the main dock on day 1 at noon.", "en", "b", 1),
        (13, "Order 5 shipped to the main dock on day 1 at noon.", "en", "b", 1),
        (14, "a b c d e f g h a b c d e f g h\nA B", "de", "d", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def hold(spark):
    """Holds a DataFrame's rows against DuckDB SQL over given tables."""
    def check(df, sql, **tables):
        con = duckdb.connect()
        for name, t in tables.items():
            con.register(name, t.toArrow())
        got = df.toArrow()
        con.register("got", got)
        con.execute("CREATE TABLE want AS " + sql)
        assert sorted(got.column_names) == sorted(r[0] for r in con.execute("DESCRIBE want").fetchall())
        cols = ", ".join(f'"{c}"' for c in got.column_names)
        for a, b in (("got", "want"), ("want", "got")):
            assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []

    return check
