"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import geometry, text, vocab


@pytest.fixture(scope="session")
def of(spark):
    def value(column, **given):
        schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in given.items())
        df = spark.createDataFrame([tuple(given.values())], schema) if given else spark.range(1)
        return df.select(column.alias("x")).first()["x"]

    return value


@pytest.mark.parametrize("raw, want", [("$1,234.56", "1234.56"), ("", None), ("invalid", None), (" 5 ", "5.00"), (None, None), ("-3.1", "-3.10")])
def test_currency(of, raw, want):
    got = of(text.currency(F.col("a")), a=raw)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("raw, want", [("Budget Item", "budget_item"), (" Employee First-Name ", "employee_first_name"), ("A / B", "a_b")])
def test_column_name(raw, want):
    assert text.column_name(raw) == want


@pytest.mark.parametrize("raw, want", [("SALARY_TOTAL", "Salary"), ("SPACE_RENTAL", "Space Rental/Occupancy Costs"), ("salary", "Salary"), ("Salary", "Salary"), ("contractual services", "contractual services"), ("Travel and Conferences", "Travel and Conferences"), ("x", "x"), ("", None)])
def test_canonical(of, raw, want):
    assert of(text.canonical_budget_item(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("Salary.pdf", "Salary"), ("Space_Rental_Occupancy_Costs.pdf", "Space Rental/Occupancy Costs"), ("unknown.pdf", None)])
def test_file_budget_item(of, raw, want):
    assert of(text.file_budget_item(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("  José  O'Neil-Smith ", "josé oneilsmith"), (None, ""), ("a_b!", "a_b")])
def test_normalize_name(of, raw, want):
    assert of(text.normalize_name(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("Chun Ping (Becca)", ["Chun Ping", "Becca"]), ("John", ["John"]), (None, []), ("(Al)", ["Al"])])
def test_variants(of, raw, want):
    assert of(text.first_name_variants(F.col("a")), a=raw) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_indel_ratio(spark):
    import random

    random.seed(1)
    rows = [("".join(random.choice("abce") for _ in range(random.randint(0, 7))), "".join(random.choice("abce") for _ in range(random.randint(0, 7)))) for _ in range(150)] + [("jon", "john"), ("maggie", "margaret")]
    for r in spark.createDataFrame(rows, "a string, b string").withColumn("x", text.indel_ratio(F.col("a"), F.col("b"))).collect():
        n = len(r["a"]) + len(r["b"])
        assert r["x"] == pytest.approx(100 if n == 0 else 200 * lcs(r["a"], r["b"]) / n)


def test_token_sort(of):
    assert of(text.token_sort_ratio(F.lit("doe john"), F.lit("john doe"))) == 100


@pytest.mark.parametrize("token, page, want", [("pp21", "see pp 21 there", True), ("pp21", "pp21", True), ("pp21", "pp 2 1", False), ("tax", "syntax", True), ("x1y", "x 1 y", True)])
def test_token_in_page(of, token, page, want):
    assert of(text.token_in_page(F.col("t"), F.col("p")), t=token, p=page) is want


def test_keywords(of):
    assert of(text.context_keywords(F.lit("T-Mobile and AT&T for PP21 telecommunications"), F.lit("Telecommunications"))) == ["tmobile", "att", "pp21"]
    assert of(text.context_keywords(F.lit("fees have been paid"), F.lit("Other"))) == ["fees", "paid"]
    assert of(text.manual_keywords(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert of(text.search_words(F.lit("The, x, que "))) == ["the", "que"]
    assert of(text.add_keyword(F.array(F.lit("a")), F.lit(" B "))) == ["a", "b"]
    assert of(text.add_keyword(F.array(F.lit("a")), F.lit("A"))) == ["a"]


@pytest.mark.parametrize("raw, want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": [1]} ok', '{"a": [1]}'), ("[1, 2] end", "[1, 2]"), ("none", None), ('{"a": ', None)])
def test_salvage(of, raw, want):
    assert of(text.salvage_json(F.col("a")), a=raw) == want


def test_csv_and_amounts(of):
    assert of(text.csv_field(F.lit('a "b", c'))) == '"a ""b"", c"'
    assert of(text.amounts_text(F.array(F.lit(19.16), F.lit(2.68)))) == "19.16 / 2.68"
    assert of(text.amount_text(F.lit(0.0))) == ""
    assert of(text.page_label(F.lit("verizon.pdf"), F.lit(1), F.lit(6))) == "verizon.pdf p.1 (vp 6)"


def test_budget_equivalence(of):
    same = lambda a, b: of(text.same_budget_item(F.lit(a), F.lit(b)))
    assert same("Supplies", "supplies") and same("supplies__att_bill", "Supplies") and not same("Salary", "Supplies")


def box(left, top):
    return geometry.box(F.lit(left), F.lit(top), F.lit(0.05), F.lit(0.02))


@pytest.mark.parametrize("a, b, want", [((0.1, 0.5), (0.2, 0.5), 1.0), ((0.1, 0.2), (0.7, 0.8), 0.0), ((0.1, 0.5), (0.35, 0.51), 0.7), ((0.1, 0.5), (0.2, 0.53), 0.6), ((0.1, 0.5), (0.6, 0.53), 0.4), ((0.1, 0.5), (0.6, 0.58), 0.2)])
def test_proximity(of, a, b, want):
    assert of(geometry.proximity(box(*a), box(*b))) == want


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_rotation_round_trip(of, turn):
    back = of(geometry.rotate(geometry.unrotate(box(0.1, 0.2), F.lit(turn)), F.lit(turn)))
    assert tuple(back) == pytest.approx((0.1, 0.2, 0.05, 0.02))


def test_expected_types(of):
    assert of(vocab.expected_types(F.lit("Insurance"))) == ["invoice"] and of(vocab.expected_types(F.lit("x"))) == list(vocab.DEFAULT_TYPES)
