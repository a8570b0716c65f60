"""The table calculator on a small table with accents, nulls, booleans, offsets and amounts as text."""

import pytest

from tesserae.operators.kinds import infer_kinds
from tesserae.operators.conditions import PROBLEMS, Filter, QueryError
from tesserae.operators.table_query import TableInfo, TableRequest, catalog_text, compile_request, execute_requests, find_table, resolve_column, run_request

ROWS = [
    ("New Delhi", 4.0, 10, "Yes", "2015-02-20 10:00:00 -0800", True), ("New Delhi", 3.0, 20, "No", "2015-02-21 09:00:00 -0800", False),
    ("Mumbai", 5.0, 30, "Yes", "2015-02-22 08:00:00 -0800", True), ("Mumbai", 4.5, 40, "Yes", "2015-02-23 07:00:00 -0800", True),
    ("Mumbai", None, 50, "No", "2015-02-24 06:00:00 -0800", False), ("Sí£o Paulo", 2.0, 60, "Yes", "2015-02-25 05:00:00 -0800", True),
]


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame(ROWS, "city string, rating double, votes long, delivery string, when string, open boolean")
    prices = spark.createDataFrame([(f"i{i}", f"${i + 0.5:.2f}" if i < 29 else "n/a") for i in range(30)], "item string, price string")
    return {"sales.csv": sales.cache(), "prices.xlsx": prices.cache()}


@pytest.fixture(scope="module")
def ask(tables):
    kinds = {n: infer_kinds(df) for n, df in tables.items()}

    def run(operation, column=None, *filters, by=(), table="sales.csv", **more):
        df = tables[table]
        info = TableInfo("T1", "shop", table, "main", df.count(), kinds[table])
        return run_request(TableRequest("T1", operation, column, tuple(Filter(*f) for f in filters), by, **more), info, df, "C1", kinds[table])

    return run


def test_kinds(tables):
    assert infer_kinds(tables["sales.csv"]) == {"city": "text", "rating": "decimal", "votes": "integer", "delivery": "text", "when": "date", "open": "boolean"}
    assert infer_kinds(tables["prices.xlsx"]) == {"item": "text", "price": "amount_text"}


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        (("count",), 6), (("count", None, ("city", "==", "new delhi")), 2), (("count", "rating"), 5), (("nunique", "city"), 3),
        (("mean", "rating", ("city", "==", "Mumbai")), 4.75), (("sum", "votes", ("votes", ">=", "30")), 180), (("median", "votes"), 35), (("min", "rating"), 2), (("max", "rating"), 5),
        (("count", None, ("city", "in", None, ("mumbai", "NEW DELHI"))), 5), (("count", None, ("city", "contains", "del")), 2), (("count", None, ("city", "!=", "Mumbai")), 3),
        (("count", None, ("rating", "is_null")), 1), (("count", None, ("rating", "not_null")), 5),
        (("count", None, ("open", "==", "yes")), 4), (("count", None, ("when", ">=", "2015-02-23")), 3), (("count", None, ("when", "<=", "2015-02-21")), 2), (("count", None, ("when", "==", "2015-02-22")), 1),
        (("mean", "rating", ("city", "==", "Paris")), None), (("count", None, ("city", "==", "Paris")), 0),
    ],
)
def test_single_figures(ask, asked, want):
    got = ask(*asked)
    assert got.ok and got.value == want


def test_dates_and_amounts(ask):
    assert ask("min", "when").value.startswith("2015-02-20T18:00:00")
    got = ask("sum", "price", table="prices.xlsx")
    assert got.value == 420.5 and "left out 1 value" in got.notes[0]


def test_groups(ask):
    assert ask("count", by=("city",)).rows == [{"city": "Mumbai", "value": 3}, {"city": "New Delhi", "value": 2}, {"city": "Sí£o Paulo", "value": 1}]
    one = ask("count", by=("city",), limit=1)
    assert len(one.rows) == 1 and one.rows_note == "the greatest 1 of 3 groups" and "[C1] count(*) by city" in one.to_text()
    assert ask("count", by=("city",), order="asc").rows[0]["value"] == 1
    assert {"city": "Mumbai", "delivery": "Yes", "value": 70} in ask("sum", "votes", by=("city", "delivery")).rows
    assert [r["value"] for r in ask("mean", "rating", by=("city",)).rows] == [4.75, 3.5, 2]
    assert "first 2" in ask("count", by=("city", "delivery", "open")).notes[0]


def test_values_that_are_nearly_right(ask, spark):
    fixed = ask("count", None, ("city", "==", "São Paulo"))
    assert fixed.value == 1 and "spelt most alike" in fixed.notes[0] and "Sí£o" in fixed.description
    assert ask("count", None, ("city", "==", "Nw Delhi")).value == 2
    off = ask("count", None, ("city", "==", "Sao Pablo"))
    assert off.value == 0 and off.suggestions["city"] == ["Sí£o Paulo"]
    assert ask("count", None, ("city", "==", "Delhi")).value == 0
    assert ask("count", None, ("city", "in", None, ("São Paulo",))).value == 0
    two = spark.createDataFrame([("Cafe Alpha",), ("Cafe Alpho",)], "n string")
    plan = compile_request(TableRequest("t", "count", filters=(Filter("n", "==", "Cafe Alphe"),)), two)
    assert plan.result.first()["value"] == 0 and set(plan.suggestions["n"]) == {"Cafe Alpha", "Cafe Alpho"}


@pytest.mark.parametrize(
    ("asked", "problem"),
    [
        (("sum", "city"), "no figures"), (("sum",), "which column"), (("count", None, ("votes", "contains", "1")), "search in figures"), (("count", None, ("votes", ">", "x")), "not a figure"),
        (("count", None, ("when", "in", None, ("2015",))), "dates are ordered"), (("count", None, ("when", "==", "soon")), "not a day"), (("count", None, ("open", ">", "yes")), "true or false"),
        (("count", None, ("city", ">", "a")), "texts have no order"), (("count", None, ("city", "==", " ")), "value"), (("count", "citi_es_x"), "column"), (("mode", "city"), "operation"), (("count", None, ("city", "~", "a")), "comparison"),
    ],
)
def test_refusals(ask, tables, asked, problem):
    got = ask(*asked)
    assert not got.ok and got.value is None and got.rows is None and "failed" in got.to_text() and not got.to_dict()["ok"]
    with pytest.raises(QueryError) as e:
        compile_request(TableRequest("t", asked[0], asked[1] if len(asked) > 1 else None, tuple(Filter(*f) for f in asked[2:])), tables["sales.csv"])
    assert e.value.problem == problem in PROBLEMS and str(e.value) == got.error


def test_names_and_requests(tables):
    assert resolve_column("When", ["when", "x"]) == "when" and resolve_column("has online", ["Has-Online"]) == "Has-Online"
    catalog = [TableInfo("T1", "shop", "prices.xlsx", "Sheet1", 30, {}), TableInfo("T2", "shop", "sales.csv", "main", 6, {"city": "text"})]
    assert find_table("SALES.csv", catalog).ref == "T2" and find_table("shop/prices.xlsx [sheet1]", catalog).ref == "T1" and find_table("T9", catalog) is None
    asked = [TableRequest("T2", "count"), TableRequest("nope", "count"), TableRequest("T1", "sum", "price"), TableRequest("T2", "count"), TableRequest("T2", "count")]
    got = execute_requests(asked, catalog, lambda t, s, i: tables[s], start=4)
    assert [r.ref for r in got] == ["C4", "C5", "C6"] and [r.ok for r in got] == [True, False, True] and got[2].value == 420.5
    assert "T1, T2" in got[1].error and catalog_text(catalog).splitlines() == ["T1: shop/prices.xlsx [Sheet1] | 30 rows | ", "T2: shop/sales.csv | 6 rows | city: text"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None)], "k string, x double")
    value = lambda op, *f, c="x": compile_request(TableRequest("t", op, c, tuple(Filter(*x) for x in f)), df).result.first()["value"]
    assert value("count") == 1 and value("max") == 1 and value("sum") == 1 and value("count", ("x", ">", "0"), c=None) == 1 and value("count", ("x", "is_null"), c=None) == 2
    assert value("sum", ("k", "==", "b")) == 0  # rows, but no values


def test_pushdown(spark, sf_dir):
    """Comparisons reach the scan, and only touched columns are read."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = compile_request(TableRequest("t", "sum", "l_tax", (Filter("l_quantity", ">=", "30"), Filter("l_shipdate", "<", "1996-01-01"))), df)
    text = plan.result._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,30.0)" in text and "LessThan(l_sh" in text and "l_comment" not in text and "l_partkey" not in text.split("ReadSchema")[1]
