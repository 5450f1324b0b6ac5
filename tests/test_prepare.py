import datetime as dt
from decimal import Decimal

import pytest

from millrace.errors import InvalidInput
from millrace.functions import expressions as e
from millrace.operators.prepare import prepare


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(1, "NL", 10.0), (2, "BE", 20.0), (3, "NL", 30.0), (3, "NL", 30.0)], "order_id int, region string, amount double")


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(
        [(1, 2, 10.0, "NL"), (3, 0, 20.5, "BE"), (5, 4, None, "nl")], "a bigint, b bigint, amount double, region string")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_formula_and_filter(orders):
    out = prepare(orders, [{"op": "formula", "column": "with_vat", "expression": "amount * 1.21"},
                           {"op": "filter", "expression": "region = 'NL'"}])
    assert sorted(round(v, 6) for v in values(out, "with_vat")) == [12.1, 36.3, 36.3]


def test_formula_overwrites(orders):
    out = prepare(orders, [{"op": "formula", "column": "amount", "expression": lambda df: df.amount + 1}])
    assert out.columns == orders.columns and min(values(out, "amount")) == 11.0


def test_rename_swap_and_unknown(orders):
    out = prepare(orders, [{"op": "rename", "mapping": {"order_id": "region", "region": "order_id"}}])
    assert out.columns == ["region", "order_id", "amount"] and out.first()["order_id"] == "NL"
    with pytest.raises(InvalidInput):
        prepare(orders, [{"op": "rename", "mapping": {"nope": "x"}}])
    with pytest.raises(InvalidInput):
        prepare(orders, [{"op": "rename", "mapping": {"order_id": "region"}}])


def test_cast_good_and_bad(spark, orders):
    out = prepare(orders, [{"op": "cast", "casts": {"order_id": "int64", "amount": "decimal(10,2)"}}])
    assert [t for _, t in out.dtypes] == ["bigint", "string", "decimal(10,2)"] and out.first()["amount"] == Decimal("10.00")
    with pytest.raises(Exception):
        prepare(orders, [{"op": "cast", "casts": {"region": "int64"}}]).collect()
    with pytest.raises(InvalidInput):
        prepare(orders, [{"op": "cast", "casts": {"region": "nonsense"}}])


def test_filter_drops_null(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert values(prepare(df, [{"op": "filter", "expression": "x > 1"}]), "x") == [3]


def test_fill_nulls_keeps_fractions(spark):
    df = spark.createDataFrame([(1, None), (None, "a")], "n int, s string")
    out = prepare(df, [{"op": "fill_nulls", "values": {"n": 2.5, "s": "none"}}])
    assert sorted(tuple(r) for r in out.collect()) == [(1.0, "none"), (2.5, "a")]


def test_dedupe(orders):
    assert sorted(values(prepare(orders, [{"op": "dedupe", "subset": ["order_id"]}]), "order_id")) == [1, 2, 3]
    assert prepare(orders, [{"op": "dedupe"}]).count() == 3


def test_dedupe_keeps_whole_first_row(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 2, "z"), (None, 1, "n"), (None, 0, "m")], "k int, t int, v string")
    out = prepare(df, [{"op": "dedupe", "subset": ["k"], "order": ["t"]}])
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(1, 2, "z"), (None, 0, "m")]


def test_dedupe_limits_before_shuffle(orders):
    out = prepare(orders, [{"op": "dedupe", "subset": ["order_id"]}])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_select_keep_order_and_drop(orders):
    assert prepare(orders, [{"op": "select", "columns": ["amount", "order_id"]}]).columns == ["amount", "order_id"]
    assert prepare(orders, [{"op": "select", "columns": ["amount"], "drop": True}]).columns == ["order_id", "region"]
    with pytest.raises(InvalidInput):
        prepare(orders, [{"op": "select", "columns": ["nope"], "drop": True}])


@pytest.mark.parametrize("steps", [[], [{"op": "explode"}], [{"op": "rename"}], [{"op": "filter", "expression": ""}]])
def test_bad_steps(orders, steps):
    with pytest.raises(InvalidInput):
        prepare(orders, steps)


def test_division_by_zero_is_null(numbers):
    a, b = e.col(numbers, "a"), e.col(numbers, "b")
    assert values(numbers.select(e.divide(a, b).alias("x")), "x") == [0.5, None, 1.25]
    assert values(numbers.select(e.floor_divide(a, b).alias("x")), "x") == [0, None, 1]
    assert values(numbers.select(e.modulo(a, b).alias("x")), "x") == [1, None, 1]
    assert numbers.select(e.divide(1, 0).alias("x")).first()[0] is None


def test_signs_and_floor(spark):
    row = spark.range(1).select(e.modulo(-7, 3), e.floor_divide(-7, 2), e.power(2, 10)).first()
    assert tuple(row) == (-1, -4, 1024.0)


def test_comparison_chain(spark):
    df = spark.createDataFrame([(5,), (15,), (-1,)], "a int")
    assert values(df.filter(e.compare(0, "<", df.a, "<", 10)), "a") == [5]
    with pytest.raises(InvalidInput):
        e.compare(1, "in", 2)


def test_none_comparison_and_if_else(numbers):
    amount = e.col(numbers, "amount")
    assert values(numbers.select(e.equal(amount, None).alias("x")), "x") == [False, False, True]
    assert values(numbers.select(e.not_equal(amount, None).alias("x")), "x") == [True, True, False]
    assert values(numbers.select(e.if_else(amount > 15, "hi", "lo").alias("x")), "x") == ["lo", "hi", "lo"]


def test_text_functions(spark):
    df = spark.createDataFrame([(" \tNl\n", 7, None)], "s string, n int, z string")
    row = df.select(e.trim(df.s), e.concat(df.n, "-", "x"), e.concat("a", df.z), e.replace(df.s, "N", "."), e.length(e.trim(df.s))).first()
    assert tuple(row) == ("Nl", "7-x", None, " \t.l\n", 2)


def test_round_dates_cast(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29), 2.345)], "d date, x double")
    row = df.select(e.round_to(e.cast(df.x, "decimal(9,3)"), 2), e.year("d"), e.month("d"), e.day("d"), e.cast("12", "int64")).first()
    assert tuple(row) == (Decimal("2.35"), 2024, 2, 29, 12)


def test_literals_and_names(numbers):
    with pytest.raises(InvalidInput):
        e.col(numbers, "nope")
    with pytest.raises(InvalidInput):
        e.lit("x" * 10_001)
    with pytest.raises(InvalidInput):
        e.lit(object())
    odd = numbers.withColumnRenamed("a", "a b.c`d")
    assert values(odd.select(e.col(odd, "a b.c`d").alias("x")), "x") == [1, 3, 5]


@pytest.mark.parametrize("text", [
    "__import__('os')", "a.real", "java_method('java.lang.System', 'exit')", "reflect('a', 'b')", "(select 1)", "nope + 1",
    "transform(array(1), x -> x)", "sum(a)", "exists(select 1)", "a in (select 1)", "x" * 4001, "", "a +", "input_file_name()", "*"])
def test_expression_rejections(numbers, text):
    with pytest.raises(InvalidInput):
        prepare(numbers, [{"op": "formula", "column": "x", "expression": text or " "}])
