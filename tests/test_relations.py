import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput
from millrace.operators import combine
from millrace.operators.group import group
from millrace.operators.join import HOW, join


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(1, "NL", 10.0), (2, "BE", 20.0), (3, "NL", 30.0), (3, "NL", 30.0)], "order_id int, region string, amount double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_join_names(spark, orders):
    regions = spark.createDataFrame([("NL", "Netherlands", 1.0), ("BE", "Belgium", 2.0)], "region string, country string, amount double")
    inner = join(orders, regions, [("region", "region")])
    assert inner.columns == ["order_id", "region", "amount", "country", "amount_right"] and inner.count() == 4
    left = join(orders, regions.limit(0), [("region", "region")], "left", "_r")
    assert left.columns == ["order_id", "region", "amount", "region_r", "country", "amount_r"]
    assert left.filter("region_r IS NULL").count() == 4


def test_join_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, w string")
    assert rows(join(a, b, [("k", "k")])) == [(1, "x", "p")]
    assert join(a, b, [("k", "k")], "outer").count() == 4


@pytest.mark.parametrize("how", HOW)
def test_salted_join_equals_plain_join(spark, how):
    random.seed(5)
    a = [(random.choice([1, 1, 1, 2, 3, None, 7]), i % 5) for i in range(400)]
    b = [(k, w) for k, w in [(1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e")]]
    left = spark.createDataFrame(a, "k int, v int")
    right = spark.createDataFrame(b, "k int, w string")
    plain, salted = join(left, right, [("k", "k")], how), join(left, right, [("k", "k")], how, hot_rows=20)
    assert plain.columns == salted.columns and rows(plain) == rows(salted)


def test_join_rejections(orders):
    for bad in ({"how": "cross"}, {"on": []}, {"on": [("nope", "region")]}, {"right_suffix": "x" * 33}):
        with pytest.raises(InvalidInput):
            join(orders, orders, **{"on": [("region", "region")], **bad})
    other = orders.withColumnRenamed("amount", "amount_right").withColumn("amount", F.lit(1))
    with pytest.raises(InvalidInput):
        join(orders, other, [("region", "region")])


def test_group(spark, orders):
    out = {r["region"]: r for r in group(orders, ["region"], [
        {"column": "amount", "func": "sum", "as": "total"}, {"column": "order_id", "func": "count_distinct"},
        {"column": "amount", "func": "mean"}, {"column": "amount", "func": "min"}, {"column": "amount", "func": "max"}]).collect()}
    assert out["NL"]["total"] == 70.0 and out["NL"]["count_distinct_order_id"] == 2 and out["BE"]["min_amount"] == 20.0
    nulls = spark.createDataFrame([(None, None), (None, 2), ("a", None)], "k string, v int")
    assert rows(group(nulls, ["k"], [{"column": "v", "func": "count"}, {"column": "v", "func": "sum"}])) == [("a", 0, None), (None, 1, 2)]
    for bad in (([], [{"column": "amount", "func": "sum"}]), (["region"], []), (["region"], [{"column": "amount", "func": "mode"}])):
        with pytest.raises(InvalidInput):
            group(orders, *bad)


def test_stack(spark, orders):
    regions = spark.createDataFrame([("NL", "Netherlands"), ("BE", "Belgium")], "region string, country string")
    out = combine.stack(orders, regions)
    assert out.columns == ["order_id", "region", "amount", "country"] and out.count() == 6
    with pytest.raises(InvalidInput):
        combine.stack(orders, regions.withColumn("amount", F.lit("x")))
    with pytest.raises(InvalidInput):
        combine.stack(orders)
    assert dict(combine.stack(orders, orders.withColumn("order_id", F.col("order_id").cast("bigint"))).dtypes)["order_id"] == "bigint"


def test_split_leaves_null_out(spark, orders):
    match, rest = combine.split(orders, "region = 'NL'")
    assert (match.count(), rest.count()) == (3, 1)
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    match, rest = combine.split(df, "x > 2")
    assert (match.count(), rest.count()) == (1, 1)
    assert combine.split(df, "x > 2", null_to="rest")[1].count() == 2


def test_samples(spark):
    df = spark.range(20_000).withColumn("t", F.concat(F.lit("v"), "id"))
    assert combine.sample(df).count() == 1000 and combine.sample(df, n=7).count() == 7
    assert combine.sample(df, "random", n=5).count() == 5
    some = combine.sample(df, "random", fraction=0.2)
    assert 3600 < some.count() < 4400
    assert rows(some) == rows(combine.sample(df.repartition(13), "random", fraction=0.2))
    assert rows(some) != rows(combine.sample(df, "random", fraction=0.2, seed=1))
    assert combine.sample(df, "random", fraction=1.0).count() == 20_000
    for bad in ({"n": 10_000_001}, {"method": "random", "fraction": 0.0}, {"method": "best"}):
        with pytest.raises(InvalidInput):
            combine.sample(df, **bad)


def test_top_values_and_pages(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",), (None,), ("d",), ("e",), ("f",)], "x string")
    assert [(r["value"], r["n"]) for r in combine.top_values(df, ["x"]).orderBy("position").collect()] == [("a", 2), ("b", 2), ("c", 1), ("d", 1), ("e", 1)]
    page = combine.page_after(spark.range(10), "id", 3, 2)
    assert [r["id"] for r in page.collect()] == [4, 5, 6]
    assert [r["id"] for r in combine.page_after(spark.range(10), "id", None, 1, descending=True).collect()] == [9, 8]


def test_top_values_limit_before_ranking(spark):
    plan = combine.top_values(spark.range(9).selectExpr("cast(id as string) s"), ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
