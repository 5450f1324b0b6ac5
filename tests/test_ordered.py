"""Ordered computations against plain pandas, on data where one key holds a third of the rows or more."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput
from millrace.operators import ordered


@pytest.fixture(scope="module", params=["hot", "ties", "many"])
def data(spark, request):
    random.seed(11)
    rows = []
    for i in range(600):
        key = {"hot": "a" if i % 5 < 2 else f"k{i % 40}", "ties": random.choice(["a", "b", None]), "many": f"k{i % 300}"}[request.param]
        at = 7 if request.param == "ties" and i % 2 else random.randint(0, 50)
        rows.append((key, at, i, random.choice([None, 1, 2, 3, 10])))
    df = spark.createDataFrame(rows, "k string, at int, id int, v int").repartition(5)
    pdf = pd.DataFrame(rows, columns=["k", "at", "id", "v"]).sort_values(["at", "id"])
    pdf["k"] = pdf["k"].where(pdf["k"].notna(), "~")
    return df, pdf


ORDER = ["at", "id"]


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_chunks_follow_order_and_split_hot_keys(data):
    df, _ = data
    cut = ordered.chunked(df, ["k"], ORDER)
    spread = cut.groupBy("k").agg(F.count_distinct(ordered.CHUNK).alias("c")).agg(F.max("c")).first()[0]
    assert spread >= 1
    bounds = cut.groupBy(ordered.CHUNK).agg(F.min(F.struct("k", *ORDER)).alias("lo"), F.max(F.struct("k", *ORDER)).alias("hi")).orderBy(ordered.CHUNK).collect()
    keyed = lambda r: tuple((x is not None, x) for x in r)
    assert all(keyed(a["hi"]) < keyed(b["lo"]) for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_running(data, hot):
    df, pdf = data
    out = by_id(ordered.by_order(df, ["k"], ORDER, {"n": F.lit(1), "s": F.col("v")}, hot_rows=hot), "n", "s")
    n = pdf.groupby("k").cumcount() + 1
    s = pdf["v"].fillna(0).groupby(pdf["k"]).cumsum()
    assert out == {i: (a, int(b)) for i, a, b in zip(pdf["id"], n, s)}


@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_neighbours(data, hot):
    df, pdf = data
    out = by_id(ordered.by_order(df, ["k"], ORDER, previous={"before": "v"}, following={"after": "id"}, hot_rows=hot), "before", "after")
    clean = lambda x: None if pd.isna(x) else int(x)
    expected = {i: (clean(a), clean(b)) for i, a, b in zip(pdf["id"], pdf.groupby("k")["v"].shift(1), pdf.groupby("k")["id"].shift(-1))}
    assert out == expected


@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_ranks(data, hot):
    df, pdf = data
    out = by_id(ordered.ranks(df, ["k"], "at", hot_rows=hot), "rank", "dense_rank")
    rank, dense = pdf.groupby("k")["at"].rank("min"), pdf.groupby("k")["at"].rank("dense")
    assert out == {i: (int(a), int(b)) for i, a, b in zip(pdf["id"], rank, dense)}


@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_trailing(spark, data, hot):
    df, pdf = data
    timed = df.withColumn("t", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(at)"))
    out = by_id(ordered.trailing(timed, ["k"], "t", "id", "3 DAYS", {"n": F.lit(1), "s": F.col("v")}, hot_rows=hot), "n", "s")
    expected = {}
    for _, group in pdf.groupby("k"):
        for i, at in zip(group["id"], group["at"]):
            frame = group[(group["at"] >= at - 3) & (group["at"] <= at)]
            expected[i] = (len(frame), int(frame["v"].fillna(0).sum()))
    assert out == expected


@pytest.mark.parametrize("hot", [0, 10_000])
def test_trailing_keeps_infinities_in_their_frames(spark, hot):
    values = [1.0, float("inf"), 2.0, 3.0, 1e17, 1.0, float("nan"), 2.0, 5.0]
    rows = [("a", dt.datetime(2024, 1, 1, i), i, v) for i, v in enumerate(values)] + [("a", None, 20, 4.0), ("a", None, 21, 6.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, id int, v double")
    got = by_id(ordered.trailing(df, ["k"], "t", "id", "30 MINUTES", {"s": F.col("v")}, hot_rows=hot), "s")
    assert [str(got[i][0]) for i in range(9)] == [str(v) for v in values] and got[20] == got[21] == (10.0,)
    got = by_id(ordered.trailing(df, ["k"], "t", "id", "1 HOUR", {"s": F.col("v")}, hot_rows=hot), "s")
    assert [str(got[i][0]) for i in range(9)] == ["1.0", "inf", "inf", "5.0", "1e+17", "1e+17", "nan", "nan", "7.0"]


def test_trailing_needs_a_fixed_length(data):
    with pytest.raises(InvalidInput):
        ordered.trailing(data[0].withColumn("t", F.current_timestamp()), ["k"], "t", "id", "1 MONTH", {"n": F.lit(1)})


def test_ends_and_median(data):
    df, pdf = data
    out = by_id(ordered.ends(df, ["k"], ORDER, {"first": "id"}, {"last": "id"}), "first", "last")
    firsts, lasts = pdf.groupby("k")["id"].transform("first"), pdf.groupby("k")["id"].transform("last")
    assert out == {i: (a, b) for i, a, b in zip(pdf["id"], firsts, lasts)}
    for hot in (0, 30, 10_000):
        medians = {r["k"] or "~": r["median"] for r in ordered.exact_median(df, ["k"], "v", hot_rows=hot).collect()}
        assert medians == pdf.dropna().groupby("k")["v"].median().to_dict()


def test_hot_key_is_spread(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k", "7 AS at", "id")
    cut = ordered.chunked(df, ["k"], ["at", "id"])
    assert cut.filter("k = 'hot'").select(ordered.CHUNK).distinct().count() > 1
    assert cut.groupBy(ordered.CHUNK).count().agg(F.max("count")).first()[0] < 1200
