"""Metrics over linked entities against loops over rows, and checks that gate a version."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.errors import ChecksFailed, InvalidInput
from millrace.operators.checks import Check, check
from millrace.operators.metrics import Link, Metric, measure, repeated_keys, way
from millrace.sources import versions

# A sale without a shop, with an unknown shop, repeated rows, a shop without sales, a shop without a town.
SALES = [(1, "a", 10, "x"), (2, "a", 20, "y"), (2, "a", 20, "y"), (3, "b", 5, "x"), (4, None, 7, "x"), (5, "zz", 8, None), (6, "d", None, "y")]
SHOPS = [("a", 1, 3), ("b", 2, 4), ("c", 2, 5), ("d", None, 6)]
TOWNS = [(1, "N"), (2, "S"), (3, "E")]
LINKS = [Link("sale shop", "sale", "shop", (("shop", "id"),)), Link("shop town", "shop", "town", (("town", "id"),))]


@pytest.fixture(scope="module")
def entities(spark):
    return {"sale": spark.createDataFrame(SALES, "id int, shop string, amount int, kind string"),
            "shop": spark.createDataFrame(SHOPS, "id string, town int, staff int"),
            "town": spark.createDataFrame(TOWNS, "id int, side string")}


def side(shop):
    town = next((t for i, t, _ in SHOPS if i == shop), None)
    return next((s for i, s in TOWNS if i == town), None)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("first", [False, True])
def test_metrics_of_two_entities(entities, first):
    asked = {"total": Metric("sale", "sum", "amount"), "sales": Metric("sale", "count"), "mean": Metric("sale", "mean", "amount"),
             "priced": Metric("sale", "count", "amount"), "staff": Metric("shop", "sum", "staff"), "top": Metric("sale", "max", "amount * 2")}
    got = measure(entities, LINKS, asked, {"side": "town.side"}, aggregate_first=first)
    want = []
    for s in {side(x) for _, x, _, _ in SALES} | {side(i) for i, _, _ in SHOPS}:
        mine = [a for _, x, a, _ in SALES if side(x) == s]
        known = [a for a in mine if a is not None]
        staff = [n for i, _, n in SHOPS if side(i) == s]
        want.append((s, sum(known) if known else None, len(mine), sum(known) / len(known) if known else None, len(known), sum(staff) if staff else None, 2 * max(known) if known else None))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("first", [False, True])
def test_filters_keep_rows_whose_partner_passes(entities, first):
    got = measure(entities, LINKS, {"total": Metric("sale", "sum", "amount")}, {"kind": "sale.kind"}, filters=[("town", "side <> 'S'"), ("sale", "amount > 10")], aggregate_first=first)
    assert rows(got) == [("y", 40)]


def test_no_dimensions_and_no_rows(entities):
    asked = {"n": Metric("sale", "count"), "kinds": Metric("sale", "count_distinct", "kind"), "towns": Metric("town", "count")}
    assert rows(measure(entities, LINKS, asked)) == [(7, 2, 3)]
    empty = {n: df.limit(0) for n, df in entities.items()}
    assert rows(measure(empty, LINKS, asked)) == [(0, 0, 0)]
    assert rows(measure(empty, LINKS, {"n": asked["n"]}, {"side": "town.side"})) == []


def test_grain(spark, entities):
    days = spark.createDataFrame([("a", "2024-01-31"), ("a", "2024-01-01"), ("b", "2024-02-01"), (None, None)], "shop string, d string").withColumn("d", F.to_timestamp("d"))
    got = measure({**entities, "visit": days}, [*LINKS, Link("visit shop", "visit", "shop", (("shop", "id"),))], {"n": Metric("visit", "count")}, grain={"month": ("visit.d", "month")})
    assert {(str(r.month)[:10], r.n) for r in got.collect()} == {("2024-01-01", 2), ("2024-02-01", 1), ("None", 1)}


def test_what_is_refused(entities):
    n = {"n": Metric("sale", "count")}
    with pytest.raises(InvalidInput, match="several times"):
        measure(entities, LINKS, {"towns": Metric("town", "count")}, {"kind": "sale.kind"})
    with pytest.raises(InvalidInput, match="several times"):
        measure(entities, LINKS, {"staff": Metric("shop", "sum", "staff")}, filters=[("sale", "amount > 1")])
    second = [*LINKS, Link("sale town", "sale", "town", (("id", "id"),))]
    with pytest.raises(InvalidInput, match="several ways"):
        measure(entities, second, n, {"side": "town.side"})
    assert measure(entities, second, n, {"side": "town.side"}, without=["sale town"]).count() == 3
    assert [x.name for x in way(LINKS + [Link("back", "town", "sale", (("id", "id"),))], "sale", "town")] == ["sale shop", "shop town"]
    for bad in ({"n": Metric("sale", "median", "amount")}, {"n": Metric("sale", "sum")}, {"n": Metric("moon", "count")}, {}, {"N": n["n"], "n": n["n"]}, {"n": Metric("sale", "sum", "(SELECT 1)")}):
        with pytest.raises(InvalidInput):
            measure(entities, LINKS, bad)
    for kw in ({"dimensions": {"x": "town.nothing"}}, {"dimensions": {"n": "town.side"}}, {"grain": {"x": ("sale.kind", "decade")}}, {"filters": [("town", "reflect('a', 'b')")]}):
        with pytest.raises(InvalidInput):
            measure(entities, LINKS, n, **kw)
    with pytest.raises(InvalidInput):
        measure(entities, LINKS, {"k": Metric("sale", "count_distinct", "kind")}, aggregate_first=True)


def test_links_whose_one_side_repeats(entities):
    wrong = Link("shop sale", "shop", "sale", (("id", "shop"),))
    assert rows(repeated_keys(entities, [*LINKS, wrong])) == [("sale shop", 0), ("shop sale", 1), ("shop town", 0)]


def test_rows_are_joined_once_per_key_when_aggregated_first(entities):
    plan = measure(entities, LINKS, {"n": Metric("sale", "count")}, {"side": "town.side"}, aggregate_first=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate") and plan.count("Aggregate") == 2


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (2, "b", float("nan"))], "i int, t string, x double")
    asked = [Check("rows", "rows", warn=(3, 3)), Check("nulls", "null_share", "t", warn=(0, 0.5), fail=(0, 0.3)), Check("known", "distinct", "i", fail=(2, 2)),
             Check("big", "matching_share", "i > 1", warn=(0.9, None)), Check("sum", "sum", "i", warn=(None, 4), fail=(None, 5)), Check("nan", "mean", "x", warn=(0, 9))]
    assert [(r["name"], r["status"]) for r in check(df, asked)] == [("rows", "pass"), ("nulls", "fail"), ("known", "pass"), ("big", "warn"), ("sum", "warn"), ("nan", "warn")]
    # Of no rows there is no share, sum or mean, and what has no value is outside any bounds.
    assert [(r["value"], r["status"]) for r in check(df.limit(0), asked)] == [(0, "warn"), (None, "fail"), (0, "fail"), (None, "warn"), (None, "fail"), (None, "warn")]
    assert check(df, []) == []
    for bad in (Check("b", "median", "i"), Check("b", "rows", "i"), Check("b", "sum"), Check("b", "sum", "zz"), Check("b", "matching_share", "(SELECT 1)")):
        with pytest.raises(InvalidInput):
            check(df, [bad])


def test_a_failing_check_leaves_no_version(spark, tmp_path):
    root, df = str(tmp_path), spark.range(10)
    most = lambda n: Check("most", "max", "id", fail=(None, n))
    assert versions.write_version(df, root, "p", "d", checks=[most(9), Check("rows", "rows", warn=(99, None))]) == 1
    kept = json.loads(versions.versions(spark, root).first().profile)["checks"]
    assert [(r["value"], r["status"]) for r in kept] == [(9.0, "pass"), (10.0, "warn")]
    with pytest.raises(ChecksFailed) as failed:
        versions.write_version(df, root, "p", "d", checks=[most(8)])
    assert failed.value.results == [{"name": "most", "value": 9.0, "status": "fail"}]
    assert versions.current_version(spark, root, "p", "d") == 1 and os.listdir(f"{root}/projects/p/datasets/d") == ["v1"]
    # The claim is free again, and the next build takes the same number.
    assert versions.write_version(df.limit(3), root, "p", "d", checks=[most(8)]) == 2
