"""Sketches that merge and drift between versions, against loops over rows."""

import math
import random
from bisect import bisect_right

import pytest

from millrace.errors import InvalidInput
from millrace.operators import drift, sketches

R = random.Random(4)
BASE = [(R.gauss(0, 1), R.randrange(30), R.choice("aab")) for _ in range(4000)]
NOW = [(R.gauss(0.4, 1.3), R.choice([1, 2, R.randrange(30)]), R.choice("abc")) for _ in range(3000)]
ODD = [(None, None, None), (float("nan"), 5, ""), (float("inf"), 5, "a"), (-0.0, 0, "a"), (0.0, 0, None)]
SCHEMA = "x double, n int, kind string"


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(BASE + ODD, SCHEMA), spark.createDataFrame(NOW + ODD[:2], SCHEMA)


def walked(a, b):
    a, b = (sorted(v for v in side if v is not None and v == v) for side in (a, b))
    return max(abs(bisect_right(a, v) / len(a) - bisect_right(b, v) / len(b)) for v in {*a, *b})


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_distances(sides, hot_rows):
    got = {r.name: r for r in drift.distances(*sides, ["x", "n"], hot_rows=hot_rows).collect()}
    for i, name in enumerate(["x", "n"]):
        a, b = [r[i] for r in BASE + ODD], [r[i] for r in NOW + ODD[:2]]
        assert got[name].ks == pytest.approx(walked(a, b), abs=1e-12)
        assert got[name].n_base == sum(v is not None and v == v for v in a)


def test_stability(sides):
    got = {r.name: r.psi for r in drift.stability(*sides, ["kind", "n"]).collect()}
    for i, name in ((2, "kind"), (1, "n")):
        a, b = [r[i] for r in BASE + ODD], [r[i] for r in NOW + ODD[:2]]
        want = 0
        for v in {*a, *b}:
            p, q = max(a.count(v) / len(a), drift.FLOOR), max(b.count(v) / len(b), drift.FLOOR)
            want += (q - p) * math.log(q / p)
        assert got[name] == pytest.approx(want, abs=1e-9)


def test_without_rows(spark, sides):
    none = spark.createDataFrame([], SCHEMA)
    assert [(r.n_now, r.ks) for r in drift.distances(sides[0], none, ["n"]).collect()] == [(0, None)]
    assert drift.distances(none, none, ["n"]).collect() == []
    assert [r.psi for r in drift.stability(none, sides[1], ["kind"]).collect()] == [None]
    empty = sketches.sketch(none)
    assert [(r.row_count, r.null_count, r.low, r["mean"], r.quantiles) for r in sketches.shown(empty).collect()] == [(0, 0, None, None, None)] * 3
    assert drift.sketched(empty, sketches.sketch(sides[1])).collect() == []
    grown = {r.name: r.row_count for r in sketches.shown(sketches.appended(empty, sides[1])).collect()}
    assert grown == {"x": len(NOW) + 2, "n": len(NOW) + 2, "kind": len(NOW) + 2}
    with pytest.raises(InvalidInput):
        drift.distances(*sides, ["kind"])
    with pytest.raises(InvalidInput):
        drift.distances(*sides, [])


def test_sketches_stay_within_their_bound(spark):
    values = [R.expovariate(1) for _ in range(60_000)]
    parts = [spark.createDataFrame([(v, i % 977) for i, v in enumerate(values[at : at + 15_000])], "v double, `k.ey` int") for at in range(0, 60_000, 15_000)]
    kept = sketches.sketch(parts[0])
    for part in parts[1:]:
        kept = sketches.appended(kept, part)
    shares = tuple(i / 20 for i in range(1, 20))
    got = {r.name: r for r in sketches.shown(kept, shares).collect()}
    ranked = sorted(values)
    assert all(abs(bisect_right(ranked, q) / len(ranked) - s) <= sketches.RANK_ERROR for s, q in zip(shares, got["v"].quantiles))
    assert (got["v"].low, got["v"].high, got["v"].row_count) == (ranked[0], ranked[-1], 60_000)
    assert got["v"]["mean"] == pytest.approx(sum(values) / 60_000)
    assert abs(got["k.ey"].distinct_approx - 977) <= 0.06 * 977


def test_sketched_drift(sides):
    got = {r.name: r for r in drift.sketched(*(sketches.sketch(s) for s in sides)).collect()}
    exact = {r.name: r.ks for r in drift.distances(*sides, ["x", "n"]).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[c].ks - exact[c]) <= 2 * sketches.RANK_ERROR + 2 / drift.GRID for c in exact)
    # Two sketches of the same rows differ by their random choices, within the bound.
    for r in drift.sketched(sketches.sketch(sides[0]), sketches.sketch(sides[0])).collect():
        assert r.ks <= 2 * sketches.RANK_ERROR + 2 / drift.GRID and r.psi < 0.01
    # Bins at the deciles of the base, by hand.
    a, b = (sorted(r[0] for r in side if r[0] is not None and r[0] == r[0]) for side in (BASE + ODD, NOW + ODD[:2]))
    edges = [a[len(a) * i // 10] for i in range(1, 10)]
    shares = [[(bisect_right(s, hi) - bisect_right(s, lo)) / len(s) for lo, hi in zip([-math.inf, *edges], [*edges, math.inf])] for s in (a, b)]
    assert got["x"].psi == pytest.approx(sum((q - p) * math.log(q / p) for p, q in zip(*shares)), abs=0.05)
