"""Misspelled terms against edit distances to all values."""

import random

import pytest

from millrace.errors import InvalidInput
from millrace.operators.terms import index, resolve


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fold(text):
    return " ".join(text.lower().split())


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_like_all_distances(spark, edits):
    r = random.Random(edits)
    text = lambda: "".join(r.choice("abA é字😀") for _ in range(r.randrange(0, 8)))
    rows = [(text(), r.choice(["a", "ab", "Ab", None, " "])) for _ in range(150)]
    asked = [*(text() for _ in range(60)), "", None, " A  b ", "a b", "x" * 30]
    found = index(spark.createDataFrame(rows, "`na.me` string, kind string"), ["na.me", "kind"], edits)
    got = sorted(tuple(x) for x in resolve(spark.createDataFrame([(t,) for t in [*asked, *asked]], "q string"), "q", found, edits, matches=4).collect())
    counts = {}
    for row in rows:
        for attribute, value in zip(["na.me", "kind"], row):
            if value and value.strip():
                counts[attribute, value] = counts.get((attribute, value), 0) + 1
    want = []
    for t in {t for t in asked if t and t.strip()}:
        near = sorted((d, -n, a, v.encode()) for (a, v), n in counts.items() if (d := distance(fold(t), fold(v))) <= edits)
        want += [(t, i, a, v.decode(), d, -n) for i, (d, n, a, v) in enumerate(near[:4], 1)]
    assert got == sorted(want) and (got or edits == 0)


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "a string")
    some = spark.createDataFrame([("x",)], "a string")
    assert index(none, ["a"]).count() == 0
    assert resolve(none, "a", index(some, ["a"])).count() == resolve(some, "a", index(none, ["a"])).count() == 0
    for wrong in (lambda: index(some, []), lambda: resolve(some, "a", index(some, ["a"]), edits=-1), lambda: resolve(some, "a", index(some, ["a"]), matches=0)):
        with pytest.raises(InvalidInput):
            wrong()
