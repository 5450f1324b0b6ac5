"""Vector search, word ranking and fusion against plain Python on small tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput
from millrace.operators import retrieval

SCHEMA = "id long, v array<float>, list int, score string"


def unit(v):
    return np.array(v, dtype=np.float64) / np.linalg.norm(v)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 16))
    made = [(i, (centers[i % 12] + 0.4 * r.normal(size=16)).astype(float).tolist()) for i in range(400)]
    copies = [(1000 + i, made[5][1]) for i in range(300)]  # one vector holds a third of all rows
    return made + copies + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, 2.0]), (2004, [float("nan")] * 16), (None, made[7][1])]


def by_hand(rows, query, k):
    scored = [(-float(unit(np.float32(query)) @ unit(np.float32(v))), i) for i, v in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v) and i is not None]
    return [(i, -s) for s, i in sorted((round(s, 9), i) for s, i in scored)[:k]]


@pytest.mark.parametrize("part", [4096, 30])
def test_neighbours(spark, rows, tmp_path, monkeypatch, part):
    monkeypatch.setattr(retrieval, "PART", part)
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    index = retrieval.build(vectors.filter("id IS NOT NULL"), "id", "v", str(tmp_path / f"index{part}"), lists=20)
    stored = spark.read.parquet(index.path)
    assert stored.count() == 700 and stored.groupBy("list", "part").count().agg(F.max("count")).first()[0] <= 2 * part
    asked = vectors.filter("id < 60 OR id IN (2000, 2002, 2003)")
    everywhere = retrieval.search(asked, index, "id", "v", k=5, probe=20, refine=400).collect()
    whole = retrieval.exact(asked, vectors.filter("id IS NOT NULL"), "id", "v", "id", "v", 5).collect()
    near = collections.defaultdict(set)
    for r in retrieval.search(asked, index, "id", "v", k=5, probe=4, refine=400).collect():
        near[r.query].add(r.id)
    text = dict(rows)
    for q in range(60):
        hand = by_hand(rows, text[q], 5)
        # Equal vectors may differ in the last digit of their scores, so ids are compared where scores are.
        for found in (everywhere, whole):
            mine = sorted((r.rank, r.id, r.score) for r in found if r.query == q)
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and np.allclose([m[2] for m in mine], [s for _, s in hand], atol=1e-6)
    assert {r.query for r in everywhere} == {r.query for r in whole} == set(range(60))
    scores = {(r.query, r.id) for r in whole}
    assert sum((q, i) in scores for q in near for i in near[q]) >= 0.9 * len([1 for q in range(60) if q % 12 != 5]) * 5


def test_no_vectors(spark, tmp_path):
    with pytest.raises(InvalidInput):
        retrieval.build(spark.createDataFrame([(1, None, 1, "")], SCHEMA), "id", "v", str(tmp_path / "none"))
    one = spark.createDataFrame([(1, [3.0, 4.0], 1, "")], SCHEMA)
    index = retrieval.build(one, "id", "v", str(tmp_path / "one"))
    assert [tuple(r)[:2] for r in retrieval.search(one, index, "id", "v").collect()] == [(1, 1)]
    assert retrieval.search(one.limit(0), index, "id", "v").count() == 0 == retrieval.exact(one.limit(0), one, "id", "v", "id", "v").count()
    with pytest.raises(InvalidInput):
        retrieval.search(one, index, "id", "v", k=60)


def test_words(spark):
    r = random.Random(2)
    said = [" ".join(r.choice(["the", "Cat", "sat", "é字", "x_1", "on", "mat"][: 3 + i % 5]) for _ in range(r.randrange(1, 30))) for i in range(40)]
    docs = [*enumerate(said), (50, said[3]), (51, None), (52, "")]
    asked = [(1, "the CAT cat"), (2, "é字 mat!"), (3, "unseen"), (4, None), (5, "x_1 on the")]
    got = retrieval.bm25(spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(asked, "q long, s string"), "id", "t", "q", "s", 6).collect()
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    held = {i: split(t) for i, t in docs}
    mean = sum(map(len, held.values())) / len(held)
    for q, text in asked:
        scores = {}
        for i, w in held.items():
            for word in set(split(text)):
                df = sum(word in x for x in held.values())
                tf = w.count(word)
                if tf:
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        hand = sorted((-round(s, 9), i) for i, s in scores.items())[:6]
        assert [(x.id, x.score) for x in sorted((x for x in got if x.query == q), key=lambda x: x.rank)] == [(i, pytest.approx(-s, abs=2e-9)) for s, i in hand]


def test_fusion(spark):
    one = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "query long, id long, rank int")
    two = spark.createDataFrame([(1, 8, 1), (1, 6, 2)], "query long, id long, rank int")
    got = sorted((r.query, r.rank, r.id, r.score) for r in retrieval.fused([one, two], 2).collect())
    assert got == [(1, 1, 8, 1 / 61 + 1 / 62), (1, 2, 7, 1 / 61), (2, 1, 9, 1 / 61)]
    with pytest.raises(InvalidInput):
        retrieval.fused([])


def test_words_meet_in_parts(spark, monkeypatch):
    """Only a part's first places are shuffled, and repeated ids count as before, whatever the parts and blocks."""
    docs = spark.createDataFrame([(i % 150 if i else None, "the cat " * (i % 7) + "on a mat" * (i % 3)) for i in range(300)], "id long, t string")
    asked = spark.createDataFrame([(q, "the cat on mat") for q in (*range(6), 3, None)], "q long, s string")
    rank = lambda: retrieval.bm25(docs, asked, "id", "t", "q", "s", 3)
    whole = {tuple(r) for r in rank().collect()}
    assert len(whole) == 21
    for part, queries in ((40, 2), (7, 512)):
        monkeypatch.setattr(retrieval, "PART", part)
        monkeypatch.setattr(retrieval, "QUERIES", queries)
        assert {tuple(r) for r in rank().collect()} == whole
    plan = rank()._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
