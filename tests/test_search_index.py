"""The stored index against the search that reads all texts, over generations, merges and failed writes."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput
from millrace.operators import search, search_index

WORDS = ["the", "then", "theme", "Érer", "er", "errand", "字符", "x_1", "a"]


def made(spark, seed, keys):
    r = random.Random(seed)
    rows = [(k, " ".join(r.choice(WORDS) + r.choice(["", ".", "-"]) for _ in range(r.randrange(0, 9))) or None, r.choice(["p", "q", None])) for k in keys]
    return spark.createDataFrame(rows, "id long, body string, project string")


def scanned(refs, query, where=None):
    # Searches show 50 objects at most, so all are asked for key by key range.
    words = search.query_words(query)
    body = F.lower(F.concat_ws(" ", "body"))
    hits = refs.withColumn("_b", body).filter(search.matches(F.col("_b"), words))
    rank = sum((F.regexp_count("_b", F.lit(search._starts_a_word(w))) for w in words[1:]), F.regexp_count("_b", F.lit(search._starts_a_word(words[0]))))
    hits = hits if where is None else hits.filter(where)
    return {(r.id, r.project, r["rank"]) for r in hits.withColumn("rank", rank.cast("bigint")).collect()}


@pytest.mark.parametrize("query", ["the", "the er", "THE then", "字", "x_ a", "ér the", "nothing"])
def test_like_a_scan(spark, tmp_path, query):
    path = str(tmp_path / "index")
    refs = made(spark, 1, [*range(80), 2**40, -3, 70_000])
    search_index.write(refs, path, ["body"], "id", ["id", "project"])
    words = search.query_words(query)
    assert {tuple(r) for r in search_index.found(spark, path, words).collect()} == scanned(refs, query)
    assert {tuple(r) for r in search_index.found(spark, path, words, F.col("project") == "p").collect()} == scanned(refs, query, F.col("project") == "p")
    top = search.search(refs, query, ["body"], name="id", limit=7).select("id", "project", "rank").collect()
    assert search_index.search(spark, path, query, "id", limit=7).collect() == top


def test_generations(spark, tmp_path):
    path = str(tmp_path / "index")
    first, second = made(spark, 1, range(60)), made(spark, 2, range(40, 90, 2))
    search_index.write(first, path, ["body"], "id", ["id", "project"])
    search_index.write(second, path, ["body"], "id", ["id", "project"], removed=spark.createDataFrame([(1,), (1,), (44,), (500,)], "id long"))
    now = first.join(second, "id", "left_anti").filter("id <> 1").unionByName(second)
    expected = scanned(now, "the er")
    ask = lambda: {tuple(r) for r in search_index.found(spark, path, ["the", "er"]).collect()}
    assert ask() == expected
    search_index.merge(spark, path)
    assert search_index.generations(spark, path) == ["00000003-merged"] and ask() == expected
    # A generation without complete entries isn't read, and its number isn't taken again.
    (tmp_path / "index" / "00000004" / "postings").mkdir(parents=True)
    search_index.write(spark.createDataFrame([(7, "the error", "z")], first.schema), path, ["body"], "id", ["id", "project"])
    assert search_index.generations(spark, path) == ["00000003-merged", "00000005"]
    assert (7, "z", 2) in ask()


def test_only_the_terms_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    search_index.write(made(spark, 3, range(50)), path, ["body"], "id", ["id"])
    plan = search_index.postings_of(spark, path, ["the", "er"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,the)" in plan and "StringStartsWith(term,er)" in plan


def test_bad_input(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(InvalidInput):
        search_index.search(spark, path, "x", "id")
    with pytest.raises(Exception, match="without a key"):
        search_index.write(spark.createDataFrame([(None, "the")], "id long, body string"), path, ["body"], "id", ["id"])
    search_index.write(made(spark, 1, []), path, ["body"], "id", ["id", "project"])
    assert search_index.search(spark, path, "the", "id").count() == 0 and search_index.search(spark, path, "", "id").count() == 0
    with pytest.raises(InvalidInput):
        search_index.search(spark, path, "the", "id", limit=51)


def test_words_are_listed_where_they_are(spark):
    """An object's words are counted in its row; lists of a batch need no shuffle."""
    words = spark.createDataFrame([(1, ["the", "a", "the"]), (70000, ["the"]), (-3, ["a"]), (5, []), (6, None), (1, ["a"])], "key long, words array<string>").coalesce(1)
    out = search_index._listed(words)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.block * search_index.BLOCK + p): 0 for r in out.collect() for p in r.places}
    for r in out.collect():
        for p, n in zip(r.places, r.counts):
            got[r.term, r.block * search_index.BLOCK + p] += n
    assert got == {("the", 1): 2, ("a", 1): 2, ("the", 70000): 1, ("a", -3): 1}
    assert search_index._listed(words.limit(0)).count() == 0 == search_index._listed(words.filter("key = 5")).count()
