import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput
from millrace.operators import combine, group, join, labels, prepare
from millrace.plans import lineage


def catalog(spark, versions, hashes=("h1", "h2"), built=(("b", 1, "h1", {"a": 1}), ("c", 1, "h2", {"b": 1}))):
    """a -> r1 -> b -> r2 -> c"""
    return (
        spark.createDataFrame(list(zip("abc", versions)), "dataset string, current_version bigint"),
        spark.createDataFrame([("r1", "b", hashes[0]), ("r2", "c", hashes[1])], "recipe string, output string, config_hash string"),
        spark.createDataFrame([("r1", "a"), ("r2", "b")], "recipe string, input string"),
        spark.createDataFrame(list(built), "dataset string, version bigint, recipe_config_hash string, input_versions map<string,bigint>"),
    )


def steps(spark, tables, force=False):
    targets = spark.createDataFrame([("r2",)], "recipe string")
    deps = lineage.dependencies(tables[1], tables[2])
    out = lineage.rebuild_steps(targets, deps, lineage.staleness(*tables), force)
    return [r["recipe"] for r in out.orderBy("level", "recipe").collect()]


def test_rebuild_sets(spark):
    assert steps(spark, catalog(spark, (1, 0, 0), built=())) == ["r1", "r2"]
    fresh = catalog(spark, (1, 1, 1))
    assert steps(spark, fresh) == [] and steps(spark, fresh, force=True) == ["r1", "r2"]
    assert steps(spark, catalog(spark, (1, 1, 1), hashes=("changed", "h2"))) == ["r1", "r2"]
    rebuilt = catalog(spark, (1, 2, 1), hashes=("changed", "h2"), built=(("b", 2, "changed", {"a": 1}), ("c", 1, "h2", {"b": 1})))
    assert steps(spark, rebuilt) == ["r2"]


def test_staleness_states(spark):
    states = lambda t: {r["dataset"]: r["staleness"] for r in lineage.staleness(*t).collect()}
    assert states(catalog(spark, (1, 1, 0))) == {"b": "fresh", "c": "never_built"}
    assert states(catalog(spark, (2, 1, 1))) == {"b": "stale", "c": "fresh"}
    assert states(catalog(spark, (1, 1, 1), built=(("b", 1, "h1", {}), ("c", 1, "h2", {"b": 1})))) == {"b": "stale", "c": "fresh"}


def test_status_overlay(spark):
    tables = catalog(spark, (0, 1, 1))
    runs = spark.createDataFrame([("b", "failed", 2), ("b", "succeeded", 1), ("c", "failed", 1), ("c", "running", None)], "dataset string, status string, finished_at int")
    out = {r["dataset"]: r["status"] for r in lineage.dataset_status(tables[0], lineage.staleness(*tables), runs).collect()}
    assert out == {"a": "source_empty", "b": "failed", "c": "building"}


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "recipe string")
    deps = lambda *pairs: spark.createDataFrame(list(pairs), "recipe string, needs string")
    out = {r["recipe"]: r["level"] for r in lineage.levels(nodes, deps(("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("x", "a"))).collect()}
    assert out == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    with pytest.raises(InvalidInput):
        lineage.levels(nodes, deps(("a", "b"), ("b", "a"), ("c", "b")))
    with pytest.raises(InvalidInput):
        lineage.levels(nodes, deps(*(("abcde"[i], "abcde"[(i + 1) % 5]) for i in range(5))))


def test_floors_and_ratchet(spark):
    pairs = spark.createDataFrame(
        [("o", "none", None, "intern", "bsn"), ("o", "bijzonder", "bbn2", None, "bsn"), ("p", "persoonsgegevens", None, None, "none")],
        "output string, classification string, bbn string, confidentiality string, own string")
    plain = {r["output"]: tuple(r)[1:] for r in labels.floors(pairs, "output").collect()}
    assert plain == {"o": ("bijzonder", "bbn2", "intern"), "p": ("persoonsgegevens", None, None)}
    kept = {r["output"]: r["classification"] for r in labels.floors(pairs, "output", {"classification": "own"}).collect()}
    assert kept == {"o": "bsn", "p": "persoonsgegevens"}


def test_purposes_and_basis(spark):
    pairs = spark.createDataFrame(
        [("o", 1, ["b", "a", "c"], "law"), ("o", 2, ["c", "b", "b"], "consent"), ("o", 3, ["b", "c"], "law"), ("q", 1, ["x"], None), ("q", 2, ["y"], "")],
        "output string, ordinal int, codes array<string>, basis string")
    assert {r["output"]: r["purposes"] for r in labels.purposes(pairs, "output", "ordinal", "codes").collect()} == {"o": ["b", "c"], "q": []}
    assert {r["output"]: r["legal_basis"] for r in labels.legal_basis(pairs, "output", "ordinal", "basis").collect()} == {
        "o": "law · consent", "q": "Derived (see inputs)"}


def test_column_labels(spark):
    df = labels.label_columns(spark.createDataFrame([(1, "x")], "id int, bsn string"), {"bsn": "bsn"})
    assert labels.column_labels(df.schema) == {"id": "none", "bsn": "bsn"}
    df = labels.explicit_labels(df)
    carried = lambda out, *inputs, **how: labels.column_labels(labels.carry_labels(out, *inputs, **how).schema)
    assert carried(df.selectExpr("id", "bsn", "concat(bsn, id) AS mixed"), df) == {"id": "none", "bsn": "bsn", "mixed": "bsn"}
    assert carried(df.selectExpr("bsn AS id", "id AS bsn"), df) == {"id": "bsn", "bsn": "none"}  # labels follow values, not names
    assert carried(prepare.formula(df, "id", "bsn"), df) == {"id": "bsn", "bsn": "bsn"}
    assert carried(prepare.prepare(df, [{"op": "cast", "casts": {"id": "string"}}, {"op": "fill_nulls", "values": {"id": "0"}}]), df) == {"id": "none", "bsn": "bsn"}
    plain = labels.explicit_labels(df.sparkSession.createDataFrame([(1, "y")], "id int, bsn string"))
    assert carried(join.join(plain, df, [("id", "id")], "left"), plain, df) == {"id": "none", "bsn": "none", "id_right": "none", "bsn_right": "bsn"}
    assert carried(plain.union(df), plain, df) == {"id": "bsn", "bsn": "bsn"}
    assert carried(combine.stack(plain, df), plain, df, by_name=True) == {"id": "none", "bsn": "bsn"}
    assert carried(group.group(df, ["id"], [{"column": "bsn", "func": "max", "as": "top"}]), df) == {"id": "none", "top": "bsn"}
    for bad in ({"nope": "bsn"}, {"id": "secret"}):
        with pytest.raises(InvalidInput):
            labels.label_columns(df, bad)
    assert labels.blocking_labels("bsn", "bbn3") == ["bbn3", "bsn"] and labels.blocking_labels("none", None) == []


def test_levels_keep_each_recipe_once(spark):
    """A deep chain beside a wide one: the result holds a row per recipe as it is, with nothing grouped again."""
    nodes = spark.range(40).select(F.col("id").alias("recipe"))
    needs = nodes.filter("recipe > 0").select("recipe", F.explode(F.array(F.col("recipe") - 1, F.expr("recipe div 2"))).alias("needs"))
    out = lineage.levels(nodes, needs)
    assert sorted((r.recipe, r.level) for r in out.collect()) == [(i, i) for i in range(40)]
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
