"""Build datasets: the stale recipes upstream of the targets, inputs before outputs, each one a version.

A flow is a list of recipes: {"recipe", "kind", "config", "inputs": [dataset], "output": dataset}. It is
catalog metadata, one entry per recipe; the data itself only moves through Spark.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.errors import InvalidInput
from millrace.operators.labels import LADDERS, carry_labels, explicit_labels, stricter
from millrace.plans.lineage import dependencies, rebuild_steps, staleness
from millrace.plans.recipes import config_hash, run
from millrace.sources.versions import read_version, versions, write_version


def _tables(spark: SparkSession, root: str, project: str, flow: list[dict[str, Any]]) -> dict[str, DataFrame]:
    # Arrow tables become local relations, whose size Spark knows when it plans the joins.
    recipes = spark.createDataFrame(pa.table({
        "recipe": pa.array([r["recipe"] for r in flow], pa.string()), "output": pa.array([r["output"] for r in flow], pa.string()),
        "config_hash": pa.array([config_hash(_plain(r["config"])) for r in flow], pa.string())}))
    reads = [(r["recipe"], i) for r in flow for i in r["inputs"]]
    inputs = spark.createDataFrame(pa.table({
        "recipe": pa.array([r for r, _ in reads], pa.string()), "input": pa.array([i for _, i in reads], pa.string())}))
    built = versions(spark, root).filter(F.col("project") == project)
    names = inputs.select(F.col("input").alias("dataset")).unionByName(recipes.select(F.col("output").alias("dataset"))).distinct()
    current = built.groupBy("dataset").agg(F.max("version").alias("v"))
    datasets = names.join(current, "dataset", "left").select("dataset", F.coalesce("v", F.lit(0)).alias("current_version"))
    return {"recipes": recipes, "inputs": inputs, "versions": built, "datasets": datasets}


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else getattr(value, "__qualname__", str(value))


def steps_for(spark: SparkSession, root: str, project: str, flow: list[dict[str, Any]], targets: list[str],
              force: bool = False) -> list[str]:
    """The recipes a build would run, in order."""
    t = _tables(spark, root, project, flow)
    unmade = sorted(set(targets) - {r["output"] for r in flow})
    if unmade:
        raise InvalidInput(f"no recipe produces {unmade}")
    wanted = t["recipes"].filter(F.col("output").isin(targets)).select("recipe")
    state = staleness(t["datasets"], t["recipes"], t["inputs"], t["versions"])
    steps = rebuild_steps(wanted, dependencies(t["recipes"], t["inputs"]), state, force)
    return [r["recipe"] for r in steps.orderBy("level", "recipe").collect()]


def build(spark: SparkSession, root: str, project: str, flow: list[dict[str, Any]], targets: list[str],
          force: bool = False, labels: dict[str, tuple[str | None, str | None]] | None = None) -> dict[str, int]:
    """Run the steps and commit a version for each output: {dataset: version}. A split also commits its
    second output, as `<output>_rest`.

    An output is at least as strictly labelled, per ladder, as each of its inputs, and never less than its
    own last version. A code step is judged by the labels of its inputs' versions, and by those that `labels`
    adds as (classification, bbn).
    """
    by_name = {r["recipe"]: r for r in flow}
    made: dict[str, int] = {}
    for name in steps_for(spark, root, project, flow, targets, force):
        recipe = by_name[name]
        made_here = (recipe["output"], recipe["output"] + "_rest")
        newest = F.max_by(F.struct("version", *LADDERS), "version").alias("newest")
        rows = versions(spark, root).filter(
            (F.col("project") == project) & F.col("dataset").isin([*recipe["inputs"], *made_here])
        ).groupBy("dataset").agg(newest).collect()
        known = {r["dataset"]: r["newest"].asDict() for r in rows}
        current = {i: known[i]["version"] for i in recipe["inputs"] if i in known}
        inputs = [explicit_labels(read_version(spark, root, project, i, current.get(i))) for i in recipe["inputs"]]
        told = {i: dict(zip(LADDERS, v)) for i, v in (labels or {}).items()}
        judged = {i: stricter(known.get(i, {}), told.get(i, {})) for i in recipe["inputs"]}
        gate = {i: (v["classification"], v["bbn"]) for i, v in judged.items()}
        outputs = run(recipe["kind"], recipe["config"], inputs, names=recipe["inputs"], labels=gate)
        plain = _plain(recipe["config"])
        for dataset, df in zip(made_here, outputs):
            made[dataset] = write_version(
                carry_labels(df, *inputs, by_name=recipe["kind"] == "stack"), root, project, dataset, config_hash(plain),
                current, plain, labels=stricter(known.get(dataset, {}), *judged.values()))
    return made
