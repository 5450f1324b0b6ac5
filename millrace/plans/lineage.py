"""Lineage over catalog tables: staleness, upstream closure, build levels, rebuild set, status.

Tables: datasets (dataset, current_version), recipes (recipe, output, config_hash), recipe_inputs
(recipe, input), versions (dataset, version, recipe_config_hash, input_versions). Walks over the graph
are frontier joins, one step of the graph per round; each round is checkpointed, so its plan stays
short and a lost executor does not replay the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.operators.combine import latest_per_key
from millrace.session import checkpointed, stored

NEVER_BUILT, STALE, FRESH = "never_built", "stale", "fresh"
FINISHED = ("succeeded", "failed", "skipped")

# Rounds of a walk after which what it has seen becomes one table again.
COMPACT_ROUNDS = 8


def staleness(datasets: DataFrame, recipes: DataFrame, recipe_inputs: DataFrame, versions: DataFrame) -> DataFrame:
    """(recipe, dataset, staleness) per produced dataset.

    Stale when the recipe changed since the current version was built, or an input has a newer version
    than that build read; an input the build did not read counts as version 0.
    """
    built = versions.select(
        F.col("dataset").alias("output"), F.col("version").alias("current_version"),
        F.col("recipe_config_hash").alias("built_hash"), "input_versions")
    produced = recipes.join(
        datasets.select(F.col("dataset").alias("output"), "current_version"), "output"
    ).join(built, ["output", "current_version"], "left")
    read = produced.select("recipe", F.explode("input_versions").alias("input", "read_version"))
    now = datasets.select(F.col("dataset").cast("string").alias("input"), F.col("current_version").alias("now_version"))
    newer = (
        recipe_inputs.withColumn("input", F.col("input").cast("string"))
        .join(now, "input").join(read, ["recipe", "input"], "left")
        .filter(F.col("now_version") > F.coalesce("read_version", F.lit(0)))
        .select("recipe").distinct().withColumn("newer_input", F.lit(True))
    )
    state = (
        F.when((F.col("current_version") == 0) | F.col("built_hash").isNull() & F.col("input_versions").isNull(), NEVER_BUILT)
        .when(~F.col("built_hash").eqNullSafe(F.col("config_hash")) | F.coalesce("newer_input", F.lit(False)), STALE)
        .otherwise(FRESH)
    )
    return produced.join(newer, "recipe", "left").select("recipe", F.col("output").alias("dataset"), state.alias("staleness"))


def dependencies(recipes: DataFrame, recipe_inputs: DataFrame) -> DataFrame:
    """(recipe, needs): a recipe needs each recipe that produces one of its inputs."""
    makers = recipes.select(F.col("output").alias("input"), F.col("recipe").alias("needs"))
    return recipe_inputs.join(makers, "input").select("recipe", "needs").distinct()


def reach(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """Every node reachable from `start` along source -> target, start included."""
    return _reach(checkpointed(edges), start, source, target)


def _reach(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    node = start.columns[0]
    seen = frontier = checkpointed(start.distinct())
    rounds = 0
    while True:
        step = (
            frontier.join(edges, frontier[node] == edges[source]).select(edges[target].alias(node)).distinct()
            .join(seen, node, "left_anti")
        )
        frontier, found = stored(step)
        if not found:
            return seen
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % COMPACT_ROUNDS == 0:
            seen = checkpointed(seen)


def upstream(targets: DataFrame, deps: DataFrame) -> DataFrame:
    """The producers of the targets and every recipe upstream of them."""
    return reach(deps, targets, "recipe", "needs")


def levels(recipes: DataFrame, deps: DataFrame) -> DataFrame:
    """(recipe, level): 0 without dependencies, else one more than the highest of them. A cycle is an
    error."""
    return _ranked(recipes.select("recipe").distinct().withColumn("marked", F.lit(False)), deps).drop("marked")


def _ranked(recipes: DataFrame, deps: DataFrame) -> DataFrame:
    """(recipe, level, marked): `marked` also where anything the recipe needs, over any number of steps, is.

    A recipe is placed in the round after the last of its needs. So each dependency is met once, in the round after
    what it needs was placed, and each recipe is kept once. A round that places none before all are has found a cycle.
    """
    nodes, total = stored(recipes)
    inner = checkpointed(deps.join(nodes.withColumnRenamed("marked", "own"), "recipe").join(nodes.select(F.col("recipe").alias("needs")), "needs", "left_semi").select("recipe", "needs", "own"))
    edges = checkpointed(inner.join(inner.groupBy("recipe").agg(F.count("*").alias("degree")), "recipe"))
    placed, found = stored(nodes.join(inner.select("recipe").distinct(), "recipe", "left_anti").select("recipe", "marked"))
    out, waiting, level = placed.withColumn("level", F.lit(0)), None, 0
    while found < total:
        hits = edges.join(placed.withColumnRenamed("recipe", "needs"), "needs").select("recipe", "degree", F.lit(1).cast("bigint").alias("met"), (F.col("own") | F.col("marked")).alias("marked"))
        if waiting is not None:
            hits = hits.unionByName(waiting)
        judged = checkpointed(hits.groupBy("recipe").agg(F.max("degree").alias("degree"), F.sum("met").alias("met"), F.bool_or("marked").alias("marked")))
        placed, waiting, level = judged.filter("met = degree").select("recipe", "marked"), judged.filter("met < degree"), level + 1
        more = placed.count()
        if not more:
            raise InvalidInput("the recipes form a cycle")
        out, found = out.unionByName(placed.withColumn("level", F.lit(level))), found + more
    return out


def rebuild_steps(targets: DataFrame, deps: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """(recipe, level) to run for the targets: every stale recipe upstream and what depends on it.

    Order by level, then recipe.
    """
    deps = checkpointed(deps)
    closure = _reach(deps, targets, "recipe", "needs")
    inner = checkpointed(deps.join(closure, "recipe", "left_semi"))
    if force:
        return levels(closure, inner)
    stale = state.filter(F.col("staleness") != FRESH).select("recipe").distinct().withColumn("marked", F.lit(True))
    marked = closure.join(stale, "recipe", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    return _ranked(marked, inner).filter("marked").drop("marked")


def dataset_status(datasets: DataFrame, state: DataFrame, steps: DataFrame) -> DataFrame:
    """(dataset, status): staleness for produced datasets, source or source_empty for others; `building`
    while a step runs, `failed` when the latest finished step failed.

    `steps` holds dataset, status, finished_at.
    """
    running = steps.filter("status = 'running'").select("dataset").distinct().withColumn("_running", F.lit(True))
    finished = steps.filter(F.col("status").isin(*FINISHED) & F.col("finished_at").isNotNull())
    last = latest_per_key(finished.select("dataset", "status", "finished_at"), ["dataset"], ["finished_at"])
    base = F.coalesce("staleness", F.when(F.col("current_version") == 0, "source_empty").otherwise("source"))
    return (
        datasets.join(state.select("dataset", "staleness"), "dataset", "left")
        .join(running, "dataset", "left")
        .join(last.select("dataset", F.col("status").alias("_last")), "dataset", "left")
        .select("dataset", F.when(F.col("_running"), "building").when(F.col("_last") == "failed", "failed")
                .otherwise(base).alias("status"))
    )
