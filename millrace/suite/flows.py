"""Lineage, labels and event tailing over catalogs derived from the test tables.

Orders stand for recipes: recipe k makes dataset k and reads datasets k div 8 and k div 12, so the graph
has as many nodes as the table has rows and a depth that grows with its logarithm.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import labels
from millrace.plans import lineage
from millrace.session import scratch_path
from millrace.streaming import events as log
from millrace.suite import Suite, table

suite = Suite()

# The same catalog in SQL, for the twins.
_CATALOG = """
    orders_ AS (SELECT o_orderkey AS k, o_custkey % 4 AS version, o_orderstatus AS hash, o_totalprice FROM orders),
    inputs_ AS (SELECT k AS recipe, k // 8 AS input FROM orders_ WHERE k > 0 UNION SELECT k, k // 12 FROM orders_ WHERE k > 0),
    state_ AS (
      SELECT o.k AS recipe, CASE WHEN o.version = 0 THEN 'never_built'
        WHEN o.hash = 'P' OR bool_or(coalesce(d.version > CASE WHEN i.input % 9 = 0 THEN 0 ELSE 2 END, FALSE)) THEN 'stale' ELSE 'fresh' END AS staleness
      FROM orders_ o LEFT JOIN inputs_ i ON i.recipe = o.k LEFT JOIN orders_ d ON d.k = i.input GROUP BY o.k, o.version, o.hash)"""


def _catalog(spark, sf):
    """datasets, recipes, recipe_inputs, versions. A recipe whose order is pending was changed after its
    last build; builds read version 2 of their inputs, and missed every ninth input."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4).alias("version"), F.col("o_orderstatus").alias("hash"))
    read = orders.filter("k > 0").select("k", F.array_distinct(F.array(F.expr("k div 8"), F.expr("k div 12"))).alias("inputs"))
    datasets = orders.select(F.col("k").alias("dataset"), F.col("version").alias("current_version"))
    recipes = orders.select(F.col("k").alias("recipe"), F.col("k").alias("output"), F.col("hash").alias("config_hash"))
    inputs = read.select(F.col("k").alias("recipe"), F.explode("inputs").alias("input"))
    known = F.transform(F.filter("inputs", lambda i: i % 9 != 0), lambda i: F.struct(i.cast("string"), F.lit(2).cast("bigint")))
    versions = orders.filter("version > 0").join(read.select("k", F.map_from_entries(known).alias("seen")), "k", "left").select(
        F.col("k").alias("dataset"), "version", F.when(F.col("hash") == "P", "old").otherwise(F.col("hash")).alias("recipe_config_hash"),
        F.coalesce("seen", F.create_map().cast("map<string,bigint>")).alias("input_versions"))
    return datasets, recipes, inputs, versions


@suite.add(f"WITH {_CATALOG} SELECT staleness, count(*) AS n, min(recipe) AS low, max(recipe) AS high FROM state_ GROUP BY staleness")
def lineage_staleness(spark, sf):
    return lineage.staleness(*_catalog(spark, sf)).groupBy("staleness").agg(
        F.count("*").alias("n"), F.min("recipe").alias("low"), F.max("recipe").alias("high"))


def _targets(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("recipe"))


@suite.add(f"""
    WITH RECURSIVE {_CATALOG}, up AS (SELECT k AS recipe FROM orders_ WHERE o_totalprice > 400000
      UNION SELECT i.input FROM up JOIN inputs_ i ON i.recipe = up.recipe)
    SELECT recipe FROM up""")
def lineage_upstream(spark, sf):
    _, recipes, inputs, _ = _catalog(spark, sf)
    return lineage.upstream(_targets(spark, sf), lineage.dependencies(recipes, inputs))


@suite.add(f"""
    WITH RECURSIVE {_CATALOG}, walk AS (SELECT k AS recipe, 0 AS level FROM orders_ WHERE k = 0
      UNION SELECT i.recipe, w.level + 1 FROM walk w JOIN inputs_ i ON i.input = w.recipe)
    SELECT recipe, max(level)::BIGINT AS level FROM walk GROUP BY recipe""")
def lineage_levels(spark, sf):
    _, recipes, inputs, _ = _catalog(spark, sf)
    return lineage.levels(recipes, lineage.dependencies(recipes, inputs)).withColumn("level", F.col("level").cast("bigint"))


@suite.add(f"""
    WITH RECURSIVE {_CATALOG}, up AS (SELECT k AS recipe FROM orders_ WHERE o_totalprice > 400000
      UNION SELECT i.input FROM up JOIN inputs_ i ON i.recipe = up.recipe),
    run AS (SELECT s.recipe FROM state_ s JOIN up USING (recipe) WHERE staleness != 'fresh'
      UNION SELECT i.recipe FROM run JOIN inputs_ i ON i.input = run.recipe JOIN up ON up.recipe = i.recipe)
    SELECT recipe FROM run""")
def lineage_rebuild(spark, sf):
    datasets, recipes, inputs, versions = _catalog(spark, sf)
    state = lineage.staleness(datasets, recipes, inputs, versions)
    return lineage.rebuild_steps(_targets(spark, sf), lineage.dependencies(recipes, inputs), state).select("recipe")


@suite.add(f"""
    WITH {_CATALOG},
    steps AS (SELECT l_orderkey AS dataset, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'succeeded' ELSE 'running' END AS status,
                l_shipdate AS done, l_partkey, l_linenumber, l_suppkey FROM lineitem),
    last AS (SELECT dataset, status FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY done DESC, status DESC) AS rn
             FROM steps WHERE status != 'running') WHERE rn = 1),
    busy AS (SELECT DISTINCT dataset FROM steps WHERE status = 'running')
    SELECT CASE WHEN b.dataset IS NOT NULL THEN 'building' WHEN l.status = 'failed' THEN 'failed' ELSE s.staleness END AS status, count(*) AS n
    FROM state_ s LEFT JOIN busy b ON b.dataset = s.recipe LEFT JOIN last l ON l.dataset = s.recipe GROUP BY 1""")
def lineage_status(spark, sf):
    catalog = _catalog(spark, sf)
    steps = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("dataset"),
        F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "succeeded").otherwise("running").alias("status"),
        # The status decides between steps that finished at one moment.
        F.struct("l_shipdate", F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("finished_at"))
    shown = lineage.dataset_status(catalog[0], lineage.staleness(*catalog), steps)
    return shown.groupBy("status").agg(F.count("*").alias("n"))


_LADDER = "list_value('none', 'persoonsgegevens', 'bijzonder', 'bsn')"


@suite.add(f"""
    WITH r AS (SELECT l_orderkey AS output, max(l_linenumber % 4) AS c, max(CASE WHEN l_quantity < 40 THEN 0 ELSE l_quantity % 4 END) AS b,
        max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS f, max(l_orderkey % 3) AS manual FROM lineitem GROUP BY l_orderkey)
    SELECT output, {_LADDER}[CAST(greatest(c, manual) AS BIGINT) + 1] AS classification,
      list_value(NULL, 'bbn1', 'bbn2', 'bbn3')[CAST(b AS BIGINT) + 1] AS bbn, list_value(NULL, 'intern', 'vertrouwelijk')[f + 1] AS confidentiality FROM r""")
def label_floors(spark, sf):
    """Strictest label over each order's lines, never below the order's own."""
    step = lambda ladder, c: labels.label(ladder, c.cast("int"))
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("output"),
        step("classification", F.col("l_linenumber") % 4).alias("classification"),
        step("bbn", F.when(F.col("l_quantity") < 40, 0).otherwise(F.col("l_quantity") % 4)).alias("bbn"),
        step("confidentiality", F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("confidentiality"),
        step("classification", F.col("l_orderkey") % 3).alias("own"))
    return labels.floors(pairs, "output", {"classification": "own"})


@suite.add("""
    WITH o AS (SELECT o_custkey, o_orderkey, list_filter(['z-care', 'billing', 'audit', 'stats'],
        lambda c: c != CASE o_orderstatus WHEN 'F' THEN 'stats' WHEN 'O' THEN 'billing' ELSE 'none' END) AS codes FROM orders),
    f AS (SELECT o_custkey, arg_min(codes, o_orderkey) AS first, count(*) AS inputs FROM o GROUP BY o_custkey),
    x AS (SELECT o_custkey, unnest(codes) AS code FROM o), c AS (SELECT o_custkey, code, count(*) AS n FROM x GROUP BY o_custkey, code),
    p AS (SELECT o_custkey, inputs, unnest(first) AS code, generate_subscripts(first, 1) AS place FROM f),
    k AS (SELECT p.o_custkey, p.code, p.place FROM p JOIN c ON c.o_custkey = p.o_custkey AND c.code = p.code AND c.n = p.inputs)
    SELECT f.o_custkey, coalesce(string_agg(k.code, ',' ORDER BY place), '') AS purposes FROM f LEFT JOIN k USING (o_custkey) GROUP BY f.o_custkey""")
def label_purposes(spark, sf):
    codes = F.array(*map(F.lit, ("z-care", "billing", "audit", "stats")))
    refused = F.when(F.col("o_orderstatus") == "F", "stats").when(F.col("o_orderstatus") == "O", "billing").otherwise("none")
    pairs = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.array_remove(codes, refused).alias("codes"))
    out = labels.purposes(pairs, "o_custkey", "o_orderkey", "codes")
    return out.withColumn("purposes", F.array_join("purposes", ","))


@suite.add("""
    WITH p AS (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS basis, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2)
    SELECT o_custkey, coalesce(string_agg(basis, ' · ' ORDER BY seen), 'Derived (see inputs)') AS legal_basis FROM p GROUP BY o_custkey""")
def label_legal_basis(spark, sf):
    pairs = table(spark, sf, "orders").withColumn("basis", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return labels.legal_basis(pairs, "o_custkey", "o_orderkey", "basis")


_LOG = """SELECT event_id AS seq, event_type AS topic, CASE WHEN user_id % 3 = 0 THEN user_id END AS user_id,
      CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS project_id, props FROM events"""


def _log(events):
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("topic"),
        F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5).alias("project_id"), "props")


def _members(spark, sf):
    """Users are members of the project their nation number gives."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.pmod(F.col("c_nationkey"), F.lit(4)).cast("bigint").alias("project_id")).distinct()


_VISIBLE = """(user_id = 42 OR (user_id IS NULL AND (project_id IS NULL
    OR project_id IN (SELECT c_nationkey % 4 FROM customer WHERE c_custkey = 42))))"""


@suite.add(f"SELECT seq, topic, props FROM ({_LOG}) WHERE topic IN ('click', 'error') AND {_VISIBLE}")
def event_tail_stream(spark, sf):
    """The whole log as a file stream: topic filter, visibility join, parquet sink, checkpoint as cursor."""
    out = scratch_path(spark, "tail")
    stream = log.read_log(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")
    seen = log.visible(log.of_topics(_log(stream), ["click", "error"]), 42, memberships=_members(spark, sf))
    log.tail(seen.select("seq", "topic", "props"), out, scratch_path(spark, "cursor"))
    return spark.read.parquet(out)


@suite.add(f"SELECT seq, topic, project_id FROM ({_LOG}) WHERE user_id = 42 OR user_id IS NULL")
def event_visible_admin(spark, sf):
    return log.visible(_log(table(spark, sf, "events")), 42, admin=True).select("seq", "topic", "project_id")


@suite.add(f"SELECT seq, topic FROM ({_LOG}) WHERE seq > 250 ORDER BY seq LIMIT 500")
def event_page(spark, sf):
    return log.page(_log(table(spark, sf, "events")), 250).select("seq", "topic")


@suite.add("SELECT min(event_id) > 1 AS reset, CASE WHEN min(event_id) > 1 THEN max(event_id) ELSE 0 END AS cursor FROM events WHERE value > 50")
def event_cursor_reset(spark, sf):
    """After retention removed the first rows, a cursor of 0 starts again from the head."""
    return log.cursor_reset(_log(table(spark, sf, "events").filter("value > 50")), 0)
