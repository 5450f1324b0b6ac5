"""Prepare, expressions, joins, groups, stack, split, sample, ordered computations, profile, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import expressions as e
from millrace.errors import ChecksFailed
from millrace.operators import code_step, combine, drift, metrics, ordered, sketches
from millrace.operators.checks import Check
from millrace.operators.group import group
from millrace.operators.join import join
from millrace.operators.labels import label_columns
from millrace.operators.prepare import prepare
from millrace.operators.profile import profile, summary
from millrace.plans import recipes as plans
from millrace.plans.build import build
from millrace.session import scratch_path
from millrace.sources import files, jdbc, versions
from millrace.suite import Suite, table

suite = Suite()


@suite.add("""
    SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2)) * 1.21) AS DOUBLE) AS with_vat,
           count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' GROUP BY n_name""")
def prepare_join_group(spark, sf):
    """CSV-to-report flow of the acceptance test: prepare, join, join, group."""
    orders = prepare(table(spark, sf, "orders"), [
        {"op": "cast", "casts": {"o_totalprice": "decimal(12,2)"}},
        {"op": "formula", "column": "vat", "expression": "o_totalprice * 1.21"},
        {"op": "filter", "expression": "o_orderstatus = 'F'"},
        {"op": "select", "columns": ["o_orderkey", "o_custkey", "vat"]},
    ])
    placed = join(orders, table(spark, sf, "customer"), [("o_custkey", "c_custkey")])
    placed = join(placed, table(spark, sf, "nation"), [("c_nationkey", "n_nationkey")])
    return group(placed, ["n_name"], [
        {"column": "vat", "func": "sum", "as": "with_vat"},
        {"column": "o_orderkey", "func": "count", "as": "orders"},
        {"column": "o_custkey", "func": "count_distinct", "as": "customers"},
    ]).withColumn("with_vat", F.col("with_vat").cast("double"))


@suite.add("""
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey,
           coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer""")
def rename_cast_fill(spark, sf):
    return prepare(table(spark, sf, "customer"), [
        {"op": "rename", "mapping": {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}},
        {"op": "cast", "casts": {"id": "string"}},
        {"op": "formula", "column": "segment", "expression": "nullif(segment, 'BUILDING')"},
        {"op": "fill_nulls", "values": {"segment": "none"}},
        {"op": "select", "columns": ["c_acctbal"], "drop": True},
    ])


@suite.add("""
    SELECT l_linestatus, count(*) AS n FROM lineitem
    WHERE nullif(l_returnflag, 'N') = 'R' AND l_quantity > 10 GROUP BY l_linestatus""")
def filter_drops_null(spark, sf):
    kept = prepare(table(spark, sf, "lineitem"), [
        {"op": "filter", "expression": "nullif(l_returnflag, 'N') = 'R' and l_quantity > 10"}])
    return group(kept, ["l_linestatus"], [{"column": "l_orderkey", "func": "count", "as": "n"}])


@suite.add("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedupe_rows(spark, sf):
    return prepare(table(spark, sf, "lineitem"), [
        {"op": "select", "columns": ["l_returnflag", "l_linestatus", "l_linenumber"]}, {"op": "dedupe"}])


@suite.add("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
    WHERE rn = 1""")
def dedupe_subset(spark, sf):
    first = prepare(table(spark, sf, "lineitem"), [
        {"op": "dedupe", "subset": ["l_orderkey"], "order": ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]}])
    return first.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


@suite.add("""
    SELECT DISTINCT l_linenumber, l_quantity,
      l_linenumber / nullif(l_quantity % 7, 0) AS quotient,
      CAST(floor(l_quantity / nullif(l_quantity % 7, 0)) AS BIGINT) AS floored,
      (0 - l_linenumber) % nullif(CAST(l_quantity AS BIGINT) % 3, 0) AS remainder,
      CAST(l_linenumber * l_linenumber AS DOUBLE) AS squared,
      CAST(l_linenumber AS BIGINT) * 3 - 4 + 1 AS combined, -l_quantity AS minus FROM lineitem""")
def expression_arithmetic(spark, sf):
    df = table(spark, sf, "lineitem")
    line, quantity = e.col(df, "l_linenumber"), e.col(df, "l_quantity")
    return df.select(
        "l_linenumber", "l_quantity",
        e.divide(line, quantity % 7).alias("quotient"),
        e.floor_divide(quantity, quantity % 7).alias("floored"),
        e.modulo((e.lit(0) - line).cast("bigint"), quantity.cast("bigint") % 3).alias("remainder"),
        e.power(line, 2).alias("squared"),
        (line.cast("bigint") * 3 - 4 + 1).alias("combined"),
        (-quantity).alias("minus"),
    ).distinct()


@suite.add("""
    WITH x AS (SELECT l_quantity, nullif(l_returnflag, 'N') AS flag FROM lineitem)
    SELECT l_quantity, flag, 10 < l_quantity AND l_quantity < 20 AS teens, flag IS NULL AS no_flag,
      flag = 'R' OR l_quantity > 45 AS r_or_many, NOT (flag = 'R') AND l_quantity >= 5 AS not_r,
      flag != 'A' AS not_a, count(*) AS n FROM x GROUP BY l_quantity, flag""")
def expression_logic(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    counted = df.groupBy("l_quantity", "flag").agg(F.count("*").alias("n"))
    q, flag = F.col("l_quantity"), F.col("flag")
    return counted.select(
        "l_quantity", "flag",
        e.compare(10, "<", q, "<", 20).alias("teens"),
        e.equal(flag, None).alias("no_flag"),
        e.any_of(e.equal(flag, "R"), e.compare(q, ">", 45)).alias("r_or_many"),
        e.all_of(e.negate(e.equal(flag, "R")), e.compare(q, ">=", 5)).alias("not_r"),
        e.not_equal(flag, "A").alias("not_a"), "n")


@suite.add(r"""
    SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low,
      trim(chr(9) || ' ' || p_type || '  ', chr(9) || ' ') AS trimmed, CAST(length(p_name) AS BIGINT) AS size,
      replace(p_brand, '#', '-') AS replaced, p_brand || '/' || CAST(p_size AS VARCHAR) AS joined,
      nullif(p_type, 'ECONOMY') || '!' AS null_through FROM part""")
def expression_text(spark, sf):
    df = table(spark, sf, "part")
    return df.select(
        "p_partkey", e.upper("p_name").alias("up"), e.lower("p_brand").alias("low"),
        e.trim(e.concat("\t ", e.col(df, "p_type"), "  ")).alias("trimmed"),
        e.length("p_name").cast("bigint").alias("size"),
        e.replace(e.col(df, "p_brand"), "#", "-").alias("replaced"),
        e.concat(e.col(df, "p_brand"), "/", e.col(df, "p_size")).alias("joined"),
        e.concat(F.nullif("p_type", F.lit("ECONOMY")), "!").alias("null_through"))


@suite.add("""
    SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS rounded,
      abs(0 - o_totalprice) AS size, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
      CAST(day(o_orderdate) AS BIGINT) AS d, coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) AS either,
      CASE WHEN nullif(o_orderstatus, 'P') = 'F' THEN 'done' ELSE 'open' END AS state,
      CAST(o_custkey AS VARCHAR) AS customer FROM orders""")
def expression_functions(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(
        "o_orderkey",
        e.round_to(e.cast(e.col(df, "o_totalprice"), "decimal(12,2)"), 1).cast("double").alias("rounded"),
        e.absolute(e.lit(0) - e.col(df, "o_totalprice")).alias("size"),
        e.year("o_orderdate").cast("bigint").alias("y"), e.month("o_orderdate").cast("bigint").alias("m"),
        e.day("o_orderdate").cast("bigint").alias("d"),
        e.coalesce(F.nullif("o_orderstatus", F.lit("O")), "o_orderpriority").alias("either"),
        e.if_else(F.nullif("o_orderstatus", F.lit("P")) == "F", "done", "open").alias("state"),
        e.cast(e.col(df, "o_custkey"), "string").alias("customer"))


@suite.add("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey""")
def join_inner(spark, sf):
    return join(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "o_orderstatus")


def _nation_money(spark, sf, name, prefix, regions):
    nation = table(spark, sf, "nation").filter(F.col("n_regionkey").isin(*regions))
    joined = join(table(spark, sf, name), nation, [(f"{prefix}_nationkey", "n_nationkey")])
    return joined.groupBy(F.col("n_name").alias("name")).agg(
        F.count("*").alias("n"), F.sum(F.col(f"{prefix}_acctbal").cast("decimal(12,2)")).cast("double").alias("money"))


_NATION_MONEY = """
    WITH c AS (SELECT n_name AS name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS money
               FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1) GROUP BY n_name),
         s AS (SELECT n_name AS name, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS money
               FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2) GROUP BY n_name)
    SELECT c.name, c.n, c.money, s.name AS name_right, s.n AS n_right, s.money AS money_right FROM c {how} JOIN s ON c.name = s.name"""


def _sides(spark, sf):
    return _nation_money(spark, sf, "customer", "c", (0, 1)), _nation_money(spark, sf, "supplier", "s", (1, 2))


@suite.add(_NATION_MONEY.format(how="LEFT"))
def join_left_suffix(spark, sf):
    return join(*_sides(spark, sf), [("name", "name")], "left")


@suite.add(_NATION_MONEY.format(how="RIGHT"))
def join_right_suffix(spark, sf):
    return join(*_sides(spark, sf), [("name", "name")], "right")


@suite.add(_NATION_MONEY.format(how="FULL"))
def join_outer_suffix(spark, sf):
    return join(*_sides(spark, sf), [("name", "name")], "outer")


_WHOLE = """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 3 = 0 THEN 1 ELSE o_custkey END AS customer FROM orders),
         c AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS customer, c_name FROM customer)
    SELECT o_orderkey, o.customer, c.customer AS customer_right, c_name FROM o {how} JOIN c ON o.customer = c.customer"""


def _whole(spark, sf, how):
    """All orders with all customers; keys are NULL on both sides, and a third of the orders have one customer."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.expr(
        "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 3 = 0 THEN 1 ELSE o_custkey END").alias("customer"))
    customers = table(spark, sf, "customer").select(F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_custkey END").alias("customer"), "c_name")
    return join(orders, customers, [("customer", "customer")], how, hot_rows=200)


@suite.add(_WHOLE.format(how="LEFT"))
def join_left_whole(spark, sf):
    return _whole(spark, sf, "left")


@suite.add(_WHOLE.format(how="RIGHT"))
def join_right_whole(spark, sf):
    return _whole(spark, sf, "right")


@suite.add(_WHOLE.format(how="FULL"))
def join_outer_whole(spark, sf):
    return _whole(spark, sf, "outer")


@suite.add("""
    WITH s AS (SELECT l_returnflag AS flag, max(l_quantity) AS top FROM lineitem GROUP BY l_returnflag)
    SELECT l_suppkey, count(*) AS n, sum(CAST(top - l_quantity AS BIGINT))::BIGINT AS below_top
    FROM lineitem LEFT JOIN s ON l_returnflag = flag GROUP BY l_suppkey""")
def join_hot_keys(spark, sf):
    """Three join keys hold all rows, so each is spread over salts."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    best = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.max("l_quantity").alias("top"))
    joined = join(lines, best, [("l_returnflag", "flag")], "left", hot_rows=4096)
    return joined.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum((F.col("top") - F.col("l_quantity")).cast("bigint")).alias("below_top"))


@suite.add("""
    SELECT nullif(o_orderpriority, '5-LOW') AS priority, count(nullif(o_orderstatus, 'F')) AS count_status,
      count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
      min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
      avg(o_custkey) AS mean
    FROM orders GROUP BY 1""")
def group_aggregates(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_custkey",
        F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_totalprice",
        F.col("o_totalprice").cast("decimal(12,2)").alias("money"))
    out = group(orders, ["priority"], [
        {"column": "status", "func": "count"},
        {"column": "o_custkey", "func": "count_distinct", "as": "customers"},
        {"column": "money", "func": "sum", "as": "total"},
        {"column": "o_totalprice", "func": "min", "as": "lowest"},
        {"column": "o_totalprice", "func": "max", "as": "highest"},
        {"column": "o_custkey", "func": "mean", "as": "mean"},
    ])
    return out.withColumn("total", F.col("total").cast("double"))


@suite.add("""
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier""")
def stack_by_name(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("'supplier' AS kind", "s_acctbal AS balance", "s_name AS name", "s_suppkey AS id")
    return combine.stack(customers, suppliers)


def _split(spark, sf, place):
    lines = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return combine.split(lines, "flag = 'R'")[place].select("l_orderkey", "l_linenumber", "l_partkey", "flag")


@suite.add("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag FROM lineitem WHERE l_returnflag = 'R'")
def split_match(spark, sf):
    return _split(spark, sf, 0)


@suite.add("""SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag, 'N') AS flag FROM lineitem
              WHERE NOT (nullif(l_returnflag, 'N') = 'R')""")
def split_rest(spark, sf):
    """Rows whose predicate is NULL are in neither output."""
    return _split(spark, sf, 1)


@suite.add("""
    SELECT branch, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'match' ELSE 'rest' END AS branch FROM orders)
    GROUP BY branch""")
def split_written_once(spark, sf):
    path = scratch_path(spark, "split")
    combine.write_split(table(spark, sf, "orders"), "o_orderstatus = 'F'", path)
    return spark.read.parquet(path).groupBy("branch").agg(F.count("*").alias("n"))


@suite.add("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8) AS BIGINT)
          < 429496729""")
def sample_fraction(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return combine.sample(table(spark, sf, "lineitem"), "random", fraction=0.1, columns=keys).select(keys)


@suite.add("SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS distinct_rows FROM orders")
def sample_head(spark, sf):
    """The first 1000 rows, in no order: as many rows, and different ones."""
    return combine.sample(table(spark, sf, "orders")).agg(
        F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_rows"))


@suite.add("""
    WITH v AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem
      UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem),
    c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM c)
    SELECT "column", value, n, position FROM r WHERE position <= 5""")
def top_values(spark, sf):
    return combine.top_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"]).withColumn(
        "position", F.col("position").cast("bigint"))


@suite.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def page_after_key(spark, sf):
    return combine.page_after(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@suite.add("SELECT event_id, user_id FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 51")
def page_before_key(spark, sf):
    return combine.page_after(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 700, 50, descending=True)


@suite.add("""
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, sf):
    return combine.latest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value")


_EVENT_ORDER = ["ts", "event_id"]


@suite.add("""
    SELECT event_id, user_id, row_number() OVER w AS position, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after,
      CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS so_far
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def ordered_position_neighbours(spark, sf):
    """row_number, lag, lead and a running sum per user."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    summed = ordered.by_order(
        events, ["user_id"], _EVENT_ORDER, {"position": F.lit(1), "so_far": F.col("value").cast("decimal(12,2)")},
        previous={"before": "event_type"}, following={"after": "event_type"})
    return summed.select("event_id", "user_id", F.col("position").cast("bigint").alias("position"), "before", "after",
                         F.col("so_far").cast("double").alias("so_far"))


@suite.add("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
      rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM lineitem
    WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def ordered_ranks(spark, sf):
    """Three keys hold all rows, so they count as hot: ties are counted before anything is ordered."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return ordered.ranks(lines, ["l_returnflag"], "l_quantity", hot_rows=10_000)


@suite.add("""
    SELECT event_id, event_type, row_number() OVER w AS position, lag(value) OVER w AS before, lead(user_id) OVER w AS after,
      CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS so_far
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def ordered_hot_keys(spark, sf):
    """The same per event type: five keys hold all rows and are cut into chunks."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    summed = ordered.by_order(
        events, ["event_type"], _EVENT_ORDER, {"position": F.lit(1), "so_far": F.col("value").cast("decimal(12,2)")},
        previous={"before": "value"}, following={"after": "user_id"}, hot_rows=1000)
    return summed.select("event_id", "event_type", F.col("position").cast("bigint").alias("position"), "before", "after",
                         F.col("so_far").cast("double").alias("so_far"))


@suite.add("""
    SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS total FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def ordered_trailing_day(spark, sf):
    out = ordered.trailing(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "1 DAY", {
        "n": F.lit(1), "total": F.col("value").cast("decimal(12,2)")})
    return out.withColumns({"n": F.col("n").cast("bigint"), "total": F.col("total").cast("double")})


@suite.add("""
    SELECT event_id, event_type, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def ordered_trailing_hot_keys(spark, sf):
    return ordered.trailing(table(spark, sf, "events"), ["event_type"], "ts", "event_id", "6 HOURS", {"n": F.lit(1)},
                            hot_rows=1000).withColumn("n", F.col("n").cast("bigint"))


@suite.add("""
    WITH made AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE ELSE floor(value) END AS v FROM events),
    r AS (SELECT event_id, event_type, sum(v) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS total FROM made)
    SELECT event_id, event_type, coalesce(isinf(total), false) AS endless, CASE WHEN NOT isinf(total) THEN total ELSE 0 END AS total FROM r""")
def ordered_trailing_infinite(spark, sf):
    """Infinite values in hot keys stay inside the frames that hold them."""
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.floor("value").cast("double"))
    out = ordered.trailing(table(spark, sf, "events"), ["event_type"], "ts", "event_id", "6 HOURS", {"total": value}, hot_rows=1000)
    endless = F.col("total") == float("inf")
    return out.select("event_id", "event_type", endless.alias("endless"), F.when(endless, 0.0).otherwise(F.col("total")).alias("total"))


@suite.add("""
    SELECT event_id, user_id, first_value(event_type) OVER w AS first_type, last_value(value) OVER w AS last_value FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def ordered_first_last(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ordered.ends(events, ["user_id"], _EVENT_ORDER, {"first_type": "event_type"}, {"last_value": "value"}).select(
        "event_id", "user_id", "first_type", "last_value")


@suite.add("SELECT l_returnflag, CAST(median(l_extendedprice) AS DOUBLE) AS median FROM lineitem GROUP BY l_returnflag")
def ordered_median(spark, sf):
    return ordered.exact_median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", hot_rows=10_000)


@suite.add("""
    WITH x AS (SELECT l_orderkey, l_quantity, nullif(l_returnflag, 'N') AS flag, CAST(l_shipdate AS DATE) AS shipped FROM lineitem),
    a AS (SELECT count(*) AS row_count, count(*) - count(flag) AS nf, min(l_orderkey) AS k0, max(l_orderkey) AS k1,
      round(avg(l_orderkey), 4) AS km, min(l_quantity) AS q0, max(l_quantity) AS q1,
      round(avg(l_quantity), 4) AS qm, min(shipped) AS s0, max(shipped) AS s1 FROM x)
    SELECT 'l_orderkey' AS name, 'numeric' AS kind, row_count, 0::BIGINT AS null_count, k0::VARCHAR AS "min", k1::VARCHAR AS "max", km AS mean FROM a
    UNION ALL SELECT 'l_quantity', 'numeric', row_count, 0, q0::VARCHAR, q1::VARCHAR, qm FROM a
    UNION ALL SELECT 'flag', 'other', row_count, nf, NULL, NULL, NULL FROM a
    UNION ALL SELECT 'shipped', 'temporal', row_count, 0, s0::VARCHAR, s1::VARCHAR, NULL FROM a""")
def profile_summary(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.to_date("l_shipdate").alias("shipped"))
    return summary(lines).select("name", "kind", "row_count", "null_count", "min", "max", F.round("mean", 4).alias("mean"))


@suite.add("""
    WITH v AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM v)
    SELECT name, string_agg(value || '=' || n, ', ' ORDER BY place) AS shown FROM r WHERE place <= 5 GROUP BY name""")
def profile_top_values(spark, sf):
    out = profile(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    line = F.transform("top_values", lambda s: F.concat(s["value"], F.lit("="), s["count"].cast("string")))
    return out.select("name", F.array_join(line, ", ").alias("shown"))


@suite.add("""
    SELECT count(*) AS columns_close FROM (SELECT count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT count(DISTINCT l_quantity) FROM lineitem)""")
def profile_distinct_close(spark, sf):
    """How many approximate distinct counts lie within 15% of the exact ones."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    exact = lines.agg(*(F.count_distinct(c).alias(c) for c in lines.columns)).select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("name"), F.col(c).alias("exact")) for c in lines.columns))))
    both = summary(lines).join(exact, "name")
    return both.agg(F.count_if(F.abs(F.col("distinct_approx") - F.col("exact")) <= 0.15 * F.col("exact")).alias("columns_close"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]
_BEFORE = "l_shipdate < TIMESTAMP '1995-06-17'"
_DISTANCES = f"""
    WITH v AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS name,
        unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE]) AS value, coalesce({_BEFORE}, false) AS base FROM lineitem),
    c AS (SELECT name, value, count(*) FILTER (WHERE base) AS b, count(*) FILTER (WHERE NOT base) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
    u AS (SELECT name, sum(b) OVER w AS b, sum(n) OVER w AS n, sum(b) OVER (PARTITION BY name) AS bs, sum(n) OVER (PARTITION BY name) AS ns
      FROM c WINDOW w AS (PARTITION BY name ORDER BY value))
    SELECT name, bs::BIGINT AS n_base, ns::BIGINT AS n_now, round(max(abs(b / bs - n / ns)), 9) AS ks FROM u GROUP BY ALL"""


def _lines_by_half(spark, sf):
    lines = table(spark, sf, "lineitem")
    before = F.coalesce(F.expr(_BEFORE), F.lit(False))
    return lines.filter(before), lines.filter(~before)


@suite.add(_DISTANCES)
def drift_distances(spark, sf):
    """Kolmogorov-Smirnov distances between the lines of two halves of the years."""
    return drift.distances(*_lines_by_half(spark, sf), _MEASURES).withColumn("ks", F.round("ks", 9))


@suite.add(f"""
    WITH v AS (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS name, unnest([o_orderstatus, o_orderpriority]) AS value, o_custkey % 3 = 0 AS base FROM orders),
    c AS (SELECT name, value, count(*) FILTER (WHERE base) AS b, count(*) FILTER (WHERE NOT base) AS n FROM v GROUP BY ALL),
    s AS (SELECT name, sum(b) OVER (PARTITION BY name) AS bs, sum(n) OVER (PARTITION BY name) AS ns, greatest(b / bs, {drift.FLOOR}) AS p, greatest(n / ns, {drift.FLOOR}) AS q FROM c)
    SELECT name, bs::BIGINT AS n_base, ns::BIGINT AS n_now, round(sum((q - p) * ln(q / p)), 9) AS psi FROM s GROUP BY ALL""")
def drift_stability(spark, sf):
    """Population stability of two columns between the orders of a third of the customers and of the others."""
    orders = table(spark, sf, "orders")
    return drift.stability(orders.filter("o_custkey % 3 = 0"), orders.filter("o_custkey % 3 <> 0"), ["o_orderstatus", "o_orderpriority"]).withColumn("psi", F.round("psi", 9))


@suite.add(f"""WITH d AS ({_DISTANCES}) SELECT name, true AS close FROM d""")
def drift_sketched_close(spark, sf):
    """Whether the distances read from sketches lie within their bound of the exact ones."""
    halves = _lines_by_half(spark, sf)
    read = drift.sketched(*(sketches.sketch(h.select(*_MEASURES)) for h in halves)).select("name", F.col("ks").alias("read"))
    gap = F.abs(F.col("read") - F.col("ks"))
    return drift.distances(*halves, _MEASURES).join(read, "name").select("name", (gap <= 2 * sketches.RANK_ERROR + 2 / drift.GRID).alias("close"))


@suite.add("""
    WITH v AS (SELECT unnest(['l_orderkey', 'l_quantity', 'l_extendedprice']) AS name, unnest([l_orderkey::DOUBLE, l_quantity::DOUBLE, l_extendedprice::DOUBLE]) AS value FROM lineitem)
    SELECT name, count(*) AS row_count, count(*) - count(value) AS null_count, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean,
      true AS distinct_close, true AS median_close FROM v GROUP BY name""")
def profile_of_versions(spark, sf):
    """Lines that arrive in four appended versions: sketches kept, merged and shown, beside the exact numbers of all rows."""
    lines, path = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), scratch_path(spark, "sketches")
    for version in range(4):
        sketches.sketch(lines.filter(F.col("l_orderkey") % 4 == version)).write.mode("append").parquet(path)
    got = sketches.shown(sketches.merged(spark.read.parquet(path)), (0.5,))
    middle = got.select("name", F.col("quantiles")[0].alias("middle"))
    at = {r.name: r.middle for r in middle.collect()}  # a row per column
    exact = lines.agg(*(F.struct(F.count_distinct(c).alias("distinct"), F.avg((F.col(c) < at[c]).cast("int")).alias("below"), F.avg((F.col(c) <= at[c]).cast("int")).alias("upto")).alias(c)
                        for c in lines.columns)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("of"), f"{c}.*") for c in lines.columns))))
    error = sketches.RANK_ERROR
    return got.join(exact, got["name"] == exact["of"]).select(
        "name", "row_count", "null_count", "low", "high", F.round("mean", 4).alias("mean"),
        (F.abs(F.col("distinct_approx") - F.col("distinct")) <= 0.08 * F.col("distinct")).alias("distinct_close"),
        ((F.col("below") <= 0.5 + error) & (F.col("upto") >= 0.5 - error)).alias("median_close"))


@suite.add("""SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def csv_round_trip(spark, sf):
    """Write a table as CSV, read it back with inferred types: whole numbers are bigint."""
    path = scratch_path(spark, "csv") + ".csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path, header=True)


_SPOKEN = """'He said "' || coalesce(text, '') || '", then:' || chr(10) || '""' || chr(10) || ',x'"""


@suite.add(f"""
    SELECT 'd' || doc_id AS id, {_SPOKEN} AS said, lang FROM documents
    UNION ALL SELECT 'c' || conv_id || '/' || turn, {_SPOKEN}, role FROM conversations""")
def csv_texts(spark, sf):
    """Texts with quotes, commas and line breaks, written as CSV and read back whole."""
    path = scratch_path(spark, "texts") + ".csv"
    said = F.expr(_SPOKEN).alias("said")
    both = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), said, "lang").unionByName(
        table(spark, sf, "conversations").select(F.concat_ws("/", F.concat(F.lit("c"), "conv_id"), "turn").alias("id"), said, F.col("role").alias("lang")))
    both.write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path, header=True)


@suite.add("""
    SELECT 'customers' AS dataset, 1::BIGINT AS version, 'persoonsgegevens' AS classification, NULL AS bbn, 'intern' AS confidentiality, 'persoonsgegevens' AS names, count(*) AS row_count FROM customer
    UNION ALL SELECT 'nations', 1, 'none', 'bbn2', NULL, 'none', count(*) FROM nation
    UNION ALL SELECT 'placed', 1, 'persoonsgegevens', 'bbn2', 'intern', 'persoonsgegevens', count(*) FROM customer
    UNION ALL SELECT 'shown', 1, 'persoonsgegevens', 'bbn2', 'intern', 'persoonsgegevens', count(*) FROM customer
    UNION ALL SELECT 'totals', 1, 'persoonsgegevens', 'bbn2', 'intern', 'none,persoonsgegevens', count(DISTINCT c_nationkey) FROM customer""")
def build_labels(spark, sf):
    """A build of three steps: every output is labelled as its strictest input, and columns as what they hold."""
    root = scratch_path(spark, "labelled")
    customers = label_columns(table(spark, sf, "customer"), {"c_name": "persoonsgegevens"})
    versions.write_version(customers, root, "p", "customers", labels={"classification": "persoonsgegevens", "confidentiality": "intern"})
    versions.write_version(table(spark, sf, "nation"), root, "p", "nations", labels={"bbn": "bbn2"})
    build(spark, root, "p", [
        {"recipe": "r1", "kind": "join", "inputs": ["customers", "nations"], "output": "placed", "config": {"on": [("c_nationkey", "n_nationkey")]}},
        {"recipe": "r2", "kind": "prepare", "inputs": ["placed"], "output": "shown", "config": {"steps": [
            {"op": "rename", "mapping": {"c_name": "n_name", "n_name": "c_name"}}]}},
        {"recipe": "r3", "kind": "group", "inputs": ["shown"], "output": "totals", "config": {"by": ["c_name"], "aggregations": [
            {"column": "n_name", "func": "count", "as": "customers"}]}},
    ], ["totals"])
    fields = F.from_json("schema", "array<struct<name string, classification string>>")
    named = F.filter(fields, lambda f: f["name"].isin("n_name", "customers", "c_name"))
    found = F.when(F.col("dataset") == "totals", F.array_join(F.transform(named, lambda f: f["classification"]), ",")).when(
        F.col("dataset").isin("customers", "placed"), F.filter(fields, lambda f: f["name"] == "c_name")[0]["classification"]).otherwise(
        F.filter(fields, lambda f: f["name"] == "n_name")[0]["classification"])
    return versions.versions(spark, root).select(
        "dataset", "version", "classification", "bbn", "confidentiality", found.alias("names"), "row_count")


@suite.add("""
    SELECT 'c_acctbal' AS name, 'double' AS type, count(*) AS row_count FROM customer UNION ALL SELECT 'c_custkey', 'bigint', count(*) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', count(*) FROM customer UNION ALL SELECT 'c_name', 'string', count(*) FROM customer
    UNION ALL SELECT 'c_nationkey', 'bigint', count(*) FROM customer""")
def upload_conversion(spark, sf):
    """An upload becomes typed parquet; schema and row count come from the write and survive validation."""
    upload, target = scratch_path(spark, "upload") + ".csv", scratch_path(spark, "typed")
    table(spark, sf, "customer").write.option("header", True).csv(upload)
    files.convert(spark, upload, target)
    schema, rows = files.validate(spark, target, full=True)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), rows) for f in schema.fields],
                                 "name string, type string, row_count bigint")


@suite.add("""
    SELECT 1::BIGINT AS version, count(*) AS row_count, count(*) AS rows_read FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, count(*), count(*) FROM orders""")
def versioned_sink(spark, sf):
    """Two versions of one dataset: each keeps its own rows, and the catalog knows both."""
    root, orders = scratch_path(spark, "store"), table(spark, sf, "orders")
    versions.write_version(orders.filter("o_orderstatus = 'F'"), root, "p", "orders")
    versions.write_version(orders, root, "p", "orders", input_versions={"raw": 1})
    catalog = versions.versions(spark, root).select("version", "row_count")
    read = versions.read_version(spark, root, "p", "orders", 1).select(F.lit(1).cast("bigint").alias("version")).unionByName(
        versions.read_version(spark, root, "p", "orders").select(F.lit(2).cast("bigint").alias("version")))
    return catalog.join(read.groupBy("version").agg(F.count("*").alias("rows_read")), "version")


@suite.add("SELECT least(count(*), 100) AS sampled, least(count(*), 500) AS snapshot, least(count(*), 200) AS previewed FROM orders")
def capped_reads(spark, sf):
    """A sample, a capped snapshot and a recipe preview hold as many rows as they should."""
    orders = table(spark, sf, "orders")
    taken = jdbc.snapshot(orders, scratch_path(spark, "snapshot"), limit=500)
    shown = plans.preview("prepare", {"steps": [{"op": "filter", "expression": "o_totalprice > 0"}]}, [orders], 200)
    one = files.sample_rows(orders).select(F.lit("s").alias("kind")).unionByName(shown.select(F.lit("p").alias("kind")))
    return one.agg(F.count_if(F.col("kind") == "s").alias("sampled"), F.lit(taken).cast("bigint").alias("snapshot"),
                   F.count_if(F.col("kind") == "p").alias("previewed"))


@suite.add("""SELECT event_id, sha256(replace(props, ' ', '')) AS hash FROM events""")
def recipe_config_hash(spark, sf):
    """Event properties as configs: the hash of their sorted, compact JSON."""
    return table(spark, sf, "events").select("event_id", plans.config_hashes(F.col("props")).alias("hash"))


@suite.add("""SELECT o_orderkey, sha256('{"big":1e+20,"name":"1.0e5","price":' || o_totalprice || ',"scale":1.0,"small":1e-07,"tiny":-0.0}') AS hash FROM orders""")
def recipe_config_hash_floats(spark, sf):
    """Configs with fractions and exponents hash as a single config does."""
    text = F.concat(F.lit('{"scale": 1.0, "price": '), F.col("o_totalprice").cast("string"), F.lit(', "tiny": -0.0, "big": 1e20, "small": 0.0000001, "name": "1.0e5"}'))
    return table(spark, sf, "orders").select("o_orderkey", plans.config_hashes(text).alias("hash"))


@suite.add("SELECT o_orderkey, o_custkey FROM orders")
def sample_random_without_fraction(spark, sf):
    """Random without a fraction is the first n rows: all of them if there are no more."""
    return combine.sample(table(spark, sf, "orders"), "random", n=10_000_000).select("o_orderkey", "o_custkey")


@suite.add("""
    WITH c AS (SELECT 'p' || o_custkey % 3 AS project, 'd' || o_custkey AS dataset, o_orderkey % 9 AS version, o_orderstatus FROM orders),
    known AS (SELECT DISTINCT project, dataset, version FROM c WHERE o_orderstatus = 'F'), top AS (SELECT project, dataset, max(version) AS current FROM known GROUP BY ALL)
    SELECT DISTINCT project, dataset, version, 's3a://b/projects/' || project || '/datasets/' || dataset || '/v' || version AS folder
    FROM c ANTI JOIN known USING (project, dataset, version) LEFT JOIN top USING (project, dataset) WHERE version > coalesce(current, 0)""")
def version_orphans(spark, sf):
    """Folders above the current version that no catalog row knows."""
    rows = table(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("project"), F.concat(F.lit("d"), F.col("o_custkey")).alias("dataset"),
                                             (F.col("o_orderkey") % 9).alias("version"), "o_orderstatus")
    path = F.concat_ws("/", F.lit("s3a://b/projects"), "project", F.lit("datasets"), "dataset", F.concat(F.lit("v"), "version"), F.lit("part-0.parquet"))
    return versions.orphans(rows.select(path.alias("path")), rows.filter("o_orderstatus = 'F'")).select("project", "dataset", "version", "folder")


@suite.add("""
    SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name, unnest(['bigint', 'string', 'string', 'string', 'bigint', 'double']) AS type,
      least(count(*), 50) AS shown, 'csv' AS format FROM part""")
def upload_inferred(spark, sf):
    """Types from every row of an upload, and a preview of 50."""
    upload = scratch_path(spark, "upload") + ".csv"
    table(spark, sf, "part").write.option("header", True).csv(upload)
    got = files.infer(spark, upload)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), len(got.preview), got.format) for f in got.schema.fields], "name string, type string, shown bigint, format string")


def _grade(pdf):
    return pdf.assign(grade=["high" if b > 5000 else "low" for b in pdf["c_acctbal"]])[["c_custkey", "grade"]]


@suite.add("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS grade FROM customer")
def python_step(spark, sf):
    """User code over a table in batches, with a declared schema and the label gate."""
    grade = lambda customers: code_step.map_batches(customers, _grade, "c_custkey bigint, grade string")
    return code_step.code_step({"customers": table(spark, sf, "customer")}, grade, {"customers": ("persoonsgegevens", "bbn1")})


_LINKS = [metrics.Link("line order", "lineitem", "orders", (("l_orderkey", "o_orderkey"),)),
          metrics.Link("line part", "lineitem", "part", (("l_partkey", "p_partkey"),)),
          metrics.Link("line supplier", "lineitem", "supplier", (("l_suppkey", "s_suppkey"),)),
          metrics.Link("order customer", "orders", "customer", (("o_custkey", "c_custkey"),)),
          metrics.Link("customer nation", "customer", "nation", (("c_nationkey", "n_nationkey"),)),
          metrics.Link("supplier nation", "supplier", "nation", (("s_nationkey", "n_nationkey"),)),
          metrics.Link("nation region", "nation", "region", (("n_regionkey", "r_regionkey"),))]
_REVENUE = metrics.Metric("lineitem", "sum", "CAST(l_extendedprice AS DECIMAL(12,2))")


def _entities(spark, sf):
    return {n: table(spark, sf, n) for n in {x for link in _LINKS for x in (link.many, link.one)}}


@suite.add("""
    WITH place AS (SELECT c_custkey, c_mktsegment AS segment, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
    c AS (SELECT region, segment, count(*) AS customers FROM place GROUP BY ALL),
    o AS (SELECT region, segment, count(*) AS orders, count(DISTINCT o_custkey) AS buyers, max(o_totalprice) AS largest FROM orders LEFT JOIN place ON o_custkey = c_custkey GROUP BY ALL),
    l AS (SELECT region, segment, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN place ON o_custkey = c_custkey GROUP BY ALL),
    keys AS (SELECT region, segment FROM c UNION SELECT region, segment FROM o UNION SELECT region, segment FROM l)
    SELECT k.region, k.segment, revenue, coalesce(orders, 0) AS orders, coalesce(buyers, 0) AS buyers, largest, coalesce(customers, 0) AS customers FROM keys k
    LEFT JOIN c ON c.region IS NOT DISTINCT FROM k.region AND c.segment IS NOT DISTINCT FROM k.segment
    LEFT JOIN o ON o.region IS NOT DISTINCT FROM k.region AND o.segment IS NOT DISTINCT FROM k.segment
    LEFT JOIN l ON l.region IS NOT DISTINCT FROM k.region AND l.segment IS NOT DISTINCT FROM k.segment""")
def metrics_of_three_entities(spark, sf):
    """Lines, orders and customers by place: aggregated apart, so that none multiplies another."""
    got = metrics.measure(
        _entities(spark, sf), _LINKS,
        {"revenue": _REVENUE, "orders": metrics.Metric("orders", "count"), "buyers": metrics.Metric("orders", "count_distinct", "o_custkey"),
         "largest": metrics.Metric("orders", "max", "o_totalprice"), "customers": metrics.Metric("customer", "count")},
        {"region": "region.r_name", "segment": "customer.c_mktsegment"}, without=["supplier nation"])
    return got.withColumn("revenue", F.col("revenue").cast("double"))


@suite.add("""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, p_brand AS brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue,
           count(*) AS lines, max(l_quantity) AS most, min(l_discount) AS least
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN part ON l_partkey = p_partkey WHERE r_name = 'EUROPE' AND l_returnflag <> 'R' GROUP BY ALL""")
def metrics_by_month(spark, sf):
    """Filters two and four links away, a grain and a dimension; lines are aggregated by order and part before they are joined."""
    got = metrics.measure(
        _entities(spark, sf), _LINKS,
        {"revenue": _REVENUE, "lines": metrics.Metric("lineitem", "count"), "most": metrics.Metric("lineitem", "max", "l_quantity"), "least": metrics.Metric("lineitem", "min", "l_discount")},
        {"brand": "part.p_brand"}, {"month": ("orders.o_orderdate", "month")}, [("region", "r_name = 'EUROPE'"), ("lineitem", "l_returnflag <> 'R'")],
        without=["supplier nation"], aggregate_first=True)
    return got.withColumn("revenue", F.col("revenue").cast("double")).withColumn("month", F.col("month").cast("date"))


@suite.add("""
    SELECT 'lines of a part' AS link, count(*) AS keys FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'order customer', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def metrics_repeated_keys(spark, sf):
    """A link the wrong way round is found by the keys that its one side repeats."""
    wrong = metrics.Link("lines of a part", "part", "lineitem", (("p_partkey", "l_partkey"),))
    return metrics.repeated_keys(_entities(spark, sf), [wrong, _LINKS[3]])


@suite.add("""
    SELECT unnest(['rows', 'no customer', 'paid', 'price', 'open']) AS name,
      unnest([CAST(count(*) AS DOUBLE), count(*) FILTER (o_custkey IS NULL) / count(*), count(*) FILTER (o_totalprice > 0) / count(*), max(o_totalprice), count(*) FILTER (o_orderstatus = 'O') / count(*)]) AS value,
      unnest(['pass', 'pass', 'pass', CASE WHEN max(o_totalprice) > 1000 THEN 'warn' ELSE 'pass' END, 'fail']) AS status, 1::BIGINT AS versions, 0::BIGINT AS orphans FROM orders""")
def version_checks(spark, sf):
    """Checks measured in the write: a build whose check fails leaves neither version nor folder."""
    root, orders = scratch_path(spark, "store"), table(spark, sf, "orders")
    kept = [Check("rows", "rows", fail=(1, None)), Check("no customer", "null_share", "o_custkey", fail=(0, 0)),
            Check("paid", "matching_share", "o_totalprice > 0", warn=(0.9, 1)), Check("price", "max", "o_totalprice", warn=(None, 1000))]
    versions.write_version(orders, root, "p", "orders", checks=kept, with_profile=False)
    try:
        versions.write_version(orders, root, "p", "orders", checks=[*kept, Check("open", "matching_share", "o_orderstatus = 'O'", fail=(2, None))])
        results = []
    except ChecksFailed as error:
        results = error.results
    left = versions.versions(spark, root).count()
    orphans = versions.orphans(versions.list_files(spark, f"{root}/projects"), versions.versions(spark, root)).count()
    shown = spark.createDataFrame([(r["name"], r["value"], r["status"], orphans) for r in results], "name string, value double, status string, orphans bigint")
    return shown.withColumn("versions", F.lit(left).cast("bigint"))
