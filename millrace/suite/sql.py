"""SQL steps over named inputs, one query per family of functions and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.checked_sql import sql_step
from millrace.suite import Suite, table

suite = Suite()


def _step(spark, sf, names, query):
    return sql_step([table(spark, sf, n) for n in names], query)


@suite.add("""
    SELECT c_nationkey, count(*) AS n FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY c_nationkey""")
def sql_semi_anti(spark, sf):
    return _step(spark, sf, ["customer", "orders"], """
        SELECT c_nationkey, count(*) AS n FROM in_1
        WHERE c_custkey IN (SELECT o_custkey FROM in_2 WHERE o_orderstatus = 'P')
          AND NOT EXISTS (SELECT 1 FROM in_2 WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY c_nationkey""")


@suite.add("""
    WITH big AS (SELECT * FROM customer WHERE c_acctbal > 5000)
    SELECT n_name, count(c_custkey) AS n, CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(12,2))), 0) AS DOUBLE) AS money
    FROM nation LEFT JOIN big ON n_nationkey = c_nationkey GROUP BY n_name""")
def sql_cte_join(spark, sf):
    return _step(spark, sf, ["customer", "nation"], """
        WITH big AS (SELECT * FROM main.in_1 WHERE c_acctbal > 5000)
        SELECT n_name, count(c_custkey) AS n, CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(12,2))), 0) AS DOUBLE) AS money
        FROM in_2 LEFT JOIN big ON n_nationkey = c_nationkey GROUP BY n_name""")


_ROLLUP = """
    SELECT n_regionkey, n_name, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS money, count(*) AS n
    FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name) HAVING count(*) > 0"""


@suite.add(_ROLLUP.format(c="customer", n="nation"))
def sql_rollup(spark, sf):
    return _step(spark, sf, ["customer", "nation"], _ROLLUP.format(c="in_1", n="in_2"))


_CUBE = """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS all_flags
    FROM {t} GROUP BY CUBE (l_returnflag, l_linestatus)"""


@suite.add(_CUBE.format(t="lineitem"))
def sql_cube(spark, sf):
    return _step(spark, sf, ["lineitem"], _CUBE.format(t="in_1"))


_SETS = """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
    FROM {t} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"""


@suite.add(_SETS.format(t="lineitem"))
def sql_grouping_sets(spark, sf):
    return _step(spark, sf, ["lineitem"], _SETS.format(t="in_1"))


_SET_OPERATIONS = """
    WITH used AS (SELECT l_suppkey AS k FROM {a} INTERSECT SELECT s_suppkey FROM {b}),
         unused AS (SELECT s_suppkey AS k FROM {b} EXCEPT SELECT l_suppkey FROM {a} WHERE l_quantity > 49),
         either AS (SELECT k, 'used' AS side FROM used UNION ALL SELECT k, 'rare' FROM unused)
    SELECT side, count(*) AS n, min(k) AS low, max(k) AS high FROM either GROUP BY side"""


@suite.add(_SET_OPERATIONS.format(a="lineitem", b="supplier"))
def sql_set_operations(spark, sf):
    return _step(spark, sf, ["lineitem", "supplier"], _SET_OPERATIONS.format(a="in_1", b="in_2"))


_TOP = """SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'F') AS status FROM {t}
    ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100"""


@suite.add(_TOP.format(t="orders"))
def sql_order_limit(spark, sf):
    return _step(spark, sf, ["orders"], _TOP.format(t="in_1"))


@suite.add("""
    SELECT l_suppkey, round(stddev(l_quantity), 6) AS deviation, round(variance(l_quantity), 6) AS spread,
      avg(l_quantity) AS average, avg(l_linenumber) AS mean_line, min(l_shipdate)::DATE AS first_day,
      max(l_linenumber)::BIGINT AS top_line, count(DISTINCT l_partkey) AS parts,
      count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(l_orderkey) > 0 AS any_rows FROM lineitem GROUP BY l_suppkey""")
def sql_aggregates(spark, sf):
    return _step(spark, sf, ["lineitem"], """
        SELECT l_suppkey, round(stddev(l_quantity), 6) AS deviation, round(variance(l_quantity), 6) AS spread,
          avg(l_quantity) AS average, mean(l_linenumber) AS mean_line, CAST(min(l_shipdate) AS DATE) AS first_day,
          CAST(max(l_linenumber) AS BIGINT) AS top_line, count(DISTINCT l_partkey) AS parts,
          count(*) FILTER (WHERE l_returnflag = 'R') AS returned, approx_count_distinct(l_orderkey) > 0 AS any_rows
        FROM in_1 GROUP BY l_suppkey""")


_GATHERED = """
    WITH p AS (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM {c} JOIN {o} ON c_custkey = o_custkey
               GROUP BY c_nationkey, o_orderpriority)
    SELECT c_nationkey, {agg} AS priorities, CAST(sum(n) AS BIGINT) AS n, {size} AS kinds FROM p GROUP BY c_nationkey"""


@suite.add(_GATHERED.format(c="customer", o="orders", agg="string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)",
                            size="len(list(o_orderpriority))::BIGINT"))
def sql_gathered(spark, sf):
    """Lists of different values: as long as the domain, not as the group."""
    out = _step(spark, sf, ["customer", "orders"], _GATHERED.format(
        c="in_1", o="in_2", agg="string_agg(o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority)", size="list(o_orderpriority)"))
    return out.withColumn("kinds", F.size("kinds").cast("bigint"))


@suite.add("""
    SELECT DISTINCT l_quantity, l_linenumber, abs(10 - l_quantity) AS a, round(CAST(l_quantity / 8 AS DECIMAL(12,3)), 1)::DOUBLE AS r,
      ceil(l_quantity / 8)::BIGINT AS c, floor(l_quantity / 8)::BIGINT AS f, greatest(l_quantity, 25) AS g, least(l_linenumber, 3)::BIGINT AS l,
      sign(l_quantity - 25)::DOUBLE AS s, power(l_linenumber, 2)::DOUBLE AS p, sqrt(l_linenumber * l_linenumber) AS q,
      round(exp(l_linenumber), 6) AS e, round(ln(l_quantity), 9) AS n, round(log(l_quantity), 9) AS lg, (l_linenumber % 3)::BIGINT AS m FROM lineitem""")
def sql_numeric(spark, sf):
    return _step(spark, sf, ["lineitem"], """
        SELECT DISTINCT l_quantity, l_linenumber, abs(10 - l_quantity) AS a, CAST(round(CAST(l_quantity / 8 AS DECIMAL(12,3)), 1) AS DOUBLE) AS r,
          CAST(ceil(l_quantity / 8) AS BIGINT) AS c, CAST(floor(l_quantity / 8) AS BIGINT) AS f, greatest(l_quantity, 25) AS g,
          CAST(least(l_linenumber, 3) AS BIGINT) AS l, CAST(sign(l_quantity - 25) AS DOUBLE) AS s, CAST(power(l_linenumber, 2) AS DOUBLE) AS p,
          sqrt(l_linenumber * l_linenumber) AS q, round(exp(l_linenumber), 6) AS e, round(ln(l_quantity), 9) AS n,
          round(log(l_quantity), 9) AS lg, CAST(mod(l_linenumber, 3) AS BIGINT) AS m FROM in_1""")


@suite.add("""
    SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), 'plain') AS t, ifnull(nullif(p_size, 11), 0)::BIGINT AS z,
      CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS c, if(p_retailprice > 1000, 'dear', 'cheap') AS i,
      CAST(p_size AS VARCHAR) AS s, TRY_CAST(p_name AS BIGINT) AS nothing, CAST(round(p_retailprice, 0) AS BIGINT) AS whole,
      TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand_number FROM part""")
def sql_conditional_cast(spark, sf):
    return _step(spark, sf, ["part"], """
        SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), 'plain') AS t, CAST(ifnull(nullif(p_size, 11), 0) AS BIGINT) AS z,
          CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS c, if(p_retailprice > 1000, 'dear', 'cheap') AS i,
          CAST(p_size AS STRING) AS s, TRY_CAST(p_name AS BIGINT) AS nothing, CAST(round(p_retailprice, 0) AS BIGINT) AS whole,
          TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand_number FROM in_1""")


_TEXT = """
    SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_mktsegment) AS w, trim('  ' || c_mktsegment || ' ') AS t, ltrim('  x ') AS lt,
      rtrim(' x  ') AS rt, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 1, 4) AS s4, substr(c_name, 10) AS tail,
      replace(c_name, '#', '.') AS r, concat(c_name, '-', c_mktsegment) AS cc, concat_ws('/', c_name, c_mktsegment) AS cw,
      left(c_name, 3) AS l3, right(c_name, 3) AS r3, lpad(CAST(c_custkey AS {text}), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp,
      reverse(c_mktsegment) AS rv, contains(c_name, '00') AS has, starts_with(c_mktsegment, 'B') AS sw, ends_with(c_mktsegment, 'E') AS ew,
      CAST(position('#' IN c_name) AS BIGINT) AS pos, CAST(strlen(c_name) AS BIGINT) AS bytes FROM {t}"""


@suite.add(_TEXT.format(t="customer", text="VARCHAR"))
def sql_text(spark, sf):
    return _step(spark, sf, ["customer"], _TEXT.format(t="in_1", text="STRING"))


_DATES = """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS day_of, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
      CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(minute(o_orderdate) AS BIGINT) AS mi,
      CAST(second(o_orderdate) AS BIGINT) AS s, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, strftime(o_orderdate, '%Y/%m/%d') AS shown,
      CAST(strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y') AS DATE) AS back,
      date_diff('day', CAST('1995-01-31' AS TIMESTAMP), o_orderdate) AS days, date_diff('month', CAST('1995-01-31' AS TIMESTAMP), o_orderdate) AS months,
      date_diff('year', CAST('1995-01-31' AS TIMESTAMP), o_orderdate) AS years, current_date >= CAST(o_orderdate AS DATE) AS past, now() IS NOT NULL AS is_now
    FROM {t}"""


@suite.add(_DATES.format(t="orders"))
def sql_dates(spark, sf):
    return _step(spark, sf, ["orders"], _DATES.format(t="in_1"))


@suite.add("""
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, typeof(1) IS NOT NULL AS typed,
      min('{"event":"' || event_type || '"}') AS doc FROM events GROUP BY 1, 2""")
def sql_json(spark, sf):
    out = _step(spark, sf, ["events"], """
        SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, typeof(1) IS NOT NULL AS typed,
          min(concat('{"event":"', event_type, '"}')) AS doc FROM in_1 GROUP BY 1, 2""")
    return out


_DIALECT = """
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / {divisor} AS quotient, o_custkey % {remainder} AS rest, mod(o_custkey, {remainder}) AS rest_too,
      CAST(to_json(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END) AS {text}) AS quoted, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S, %A (%%)') AS shown,
      CAST(date_part('dow', o_orderdate) AS BIGINT) AS weekday FROM {t}"""


@suite.add(_DIALECT.format(t="orders", text="VARCHAR", divisor="nullif(o_custkey % 3, 0)", remainder="nullif(o_orderkey % 4, 0)"))
def sql_zero_divisors(spark, sf):
    """Zero divisors, NULLs, literal letters in date formats and Sundays."""
    return _step(spark, sf, ["orders"], _DIALECT.format(t="in_1", text="STRING", divisor="(o_custkey % 3)", remainder="(o_orderkey % 4)"))


_NULL_ORDER = """
    WITH part_null AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS customer, o_orderstatus FROM {t})
    SELECT o_orderkey, CAST(row_number() OVER (ORDER BY customer, o_orderkey) AS BIGINT) AS up,
      CAST(row_number() OVER (ORDER BY customer DESC, o_orderkey) AS BIGINT) AS down FROM part_null"""


@suite.add(_NULL_ORDER.format(t="orders"))
def sql_null_order(spark, sf):
    return _step(spark, sf, ["orders"], _NULL_ORDER.format(t="in_1"))


_DISTINCT = "SELECT o_orderstatus, CAST({customers} AS BIGINT) AS customers, CAST({days} AS BIGINT) AS days FROM {t} GROUP BY o_orderstatus"


@suite.add(_DISTINCT.format(t="orders", customers="count(DISTINCT o_custkey)", days="count(DISTINCT o_orderdate)"))
def sql_count_distinct(spark, sf):
    return _step(spark, sf, ["orders"], _DISTINCT.format(t="in_1", customers="count_distinct(o_custkey)", days="count_distinct(o_orderdate)"))


_WHOLE = """
    SELECT p_partkey, CAST({q} AS BIGINT) AS halves, CAST(-{q} AS INTEGER) AS below, TRY_CAST(p_brand AS INTEGER) AS no_number,
      substring(p_name, p_size - 3, 2) AS from_place, substring(p_name, 0, p_size) AS from_zero FROM {t}"""


@suite.add(_WHOLE.format(t="part", q="(p_size + CAST(0.5 AS DECIMAL(2,1)))"))
def sql_whole_numbers(spark, sf):
    """Casts to whole numbers round, halves away from zero; a text cut from place 0 is a character shorter."""
    return _step(spark, sf, ["part"], _WHOLE.format(t="in_1", q="(p_size + CAST(0.5 AS DECIMAL(2,1)))"))


_LISTED = "SELECT c_nationkey, {size}(list(CASE WHEN c_acctbal < 2000 THEN NULL ELSE c_mktsegment END)) AS listed, {size}(list(DISTINCT nullif(c_mktsegment, 'BUILDING'))) AS kinds FROM {t} GROUP BY c_nationkey"


@suite.add(_LISTED.format(t="customer", size="len"))
def sql_list_keeps_nulls(spark, sf):
    """A list has an element per row, NULL ones too."""
    out = _step(spark, sf, ["customer"], _LISTED.format(t="in_1", size=""))
    return out.withColumns({c: F.size(c).cast("bigint") for c in ("listed", "kinds")})
