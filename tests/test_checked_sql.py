import pytest

from millrace.errors import InvalidInput
from millrace.operators.checked_sql import check_sql, checked_expression, sql_step

INPUTS = ["in_1", "in_2"]


@pytest.fixture(scope="module")
def inputs(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 0.0)], "id int, name string, amount double")
    return [df, df]


@pytest.mark.parametrize("query, rows", [
    ("SELECT * FROM in_1", 2),
    ("SELECT name, sum(amount) AS total FROM in_1 GROUP BY name", 2),
    ("SELECT in_1.id FROM in_1 JOIN in_2 ON in_1.id = in_2.id", 2),
    ("WITH x AS (SELECT * FROM in_1) SELECT * FROM x", 2),
    ("SELECT upper(name), round(amount, 2) FROM in_1 WHERE amount > 0", 1),
    ("SELECT * FROM main.in_1", 2),
    ("SELECT id FROM IN_1;", 2),
    ("SELECT a.id FROM in_1 a CROSS JOIN in_2 b WHERE a.id < b.id", 1),
    ("SELECT * FROM in_1 LEFT ANTI JOIN in_2 ON in_1.id = in_2.id + 1", 1),
    ("SELECT u.id FROM (SELECT id FROM in_1 UNION ALL SELECT id FROM temp.in_2) u WHERE id IN (SELECT id FROM in_2)", 4),
    ("SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) AS rn, rank() OVER (ORDER BY id) r, dense_rank() OVER (ORDER BY id) d, "
     "lag(id) OVER (ORDER BY id) p, lead(id) OVER (ORDER BY id) n, sum(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) s, "
     "first(id) OVER (ORDER BY id) f, last(id) OVER (ORDER BY id) l FROM in_1", 2),
    ("SELECT log(100) AS l, date_diff('month', DATE '2024-01-31', DATE '2024-02-01') AS m FROM in_1", 2),
])
def test_accepted(inputs, query, rows):
    assert len(sql_step(inputs, query).collect()) == rows


@pytest.mark.parametrize("query", [
    "TABLE orders", "SELECT name FROM hidden.in_1", "SELECT id FROM a.b.in_1", "SELECT id FROM in_3",
    "SELECT i.id FROM in_1 i JOIN customers c ON i.id = c.id", "SELECT * FROM csv.`/data`", "SELECT * FROM explode(array(1, 2))",
    "MERGE INTO in_1 USING in_2 ON in_1.id = in_2.id WHEN MATCHED THEN DELETE", "DELETE FROM in_1", "DROP VIEW in_1",
    "REFRESH TABLE in_1", "ANALYZE TABLE in_1 COMPUTE STATISTICS", "USE other", "SELECT 1; SELECT 2",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM in_1) SELECT * FROM a",
    "SELECT * FROM (WITH c AS (SELECT 1 AS id) SELECT * FROM c) JOIN c USING (id)",
    "SELECT java_method('java.lang.System', 'exit', '1')", "SELECT reflect('a', 'b') FROM in_1", "SELECT * FROM parquet.`/etc`",
    "SELECT input_file_name() FROM in_1", "SELECT * FROM range(5)", "SELECT transform(id) USING 'cat' AS x FROM in_1",
    "SELECT id FROM in_1 UNION SELECT id FROM in_2", "SELECT id FROM in_1 EXCEPT SELECT id FROM in_2",
    "WITH a AS (SELECT 1) SELECT id FROM in_1 UNION ALL SELECT id FROM in_2 ORDER BY id",
    "SELECT explode(array(1)) FROM in_1", "SELECT * FROM in_1 LATERAL VIEW explode(array(1)) t", "SET x = 1", "SHOW TABLES",
    "DESCRIBE in_1", "SELECT (SELECT max(id) FROM secret) FROM in_1", "SELECT * FROM in_1 WHERE EXISTS (SELECT 1 FROM parquet.`/x`)",
    "SELECT * FROM in_1 WHERE id IN (SELECT reflect('a', 'b'))", "WITH x AS (SELECT * FROM secret) SELECT * FROM x",
    "SELECT sum(id) OVER w FROM in_1 WINDOW w AS (PARTITION BY java_method('java.lang.System', 'exit', '1'))",
    "SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'user.home') FROM in_1", "SELECT IDENTIFIER('reflect')('a', 'b') FROM in_1",
    "SELECT IDENTIFIER('java_' || 'method')('a', 'b') FROM in_1", "SELECT IDENTIFIER('id') FROM in_1", "SELECT * FROM IDENTIFIER('in_1')", "SELECT id FROM in_1 ORDER BY IDENTIFIER('reflect')('a', 'b')",
    "SELECT id FROM in_1 GROUP BY id HAVING IDENTIFIER('reflect')('a', 'b') = 'x'", "SELECT sum(id) OVER (ORDER BY IDENTIFIER('reflect')('a', 'b')) FROM in_1",
    "SELECT count(*) FILTER (WHERE IDENTIFIER('reflect')('a', 'b') = 'x') FROM in_1", "SELECT * FROM in_1 a JOIN in_2 b ON IDENTIFIER('reflect')('a', 'b') = 'x'",
    "SELECT id IN (SELECT IDENTIFIER('reflect')('a', 'b') FROM in_2) FROM in_1", "SELECT * FROM (VALUES (reflect('a', 'b'))) AS t(x)", "SELECT * FROM (VALUES (IDENTIFIER('reflect')('a', 'b'))) AS t(x)",
    "SELECT CASE WHEN id = 1 THEN IDENTIFIER('reflect')('a', 'b') END FROM in_1", "SELECT `reflect`('a', 'b') FROM in_1", "SELECT system.builtin.reflect('a', 'b') FROM in_1", "SELECT :x FROM in_1", "SELECT ? FROM in_1",
    "SELECT list(id -> id) FROM in_1", "SELECT name COLLATE UTF8_LCASE FROM in_1", "SELECT * FROM in_1 PIVOT (sum(id) FOR name IN ('a'))", "SELECT id FROM in_1 |> WHERE id > 1",
    "SELECT strftime(now(), '%Q') FROM in_1", "CACHE TABLE in_1", "EXPLAIN SELECT 1", "EXECUTE IMMEDIATE 'SELECT 1'", "", "   ",
])
def test_rejected(spark, query):
    with pytest.raises(InvalidInput):
        check_sql(spark, query, INPUTS)


def test_views_stay_private(spark, inputs):
    sql_step(inputs, "SELECT * FROM in_1").collect()
    assert not spark.catalog.tableExists("in_1")


@pytest.mark.parametrize("expression, value", [
    ("7 / zero", None), ("7 % zero", None), ("mod(7, zero)", None), ("7 div zero", None), ("8 / (zero + 2) / two", 2.0), ("7 / two", 3.5), ("7 / zero / zero", None),
    ("-7 / -two", 3.5), ("count_distinct(two)", 1), ("to_json(word)", '"it\'s"'), ("to_json(nothing)", None), ("to_json(7 / two)", "3.5"), ("log(100)", 2.0),
    ("strftime(DATE '2024-01-07', '%d of %B, it''s %A %%Y %-m')", "07 of January, it's Sunday %Y 1"), ("date_part('dow', DATE '2024-01-07')", 0),
    ("7 / date_part('DOW', DATE '2024-01-07')", None), ("list(nothing)", [None]), ("CAST(2.5 AS BIGINT)", 3), ("CAST(-2.5 AS INT)", -3), ("CAST('2.7' AS INT)", 3), ("CAST(9007199254740993 + zero AS BIGINT)", 9007199254740993),
    ("CAST('9223372036854775807' AS BIGINT)", 9223372036854775807), ("TRY_CAST(word AS INT)", None), ("TRY_CAST('1e3' AS INT)", 1000), ("CAST(two = 2 AS INT)", 1), ("(1.4 + two)::int", 3), ("CAST(nothing AS INT)", None),
    ("substring('hello', 0, 2)", "h"), ("substr('hello', zero, two)", "h"), ("substring('hello', 2 - two, CAST(1.5 AS INT))", "h"), ("substring('hello', 0)", "hello"), ("substring('hello', -2, 1)", "l"),
    ("substring('hello' FROM 0 FOR 3)", "he"), ("substring('hello', 1, two)", "he"), ("substring('hello', CAST(nothing AS INT), 2)", None), ("substring('hello', 0, 0)", ""), ("year(strptime('on 2024', 'on %Y'))", 2024)])
def test_dialect(spark, expression, value):
    df = spark.sql("SELECT 0 AS zero, 2 AS two, 'it''s' AS word, CAST(NULL AS STRING) AS nothing")
    assert sql_step([df], f"SELECT {expression} AS x FROM in_1" + (" GROUP BY two" if "count" in expression else "")).first()["x"] == value
    if "count" not in expression and "list" not in expression:
        assert df.select(checked_expression(df, expression).alias("x")).first()["x"] == value


def test_nulls_come_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    ids = lambda order: [r["id"] for r in sql_step([df], f"SELECT id FROM in_1 ORDER BY {order}").collect()]
    assert ids("v") == [2, 3, 1] and ids("v DESC") == [3, 2, 1] and ids("v NULLS FIRST") == [1, 2, 3] and ids("10 / (v - 5), id") == [3, 1, 2]


@pytest.mark.parametrize("expression", ["IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'user.home')", "IDENTIFIER('id')", "reflect('a', 'b')", "id + IDENTIFIER('reflect')('a', 'b')", "transform(array(1), x -> x)", "(SELECT 1)",
                                        "id IN (SELECT 1)", "sum(id) OVER ()", ":x", "?", "name COLLATE UTF8_LCASE", "*", "lag(id) OVER (ORDER BY id)"])
def test_formulas_rejected(inputs, expression):
    with pytest.raises(InvalidInput):
        inputs[0].select(checked_expression(inputs[0], expression))


def test_lists_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "id int, v int")
    rows = sql_step([df], "SELECT id, list(v) AS vs, list(DISTINCT v) AS ds, list(v) FILTER (WHERE v IS NULL) AS fs FROM in_1 GROUP BY id ORDER BY id").collect()
    assert [(sorted(r.vs, key=str), sorted(r.ds, key=str), r.fs) for r in rows] == [([5, None], [5, None], [None]), ([None], [None], [None])]
    assert sql_step([df], "SELECT list(v) OVER (PARTITION BY id ORDER BY v) AS vs FROM in_1 WHERE id = 1 ORDER BY v").first().vs == [5]


def test_code_behind_a_view_of_the_query_is_refused(spark, inputs):
    from millrace.operators import checked_sql

    made = inputs[0].selectExpr("reflect('java.lang.System', 'getProperty', 'user.home') AS home")
    with pytest.raises(InvalidInput):
        checked_sql._refuse_foreign(made, set())
    assert sql_step([made], "SELECT home FROM in_1").count() == 2
