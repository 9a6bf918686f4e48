import pytest
from pyspark.sql import functions as F

from guardedlake.functions.text import cell_text, currency, quality_score
from guardedlake.operators import bounded, guard
from tests.conftest import rows

REJECTED = {
    "INSERT INTO users VALUES (1)": "INSERT", "UPDATE users SET a = 1": "UPDATE", "DELETE FROM users": "DELETE", "DROP TABLE users": "DROP",
    "ALTER TABLE users ADD c INT": "ALTER", "TRUNCATE TABLE users": "TRUNCATE", "CREATE TABLE t (a INT)": "CREATE", "MERGE INTO t USING s ON a": "MERGE",
    "GRANT SELECT ON t TO u": "GRANT", "REVOKE SELECT ON t FROM u": "REVOKE", "REINDEX TABLE t": "REINDEX", "insert into t values (1)": "INSERT",
    "Insert Into t values (1)": "INSERT", "dRoP table t": "DROP", "   DELETE FROM t": "DELETE", "\n\tupdate t set a = 1": "UPDATE",
    "WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d": "DELETE", "WITH i AS (INSERT INTO t VALUES (1)) SELECT 1": "INSERT",
    "WITH u AS (UPDATE t SET a = 1) SELECT * FROM u": "UPDATE", "SELECT * FROM (DELETE FROM t) x": "DELETE", "WITH x AS (DROP TABLE t) SELECT 1": "DROP",
    "WITH r AS (REINDEX TABLE t) SELECT 1": "REINDEX", "COPY t TO '/tmp/x'": "COPY", "CALL f()": "CALL", "DO $$ x $$": "DO", "EXECUTE p": "EXECUTE",
    "PREPARE p AS SELECT 1": "PREPARE", "LISTEN c": "LISTEN", "NOTIFY c": "NOTIFY", "VACUUM t": "VACUUM", "SET role = 'admin'": "SET",
    "SELECT 'fine so far' FROM orders; DELETE FROM orders": "DELETE", "SELECT replace(a, 'x', 'y') FROM t": "REPLACE", "SELECT 1 -- drop": "DROP", 'SELECT "do" FROM t': "DO",
}
ALLOWED = ["SELECT * FROM users", "WITH c AS (SELECT 1) SELECT * FROM c", "SELECT * FROM o WHERE id IN (SELECT id FROM c)", "EXPLAIN SELECT 1",
           "SET search_path TO public", "SELECT 'could not DROP it' AS note", "SELECT 'nobody''s INSERT' AS note", "SELECT * FROM o WHERE status = 'DELETED'",
           "SELECT created_at, updated_by FROM t"]


def screened(spark, sqls):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sqls)], "id int, sql string")
    return guard.screen(df).orderBy("id").collect()


def test_rejected_statements(spark):
    for row, word in zip(screened(spark, list(REJECTED)), REJECTED.values()):
        assert not row["allowed"] and row["keyword"] == word, row
        assert row["message"] == f"Unsafe SQL operation detected: {word}. Only SELECT queries are allowed."
        assert row["error_code"] == "SQL_EXECUTION_ERROR"


def test_allowed_statements_are_unchanged(spark):
    for row in screened(spark, ALLOWED):
        assert row["allowed"] and row["sanitized"] == row["sql"] and row["message"] is None, row


def test_empty_and_semicolons(spark):
    empty, null, blank, semis, spaced = screened(spark, ["", None, " \n\t ", "SELECT 1;;;", "SELECT 1 ;  ;  "])
    assert [r["message"] for r in (empty, null, blank)] == [guard.EMPTY_MESSAGE] * 3
    assert semis["sanitized"] == spaced["sanitized"] == "SELECT 1" and semis["allowed"]


def test_long_literal_does_not_overflow(spark):
    assert screened(spark, ["SELECT '" + "x" * 200_000 + "'"])[0]["allowed"]


@pytest.mark.parametrize("sql", [
    "ADD JAR x", "CACHE TABLE t", "REFRESH TABLE t", "USE db", "SET search_path TO x", "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT * FROM parquet.`/etc/x`", "EXPLAIN ANALYZE TABLE t COMPUTE STATISTICS", "SELECT 1; SELECT 2",
    "SELECT 1 -- '\n, reflect('a', 'b') -- '", "FROM (SELECT '\\' , x ' a) INSERT INTO t SELECT 1 --'", "SELECT nothing FROM nowhere"])
def test_guarded_sql_refuses(spark, sql):
    out = guard.guarded_sql(spark, sql)
    assert out.result is None and out.error.startswith("[sql error] ")


@pytest.mark.parametrize("sql", [
    "SELECT TRANSFORM(id) USING 'cat' AS (z string) FROM range(3)", "FROM range(3) MAP id USING 'cat' AS (z string)", "FROM range(3) REDUCE id USING 'cat' AS (z string)",
    "SELECT /* x */ TRANSFORM (id) USING 'cat' FROM range(3)", "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS (z string) FROM range(3)) q", "EXPLAIN SELECT TRANSFORM(id) USING 'cat' AS (z string) FROM range(3)",
    "SELECT 1 WHERE EXISTS (SELECT TRANSFORM(id) USING 'cat' AS (z string) FROM range(3))", "WITH q AS (SELECT TRANSFORM(id) USING 'cat' AS (z string) FROM range(3)) SELECT * FROM q",
    "SELECT * FROM `text`.`/etc/hostname`", "SELECT * FROM `text` . `/etc/hostname`", "SELECT (SELECT max(value) FROM `text`.`/etc/hostname`)"])
def test_guarded_sql_refuses_scripts_and_paths(spark, sql):
    out = guard.guarded_sql(spark, sql)
    assert out.result is None and out.error.startswith("[sql error] ")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


_CALL = "('java.util.UUID', 'randomUUID')"


@pytest.mark.parametrize("sql", [
    f"SELECT `reflect`{_CALL}", f"SELECT `ReFlect` {_CALL}", "SELECT `try_reflect`('java.lang.System', 'getenv', 'HOME')", f"SELECT `java_method`{_CALL}", f"SELECT system.builtin.`reflect`{_CALL}",
    f"SELECT `builtin`.`reflect`{_CALL}", f"EXPLAIN SELECT `reflect`{_CALL}", f"WITH q AS (SELECT `reflect`{_CALL} AS x) SELECT x FROM q", f"SELECT 1 WHERE EXISTS (SELECT `reflect`{_CALL})",
    f"SELECT (SELECT max(`reflect`{_CALL}))", f"SELECT transform(array(1), x -> `reflect`{_CALL})", f"SELECT IDENTIFIER('refl' || 'ect'){_CALL}", f"SELECT id FROM range(1) ORDER BY `reflect`{_CALL}",
    f"SELECT id FROM range(1) GROUP BY id HAVING `reflect`{_CALL} IS NULL", f"SELECT * FROM range(1) LATERAL VIEW explode(array(`reflect`{_CALL})) t AS x", "SELECT `input_file_name`()",
    "SELECT id FROM calls_the_jvm", "SELECT own_function(id) FROM range(1)", "SELECT other.`own_function`(1)"])
def test_guarded_sql_refuses_functions(spark, sql):
    spark.sql(f"SELECT reflect{_CALL} AS id").createOrReplaceTempView("calls_the_jvm")
    spark.udf.register("own_function", lambda x: x, "bigint")
    out = guard.guarded_sql(spark, sql)
    assert out.result is None and "Unsafe SQL operation detected" in out.error


def test_guarded_sql_runs_functions_that_are_allowed(spark):
    spark.udf.register("own_function", lambda x: x, "bigint")
    assert rows(guard.guarded_sql(spark, "SELECT own_function(id) FROM range(1)", ["own_function"]).result) == [(0,)]
    assert rows(guard.guarded_sql(spark, "SELECT `upper`(lower('A')), abs(-1), count(*) FROM range(2)").result) == [("A", 1, 2)]
    assert rows(guard.guarded_sql(spark, "SELECT sum(x) OVER (ORDER BY x), CASE WHEN x > 1 THEN x END FROM explode(array(1)) t(x)").result) == [(1, None)]
    assert rows(guard.guarded_sql(spark, "SELECT cast('1' AS int) + int('2'), 1 <=> 1, 'a' LIKE 'a', x IN (1, 2), -x, x[0] FROM VALUES (array(1)) t(y), LATERAL (SELECT y[0] AS x, y AS z)".replace("x[0]", "y[0]")).result) == [(3, True, True, True, -1, 1)]


def test_guarded_sql_runs_reads(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert rows(guard.guarded_sql(spark, "WITH x AS (SELECT max(id) m FROM three) SELECT m FROM x;").result) == [(2,)]
    assert guard.guarded_sql(spark, "SHOW TABLES").error is None
    assert guard.guarded_sql(spark, "EXPLAIN SELECT * FROM three").error is None
    assert guard.guarded_sql(spark, "DESCRIBE three").error is None
    assert rows(guard.guarded_sql(spark, "SELECT count(*) FROM three WHERE id IN (SELECT max(id) FROM three)").result) == [(1,)]
    assert guard.guarded_sql(spark, "SELECT '-- drop it' AS a /* and this */ FROM three").error is None


@pytest.fixture()
def employees(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'Alice Johnson', 'Engineering', 95000.00BD), (2, 'Bob Smith', 'Engineering', 88000.00BD),
        (3, 'Carol White', 'Marketing', 72000.00BD), (4, 'David Brown', 'Marketing', 68000.00BD), (5, 'Eve Davis', 'Sales', 76000.00BD)
        AS t(id, name, department, salary)""")
    df.createOrReplaceTempView("employees")
    return df


def shown(spark, sql, order=None, **caps):
    return bounded.render_result(guard.guarded_sql(spark, sql).result, order, bounded.Caps(**caps)).first()


def test_employee_results(spark, employees):
    out = shown(spark, "SELECT * FROM employees", ["id"])
    assert out["markdown"] == (
        "| id | name | department | salary | \n| --- | --- | --- | --- | \n| 1 | Alice Johnson | Engineering | 95000.00 | \n"
        "| 2 | Bob Smith | Engineering | 88000.00 | \n| 3 | Carol White | Marketing | 72000.00 | \n| 4 | David Brown | Marketing | 68000.00 | \n"
        "| 5 | Eve Davis | Sales | 76000.00 | \n\n_5 row(s) returned_")
    capped = shown(spark, "SELECT * FROM employees", ["id"], rows=2)
    assert capped["markdown"].endswith("_2 row(s) returned (limit reached)_") and "Carol" not in capped["markdown"]
    none = shown(spark, "SELECT name FROM employees WHERE salary > 999999")
    assert none["markdown"] == "| name | \n| --- | \n\n_0 row(s) returned_" and none["row_count"] == 0
    avg = shown(spark, "SELECT department, AVG(salary) AS a FROM employees GROUP BY department ORDER BY department")
    assert "91500" in avg["markdown"] and "70000" in avg["markdown"] and avg["row_count"] == 3
    assert guard.guarded_sql(spark, "DROP TABLE employees").error.startswith("[sql error] Unsafe SQL operation detected")


def test_caps(spark):
    assert shown(spark, "SELECT id FROM range(50)")["limit_reached"]
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(21)])
    assert "c20" not in bounded.render_result(wide).first()["markdown"]
    long = shown(spark, "SELECT id, repeat('x', 200) AS t FROM range(10)", ["id"], output_chars=500)
    # Header 26 characters, each line 209: two lines pass 26 + 418 <= 500, the third passes the budget and is the last.
    assert long["truncated"] and "(output truncated, showing 3 of 10 rows)" in long["markdown"]
    first = shown(spark, "SELECT 'a' AS " + "h" * 300, output_chars=10)
    assert "...[100 more]" in first["markdown"] and "| a | " in first["markdown"]
    last = shown(spark, "SELECT repeat('x', 150) AS t FROM range(1)", output_chars=100)
    assert "showing 1 of 1 rows" in last["markdown"]


def test_budget_is_passed_by_one_line_at_most(spark):
    lines = spark.range(2000).select((F.col("id") % 20).alias("result_id"), F.col("id").alias("pos"),
                                     F.repeat(F.lit("z"), (F.hash("id") % 90 + 100).cast("int")).alias("line"))
    caps = bounded.Caps(rows=40, output_chars=1500)
    header = bounded.header_text(["t"])
    got = bounded.within_budget(lines, len(header), caps)
    for rid in range(20):
        mine = sorted((r["n"], r["line"], r["shown"]) for r in got.where(F.col("result_id") == rid).collect())
        length, expect = len(header), []
        for n, line, _ in mine:
            expect.append(n == 1 or length <= 1500)
            length += len(line) + 1
        assert [s for _, _, s in mine] == expect and len(mine) == 40


def test_cells(spark):
    df = spark.createDataFrame([("x" * 200,), ("x" * 201,), (None,), ("a|b",)], "t string")
    assert [r[0] for r in df.select(cell_text("t")).collect()] == ["x" * 200, "x" * 200 + "...[1 more]", "NULL", "a|b"]


SCORES = [("0.9", 0.9), ("0.85", 0.85), ("1.0", 1.0), ("0.0", 0.0), ("0.5", 0.5), ("Quality: 0.9", 0.9), ("Quality: 0.9 out of 1.0", 0.9),
          ("I would rate this 0.75 because", 0.75), ("9.5", 1.0), ("1", 1.0), ("no score here", 0.5), ("", 0.5), ("   ", 0.5), ("Score: 0.8/1.0", 0.8),
          ("Based on my analysis:\n0.65\nit is", 0.65), ("0", 0.0), (None, 0.5), ("score is five", 0.5), ("10", 1.0), ("5", 0.5)]


def test_quality_scores(spark):
    df = spark.createDataFrame([(t,) for t, _ in SCORES], "t string").coalesce(1)
    assert [r[0] for r in df.select(quality_score("t")).collect()] == [s for _, s in SCORES]


def test_currency(spark):
    df = spark.createDataFrame([(1234.56,), (0.0,), (-500.0,), (99.999,)], "x double").coalesce(1)
    assert [r[0] for r in df.select(currency("x")).collect()] == ["$1,234.56", "$0.00", "-$500.00", "$100.00"]


def test_statement_profile(spark):
    df = spark.createDataFrame([("select a FROM t GROUP   BY a",), ("SELECT 'O\\'Brien', \"column name\", 100, 9.99 FROM t",), ("",), ("SELECT 'select 5'",)], "sql string")
    got = [tuple(r)[1:] for r in guard.statement_profile(df).coalesce(1).collect()]
    assert sorted(got) == sorted([(0, 3, 0), (2, 2, 2), (0, 0, 0), (1, 1, 0)])
    assert dict(rows(guard.keyword_frequency(df))) == {"SELECT": 3, "FROM": 2, "GROUP BY": 1}
