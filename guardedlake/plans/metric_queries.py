"""Metrics, health and data quality on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.functions.text import ACCOUNT_CLASSES, account_class, currency
from guardedlake.operators import metrics, quality, ranges, refine, sessions
from guardedlake.plans.answer_queries import log_sql, run_log
from guardedlake.plans.registry import NAMED, named
from guardedlake.plans.session_queries import messages
from guardedlake.session import materialise
from guardedlake.sources.tables import Tables


def _rank_sql(p):
    return f"min(ms) FILTER (n >= ceil(total * {p})) AS p{round(p * 100)}_ms"


@named("g01_latency", f"""
WITH q AS (SELECT event_type, CAST(round(value * 300) AS BIGINT) AS ms FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM q)
SELECT event_type, count(*) AS query_count, CAST(sum(ms) AS BIGINT) AS total_ms, sum(ms) / count(*) AS mean_ms, max(ms) AS max_ms,
  {_rank_sql(0.5)}, {_rank_sql(0.95)}, {_rank_sql(0.99)} FROM r GROUP BY 1""")
def g01(spark, folder):
    q = Tables(spark, folder).events.select("event_type", F.round(F.col("value") * 300).cast("bigint").alias("latency_ms"))
    return metrics.latency_summary(q, ["event_type"])


@named("g01_latency_sketches", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS query_count, CAST(sum(CAST(round(value * 300) AS BIGINT)) AS BIGINT) AS total_ms,
  max(CAST(round(value * 300) AS BIGINT)) AS max_ms, true AS within_error FROM events GROUP BY 1, 2""")
def g01_sketches(spark, folder):
    """Days merged from stored hours; the quantiles are held against the ranks of all rows."""
    q = Tables(spark, folder).events.select("event_type", F.date_trunc("hour", "ts").alias("hour"), F.round(F.col("value") * 300).cast("bigint").alias("latency_ms"))
    hours = materialise(metrics.latency_sketches(q, ["hour", "event_type"]), "hourly-sketches")
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    days = metrics.sketched_quantiles(metrics.merge_sketches(hours, [day, "event_type"]))
    errors = metrics.rank_errors(days, q.withColumn("day", day), ["day", "event_type"])
    return days.join(errors, ["day", "event_type"]).select("day", "event_type", "query_count", "total_ms", "max_ms", (F.col("rank_error") <= metrics.RANK_ERROR).alias("within_error"))


@named("g02_iterations", log_sql() + """
, r AS (SELECT request_id, count(DISTINCT iteration) AS iterations, bool_or(success) AS success FROM log GROUP BY 1)
SELECT count(*) AS n, CAST(sum(iterations) AS BIGINT) AS total, max(iterations) AS most, avg(iterations) AS mean FROM r WHERE success""")
def g02(spark, folder):
    per = run_log(spark, folder).groupBy("request_id", "iteration").agg(F.bool_or("success").alias("success"))
    results = per.groupBy("request_id").agg(F.count(F.lit(1)).alias("iterations"), F.bool_or("success").alias("success"))
    return metrics.iteration_summary(results)


@named("g03_agent_calls", log_sql() + "SELECT agent, success, count(*) AS calls FROM log GROUP BY 1, 2")
def g03(spark, folder):
    return metrics.agent_calls(run_log(spark, folder))


@named("g03_agent_outcomes", log_sql() + """
SELECT agent, count(*) FILTER (success AND elapsed_ms <= 30000) AS succeeded, count(*) FILTER (NOT success OR elapsed_ms > 30000) AS failed FROM log GROUP BY 1""")
def g03_outcomes(spark, folder):
    return metrics.agent_outcomes(refine.apply_timeout(run_log(spark, folder)))


@named("g04_health", """
SELECT CASE WHEN count(*) FILTER (s_acctbal > 0) > 0 THEN 'UP' ELSE 'DOWN' END AS status, count(*) AS agents, count(*) FILTER (s_acctbal > 0) AS healthy_agents,
  (SELECT count(DISTINCT conv_id) FROM conversations) AS active_sessions FROM supplier""")
def g04(spark, folder):
    agents = Tables(spark, folder).supplier.select((F.col("s_acctbal") > 0).alias("healthy"))
    return metrics.health(agents, sessions.active_count(messages(spark, folder)))


def _violations(table, rule, sql):
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations"


@named("h01_constraint_audit", " UNION ALL ".join([
    _violations("orders", "not_null(o_custkey)", "SELECT count(*) FROM orders WHERE o_custkey IS NULL"),
    _violations("orders", "check(o_orderstatus)", "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN (''F'', ''O'')".replace("''", "'")),
    _violations("orders", "length(o_orderpriority)", "SELECT count(*) FROM orders WHERE length(o_orderpriority) > 8"),
    _violations("orders", "unique(o_orderkey)", "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"),
    _violations("lineitem", "unique(l_orderkey, l_linenumber)", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem"),
    _violations("orders", "foreign_key(o_custkey)", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    _violations("lineitem", "foreign_key(l_orderkey)", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    _violations("lineitem", "foreign_key(l_partkey)", "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"),
    _violations("lineitem", "foreign_key(l_suppkey)", "SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"),
    _violations("nation", "foreign_key(n_regionkey)", "SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)"),
    _violations("events", "foreign_key(user_id)", "SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
]))
def h01(spark, folder):
    t = Tables(spark, folder)
    rules = (quality.not_null("o_custkey"), quality.one_of("o_orderstatus", ["F", "O"]), quality.max_length("o_orderpriority", 8))
    key = quality.ForeignKey
    return quality.audit_tables({n: t.scan(n) for n in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region", "events")}, {
        "orders": quality.TableRules(rules, (("o_orderkey",),), (key("o_custkey", "customer", "c_custkey"),)),
        "lineitem": quality.TableRules((), (("l_orderkey", "l_linenumber"),), (
            key("l_orderkey", "orders", "o_orderkey"), key("l_partkey", "part", "p_partkey"), key("l_suppkey", "supplier", "s_suppkey"))),
        "nation": quality.TableRules(foreign=(key("n_regionkey", "region", "r_regionkey"),)),
        "events": quality.TableRules(foreign=(key("user_id", "customer", "c_custkey", F.col("c_acctbal") > 0),))})


_QUARTERS = ["q1_amount", "q2_amount", "q3_amount", "q4_amount"]


@named("h02_derived_total", """
WITH q AS (SELECT l_suppkey AS account_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
  round(sum(CASE WHEN quarter(l_shipdate) = 1 THEN l_extendedprice ELSE 0 END), 2) AS q1_amount, round(sum(CASE WHEN quarter(l_shipdate) = 2 THEN l_extendedprice ELSE 0 END), 2) AS q2_amount,
  round(sum(CASE WHEN quarter(l_shipdate) = 3 THEN l_extendedprice ELSE 0 END), 2) AS q3_amount, round(sum(CASE WHEN quarter(l_shipdate) = 4 THEN l_extendedprice ELSE 0 END), 2) AS q4_amount
  FROM lineitem GROUP BY 1, 2)
SELECT *, round(q1_amount + q2_amount + q3_amount + q4_amount, 2) AS annual_total FROM q""")
def h02(spark, folder):
    quarter = F.quarter("l_shipdate")
    sums = [F.round(F.sum(F.when(quarter == i + 1, F.col("l_extendedprice")).otherwise(0.0)), 2).alias(q) for i, q in enumerate(_QUARTERS)]
    budgets = Tables(spark, folder).lineitem.groupBy(F.col("l_suppkey").alias("account_id"), F.year("l_shipdate").alias("fiscal_year")).agg(*sums)
    return quality.with_total(budgets, _QUARTERS, "annual_total").withColumn("annual_total", F.round("annual_total", 2))


@named("h03_currency_text", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) AS balance FROM customer""")
def h03(spark, folder):
    return Tables(spark, folder).customer.select("c_custkey", currency("c_acctbal").alias("balance"))


_PROFILED = {"documents": ["text", "lang", "source"], "pages": ["url", "html"], "conversations": ["role", "text"], "part": ["p_name", "p_brand", "p_type"],
             "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"], "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"],
             "supplier": ["s_name"], "lineitem": ["l_returnflag", "l_linestatus"], "benchmark": ["text"]}


def _profile_sql(table, col):
    return (rf"SELECT '{table}' AS table_name, '{col}' AS column_name, count(*) AS n_rows, count(*) FILTER ({col} IS NULL) AS n_null, "
            rf"count(*) FILTER (regexp_matches(trim({col}), '^[$€£]?[0-9,]+\.?[0-9]*%?$')) AS n_numeric, max(length({col})) AS max_length, "
            rf"CAST(sum(length({col})) AS BIGINT) AS total_length, count(*) FILTER (length({col}) > 40) AS n_over_limit FROM {table}")


@named("h04_text_profile", " UNION ALL ".join(_profile_sql(t, c) for t, cols in _PROFILED.items() for c in cols))
def h04(spark, folder):
    t = Tables(spark, folder)
    return quality.audit(*[quality.text_profile(name, t.scan(name)) for name in _PROFILED])


@named("h05_account_classes", """
WITH a AS (SELECT p_partkey, 900 + (p_partkey * 37) % 6500 AS code FROM part)
SELECT p_partkey, code, CASE WHEN code BETWEEN 1000 AND 1999 THEN 'ASSET' WHEN code BETWEEN 2000 AND 2999 THEN 'LIABILITY' WHEN code BETWEEN 3000 AND 3999 THEN 'EQUITY'
  WHEN code BETWEEN 4000 AND 4999 THEN 'REVENUE' WHEN code BETWEEN 5000 AND 6999 THEN 'EXPENSE' END AS account_class FROM a""")
def h05(spark, folder):
    a = Tables(spark, folder).part.select("p_partkey", ((F.col("p_partkey") * 37) % 6500 + 900).alias("code"))
    return a.withColumn("account_class", account_class("code"))


@named("h05_class_table", NAMED["h05_account_classes"].sql)
def h05_table(spark, folder):
    """The same classes, from a table of ranges."""
    a = Tables(spark, folder).part.select("p_partkey", ((F.col("p_partkey") * 37) % 6500 + 900).alias("code"))
    classes = spark.createDataFrame(ACCOUNT_CLASSES, "low bigint, high bigint, account_class string")
    return ranges.range_join(a, "code", classes, "low", "high", "left").select("p_partkey", "code", "account_class")


# One range a supplier: of 21 numbers, of 901, or empty.
@named("h05_overlapping_ranges", """
WITH r AS (SELECT s_suppkey, s_suppkey * 20 AS low, CASE WHEN s_suppkey % 97 = 0 THEN s_suppkey * 20 + 900 WHEN s_suppkey % 10 = 0 THEN s_suppkey * 20 - 1 ELSE s_suppkey * 20 + 20 END AS high FROM supplier)
SELECT p_partkey, count(s_suppkey) AS n_ranges, CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) AS suppliers FROM part LEFT JOIN r ON p_partkey BETWEEN low AND high GROUP BY 1""")
def h05_overlapping(spark, folder):
    t = Tables(spark, folder)
    low = F.col("s_suppkey") * 20
    high = F.when(F.col("s_suppkey") % 97 == 0, low + 900).when(F.col("s_suppkey") % 10 == 0, low - 1).otherwise(low + 20)
    met = ranges.range_join(t.part.select("p_partkey"), "p_partkey", t.supplier.select("s_suppkey", low.alias("low"), high.alias("high")), "low", "high", "left")
    return met.groupBy("p_partkey").agg(F.count("s_suppkey").alias("n_ranges"), F.coalesce(F.sum("s_suppkey"), F.lit(0)).alias("suppliers"))
