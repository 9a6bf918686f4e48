"""Refinement, replay and consolidation on a run log made from the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.functions.text import quality_score
from guardedlake.operators import refine
from guardedlake.plans.registry import named
from guardedlake.sources.tables import Tables


def run_log(spark, folder, calls: int = 10):
    """Every event is one agent call; ``calls`` calls in a row belong to one request, two to a round."""
    i, r = F.col("event_id") % calls, F.floor(F.col("event_id") / calls)
    it = (F.floor(i / 2) + 1).cast("int")
    mix = r * 31 + it * 17
    plan = F.when((r * 7 + it * 3) % 11 == 0, " complete ").when((r + it) % 13 != 0, "look further")
    return Tables(spark, folder).events.select(
        r.alias("request_id"), it.alias("iteration"), (i % 2).cast("int").alias("pos"),
        F.concat_ws("-", "event_type", (i % 2).cast("string")).alias("agent"), plan.alias("plan"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("value "), F.col("value").cast("string"))).alias("response"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), F.col("value").cast("string"))).alias("error"),
        F.when(mix % 23 != 0, F.concat(F.lit("Quality: 0."), F.lpad((mix % 100).cast("string"), 2, "0"))).alias("score_text"),
        F.round(F.col("value") * 300).cast("bigint").alias("elapsed_ms"))


def log_sql(calls=10):
    return f"""
WITH raw AS (SELECT *, event_id % {calls} AS i, event_id // {calls} AS r FROM events),
calls AS (SELECT *, i // 2 + 1 AS it FROM raw),
log AS (SELECT r AS request_id, it AS iteration, i % 2 AS pos, event_type || '-' || (i % 2) AS agent,
  CASE WHEN (r * 7 + it * 3) % 11 = 0 THEN ' complete ' WHEN (r + it) % 13 <> 0 THEN 'look further' END AS plan, event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN 'value ' || value END AS response, CASE WHEN event_type = 'error' THEN 'bad ' || value END AS error,
  CASE WHEN (r * 31 + it * 17) % 23 <> 0 THEN 'Quality: 0.' || lpad(CAST((r * 31 + it * 17) % 100 AS VARCHAR), 2, '0') END AS score_text,
  CAST(round(value * 300) AS BIGINT) AS elapsed_ms FROM calls)
"""


@named("e01_refinement", """
WITH tries AS (SELECT o_orderkey, n, (n * (o_orderkey * 7 + 31)) % 100 AS s FROM orders CROSS JOIN range(1, 6) AS t(n)),
stops AS (SELECT o_orderkey, coalesce(min(n) FILTER (s >= 70), 5) AS n FROM tries GROUP BY 1)
SELECT t.o_orderkey AS request_id, 'scores 0.' || lpad(CAST(s AS VARCHAR), 2, '0') || ' at try ' || t.n AS response, s / 100 AS quality_score, CAST(t.n AS INTEGER) AS iterations
FROM tries t JOIN stops USING (o_orderkey, n)""")
def e01(spark, folder):
    requests = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("request_id"))

    def step(open_rows, n):
        # Each try adds to what the one before it said of itself.
        before = F.coalesce(F.regexp_extract("last_response", r"0\.([0-9]{2})", 1).cast("bigint"), F.lit(0))
        score = F.lpad(((before + F.col("request_id") * 7 + 31) % 100).cast("string"), 2, "0")
        return open_rows.withColumn("response", F.concat(F.lit("scores 0."), score, F.lit(f" at try {n}")))

    return refine.refine(requests, step, lambda df: df.withColumn("quality_score", quality_score("response")))


_REPLAY_SQL = log_sql() + """,
rounds AS (SELECT request_id, iteration, any_value(plan) AS plan, max(score_text) AS score_text, bool_or(success) AS ok,
    iteration > 1 AND coalesce(upper(trim(any_value(plan))) = 'COMPLETE', true) AS complete FROM log GROUP BY 1, 2),
scored AS (SELECT *, CASE WHEN NOT bool_or(ok) OVER (PARTITION BY request_id ORDER BY iteration) THEN 0 WHEN score_text IS NULL THEN 0.5
    ELSE CAST(substring(score_text, 10) AS DOUBLE) END AS score FROM rounds),
ends AS (SELECT request_id, coalesce(min(iteration) FILTER (complete OR score >= 0.7), max(iteration)) AS stop FROM scored GROUP BY 1),
closed AS (SELECT e.request_id, stop, complete AS by_plan, NOT complete AND score >= 0.7 AS by_score FROM ends e JOIN scored s ON s.request_id = e.request_id AND s.iteration = stop)
"""


@named("e02_run_log_replay", _REPLAY_SQL + """
, seen AS (SELECT l.request_id, l.agent, min(l.iteration * 10 + l.pos) AS first FROM log l JOIN closed c ON c.request_id = l.request_id
    WHERE l.success AND l.iteration <= c.stop - CAST(by_plan AS INTEGER) GROUP BY 1, 2),
used AS (SELECT request_id, string_agg(agent, ',' ORDER BY first) AS agents_used FROM seen GROUP BY 1)
SELECT c.request_id, CAST(stop AS INTEGER) AS iterations, CASE WHEN by_plan THEN 'complete' WHEN by_score THEN 'threshold' ELSE 'max' END AS stopped_by,
  coalesce((SELECT max(score) FROM scored s WHERE s.request_id = c.request_id AND s.iteration = c.stop - CAST(by_plan AS INTEGER)), 0) AS quality_score,
  coalesce(agents_used, '') AS agents_used
FROM closed c LEFT JOIN used u ON u.request_id = c.request_id""")
def e02(spark, folder):
    return refine.replay(run_log(spark, folder)).withColumn("agents_used", F.array_join("agents_used", ","))


@named("e03_single_shot", log_sql() + """
SELECT request_id, CASE WHEN success THEN response ELSE error END AS response, CASE WHEN success THEN agent ELSE '' END AS agents_used,
  1 AS iterations, CAST(1 AS DOUBLE) AS quality_score FROM log WHERE iteration = 1 AND pos = 0""")
def e03(spark, folder):
    log = run_log(spark, folder).where("iteration = 1")
    return refine.single_shot(log.select("request_id", "pos", "agent"), log.select("request_id", "agent", "success", "response", "error"))


@named("e04_agent_timeouts", log_sql() + """
SELECT request_id, iteration, pos, success AND elapsed_ms <= 30000 AS success, CASE WHEN elapsed_ms <= 30000 THEN response END AS response,
  CASE WHEN elapsed_ms > 30000 THEN 'Agent timed out after 30s' WHEN NOT success THEN 'Agent execution failed: ' || error END AS error FROM log""")
def e04(spark, folder):
    return refine.apply_timeout(run_log(spark, folder)).select("request_id", "iteration", "pos", "success", "response", "error")


@named("e05_consolidation", log_sql(3) + """,
sums AS (SELECT request_id, count(*) FILTER (success) AS good, any_value(response) FILTER (success) AS single,
  string_agg('**' || agent || ':**' || chr(10) || response, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY iteration, pos) FILTER (success) AS texts,
  string_agg('- ' || agent || ': ' || error, chr(10) ORDER BY iteration, pos) FILTER (NOT success) AS errors FROM log GROUP BY 1)
SELECT e.event_id AS request_id, CASE WHEN good IS NULL THEN 'No responses were generated for your query.'
  WHEN good = 0 THEN 'All agents failed to process your query:' || chr(10) || errors WHEN good = 1 THEN single
  WHEN e.event_id % 5 = 0 THEN 'merged ' || e.event_id ELSE texts END AS response
FROM events e LEFT JOIN sums s ON s.request_id = e.event_id""")
def e05(spark, folder):
    events = Tables(spark, folder).events.select(F.col("event_id").alias("request_id"))
    merged = events.where("request_id % 5 = 0").withColumn("merged", F.concat(F.lit("merged "), F.col("request_id").cast("string")))
    return refine.consolidate(events, run_log(spark, folder, 3), merged)


@named("e06_observation_summary", log_sql() + """
SELECT request_id, string_agg('[' || agent || ']: ' || response, chr(10) ORDER BY iteration, pos) AS summary FROM log WHERE success GROUP BY 1""")
def e06(spark, folder):
    return refine.observation_summary(run_log(spark, folder))
