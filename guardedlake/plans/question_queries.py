"""The whole way from question to answer over the given conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.operators import corpus, policy
from guardedlake.plans import answer as qa
from guardedlake.plans.registry import named
from guardedlake.plans.retrieval_queries import _CONTEXT_SQL, TEMPLATE, vector_chunks, vector_queries
from guardedlake.plans.routing_queries import _ROUTES_SQL, AGENTS, THRESHOLD, requests
from guardedlake.sources.tables import Tables

RULES = [policy.ScopeRule("sch", False, "Not in scope.")]


def stand_in() -> qa.Round:
    """Deterministic functions in place of models: the answer names its round, the score follows from all that was observed."""
    def act(calls, n):
        said = F.concat("agent", F.lit(f" says {n} "), F.lpad((F.length("query") % 97).cast("string"), 2, "0"))
        return (calls.withColumn("success", F.col("prompt").isNotNull()).withColumn("response", said)
                .withColumn("error", F.lit(None).cast("string")).withColumn("elapsed_ms", F.lit(5)))

    def score(open_rows, n):
        return open_rows.withColumn("score_text", F.concat(F.lit("Quality: 0."), F.lpad(((F.length("summary") * 7 + n * 31) % 100).cast("string"), 2, "0")))

    return qa.Round(act, score)


@named("l01_question_to_answer", _ROUTES_SQL + f"""
, targets AS (SELECT s.request_id, s.agent, row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.agent) AS p
  FROM scores s JOIN best b ON b.request_id = s.request_id WHERE s.score >= {THRESHOLD} OR (b.top < {THRESHOLD} AND s.agent = b.name)),
asked AS (SELECT * FROM requests WHERE NOT regexp_matches(query, 'sch')),
sizes AS (SELECT request_id, sum(2 * length(agent) + 14) AS chars, count(*) AS agents FROM targets GROUP BY 1),
tries AS (SELECT request_id, n, ((n * chars + n * agents - 1) * 7 + n * 31) % 100 AS s FROM asked JOIN sizes USING (request_id) CROSS JOIN range(1, 6) AS t(n)),
stops AS (SELECT request_id, coalesce(min(n) FILTER (s >= 70), 5) AS n FROM tries GROUP BY 1),
texts AS (SELECT a.request_id, string_agg('**' || t.agent || ':**' || chr(10) || t.agent || ' says ' || i || ' ' || lpad(CAST(length(query) % 97 AS VARCHAR), 2, '0'),
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i, p) AS long_text, count(*) AS k,
    any_value(t.agent || ' says 1 ' || lpad(CAST(length(query) % 97 AS VARCHAR), 2, '0')) AS one
  FROM asked a JOIN stops USING (request_id) JOIN targets t ON t.request_id = a.request_id JOIN range(1, 6) AS r(i) ON i <= n GROUP BY 1),
names AS (SELECT request_id, string_agg(agent, ',' ORDER BY p) AS agents FROM targets GROUP BY 1)
SELECT request_id, CASE WHEN k = 1 THEN one ELSE long_text END AS response, CAST(n AS INTEGER) AS iterations, agents AS agents_used,
  ((SELECT any_value(s) FROM tries WHERE tries.request_id = texts.request_id AND tries.n = stops.n)) / 100 AS quality_score, 'answered' AS status,
  top AS confidence, CASE WHEN top >= {THRESHOLD} THEN 'Keyword match' ELSE 'Best keyword match (below threshold, no LLM available)' END AS reasoning
FROM texts JOIN stops USING (request_id) JOIN names USING (request_id) JOIN best USING (request_id)
UNION ALL SELECT request_id, 'Not in scope.', 0, '', 0, 'rejected', 0, NULL FROM requests WHERE regexp_matches(query, 'sch')
UNION ALL SELECT request_id, 'Routing found no suitable agents for query: ' || query, 0, '', 0, 'error', 0, 'No matching agents found and no LLM available'
  FROM asked WHERE request_id NOT IN (SELECT request_id FROM targets)""")
def l01(spark, folder):
    asked = requests(spark, folder)
    asked = asked.withColumn("user_id", F.col("role")).withColumn("session_id", F.col("conv_id").cast("string"))
    chunks = Tables(spark, folder).benchmark.select(
        F.col("item_id").alias("chunk_id"), F.lit("default").alias("namespace"), F.lit("TABLE").alias("kind"), F.lit("item").alias("title"), F.col("text").alias("content"))
    chunks = corpus.embed_by_hash(chunks, "content", 64)
    questions = corpus.embed_by_hash(asked.select("request_id", F.lit("default").alias("namespace"), "query"), "query", 64).drop("query")
    prompts = qa.contexts(questions, chunks, "Tables:\n{schemaContext}", "all tables", k=3)
    out = qa.answer(asked.drop("conv_id", "turn", "role"), AGENTS, stand_in(), prompts, RULES, [policy.redaction_filter()], route_threshold=THRESHOLD)
    return out.withColumn("agents_used", F.array_join("agents_used", ","))


# The prompt holds chunks of several kinds, always-included ones among them, of the vector's own namespace;
# agents see what was said in the session. Each answers with a digest of the one and the length of the other.
@named("l01_context_and_history", _ROUTES_SQL + ", " + _CONTEXT_SQL.replace("WITH ", "", 1) + f"""
, targets AS (SELECT s.request_id, s.agent, row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.agent) AS p
  FROM scores s JOIN best b ON b.request_id = s.request_id WHERE s.score >= {THRESHOLD} OR (b.top < {THRESHOLD} AND s.agent = b.name)),
told AS (SELECT conv_id, least(count(*), 20) AS n FROM requests GROUP BY 1),
said AS (SELECT t.request_id, t.agent, p, t.agent || ' ' || CASE WHEN query_id IS NULL THEN 'no prompt'
    ELSE md5(replace('{TEMPLATE}', '{{schemaContext}}', coalesce(context, 'all tables'))) END || ' ' || n AS text
  FROM targets t JOIN requests r ON r.request_id = t.request_id JOIN told ON told.conv_id = r.conv_id LEFT JOIN contexts x ON x.query_id = r.conv_id)
SELECT s.request_id, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg('**' || agent || ':**' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p) END AS response,
  string_agg(agent, ',' ORDER BY p) AS agents_used, 1 AS iterations, 'answered' AS status FROM said s GROUP BY 1
UNION ALL SELECT request_id, 'Routing found no suitable agents for query: ' || query, '', 0, 'error' FROM requests WHERE request_id NOT IN (SELECT request_id FROM targets)""")
def l01_context(spark, folder):
    asked = requests(spark, folder).withColumn("user_id", F.col("role")).withColumn("session_id", F.col("conv_id").cast("string"))
    vectors = vector_queries(spark, folder).withColumnRenamed("query_id", "conv_id")
    prompts = qa.contexts(asked.select("request_id", "conv_id").join(vectors, "conv_id").drop("conv_id"), vector_chunks(spark, folder), TEMPLATE, "all tables")
    messages = asked.select(F.concat_ws(":", "tenant_id", "session_id").alias("session_key"), F.col("turn").alias("seq"), F.upper("role").alias("role"), F.col("query").alias("content"))

    def act(calls, n):
        seen = F.coalesce(F.md5(F.col("prompt").cast("binary")), F.lit("no prompt"))
        return (calls.withColumn("success", F.lit(True)).withColumn("response", F.concat_ws(" ", "agent", seen, F.size("history").cast("string")))
                .withColumn("error", F.lit(None).cast("string")).withColumn("elapsed_ms", F.lit(5)))

    user = qa.Round(act, lambda open_rows, n: open_rows.withColumn("score_text", F.lit("Quality: 0.9")))
    out = qa.answer(asked.drop("conv_id", "turn", "role"), AGENTS, user, prompts, route_threshold=THRESHOLD, messages=messages)
    return out.select("request_id", "response", F.array_join("agents_used", ",").alias("agents_used"), "iterations", "status")
