"""Requests, sessions and progress feeds on the given conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.operators import feed, sessions
from guardedlake.plans.registry import named
from guardedlake.session import fresh_path, materialise
from guardedlake.sources.documents import read_lines
from guardedlake.sources.tables import Tables

_STAMP, _STAMP_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


@named("f01_request_validation", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '  ' ELSE text END AS query, repeat(lang, CAST(n_chars % 60 AS INTEGER)) AS session_id FROM documents),
v AS (SELECT doc_id, concat_ws('; ', CASE WHEN trim(query) = '' THEN 'Query must not be blank' END,
  CASE WHEN length(query) > 10000 THEN 'Query must not exceed 10,000 characters' END,
  CASE WHEN length(session_id) > 100 THEN 'Session ID must not exceed 100 characters' END) AS violations FROM r)
SELECT doc_id AS request_id, violations, violations = '' AS valid FROM v""")
def f01(spark, folder):
    d = Tables(spark, folder).documents
    r = d.select(F.col("doc_id").alias("request_id"), F.when(F.col("doc_id") % 50 == 0, "  ").otherwise(F.col("text")).alias("query"),
                 F.repeat("lang", (F.col("n_chars") % 60).cast("int")).alias("session_id"), F.lit(None).cast("map<string,string>").alias("options"))
    return sessions.validate(r).select("request_id", F.array_join("violations", "; ").alias("violations"), "valid")


@named("f02_scoped_keys", """
SELECT conv_id || '-' || turn AS request_id, coalesce(CASE WHEN conv_id % 4 <> 0 THEN 't' || (conv_id % 4) END, 'default') || ':'
  || CASE WHEN role = 'system' THEN sha256(conv_id || '-' || turn) ELSE 's' || conv_id END AS session_key,
  CASE WHEN turn % 2 = 0 THEN 'anonymous' ELSE role END AS user_id FROM conversations""")
def f02(spark, folder):
    c = Tables(spark, folder).conversations
    k = F.col("conv_id").cast("string")
    r = c.select(F.concat_ws("-", k, F.col("turn").cast("string")).alias("request_id"),
                 F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string"))).alias("tenant_id"),
                 F.when(F.col("turn") % 2 != 0, F.col("role")).alias("user_id"),
                 F.when(F.col("role") == "system", " ").otherwise(F.concat(F.lit("s"), k)).alias("session_id"))
    return sessions.scoped_keys(r).select("request_id", "session_key", "user_id")


def messages(spark, folder):
    return Tables(spark, folder).conversations.select(
        F.concat(F.lit("default:"), F.col("conv_id").cast("string")).alias("session_key"), F.col("turn").alias("seq"),
        F.upper("role").alias("role"), F.col("text").alias("content"))


_MESSAGES_SQL = "WITH messages AS (SELECT 'default:' || conv_id AS session_key, turn AS seq, upper(role) AS role, text AS content FROM conversations)"


@named("f03_trimmed_history", _MESSAGES_SQL + """
SELECT session_key, seq, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY seq DESC) AS n FROM messages) WHERE n <= 5""")
def f03(spark, folder):
    return sessions.trimmed_history(messages(spark, folder), 5)


@named("f03_exchange", """
WITH answered AS (SELECT q.conv_id, q.turn, q.text AS query, a.text AS response FROM conversations q JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')
SELECT conv_id AS session_key, turn * 2 AS seq, 'USER' AS role, query AS content FROM answered
UNION ALL SELECT conv_id, turn * 2 + 1, 'ASSISTANT', response FROM answered""")
def f03_exchange(spark, folder):
    c = Tables(spark, folder).conversations
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return sessions.exchange(q.join(a, ["conv_id", "turn"]).withColumnRenamed("conv_id", "session_key"))


@named("f04_session_summaries", _MESSAGES_SQL + """
, s AS (SELECT session_key, arg_min(content, seq) FILTER (role = 'USER') AS first_query, max(seq) AS last_seq, count(*) AS message_count FROM messages GROUP BY 1)
SELECT *, CASE WHEN length(first_query) > 40 THEN substring(first_query, 1, 40) || '…' ELSE first_query END AS label FROM s""")
def f04(spark, folder):
    return sessions.summaries(messages(spark, folder))


@named("f05_idle_sessions", f"""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
n AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM e)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, strftime(min(ts), '{_STAMP_SQL}') AS started, strftime(max(ts), '{_STAMP_SQL}') AS last_access, count(*) AS n
FROM n GROUP BY 1, 2""")
def f05(spark, folder):
    out = sessions.idle_sessions(Tables(spark, folder).events, "user_id")
    return out.withColumn("started", F.date_format("started", _STAMP)).withColumn("last_access", F.date_format("last_access", _STAMP))


@named("f05_live_sessions", f"""
SELECT user_id, strftime(max(ts), '{_STAMP_SQL}') AS last_access FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1
HAVING max(ts) > TIMESTAMP '2024-01-20 11:30:00'""")
def f05_live(spark, folder):
    out = sessions.live_at(Tables(spark, folder).events, F.lit("2024-01-20 12:00:00").cast("timestamp"), "user_id")
    return out.withColumn("last_access", F.date_format("last_access", _STAMP))


@named("f06_session_cap", f"""
SELECT user_id, strftime(max(ts), '{_STAMP_SQL}') AS last_access FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 100""")
def f06(spark, folder):
    last = Tables(spark, folder).events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_access"))
    return sessions.cap_sessions(last, 100, "user_id").withColumn("last_access", F.date_format("last_access", _STAMP))


def _flagged(spark, folder):
    return Tables(spark, folder).labels.where("quality = 1").select(F.concat(F.lit("default:"), F.col("doc_id").cast("string")).alias("session_key"))


_FLAGGED_SQL = "(SELECT 'default:' || doc_id FROM labels WHERE quality = 1)"


@named("f07_get_sessions", _MESSAGES_SQL + f" SELECT * FROM messages WHERE session_key IN {_FLAGGED_SQL}")
def f07_get(spark, folder):
    return sessions.get_sessions(messages(spark, folder), _flagged(spark, folder))


@named("f07_delete_sessions", _MESSAGES_SQL + f" SELECT * FROM messages WHERE session_key NOT IN {_FLAGGED_SQL}")
def f07_delete(spark, folder):
    return sessions.delete_sessions(messages(spark, folder), _flagged(spark, folder))


@named("f07_active_count", "SELECT count(DISTINCT conv_id) AS active_sessions FROM conversations")
def f07_active(spark, folder):
    return sessions.active_count(messages(spark, folder))


@named("f07_active_by_period", """
WITH e AS (SELECT 'tenant-' || (event_id % 3) AS tenant_id, user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events)
SELECT tenant_id, 'week' AS period, week AS since, count(DISTINCT user_id) AS exact, true AS within_error FROM e GROUP BY 1, 3
UNION ALL SELECT tenant_id, 'all', min(day), count(DISTINCT user_id), true FROM e GROUP BY 1""")
def f07_periods(spark, folder):
    """Active users of weeks and of all days, from stored sketches of days, beside the exact number."""
    e = Tables(spark, folder).events.select(F.concat(F.lit("tenant-"), (F.col("event_id") % 3).cast("string")).alias("tenant_id"), "user_id", F.to_date("ts").alias("day"))
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd")
    days = materialise(sessions.active_sketches(e, ["tenant_id", "day"], "user_id"), "daily-active")
    first = days.groupBy("tenant_id").agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("since"))

    def beside(period, sketched, exact):
        near = F.abs(F.col("active_sessions") - F.col("exact")) <= F.col("exact") * sessions.ACTIVE_ERROR
        return sketched.join(exact, [c for c in ("tenant_id", "since") if c in exact.columns]).select("tenant_id", F.lit(period).alias("period"), "since", "exact", near.alias("within_error"))

    count = F.count_distinct("user_id").alias("exact")
    weeks = beside("week", sessions.merged_active(days, ["tenant_id", week.alias("since")]), e.groupBy("tenant_id", week.alias("since")).agg(count))
    return weeks.unionByName(beside("all", sessions.merged_active(days, ["tenant_id"]).join(first, "tenant_id"), e.groupBy("tenant_id").agg(count)))


@named("f08_concurrent_writers", _MESSAGES_SQL + """
SELECT session_key, seq, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY seq DESC) AS n FROM messages) WHERE n <= 20""")
def f08(spark, folder):
    m = messages(spark, folder)
    return sessions.merge_writers(*[m.where(F.col("role") == r) for r in ("USER", "ASSISTANT", "SYSTEM")])


@named("f09_event_lines", """
SELECT 'log-' || (user_id % 7) AS file, event_id * 4 AS event_no, event_type AS type, props AS payload FROM events WHERE event_id % 9 <> 0""")
def f09(spark, folder):
    e = Tables(spark, folder).events
    first = F.col("event_id") * 4
    written = F.array(F.struct(first.alias("line_no"), F.concat(F.lit("event: "), "event_type").alias("line")),
                      F.struct((first + 1).alias("line_no"), F.when(F.col("event_id") % 9 == 0, ": none").otherwise(F.concat(F.lit("data: "), "props")).alias("line")),
                      F.struct((first + 2).alias("line_no"), F.lit("").alias("line")))
    lines = e.select(F.concat(F.lit("log-"), (F.col("user_id") % 7).cast("string")).alias("file"), F.inline(written))
    return feed.parse_events(lines, span=8_000)


_LOG = 200_000  # events to a log


@named("f09_log_files", f"""
SELECT event_id // {_LOG} AS log, 3 * (row_number() OVER (PARTITION BY event_id // {_LOG} ORDER BY event_id) - 1) AS event_no, event_type AS type, props AS payload
FROM events QUALIFY event_id % 9 <> 0""")
def f09_files(spark, folder):
    """Logs as files, written once and read back by all the splits that they are cut into."""
    data = F.when(F.col("event_id") % 9 == 0, ": none").otherwise(F.concat(F.lit("data: "), "props"))
    cells = Tables(spark, folder).events.select(F.floor(F.col("event_id") / _LOG).alias("log"), "event_id",
                                                F.concat(F.lit("event: "), "event_type", F.lit("\n"), data, F.lit("\n")).alias("value"))
    out = fresh_path(spark, "event-logs")
    cells.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(out)
    # The number of a log stands for its path from here on, which is longer than most lines.
    lines = read_lines(spark, out).select(F.regexp_extract("file", "log=([0-9]+)", 1).cast("bigint").alias("log"), "line_no", "line")
    return feed.parse_events(lines, ["log"])


@named("f10_message_reduction", r"""
SELECT conv_id || '-' || turn AS message_id, CASE WHEN conv_id % 5 = 0 THEN 'Error: timeout' ||
    CASE WHEN contains(text, chr(10)) THEN replace(substring(text, instr(text, chr(10))), chr(10), '') ELSE '' END
  ELSE replace(text, chr(10), '') END AS content, role = 'assistant' AS complete FROM conversations""")
def f10(spark, folder):
    c = Tables(spark, folder).conversations.withColumn("message_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    data = c.select("message_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    data = data.select("message_id", (F.col("i") * 2).alias("seq"), F.lit("data").alias("type"), "text")
    errors = c.where("conv_id % 5 = 0").select("message_id", F.lit(1).alias("seq"), F.lit("error").alias("type"), F.lit("timeout").alias("text"))
    done = c.where("role = 'assistant'").select("message_id", F.lit(1_000_000).alias("seq"), F.lit("done").alias("type"), F.lit("").alias("text"))
    return feed.reduce_messages(data.unionByName(errors).unionByName(done))


@named("f11_step_states", """
WITH p AS (SELECT event_id // 8 AS request_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'rag' WHEN 'click' THEN 'sql' WHEN 'purchase' THEN 'execute'
    WHEN 'signup' THEN 'format' ELSE 'rag' END AS step, 'd' || value AS detail FROM events),
s AS (SELECT request_id, step, min(seq) AS f, max(seq) AS l, arg_max(detail, seq) AS detail FROM p GROUP BY 1, 2)
SELECT request_id, step, CAST(row_number() OVER (PARTITION BY request_id ORDER BY f) AS INTEGER) AS place, detail,
  CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.request_id = s.request_id AND o.f > s.l) THEN 'done' ELSE 'active' END AS status FROM s""")
def f11(spark, folder):
    t = F.col("event_type")
    step = F.when(t == "click", "sql").when(t == "purchase", "execute").when(t == "signup", "format").otherwise("rag")
    progress = Tables(spark, folder).events.select(F.floor(F.col("event_id") / 8).alias("request_id"), F.col("event_id").alias("seq"), step.alias("step"),
                                                   F.concat(F.lit("d"), F.col("value").cast("string")).alias("detail"))
    return feed.step_states(progress)
