"""The stream forms, run once over the given tables as files that have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.operators import metrics
from guardedlake.operators.corpus import ingest_summary
from guardedlake.plans.guard_queries import _SCREEN_SQL
from guardedlake.plans.registry import NAMED, named
from guardedlake.session import fresh_path
from guardedlake.sources.tables import Tables
from guardedlake.streaming import streams

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _arriving(spark, folder, table):
    # The glob covers a table that is one file as well as one that is a folder.
    return streams.stream_table(spark, Tables(spark, folder).path(table) + "*")


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@named("s01_screen_stream", _SCREEN_SQL + "SELECT statement_id, keyword = '' AS allowed, keyword, md5(sanitized) AS digest FROM screened WHERE starts_with(statement_id, 'd-')")
def s01(spark, folder):
    docs = _arriving(spark, folder, "documents")
    statements = docs.select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("statement_id"), F.col("text").alias("sql"))
    out = fresh_path(spark, "screened")
    _finish(streams.screen_stream(statements, out, fresh_path(spark, "state")))
    schema = "statement_id string, sanitized string, keyword string, allowed boolean"
    both = streams.read_sink(spark, out, "allowed", schema).unionByName(streams.read_sink(spark, out, "rejected", schema)).drop("batch")
    return both.select("statement_id", "allowed", "keyword", F.md5(F.col("sanitized").cast("binary")).alias("digest"))


@named("s02_windowed_metrics", """
WITH q AS (SELECT event_type, ts, CAST(round(value * 300) AS BIGINT) AS ms FROM events),
w AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS query_count, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms FROM q GROUP BY 1, 2)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, query_count, total_ms, max_ms FROM w
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def s02(spark, folder):
    events = _arriving(spark, folder, "events")
    queries = events.select("event_type", "ts", F.round(F.col("value") * 300).cast("bigint").alias("latency_ms"))
    out = fresh_path(spark, "metrics")
    _finish(streams.start(streams.windowed_metrics(queries, ["event_type"]), streams.batch_sink(out, closed=lambda d: d), fresh_path(spark, "state")))
    schema = "window_start timestamp, event_type string, query_count bigint, total_ms bigint, max_ms bigint"
    return streams.read_sink(spark, out, "closed", schema).drop("batch").withColumn("window_start", F.date_format("window_start", _STAMP))


# A window counts once all four of its panes are final, and holds the panes that have rows.
@named("s02_sliding_metrics", """
WITH q AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS pane, CAST(round(value * 300) AS BIGINT) AS ms FROM events),
w AS (SELECT pane - INTERVAL 15 MINUTE * b AS h, event_type, count(*) AS query_count, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms FROM q, range(4) AS r(b) GROUP BY 1, 2)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, query_count, total_ms, max_ms, true AS within_error FROM w
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def s02_sliding(spark, folder):
    """Quarters of an hour from the stream, merged to sliding hours; quantiles are held against the rows of the table."""
    def timed(df):
        return df.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 300).cast("bigint").alias("latency_ms"))

    out = fresh_path(spark, "panes")
    _finish(streams.start(streams.windowed_sketches(timed(_arriving(spark, folder, "events")), ["event_type"]), streams.batch_sink(out, panes=lambda d: d), fresh_path(spark, "state")))
    schema = "pane_start timestamp, event_type string, query_count bigint, total_ms bigint, max_ms bigint, sketch binary"
    panes = streams.read_sink(spark, out, "panes", schema).drop("batch")
    rows = timed(Tables(spark, folder).events)
    # The watermark of the last batch: windows that end after it still lack panes.
    final = rows.agg(F.max("ts") - F.make_dt_interval(mins=F.lit(10))).scalar()
    hours = metrics.sketched_quantiles(metrics.sliding_panes(panes, ["event_type"], 3600, 900))
    hours = hours.where(F.col("window_start") + F.make_dt_interval(hours=F.lit(1)) <= final)
    windowed = rows.select("event_type", "latency_ms", F.window("ts", "1 hour", "15 minutes").start.alias("window_start"))
    errors = metrics.rank_errors(hours, windowed, ["window_start", "event_type"])
    return hours.join(errors, ["window_start", "event_type"]).select(
        F.date_format("window_start", _STAMP).alias("window_start"), "event_type", "query_count", "total_ms", "max_ms", (F.col("rank_error") <= metrics.RANK_ERROR).alias("within_error"))


@named("s02_agent_calls", """
WITH c AS (SELECT 'agent-' || (user_id % 7) AS agent, event_type <> 'error' AS success, time_bucket(INTERVAL 30 MINUTE, ts) AS pane FROM events),
w AS (SELECT pane - INTERVAL 30 MINUTE * b AS h, agent, success, count(*) AS calls FROM c, range(2) AS r(b) GROUP BY 1, 2, 3)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, agent, success, calls FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def s02_agents(spark, folder):
    events = _arriving(spark, folder, "events")
    calls = events.select("ts", F.concat(F.lit("agent-"), (F.col("user_id") % 7).cast("string")).alias("agent"), (F.col("event_type") != "error").alias("success"))
    out = fresh_path(spark, "agent-calls")
    _finish(streams.start(streams.windowed_agent_calls(calls, slide="30 minutes"), streams.batch_sink(out, closed=lambda d: d), fresh_path(spark, "state")))
    done = streams.read_sink(spark, out, "closed", "window_start timestamp, agent string, success boolean, calls bigint").drop("batch")
    return done.withColumn("window_start", F.date_format("window_start", _STAMP))


@named("s03_live_sessions", """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
n AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e),
c AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM n GROUP BY user_id, s)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(z, '%Y-%m-%d %H:%M:%S') AS last_access, n FROM c
WHERE z + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def s03(spark, folder):
    events = _arriving(spark, folder, "events").select("user_id", "ts")
    out = fresh_path(spark, "sessions")
    _finish(streams.start(streams.live_sessions(events, "user_id"), streams.batch_sink(out, closed=lambda d: d), fresh_path(spark, "state")))
    done = streams.read_sink(spark, out, "closed", "user_id bigint, started timestamp, last_access timestamp, n bigint").drop("batch")
    return done.withColumn("started", F.date_format("started", _STAMP)).withColumn("last_access", F.date_format("last_access", _STAMP))


@named("s03_history_stream", NAMED["f03_trimmed_history"].sql)
def s03_history(spark, folder):
    c = _arriving(spark, folder, "conversations")
    messages = c.select(F.concat(F.lit("default:"), F.col("conv_id").cast("string")).alias("session_key"), F.col("turn").alias("seq"),
                        F.upper("role").alias("role"), F.col("text").alias("content"))
    out = fresh_path(spark, "history")
    _finish(streams.history_stream(messages, out, fresh_path(spark, "state"), 5))
    return streams.current_history(spark, out, 5)


# The live form on the given events: the last five of each user, and a row for each user who
# has been idle for half an hour when the stream has seen everything but the last ten minutes.
@named("s03_live_history", """
WITH m AS (SELECT 'u-' || user_id AS session_key, event_id AS seq, event_type AS role, props AS content, ts FROM events),
ends AS (SELECT session_key, max(ts) AS last FROM m GROUP BY 1)
SELECT session_key, seq, role, content, false AS expired FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY seq DESC) AS n FROM m) WHERE n <= 5
UNION ALL SELECT session_key, -1, '', '', true FROM ends WHERE last + INTERVAL 40 MINUTE < (SELECT max(ts) FROM m)""")
def s03_live(spark, folder):
    e = _arriving(spark, folder, "events")
    messages = e.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("role"),
                        F.col("props").alias("content"), "ts")
    out = fresh_path(spark, "live-history")
    _finish(streams.start(streams.live_history(messages, 5), streams.batch_sink(out, history=lambda d: d), fresh_path(spark, "state")))
    return streams.read_sink(spark, out, "history", streams.HISTORY_SCHEMA).drop("batch")


# The earlier half of the time, then a restart and the later half: sessions that the first run ended begin anew.
@named("s03_session_state", """
WITH mid AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS us FROM events),
m AS (SELECT 'u-' || user_id AS session_key, event_id AS seq, event_type AS role, props AS content, ts, epoch_us(ts) > us AS later FROM events, mid),
ended AS (SELECT session_key FROM m WHERE NOT later GROUP BY 1 HAVING max(ts) + INTERVAL 40 MINUTE < (SELECT max(ts) FROM m WHERE NOT later)),
live AS (SELECT * FROM m WHERE later OR session_key NOT IN (SELECT session_key FROM ended)),
seen AS (SELECT * FROM live WHERE session_key IN (SELECT session_key FROM m WHERE later)),
told AS (SELECT 1 AS run, session_key, seq, role, content FROM m WHERE NOT later UNION ALL SELECT 2, session_key, seq, role, content FROM seen)
SELECT session_key, seq, role, content, false AS expired FROM (SELECT *, row_number() OVER (PARTITION BY run, session_key ORDER BY seq DESC) AS n FROM told) WHERE n <= 5
UNION ALL SELECT session_key, -1, '', '', true FROM ended
UNION ALL SELECT session_key, -1, '', '', true FROM live GROUP BY 1 HAVING max(ts) + INTERVAL 40 MINUTE < (SELECT max(ts) FROM m)""")
def s03_state(spark, folder):
    e = Tables(spark, folder).events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    middle = e.agg(F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).scalar()
    arriving, out, state = fresh_path(spark, "arriving"), fresh_path(spark, "session-state"), fresh_path(spark, "state")
    for half, which in (("earlier", F.col("us") <= middle), ("later", F.col("us") > middle)):
        e.where(which).drop("us").write.parquet(f"{arriving}/{half}")
        rows = streams.stream_table(spark, f"{arriving}/*")
        messages = rows.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("role"),
                               F.col("props").alias("content"), "ts")
        _finish(streams.start(streams.session_state(messages, 5), streams.batch_sink(out, history=lambda d: d), state, rocksdb=True))
    return streams.read_sink(spark, out, "history", streams.HISTORY_SCHEMA).drop("batch")


@named("s04_ingest_stream", NAMED["a14_ingest_job"].sql)
def s04(spark, folder):
    docs = _arriving(spark, folder, "documents")
    text = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n## "), "source", F.lit("\n\nLanguage "), "lang")
    framed = docs.select("doc_id", text.alias("text"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("ns"))
    out = fresh_path(spark, "chunk-log")
    _finish(streams.ingest_stream(framed, out, fresh_path(spark, "state"), F.col("ns"), F.timestamp_seconds(F.lit(0)), dim=64))
    chunks = streams.current_chunks(spark, out)
    content = chunks.where("embedding IS NOT NULL").select("namespace", "kind", "content")
    return ingest_summary(chunks).join(content, ["namespace", "kind"])
