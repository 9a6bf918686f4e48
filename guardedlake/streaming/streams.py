"""The operators over streams: screening, windowed metrics, live sessions, corpus ingest.

Sinks write one folder per batch id and overwrite it, so a batch that is replayed
after a failure leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardedlake.operators.guard import screen
from guardedlake.operators.metrics import latency_sketches
from guardedlake.operators.sessions import trimmed_history
from guardedlake.plans.ingest import STORED_SCHEMA, prepared_chunks


def stream_table(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder, or those a glob finds, as a stream."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def batch_sink(path: str, **branches: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes ``path/<branch>/batch=<id>`` for each branch."""
    def write(df: DataFrame, batch_id: int) -> None:
        if len(branches) > 1:
            df = df.persist()
        for name, pick in branches.items():
            pick(df).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        if len(branches) > 1:
            df.unpersist()

    return write


def read_sink(spark: SparkSession, path: str, branch: str, schema: str) -> DataFrame:
    """All batches a sink has written, with their number as ``batch``; none is an empty table."""
    schema = f"{schema}, batch int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/{branch}")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          once: bool = True, rocksdb: bool = False) -> StreamingQuery:
    """Start a stream; ``once`` works off what there is and ends.

    ``rocksdb`` keeps this stream's state in RocksDB. A stream takes the session's
    settings when it starts, so the setting is put back at once.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if once else writer
    if not rocksdb:
        return writer.start()
    conf = df.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def screen_stream(statements: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Screen statements as they come; allowed and rejected ones go to two branches."""
    sink = batch_sink(path, allowed=lambda d: d.where("allowed"), rejected=lambda d: d.where("NOT allowed"))
    return start(screen(statements), sink, checkpoint, once=once)


def windowed_metrics(queries: DataFrame, by: list[str], ts: str = "ts", latency: str = "latency_ms", width: str = "1 hour",
                     slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, total and maximum latency per window; a window is final when the watermark passes it.

    The aggregates have a map-side part, so a busy key sends one row per task and
    window. A time stamp without zone is cast, as a watermark needs one with it.
    """
    rows = queries.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (rows.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by)
            .agg(F.count(F.lit(1)).alias("query_count"), F.sum(latency).alias("total_ms"), F.max(latency).alias("max_ms"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
                    "query_count", "total_ms", "max_ms"))


def windowed_sketches(queries: DataFrame, by: list[str], ts: str = "ts", latency: str = "latency_ms", pane: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, total, maximum and a quantile sketch per pane, final when the watermark passes it.

    The state of a pane is its sketch, of bounded size; ``metrics.sliding_panes`` and
    ``metrics.merge_sketches`` make windows of any length of the panes in the sink.
    """
    rows = queries.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (latency_sketches(rows, [F.window(ts, pane), *by], latency)
            .select(F.col("window.start").alias("pane_start"), *by, "query_count", "total_ms", "max_ms", "sketch"))


def windowed_agent_calls(calls: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Calls by agent and outcome per window."""
    rows = calls.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (rows.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), "agent", "success").agg(F.count(F.lit(1)).alias("calls"))
            .select(F.col("window.start").alias("window_start"), "agent", "success", "calls"))


def live_sessions(accesses: DataFrame, key: str = "session_key", ts: str = "ts", idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Accesses per session, closed by an idle gap.

    With the session settings of ``get_spark``, the accesses of a key are merged to
    sessions in each task before the shuffle, so a busy key sends few rows.
    """
    rows = accesses.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (rows.groupBy(F.session_window(ts, idle), key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_access"))
            .select(key, F.col("session_window.start").alias("started"), "last_access", "n"))


HISTORY_SCHEMA = "session_key string, seq bigint, role string, content string, expired boolean"


def live_history(messages: DataFrame, keep: int = 20, idle_ms: int = 30 * 60 * 1000, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The trimmed history of each session whenever it changes, and a last row when it expires.

    ``messages(session_key, seq, role, content, ts)``. The state of a key is its last
    ``keep`` messages, whatever number has passed; rows of a key arrive in Arrow
    batches and are folded in one by one.
    """
    rows = (messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
            .select("session_key", "seq", "role", "content", F.col(ts).alias("ts")))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_key": [key[0]], "seq": [-1], "role": [""], "content": [""], "expired": [True]})
            return
        seqs, roles, texts, last = state.get if state.exists else ([], [], [], 0)
        # Plain values: a session has few messages in a batch, for which a table costs more than the work.
        held = dict(zip(seqs, zip(roles, texts, strict=True), strict=True))
        for batch in batches:
            last = max(last, int(batch["ts"].max().timestamp() * 1000))
            held.update(zip(map(int, batch["seq"].tolist()), zip(batch["role"].tolist(), batch["content"].tolist(), strict=True), strict=True))
            held = {seq: held[seq] for seq in sorted(held)[-keep:]}
        roles, texts = [r for r, _ in held.values()], [t for _, t in held.values()]
        state.update((list(held), roles, texts, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_key": key[0], "seq": list(held), "role": roles, "content": texts, "expired": False})

    return rows.groupBy("session_key").applyInPandasWithState(
        fold, HISTORY_SCHEMA, "seq array<bigint>, role array<string>, content array<string>, last bigint",
        "append", GroupStateTimeout.EventTimeTimeout)


def session_state(messages: DataFrame, keep: int = 20, idle_ms: int = 30 * 60 * 1000, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``live_history`` on keyed state and timers: a batch writes the messages it brings, not the whole state.

    The state of a session is a map of its last ``keep`` messages by ``seq`` and the time
    of its timer; messages that fall out are removed one by one, and the timer is moved
    with each access. When it fires, the session gives its last row and its state is
    dropped; a message that comes later begins a new one. A repeated ``seq`` replaces the
    message. Needs a RocksDB state store: ``start(..., rocksdb=True)``.
    """
    rows = (messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
            .select("session_key", "seq", "role", "content", F.col(ts).alias("ts")))

    class Sessions(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.kept = handle.getMapState("kept", "seq bigint", "role string, content string")
            self.timer = handle.getValueState("timer", "at bigint")

        def handleInputRows(self, key, rows, timerValues):
            last = 0
            for batch in rows:
                last = max(last, int(batch["ts"].max().timestamp() * 1000))
                # More than the last messages of a batch can't be kept, so no more are written.
                for seq, role, text in batch.drop_duplicates("seq", keep="last").nlargest(keep, "seq")[["seq", "role", "content"]].itertuples(index=False):
                    self.kept.updateValue((int(seq),), (role, text))
            for seq in sorted(k[0] for k in self.kept.keys())[:-keep]:
                self.kept.removeKey((seq,))
            before, at = self.timer.get()[0] if self.timer.exists() else None, max(last + idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            if before is None or at > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.timer.update((at,))
            held = sorted((k[0], *v) for k, v in self.kept.iterator())
            yield pd.DataFrame(held, columns=["seq", "role", "content"]).assign(session_key=key[0], expired=False)[["session_key", "seq", "role", "content", "expired"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.kept.clear()
            self.timer.clear()
            yield pd.DataFrame({"session_key": [key[0]], "seq": [-1], "role": [""], "content": [""], "expired": [True]})

        def close(self):
            pass

    return rows.groupBy("session_key").transformWithStateInPandas(Sessions(), HISTORY_SCHEMA, "Append", "EventTime")


_MESSAGES = "session_key string, seq bigint, role string, content string"


def history_stream(messages: DataFrame, path: str, checkpoint: str, keep: int = 20, once: bool = True) -> StreamingQuery:
    """Keep session histories in files: a batch adds the last ``keep`` messages of each session it saw.

    The batch is trimmed map-side, so this is the form for keys too busy for the one
    task that ``live_history`` folds a key in.
    """
    sink = batch_sink(path, history=lambda d: trimmed_history(d.select("session_key", "seq", "role", "content"), keep))
    return start(messages, sink, checkpoint, once=once)


def current_history(spark: SparkSession, path: str, keep: int = 20, base: DataFrame | None = None) -> DataFrame:
    """The trimmed history after all batches, on top of what an earlier call was stored as (``base``)."""
    messages = read_sink(spark, path, "history", _MESSAGES).drop("batch")
    return trimmed_history(messages if base is None else messages.unionByName(base), keep)


CHUNK_LOG_SCHEMA = STORED_SCHEMA + ", doc_id string, pos int"


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, namespace: str | Column, created_at: Column, dim: int = 1536,
                  encoder=None, once: bool = True) -> StreamingQuery:
    """Chunk and embed documents as they come; a batch writes its own chunks only.

    The cost of a batch is that of its documents. ``current_chunks`` reads the table
    that the batches add up to; ``ingest.store`` of it makes a new base.
    """
    def chunks(df: DataFrame) -> DataFrame:
        out = prepared_chunks(df, namespace, created_at, encoder=encoder, dim=dim)
        return out.withColumn("doc_id", F.col("doc_id").cast("string"))

    return start(docs, batch_sink(path, chunks=chunks), checkpoint, once=once)


def current_chunks(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """The chunk table after all batches: the last row per key, the first creation time.

    ``base`` is the table before the first of the batches. To compact, store the result
    and let the stream write to a new path; the stored table is then the base.
    """
    log = read_sink(spark, path, "chunks", CHUNK_LOG_SCHEMA)
    if base is not None:
        log = log.unionByName(base.withColumn("batch", F.lit(-1)), allowMissingColumns=True)
    fields = ["kind", "title", "content", "embed_text", "embedding"]
    return (log.groupBy("namespace", "chunk_id")
            .agg(F.max_by(F.struct(*fields), F.struct("batch", "doc_id", "pos")).alias("r"), F.min("created_at").alias("created_at"))
            .select("namespace", "chunk_id", *[F.col(f"r.{f}").alias(f) for f in fields], "created_at"))
