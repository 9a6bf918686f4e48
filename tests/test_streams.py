from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from guardedlake.operators import sessions
from guardedlake.plans.ingest import STORED_SCHEMA, ingest
from guardedlake.session import fresh_path, shared_dir
from guardedlake.streaming import streams
from tests.conftest import rows


def put(folder, name, **columns):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def run(spark, df, sink, state, **kw):
    q = streams.start(df, sink, state, **kw)
    q.awaitTermination()
    assert q.exception() is None
    return q


def at(*minutes):
    return [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m) for m in minutes]


def test_late_rows_and_restart(spark, tmp_path):
    put(tmp_path / "in", "a", ts=at(1, 2, 70), event_type=["v"] * 3, latency_ms=[10, 20, 30])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sink = streams.batch_sink(out, closed=lambda d: d)

    def once():
        metric = streams.windowed_metrics(streams.stream_table(spark, str(tmp_path / "in"), schema), ["event_type"])
        q = run(spark, metric, sink, state)
        return sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])

    read = "window_start timestamp, event_type string, query_count bigint, total_ms bigint, max_ms bigint"
    once()
    assert rows(streams.read_sink(spark, out, "closed", read).select("query_count", "total_ms")) == [(2, 30)]
    put(tmp_path / "in", "b", ts=at(3, 71, 200), event_type=["v"] * 3, latency_ms=[99, 5, 1])
    assert once() > 0  # minute 3 belongs to a closed window
    got = sorted(rows(streams.read_sink(spark, out, "closed", read).select("query_count", "total_ms")))
    assert got == [(2, 30), (2, 35)]


def test_agent_calls_by_window(spark, tmp_path):
    put(tmp_path / "in", "a", ts=at(1, 2, 3, 300), agent=["a", "a", "b", "a"], success=[True, False, True, True])
    calls = streams.windowed_agent_calls(streams.stream_table(spark, str(tmp_path / "in")))
    run(spark, calls, streams.batch_sink(str(tmp_path / "out"), x=lambda d: d), str(tmp_path / "state"))
    got = streams.read_sink(spark, str(tmp_path / "out"), "x", "agent string, success boolean, calls bigint").drop("batch")
    assert sorted(rows(got)) == [("a", False, 1), ("a", True, 1), ("b", True, 1)]


def test_live_history_equals_batch_trim_and_expires(spark, tmp_path):
    state, seen = str(tmp_path / "state"), str(tmp_path / "out")
    schema = None
    sink = streams.batch_sink(seen, history=lambda d: d)
    steps = [dict(session_key=["s", "s", "t"], seq=[0, 1, 0], role=["USER"] * 3, content=["a", "b", "x"], ts=at(0, 1, 1)),
             dict(session_key=["s", "s"], seq=[2, 3], role=["USER"] * 2, content=["c", "d"], ts=at(2, 3)),
             dict(session_key=["u"], seq=[0], role=["USER"], content=["z"], ts=at(100))]
    for i, step in enumerate(steps):
        put(tmp_path / "in", f"f{i}", **step)
        schema = schema or spark.read.parquet(str(tmp_path / "in")).schema
        stream = streams.stream_table(spark, str(tmp_path / "in"), schema)
        run(spark, streams.live_history(stream, keep=3), sink, state, mode="append")
    out = spark.read.parquet(f"{seen}/history/batch=*").withColumn("b", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int"))
    assert {r["session_key"] for r in out.where("expired").collect()} == {"s", "t"}
    mine = out.where("session_key = 's' AND NOT expired")
    last = mine.agg(F.max("b")).first()[0]
    messages = spark.createDataFrame([("s", i, "USER", c) for i, c in enumerate("abcd")], "session_key string, seq bigint, role string, content string")
    assert sorted(rows(mine.where(F.col("b") == last).select("seq", "content"))) == sorted(rows(sessions.trimmed_history(messages, 3).select("seq", "content")))


def test_ingest_stream_equals_batch_and_replay_is_harmless(spark, tmp_path):
    pairs = [("a", "## t\nold\n## gone\nx"), ("b", "## t\nnew")]
    for i, (d, t) in enumerate(pairs):
        put(tmp_path / "in", f"f{i}", doc_id=[d], text=[t])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stamp = F.timestamp_seconds(F.lit(7))

    def once(checkpoint):
        docs = streams.stream_table(spark, str(tmp_path / "in"), "doc_id string, text string", files_per_batch=1)
        q = streams.ingest_stream(docs, out, checkpoint, "ns", stamp, dim=8)
        q.awaitTermination()
        assert q.exception() is None
        return sorted(rows(streams.current_chunks(spark, out).select("namespace", "chunk_id", "content", "embedding", "created_at")))

    batch = spark.createDataFrame([], STORED_SCHEMA)
    for pair in pairs:
        batch = ingest(spark.createDataFrame([pair], "doc_id string, text string"), batch, "ns", stamp, dim=8)
    want = sorted(rows(batch.select("namespace", "chunk_id", "content", "embedding", "created_at")))
    assert once(state) == want
    # Without its progress the stream works the same files off again, into the same folders.
    assert once(str(tmp_path / "state-2")) == want


def test_shared_folder_is_the_session_setting(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or shared_dir(spark)
    assert fresh_path(spark, "x").startswith(folder.rstrip("/") + "/x-") and fresh_path(spark, "x") != fresh_path(spark, "x")


class Context:
    """A context without the setting."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/id"


def test_only_a_local_session_may_lack_a_shared_folder():
    local = SimpleNamespace(sparkContext=Context("local[2]"))
    assert shared_dir(local) == shared_dir(local) == local.sparkContext.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=Context("spark://host:7077")))


def test_sliding_windows(spark):
    df = spark.createDataFrame([(m.to_pydatetime(), "v", 10) for m in at(5, 25, 65)], "ts timestamp, event_type string, latency_ms int")
    out = streams.windowed_metrics(df, ["event_type"], width="1 hour", slide="30 minutes")
    assert sorted((r["window_start"].hour * 60 + r["window_start"].minute, r["query_count"]) for r in out.collect()) == [(0, 2), (30, 1), (60, 1), (1410, 2)]


def test_history_stream_equals_batch_trim(spark, tmp_path):
    for i, seqs in enumerate(([0, 3, 1], [2, 5], [4])):
        put(tmp_path / "in", f"f{i}", session_key=["s"] * len(seqs), seq=seqs, role=["USER"] * len(seqs), content=[str(x) for x in seqs])
    stream = streams.stream_table(spark, str(tmp_path / "in"), files_per_batch=1)
    streams.history_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), keep=2).awaitTermination()
    assert sorted(r["seq"] for r in streams.current_history(spark, str(tmp_path / "out"), 2).collect()) == [4, 5]


def test_session_state_over_restarts(spark, tmp_path):
    """Trims, replaces, moves the timer, ends and begins anew, on a state that outlives the query."""
    first = list(range(40))
    put(tmp_path / "in", "a", ts=at(*[0] * 40, 5, 5), session_key=["hot"] * 40 + ["b", "b"], seq=[*first, 1, 1], role=["USER"] * 42, content=[f"m{i}" for i in first] + ["old", "new"])
    schema, out, state = spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), str(tmp_path / "state")
    sink = streams.batch_sink(out, history=lambda d: d)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def once():
        seen = {r[0] for r in rows(streams.read_sink(spark, out, "history", streams.HISTORY_SCHEMA).select("batch"))}
        run(spark, streams.session_state(streams.stream_table(spark, str(tmp_path / "in"), schema), 3), sink, state, rocksdb=True)
        return sorted((r[0], r[1], r[3], r[4]) for r in rows(streams.read_sink(spark, out, "history", streams.HISTORY_SCHEMA)) if r[5] not in seen)

    assert once() == [("b", 1, "new", False), ("hot", 37, "m37", False), ("hot", 38, "m38", False), ("hot", 39, "m39", False)]
    # An earlier seq that is no longer among the last, and one that replaces; b's timer is not moved, so b ends.
    put(tmp_path / "in", "b", ts=at(25, 25, 46), session_key=["hot", "hot", "c"], seq=[3, 39, 1], role=["USER"] * 3, content=["late", "m39b", "x"])
    assert once() == [("b", -1, "", True), ("c", 1, "x", False), ("hot", 37, "m37", False), ("hot", 38, "m38", False), ("hot", 39, "m39b", False)]
    put(tmp_path / "in", "c", ts=at(47, 100), session_key=["b", "d"], seq=[2, 1], role=["USER"] * 2, content=["again", None])
    assert once() == [("b", -1, "", True), ("b", 2, "again", False), ("c", -1, "", True), ("d", 1, None, False), ("hot", -1, "", True)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
