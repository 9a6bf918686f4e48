import numpy as np
import pytest
from pyspark.sql import functions as F

from guardedlake.operators import feed, metrics, sessions
from guardedlake.sources.documents import read_lines
from guardedlake.streaming import streams
from tests.conftest import plan, rows
from tests.test_streams import at, put, run


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


TEXTS = {"plain": "a\nb\r\n\nc", "closed": "a\nb\n", "blank": "\n\n\n", "bom": "﻿a\nb\n", "open_bom": "﻿a\nb", "one": "x", "wide": "äöü€\n" * 700 + "end",
         "long": "y" * 5_000 + "\n" + "z\n" * 900 + "w" * 3_000, "many": "".join(f"event: e{i}\ndata: {i}\n\n" for i in range(2_000))}


def test_lines_of_many_splits_are_numbered_as_in_the_whole_file(spark, tmp_path, small_splits):
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    (tmp_path / "empty.log").write_bytes(b"")
    got = read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    by_file = {}
    for file, no, line in rows(got):
        by_file.setdefault(file.rsplit("/", 1)[1].removesuffix(".log"), []).append((no, line))
    expected = {n: [(i, x.removesuffix("\r")) for i, x in enumerate(t.removeprefix("﻿").split("\n"))] for n, t in TEXTS.items()}
    assert {n: sorted(x) for n, x in by_file.items()} == expected
    events = feed.parse_events(got.where(F.col("file").endswith("many.log")), span=100)
    assert sorted(rows(events.select("event_no", "type", "payload"))) == [(3 * i, f"e{i}", str(i)) for i in range(2_000)]


def test_packed_logs_end_in_a_line_break(spark, tmp_path):
    import gzip

    (tmp_path / "a.log.gz").write_bytes(gzip.compress(b"event: a\ndata: 1\n"))
    assert sorted(rows(read_lines(spark, str(tmp_path)).select("line_no", "line"))) == [(0, "event: a"), (1, "data: 1"), (2, "")]


def test_merged_sketches_keep_their_rank_error(spark):
    # A third of the rows is one group, and one latency is half of it.
    ms = F.when(F.col("id") % 2 == 0, 40).otherwise((F.col("id") * 7_919) % 100_003)
    q = spark.range(0, 300_000, 1, 8).select((F.col("id") % 50).alias("hour"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("kind"),
                                             F.when(F.col("id") % 1_000 != 7, ms).alias("latency_ms"))
    hours = metrics.latency_sketches(q, ["hour", "kind"])
    merged = metrics.sketched_quantiles(metrics.merge_sketches(hours, ["kind"])).cache()
    exact = q.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("t"), F.max("latency_ms").alias("m"))
    assert sorted(rows(merged.select("kind", "query_count", "total_ms", "max_ms"))) == sorted(rows(exact))
    errors = metrics.rank_errors(merged, q, ["kind"]).collect()
    assert len(errors) == 21 and all(0 <= r["rank_error"] <= metrics.RANK_ERROR for r in errors)
    values = np.sort(q.where("kind = 'hot' AND latency_ms IS NOT NULL").toPandas()["latency_ms"].to_numpy())
    hot = merged.where("kind = 'hot'").first()
    for p, name in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")):
        below, upto = np.searchsorted(values, hot[name], "left") / len(values), np.searchsorted(values, hot[name], "right") / len(values)
        assert below - metrics.RANK_ERROR <= p <= upto + metrics.RANK_ERROR
    assert "partial_kll" in plan(hours).lower()


def test_small_and_empty_groups(spark):
    q = spark.createDataFrame([("a", 5), ("a", 1), ("a", 9), ("b", None)], "kind string, latency_ms bigint")
    got = metrics.sketched_quantiles(metrics.latency_sketches(q, ["kind"])).select("kind", "query_count", "p50_ms", "p95_ms")
    assert sorted(rows(got)) == [("a", 3, 5, 9), ("b", 1, None, None)]
    assert rows(metrics.merge_sketches(metrics.latency_sketches(q.where("false"), ["kind"]), ["kind"])) == []


def test_panes_of_several_batches_make_sliding_windows(spark, tmp_path):
    put(tmp_path / "in", "a", ts=at(1, 16, 31, 32), event_type=["v"] * 4, latency_ms=[10, 20, 30, 40])
    schema, out, state = spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), str(tmp_path / "state")
    sink = streams.batch_sink(out, panes=lambda d: d)

    def once():
        run(spark, streams.windowed_sketches(streams.stream_table(spark, str(tmp_path / "in"), schema), ["event_type"]), sink, state)

    once()
    put(tmp_path / "in", "b", ts=at(33, 300), event_type=["v"] * 2, latency_ms=[50, 1])
    once()  # a new query on the same state: what the first one held open is still there
    panes = streams.read_sink(spark, out, "panes", "pane_start timestamp, event_type string, query_count bigint, total_ms bigint, max_ms bigint, sketch binary").drop("batch")
    hours = metrics.sketched_quantiles(metrics.sliding_panes(panes, ["event_type"], 3600, 900)).orderBy("window_start")
    assert rows(hours.select("query_count", "total_ms", "max_ms", "p50_ms")) == [
        (1, 10, 10, 10), (2, 30, 20, 10), (5, 150, 50, 30), (5, 150, 50, 30), (4, 140, 50, 30), (3, 120, 50, 40)]
    with pytest.raises(ValueError, match="whole number"):
        metrics.sliding_panes(panes, ["event_type"], 1000, 900)


def test_active_sketches_add_up_without_counting_twice(spark):
    seen = spark.range(200_000).select((F.col("id") % 5).alias("day"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40_000).alias("session_key"))
    seen = seen.unionByName(spark.createDataFrame([(9, None)], "day bigint, session_key bigint"))
    days = sessions.active_sketches(seen, ["day"])
    twice = days.unionByName(days)  # a batch written again
    exact = dict(rows(seen.groupBy("day").agg(F.count_distinct("session_key"))))
    got = dict(rows(sessions.merged_active(twice, ["day"])))
    assert got[9] == 0 and got.keys() == exact.keys()
    assert all(abs(got[d] - n) <= sessions.ACTIVE_ERROR * n for d, n in exact.items())
    total, all_days = seen.select("session_key").distinct().where("session_key IS NOT NULL").count(), sessions.merged_active(twice, []).first()[0]
    assert abs(all_days - total) <= sessions.ACTIVE_ERROR * total
