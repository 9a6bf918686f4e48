"""The bucketed chunk store beside a plain dictionary, and what its writes leave alone."""

import random

import pytest
from pyspark.sql import functions as F

from guardedlake.plans.ingest import STORED_SCHEMA, ingest_into
from guardedlake.session import fresh_path, materialise
from guardedlake.sources.chunk_store import ChunkStore, ConcurrentWrite
from tests.conftest import plan

SCHEMA = "namespace string, chunk_id string, content string, created_at timestamp"


def batch(spark, rows):
    return spark.createDataFrame(rows, "namespace string, chunk_id string, content string, at bigint, pos int").withColumn("created_at", F.timestamp_seconds("at")).drop("at")


def held(store, at=None):
    return {(r["namespace"], r["chunk_id"]): (r["content"], int(r["created_at"].timestamp())) for r in store.read(at=at).collect()}


@pytest.fixture()
def store(spark):
    return ChunkStore.create(spark, fresh_path(spark, "store"), SCHEMA, 16)


def test_upserts_and_untouched_buckets(spark, store):
    assert held(store) == {} and store.manifest().version == 0
    rng, want = random.Random(1), {}
    for step in range(4):
        rows = [(rng.choice("ab"), f"c{rng.randrange(60)}", f"{step} {i}", 100 - step * 10 + i % 3, i) for i in range(40 if step == 0 else 5)]
        before = store.manifest()
        store.upsert(batch(spark, rows), ["pos"])
        last = {(n, c): text for n, c, text, _, pos in sorted(rows, key=lambda r: r[4])}
        for key, text in last.items():
            first = min(at for n, c, _, at, _ in rows if (n, c) == key)
            want[key] = (text, min(first, want.get(key, (None, first))[1]))
        assert held(store) == want
        after = store.manifest()
        touched = {r[0] for r in batch(spark, rows).select(store.bucket()).distinct().collect()}
        assert {b for b in after.folders if after.folders[b] != before.folders.get(b)} == touched and (step == 0 or len(touched) < 16)
        assert {r["bucket"]: r["version"] for r in store.versions().collect()} == {b: v for b, (_, v) in after.folders.items()}
    assert store.upsert(batch(spark, []), ["pos"]) == 4
    old = store.manifest()
    store.compact()
    assert held(store) == want == held(store, old)
    store.reset("a")
    assert held(store) == {k: v for k, v in want.items() if k[0] == "b"}
    assert store.reset("nobody") == store.manifest().version
    store.vacuum()
    assert held(ChunkStore(spark, store.path)) == {k: v for k, v in want.items() if k[0] == "b"}


def test_one_of_two_writers_fails(spark, store):
    store.upsert(batch(spark, [("a", "x", "one", 1, 0)]), ["pos"])
    at = store.manifest()
    store.upsert(batch(spark, [("a", "y", "two", 2, 0)]), ["pos"])
    with pytest.raises(ConcurrentWrite):
        store._rewrite(at, [0], batch(spark, [("a", "z", "three", 3, 0)]).drop("pos"))
    assert set(held(store)) == {("a", "x"), ("a", "y")}


def test_half_a_manifest_is_not_read(spark, store):
    store.upsert(batch(spark, [("a", "x", "one", 1, 0)]), ["pos"])
    assert store.files.create(f"{store.path}/manifests/v0000000009.json", '{"version": 9')
    assert set(held(store)) == {("a", "x")}


def test_what_is_stored_is_not_shuffled(spark, store):
    store.upsert(batch(spark, [("a", f"c{i}", "text", i, 0) for i in range(50)]), ["pos"])
    incoming = materialise(batch(spark, [("a", "c1", "new", 1, 0)]).drop("pos"), "few")  # written, so that Spark knows its size
    touched, rows = store.merged(store.manifest(), incoming)
    final = plan(rows).split("== Physical Plan ==")[1]
    assert len(touched) == 1 and "SortMergeJoin" not in final and final.count("LeftAnti") == 1
    # Exchanges carry keys, creation times and incoming rows; the scan that reads contents of stored rows stands under none.
    kept = plan(store.read(touched).join(incoming.select("namespace", "chunk_id"), ["namespace", "chunk_id"], "left_anti")).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in kept and "Exchange hashpartitioning" not in kept


def test_ingest_into_a_store(spark):
    store = ChunkStore.create(spark, fresh_path(spark, "store"), STORED_SCHEMA, 8)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    ingest_into(store, docs(("a", "## t\nold\n## gone\nx")), "ns", F.timestamp_seconds(F.lit(1)), dim=8)
    ingest_into(store, docs(("b", "## t\nnew")), "ns", F.timestamp_seconds(F.lit(2)), dim=8)
    got = lambda: sorted((r["chunk_id"], r["content"], r["created_at"].timestamp()) for r in store.read().collect())
    assert got() == [("table:gone", "## gone\nx", 1.0), ("table:t", "## t\nnew", 1.0)]
    ingest_into(store, docs(("b", "## t\nnew")), "ns", F.timestamp_seconds(F.lit(4)), reset="ns", dim=8)
    assert got() == [("table:t", "## t\nnew", 4.0)]
