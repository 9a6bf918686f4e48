import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardedlake.operators import retrieve, vector_index
from tests.conftest import plan, rows

RNG = np.random.default_rng(3)


def frame(spark, id_col, vectors, namespaces):
    data = [(i, ns, [float(x) for x in v]) for i, (v, ns) in enumerate(zip(vectors, namespaces))]
    return spark.createDataFrame(data, f"{id_col} bigint, namespace string, embedding array<float>").repartition(3)


def brute(q, qns, c, cns, k):
    q, c = q.astype(np.float32).astype(float), c.astype(np.float32).astype(float)
    out = []
    for i in range(len(q)):
        hits = []
        for j in range(len(c)):
            if qns[i] == cns[j]:
                n = np.linalg.norm(q[i]) * np.linalg.norm(c[j])
                hits.append((round(1 - q[i] @ c[j] / n, 6) if n else float("inf"), j))
        out += [(i, j, None if d == float("inf") else d, r + 1) for r, (d, j) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=lambda x: (x[0], x[3]))


@pytest.fixture(scope="module")
def search(spark):
    # One namespace holds most rows; some vectors repeat and one has no direction.
    q, c = RNG.standard_normal((23, 8)), RNG.standard_normal((140, 8))
    c[10:20] = c[5]
    c[30] = 0
    qns = ["hot" if i % 3 else "cold" for i in range(23)]
    cns = ["hot" if i % 10 else "cold" for i in range(140)]
    return frame(spark, "query_id", q, qns), frame(spark, "chunk_id", c, cns), brute(q, qns, c, cns, 12)


def ordered(df):
    return sorted(rows(df.select("query_id", "chunk_id", "distance", "rank")), key=lambda x: (x[0], x[3]))


def same(got, want):
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    for g, w in zip(got, want):
        assert (g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-9)


def test_topk_equals_brute_force(search):
    q, c, want = search
    same(ordered(retrieve.cosine_topk(q, c, 12)), want)


@pytest.mark.parametrize("qb,cb", [(1, 1), (4, 16), (100, 1000)])
def test_block_topk_equals_brute_force(search, qb, cb):
    q, c, want = search
    same(ordered(retrieve.cosine_topk(q, c, 12, retrieve.SearchSize(qb, cb, 3, 7))), want)


def test_topk_is_a_prefix(search):
    q, c, _ = search
    assert ordered(retrieve.cosine_topk(q, c, 3)) == [r for r in ordered(retrieve.cosine_topk(q, c, 9)) if r[3] <= 3]


def test_final_cut_runs_before_the_shuffle(search):
    q, c, _ = search
    assert "WindowGroupLimit" in plan(retrieve.cosine_topk(q, c, 3))


def test_approximate_recall(spark):
    centres = RNG.standard_normal((12, 32)) * 3
    v = centres[RNG.integers(0, 12, 600)] + RNG.standard_normal((600, 32)) * 0.4
    q, c = frame(spark, "query_id", v[:100], ["n"] * 100), frame(spark, "chunk_id", v, ["n"] * 600)
    exact, found = retrieve.cosine_topk(q, c, 5), vector_index.indexed_topk(q, c, vector_index.build_index(c, lists=12), k=5, probes=3)
    assert retrieve.recall(found, exact).first()["recall"] > 0.9
    distances = {r[:3]: r[3] for r in rows(retrieve.cosine_topk(q, c, 600))}
    assert all(abs(distances[r[:3]] - r[3]) < 1e-6 for r in rows(found))


def test_index_of_odd_vectors(spark):
    v = RNG.standard_normal((90, 8))
    v[3] = 0
    c = frame(spark, "chunk_id", v, ["a"] * 45 + ["b"] * 45).union(spark.createDataFrame([(1000, "a", None)], "chunk_id bigint, namespace string, embedding array<float>"))
    q = frame(spark, "query_id", v[:50], ["a"] * 45 + ["c"] * 5)
    index = vector_index.build_index(c, lists=5)
    again = vector_index.load_index(spark, index.path)
    assert (again.centroids == index.centroids).all() and spark.read.parquet(f"{index.path}/codes").count() == 90
    # All lists probed and all candidates refined: the exact answer.
    assert sorted(rows(vector_index.indexed_topk(q, c, again, 4, probes=5, refine=30)), key=str) == sorted(rows(retrieve.cosine_topk(q, c, 4)), key=str)
    none = c.where("false")
    assert vector_index.indexed_topk(q, none, vector_index.build_index(none, lists=5), 4).count() == 0


def test_a_query_scans_the_lists_it_probes(spark):
    c = frame(spark, "chunk_id", np.eye(6), ["a"] * 6)
    index = vector_index.build_index(c, lists=6)
    found = vector_index.indexed_topk(frame(spark, "query_id", np.eye(6)[:1], ["a"]), c, index, 1, probes=1)
    assert rows(found.select("chunk_id", "distance")) == [(0, 0.0)] and "PartitionFilters: [list" in plan(found).replace("isnotnull(list", "list")


def test_namespaces_stay_apart(spark):
    chunks = spark.createDataFrame([("t", "a", "TABLE", "x", "A", [1.0, 0.0]), ("t", "b", "TABLE", "x", "SECRET", [1.0, 0.0])],
                                   "chunk_id string, namespace string, kind string, title string, content string, embedding array<float>")
    q = spark.createDataFrame([(1, "a", [0.1, 1.0])], "query_id int, namespace string, embedding array<float>")
    assert rows(retrieve.assemble(retrieve.cosine_topk(q, chunks), chunks, q)) == [(1, "A")]


def test_context_and_fallback(spark):
    chunks = spark.createDataFrame([("o", "n", "OVERVIEW", "b", "over", [1.0, 0.0]), ("e", "n", "ENUM", "a", "enum", [1.0, 0.0]), ("t1", "n", "TABLE", "x", "one", [1.0, 0.0]),
                                    ("t2", "n", "TABLE", "y", "two", [0.0, 1.0])], "chunk_id string, namespace string, kind string, title string, content string, embedding array<float>")
    q = spark.createDataFrame([(1, "n", [0.1, 1.0]), (2, "other", [1.0, 0.0])], "query_id int, namespace string, embedding array<float>")
    assert [r["chunk_id"] for r in retrieve.always_included(chunks, "n").collect()] == ["e", "o"]
    assert retrieve.always_included(chunks, "n", []).count() == 0
    hits = retrieve.cosine_topk(q, retrieve.without_kinds(chunks), 8)
    ctx = retrieve.assemble(hits, chunks, q)
    s = retrieve.SEPARATOR
    assert dict(rows(ctx)) == {1: s.join(["enum", "over", "two", "one"]), 2: None}
    assert dict(rows(retrieve.with_fallback(ctx, "all")))[2] == "all"
    with pytest.raises(retrieve.RetrievalError, match="1 queries"):
        retrieve.with_fallback(ctx, "all", fail_on_error=True)
    # A hit of an always-included kind does not come twice.
    both = retrieve.assemble(retrieve.cosine_topk(q, chunks, 8), chunks, q)
    assert dict(rows(both)) == dict(rows(ctx))
    assert ctx.select(retrieve.fill_prompt("a {schemaContext} b", F.lit("$1\\")).alias("p")).first()["p"] == "a $1\\ b"


def test_nearest_sorts_out_few_of_many_columns(monkeypatch):
    rng = np.random.default_rng(1)
    q, c = (retrieve.unit_rows(np.round(rng.normal(size=(n, 6)), 1)) for n in (40, 3_001))
    c[5], q[7], c[100:120] = 0, 0, c[99]
    cids = rng.permutation(len(c))
    sorted_out = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *more, **named: sorted_out.append(a.shape[1]) or partition(a, *more, **named))
    rows, cols, d = retrieve._nearest(q, c, cids, 8)
    assert max(sorted_out) < 100
    away = np.round(1.0 - q @ c.T, 6) + 0.0
    away[7], away[:, 5] = np.inf, np.inf
    want = [(i, *x) for i in range(len(q)) for x in sorted((away[i, j], cids[j]) for j in range(len(c)))[:8]]
    assert [(i, x, cids[j]) for i, j, x in zip(rows, cols, d)] == want


def test_rows_of_a_large_grid_are_not_copied(search):
    q, c, want = search
    hits = retrieve.cosine_topk(q, c, 12, retrieve.SearchSize(2, 8, 3, 7))
    text = plan(hits)
    assert "Generate explode" not in text and "CartesianProduct" in text
    same(ordered(hits), want)


def test_grids_small_and_large_at_once(spark, search):
    q, c, want = search
    # 'hot' has 4 blocks of queries and 'cold' 2, each one of chunks; keys of which one side has nothing, and rows without a vector or a key.
    schema = "bigint, namespace string, embedding array<float>"
    more = [(500, "alone", [1.0] * 8), (501, "hot", None), (502, None, [1.0] * 8)]
    hits = retrieve.cosine_topk(q.union(spark.createDataFrame(more, f"query_id {schema}")), c.union(spark.createDataFrame([(500, "lone", [1.0] * 8), *more[1:]], f"chunk_id {schema}")), 12, retrieve.SearchSize(4, 200, 3, 7))
    text = plan(hits)
    assert "Generate explode" in text and "CartesianProduct" in text
    same(ordered(hits), want)


@pytest.mark.parametrize("qb", [3, 100])
def test_ids_that_repeat_are_text_or_null(spark, qb):
    v = np.round(RNG.standard_normal((60, 3)), 1)
    v[20:40] = v[0]
    ids = [None if i in (5, 25) else f"c{i % 50}" for i in range(60)]
    c, q = (spark.createDataFrame([(i, "n", [float(x) for x in r]) for i, r in zip(ids, v)], f"{x}_id string, namespace string, embedding array<double>") for x in ("chunk", "query"))
    got = retrieve.cosine_topk(q.where("query_id IS NOT NULL"), c, 7, retrieve.SearchSize(qb, qb, 2, 4))
    unit = retrieve.unit_rows(v)
    away = np.round(1.0 - unit @ unit.T, 6) + 0.0
    want = []
    for x in sorted({i for i in ids if i}):
        near = sorted((away[i, j], ids[j] is not None, ids[j] or "") for i in range(60) if ids[i] == x for j in range(60))[:7]
        want += [(x, i if there else None, d, n + 1) for n, (d, there, i) in enumerate(near)]
    same(ordered(got), want)


def test_packs_hold_each_row_once(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"namespace": ["n"] * 100, "query_id": list(range(100)), "embedding": [[float(i), 1.0] for i in range(100)], "__b": pa.array([3] * 100, pa.int32())})
    monkeypatch.setattr(retrieve, "PACK_BYTES", 500)
    packs = list(retrieve._packer(["namespace"], "__b")(iter([batch.slice(0, 70), batch.slice(70)])))
    rows_of = [retrieve._unpacked(p.column("__rows")[0]) for p in packs]
    assert len({p.column("__pack")[0].as_py() for p in packs}) == len(packs) > 5 and max(r.nbytes for r in rows_of) < 1_000
    assert [x for r in rows_of for x in r.column("query_id").to_pylist()] == list(range(100))


def test_best_looks_only_at_what_is_near(monkeypatch):
    v = RNG.standard_normal((400, 8))
    rows_of = lambda n, name: pa.RecordBatch.from_pydict({name: list(range(n)), "embedding": [list(x) for x in v[:n]]})
    best, sorted_out, first = retrieve._Best(rows_of(30, "query_id"), 4, retrieve.SearchSize(30, 100, 8, 16)), [], retrieve._first
    monkeypatch.setattr(retrieve, "_first", lambda rows, *more: sorted_out.append(len(rows)) or first(rows, *more))
    chunks = retrieve._Chunks(rows_of(400, "chunk_id"), retrieve._matrix)
    best.offer(chunks)
    sorted_out.clear()
    best.offer(chunks)  # the same again: as near as those held, and not before them
    assert sum(sorted_out) <= 2 * 30 * 4
    found = best.hits(pa.scalar("n"))
    assert found.num_rows == 30 * 4 and found.column("chunk_id").to_pylist()[::4] == list(range(30))


def test_vectors_of_several_lengths_are_refused():
    with pytest.raises(ValueError, match="length"):
        retrieve._matrix(pa.RecordBatch.from_pydict({"embedding": [[1.0], [1.0, 2.0, 3.0]]}))
