"""An inverted-file index for similarity search: lists of 8-bit codes around learned centroids.

Centroids are learned by k-means over a sample of bounded size, each round one pass in
which tasks add up their vectors by nearest centroid. Every chunk is then stored once,
under its centroid, as a code of a byte per dimension. A query reads the lists of its
nearest centroids only: their numbers are a filter on the folders of the index, so other
lists are not scanned. Codes give approximate distances in the same grid of blocks as
the exact search; the few best of each query fetch their vectors by id, and the
distances that come out are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardedlake.functions.ordered import top_per_key
from guardedlake.operators.retrieve import SearchSize, block_topk, flat_matrix, ranked, unit_rows
from guardedlake.session import fresh_path, materialise

SAMPLE_PER_LIST = 256
ROUNDS = 3
TILE = 4_096
SLICES = 1 << 20


class VectorIndex(NamedTuple):
    """Where the codes of an index lie, and its centroids: as many as it has lists."""

    path: str
    centroids: np.ndarray


def _nearest_lists(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each unit vector."""
    away = -(vectors @ centroids.T)
    if n == 1:
        return away.argmin(axis=1)[:, None]
    return np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(len(centroids)), (len(vectors), 1))


def _parts(batches: Iterator[pa.RecordBatch], vectors: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            yield part, unit_rows(flat_matrix(part.column(vectors)))


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each list the number and the sum of a task's vectors nearest to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape)
        for _, vectors in _parts(batches, 0):
            nearest = _nearest_lists(vectors, centroids, 1)[:, 0]
            count += np.bincount(nearest, minlength=len(count))
            np.add.at(total, nearest, vectors)
        held = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * total.shape[1], pa.array(total[held].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), sums], ["list", "n", "total"])

    return run


def _table(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(rows[0]) if rows else 0)


def learn_centroids(chunks: DataFrame, lists: int, rounds: int = ROUNDS, sample_per_list: int = SAMPLE_PER_LIST) -> np.ndarray:
    """``lists`` centroids at unit length, learned from about ``lists * sample_per_list`` vectors taken by a hash of their id."""
    vectors = chunks.where("embedding IS NOT NULL").select(F.xxhash64("namespace", "chunk_id").alias("h"), "embedding")
    share = min(1.0, lists * sample_per_list / max(vectors.count(), 1))
    sample = materialise(vectors.where(F.pmod("h", F.lit(SLICES)) < F.lit(share * SLICES)), "index-sample")
    first = sample.dropDuplicates(["h"]).orderBy("h").limit(lists).select("embedding").collect()
    centroids = unit_rows(_table([r[0] for r in first]))
    for _ in range(rounds if len(centroids) else 0):
        parts = sample.select("embedding").mapInArrow(_sums(centroids), "list int, n bigint, total array<double>")
        summed = parts.select("list", F.posexplode("total").alias("place", "x")).groupBy("list", "place").agg(F.sum("x").alias("x"))
        centroids = centroids.copy()
        for r in summed.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("place", "x")))["x"].alias("x")).toLocalIterator():
            centroids[r["list"]] = r["x"]
        centroids = unit_rows(centroids)
    return centroids


def _codes(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each chunk's list, its vector in a byte per dimension, and what a step of those is worth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _parts(batches, 2):
            step = np.abs(vectors).max(axis=1, initial=0) / 127
            code = np.rint(np.divide(vectors, step[:, None], out=np.zeros_like(vectors), where=step[:, None] > 0)).astype(np.int8)
            codes = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]), pa.py_buffer(code.tobytes())])
            nearest = _nearest_lists(vectors, centroids, 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nearest), codes, pa.array(step)], ["namespace", "chunk_id", "list", "code", "step"])

    return run


def _extended(df: DataFrame, keep: list[str], more: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + more)


def _code_schema(chunks: DataFrame) -> T.StructType:
    return _extended(chunks, ["namespace", "chunk_id"], [T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("step", T.DoubleType())])


def build_index(chunks: DataFrame, lists: int, rounds: int = ROUNDS, sample_per_list: int = SAMPLE_PER_LIST) -> VectorIndex:
    """Learn centroids and write the index of ``chunks(chunk_id, namespace, embedding)`` to a new folder."""
    spark = chunks.sparkSession
    centroids = learn_centroids(chunks, lists, rounds, sample_per_list)
    path = fresh_path(spark, "vector-index")
    rows = chunks.where("embedding IS NOT NULL").select("namespace", "chunk_id", "embedding")
    coded = rows.mapInArrow(_codes(centroids), _code_schema(chunks))
    # A list in one file, but for one that is too large for a task.
    coded.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/codes")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    return VectorIndex(path, centroids)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before; its centroids are of bounded number."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(path, _table([r["centroid"] for r in rows]))


def _probed(centroids: np.ndarray, probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _parts(batches, 2) if len(centroids) else ():
            lists = _nearest_lists(vectors, centroids, probes)
            rows = pa.array(np.repeat(np.arange(len(lists)), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns), pa.array(lists.reshape(-1).astype(np.int32))], ["query_id", "namespace", "embedding", "list"])

    return run


def _decoded(rows: pa.RecordBatch) -> np.ndarray:
    """Codes as unit vectors."""
    flat = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(rows.num_rows, -1)
    return unit_rows(flat * rows.column("step").to_numpy(zero_copy_only=False)[:, None])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, queries in _parts(batches, 3):
        chunks = unit_rows(flat_matrix(part.column(4)))
        away = np.round(1.0 - (queries * chunks).sum(axis=1), 6) + 0.0
        away[~queries.any(axis=1) | ~chunks.any(axis=1)] = np.inf
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(away)], ["query_id", "namespace", "chunk_id", "distance"])


def indexed_topk(queries: DataFrame, chunks: DataFrame, index: VectorIndex, k: int = 8, probes: int = 8, refine: int = 2, size: SearchSize = SearchSize()) -> DataFrame:
    """Approximate ``cosine_topk`` by an index of ``chunks``: each query looks into the ``probes`` nearest lists.

    The best ``k * refine`` by their codes are ranked by exact distance, so an answer
    can miss a neighbour, and hold fewer than ``k``, but never holds a wrong distance.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", "namespace", "embedding").where("embedding IS NOT NULL")
    asked = materialise(q.mapInArrow(_probed(index.centroids, probes), _extended(q, ["query_id", "namespace", "embedding"], [T.StructField("list", T.IntegerType())])), "probes")
    lists = [r["list"] for r in asked.select("list").distinct().collect()]  # at most as many as the index has
    codes = spark.read.schema(_code_schema(chunks)).parquet(f"{index.path}/codes").where(F.col("list").isin(lists))
    near = block_topk(asked, codes, ["namespace", "list"], k * refine, size, _decoded)
    near = top_per_key(near, ["query_id", "namespace"], [F.col("distance"), F.col("chunk_id")], k * refine, "__n").drop("__n", "distance")
    of_query = near.join(q.select("query_id", "namespace", F.col("embedding").alias("q")), ["query_id", "namespace"])
    both = of_query.join(chunks.select("namespace", "chunk_id", F.col("embedding").alias("c")), ["namespace", "chunk_id"])
    hits = both.select("query_id", "namespace", "chunk_id", "q", "c").mapInArrow(_exact, _extended(both, ["query_id", "namespace", "chunk_id"], [T.StructField("distance", T.DoubleType())]))
    return ranked(hits, k)
