"""Context retrieval: kind filters, exact cosine top-k, assembly; ``vector_index`` has the approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardedlake.functions.ordered import ordered_text, top_per_key

# What stands between chunks, and the kinds that go into every context.
SEPARATOR = "\n\n---\n\n"
ALWAYS_KINDS = ["overview", "enum"]


def always_included(chunks: DataFrame, namespace: str, kinds: list[str] = ALWAYS_KINDS) -> DataFrame:
    """Chunks of the kinds that go into every context, by kind and title."""
    if not kinds:
        return chunks.where(F.lit(False))
    return (chunks.where((F.col("namespace") == namespace) & F.lower("kind").isin([k.lower() for k in kinds]))
            .orderBy("kind", "title", "chunk_id"))


def without_kinds(chunks: DataFrame, kinds: list[str] = ALWAYS_KINDS) -> DataFrame:
    """Chunks open to similarity search."""
    if not kinds:
        return chunks
    return chunks.where(~F.lower("kind").isin([k.lower() for k in kinds]))


class SearchSize(NamedTuple):
    """Rows of a block, which is what meets another one at a time, and the tile of them that is multiplied at once."""

    query_block: int = 8_192
    chunk_block: int = 32_768
    query_tile: int = 1_024
    chunk_tile: int = 8_192  # with query_tile, a distance matrix of 64 MB


# Blocks that a key may have on either side for its rows to be copied to each of the other side's.
COPIES = 2
# Bytes of rows in a pack, and of query vectors as doubles that a task holds.
PACK_BYTES = 1 << 22
TASK_BYTES = 1 << 24
# Candidates that are gathered before they are sorted.
GATHERED = 1 << 20


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def flat_matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix, straight from their values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    """The vectors of some rows as one matrix at unit length."""
    vectors = rows.column("embedding")
    if len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("all vectors must have the same length")
    return unit_rows(flat_matrix(vectors))


def _bound(dist: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least ``k`` entries don't exceed, and few more do not: the ``k``-th of the minima of many groups of columns."""
    step = max(1, dist.shape[1] // (8 * k))
    groups = dist.shape[1] // step
    least = dist[:, :groups].copy()
    for i in range(1, step):
        np.fmin(least, dist[:, i * groups:(i + 1) * groups], out=least)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1:k]
    # Rows without a distance in so many groups.
    return np.partition(dist, k - 1, axis=1)[:, k - 1:k] if np.isnan(bound).any() else bound


def _distances(q: np.ndarray, c: np.ndarray, q_zero: np.ndarray, c_zero: np.ndarray) -> np.ndarray:
    """A zero vector has no direction; as its distance is undefined it comes last."""
    dist = q @ c.T
    np.subtract(1.0, dist, out=dist)
    if q_zero.any():
        dist[q_zero] = np.inf
    if c_zero.any():
        dist[:, c_zero] = np.inf
    return dist


def _within(dist: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded distance of all that is not beyond its row's bound.

    What is as near as the bound once rounded, is so to a millionth before; only that is rounded.
    """
    at = np.flatnonzero(~(dist > bound + 1e-6))
    if not len(at):
        return at, at, dist[0, :0]
    rows, cols = np.divmod(at, dist.shape[1])
    return rows, cols, np.round(dist.reshape(-1)[at], 6) + 0.0


def _first(rows: np.ndarray, k: int, *by: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` entries of each row, by row and then by the last of ``by`` first, as ``lexsort``."""
    order = np.lexsort((*by, rows))
    held = rows[order]
    return order[np.arange(len(held)) - np.searchsorted(held, held) < k]


def _nearest(q: np.ndarray, c: np.ndarray, cids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, chunk row and distance of the ``k`` nearest, ties by chunk id."""
    dist = _distances(q, c, ~q.any(axis=1), ~c.any(axis=1))
    rows, cols, d = _within(dist, _bound(dist, k) if dist.shape[1] > k else np.full((len(q), 1), np.inf))
    keep = _first(rows, k, cids[cols], d)
    return rows[keep], cols[keep], d[keep]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as values that numpy sorts, and which of them are not null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        kind = column.type
        text, binary = pa.types.is_string(kind) or pa.types.is_large_string(kind), pa.types.is_binary(kind) or pa.types.is_large_binary(kind)
        column = column.fill_null("" if text else b"" if binary else pa.scalar(0).cast(kind))
    return column.to_numpy(zero_copy_only=False), there


class _Chunks:
    """Chunks as they are held against queries: unit vectors, and ids with their order, nulls first as Spark has it."""

    def __init__(self, rows: pa.RecordBatch, matrix: Callable[[pa.RecordBatch], np.ndarray]):
        self.vectors, self.kind = matrix(rows), rows.column("chunk_id").type
        self.zero = ~self.vectors.any(axis=1)
        self.ids, self.there = _ids(rows.column("chunk_id"))
        self.order = np.empty(len(self.ids), dtype=np.int64)
        self.order[np.lexsort((self.ids, self.there))] = np.arange(len(self.ids))


class _Best:
    """The ``k`` nearest so far of some queries.

    Once a query has ``k``, only what is as near as the last of them is looked at.
    """

    # Cosine distances end at 2: what stands for one that is undefined, for one that is not a number, and for none yet.
    UNDEFINED, NAN, NONE = 3.0, 4.0, 5.0

    def __init__(self, rows: pa.RecordBatch, k: int, size: SearchSize):
        self.vectors, self.k, self.size = _matrix(rows), k, size
        self.zero = ~self.vectors.any(axis=1)
        self.query_ids = rows.column("query_id").take(pa.array(np.arange(rows.num_rows)))  # a copy, so that the rows can go
        self.d = np.full((rows.num_rows, k), self.NONE)
        self.ids = self.there = self.kind = None

    def offer(self, chunks: _Chunks) -> None:
        if self.ids is None:
            self.ids, self.there, self.kind = np.full(self.d.shape, chunks.ids[0], dtype=chunks.ids.dtype), np.zeros(self.d.shape, dtype=bool), chunks.kind
        gathered, n = [], 0
        for i in range(0, len(self.vectors), self.size.query_tile):
            mine = slice(i, i + self.size.query_tile)
            for j in range(0, len(chunks.vectors), self.size.chunk_tile):
                other = slice(j, j + self.size.chunk_tile)
                q, c, last = self.vectors[mine], chunks.vectors[other], self.d[mine, -1:]
                if last.max() == self.NONE:
                    rows, cols, d = _nearest(q, c, chunks.order[other], self.k)
                else:
                    rows, cols, d = _within(_distances(q, c, self.zero[mine], chunks.zero[other]), np.where(last >= self.UNDEFINED, np.inf, last))
                if len(rows):
                    gathered.append((rows + i, cols + j, d))
                    n += len(rows)
                if n >= GATHERED:
                    self._add(chunks, gathered)
                    gathered, n = [], 0
        self._add(chunks, gathered)

    def _add(self, chunks: _Chunks, gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not gathered:
            return
        rows, cols, d = (np.concatenate(x) for x in zip(*gathered))
        d = np.where(np.isnan(d), self.NAN, np.minimum(d, self.UNDEFINED))
        # As many chunks may be as near as the last one held; only those that come before it by id are sorted.
        last, ids, there = self.d[rows, -1], chunks.ids[cols], chunks.there[cols]
        tie = np.flatnonzero(d == last)
        before = d < last
        before[tie] = (there[tie] < self.there[rows[tie], -1]) | ((there[tie] == self.there[rows[tie], -1]) & (ids[tie] < self.ids[rows[tie], -1]))
        rows, d, ids, there = rows[before], d[before], ids[before], there[before]
        touched, rows = np.unique(rows, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), rows])
        d, ids, there = (np.concatenate([held[touched].reshape(-1), new]) for held, new in ((self.d, d), (self.ids, ids), (self.there, there)))
        keep = _first(rows, self.k, ids, there, d)  # a touched row has ``k`` entries at least
        self.d[touched], self.ids[touched], self.there[touched] = (x[keep].reshape(-1, self.k) for x in (d, ids, there))

    def hits(self, namespace: pa.Scalar) -> pa.RecordBatch:
        rows, cols = np.nonzero(self.d < self.NONE)
        d, ids, there = self.d[rows, cols], self.ids[rows, cols], self.there[rows, cols]
        d = np.where(d == self.UNDEFINED, np.inf, np.where(d == self.NAN, np.nan, d))
        return pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(rows)), pa.repeat(namespace, len(rows)), pa.array(ids, self.kind, mask=~there), pa.array(d)], HIT)


HIT = ["query_id", "namespace", "chunk_id", "distance"]


def _hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("namespace", chunks.schema["namespace"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType())])


def ranked(hits: DataFrame, k: int) -> DataFrame:
    d = F.col("distance")
    best = top_per_key(hits, ["query_id", "namespace"], [d.asc(), F.col("chunk_id").asc()], k)
    return best.withColumn("distance", F.when(d == float("inf"), None).otherwise(d))


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = 8, size: SearchSize = SearchSize()) -> DataFrame:
    """The ``k`` chunks of a query's namespace that are nearest by cosine distance.

    ``queries(query_id, namespace, embedding)``, ``chunks(chunk_id, namespace,
    embedding)``; gives ``(query_id, namespace, chunk_id, distance, rank)``, ties by id.
    A chunk is known by its namespace and id together. Rows without a vector take no
    part. Queries and chunks meet in blocks, whatever their number (``block_topk``);
    only the ``k`` best per query leave a task, never the pairs.
    """
    q = queries.select("query_id", "namespace", "embedding").where("embedding IS NOT NULL")
    c = chunks.select("chunk_id", "namespace", "embedding").where("embedding IS NOT NULL")
    return ranked(block_topk(q, c, ["namespace"], k, size), k)


def _one_batch(rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns], schema=rows.schema)


def _packer(keys: list[str], block: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's rows in one pack, or in several that are of a few MB: its keys, a number and the rows in bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            rows = batch.drop_columns([*keys, block])
            step = max(1, PACK_BYTES * batch.num_rows // max(rows.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.slice(at, step))
                number = pa.array([(batch.column(block)[0].as_py() << 32) + n], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(0, 1) for x in keys), number, pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*keys, "__pack", "__rows"])
                n += 1

    return run


def _packs(rows: DataFrame, keys: list[str], block: str, parts: int, side: str) -> DataFrame:
    schema = T.StructType([*(rows.schema[x] for x in keys), T.StructField("__pack", T.LongType()), T.StructField("__rows", T.BinaryType())])
    packs = rows.groupBy(*keys, block).applyInArrow(_packer(keys, block), schema)
    return packs.withColumnsRenamed({"__pack": f"__{side}", "__rows": f"__{side}_rows"}).repartition(parts)


def _unpacked(rows: pa.Scalar) -> pa.RecordBatch:
    return _one_batch(pa.ipc.open_stream(rows.as_buffer()).read_all())


def _streamed(keys: list[str], k: int, size: SearchSize, matrix: Callable[[pa.RecordBatch], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best of each pack of queries over all packs of chunks that a task has it meet.

    Rows of a pack come with the first pair that it is in, and are null in the others.
    """
    of = [f"__{side}_{x}" for side in "qc" for x in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen, chunks = {}, None, None
        for batch in batches:
            q_rows, c_rows, namespaces = batch.column("__q_rows"), batch.column("__c_rows"), batch.column(of[0])
            names = list(zip(*(batch.column(x).to_pylist() for x in of)))
            for i, (name, q, c) in enumerate(zip(names, batch.column("__q").to_pylist(), batch.column("__c").to_pylist())):
                q, c = (name[:len(keys)], q), (name[len(keys):], c)
                if q_rows[i].is_valid:
                    best[q] = namespaces.take(pa.array([i]))[0], _Best(_unpacked(q_rows[i]), k, size)
                if c_rows[i].is_valid:
                    seen, chunks = c, _Chunks(_unpacked(c_rows[i]), matrix)
                if q[0] == c[0]:
                    if seen != c:
                        raise RuntimeError("a pack of chunks came before its rows")
                    best[q][1].offer(chunks)
        for namespace, found in best.values():
            yield found.hits(namespace)

    return run


def block_topk(q: DataFrame, c: DataFrame, keys: list[str], k: int, size: SearchSize, matrix: Callable[[pa.RecordBatch], np.ndarray] = _matrix) -> DataFrame:
    """Top-k hits of queries and chunks that share ``keys``, by a grid of blocks.

    Each key is given as many query and chunk blocks as its counts ask for, and rows are
    dealt to them by a hash of their id. ``keys`` begin with the namespace; ``matrix``
    makes unit vectors of chunks.

    Of a key with few blocks each pair is one group of bounded size, for which rows are
    copied ``COPIES`` times at most. In a larger grid copies would grow with the square
    of the rows; there each row is written once, in a pack with others of its block, and
    a task reads all packs of chunks, one at a time, past the packs of queries it holds.
    """
    nq = q.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size.query_block).cast("int").alias("__qn"), F.sum(F.size("embedding").cast("bigint") * 8).alias("__bytes"))
    nc = c.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size.chunk_block).cast("int").alias("__cn"))
    grid = nq.join(nc, keys)
    few = (F.col("__qn") <= COPIES) & (F.col("__cn") <= COPIES)
    n = grid.agg(F.count_if(few).alias("few"), *(F.coalesce(F.sum(F.when(~few, F.col(x))), F.lit(0)).alias(y) for x, y in (("__qn", "q"), ("__cn", "c"), ("__bytes", "bytes")))).first()

    def dealt(df: DataFrame, of: DataFrame, id_col: str, own: str, own_out: str) -> DataFrame:
        return df.join(of.drop("__bytes"), keys).withColumn(own_out, F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))

    def copied() -> DataFrame:
        def to_each(df: DataFrame, other: str, other_out: str) -> DataFrame:
            return df.withColumn(other_out, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("__qn", "__cn")

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.Table.from_arrays([a["query_id"].slice(0, 0), a["namespace"].slice(0, 0), b["chunk_id"].slice(0, 0), pa.array([], pa.float64())], HIT)
            best = _Best(_one_batch(a), k, size)
            best.offer(_Chunks(_one_batch(b), matrix))
            return pa.Table.from_batches([best.hits(a["namespace"][0])])

        of, block = grid.where(few), [*keys, "__qb", "__cb"]
        left = to_each(dealt(q, of, "query_id", "__qn", "__qb"), "__cn", "__cb")
        right = to_each(dealt(c, of, "chunk_id", "__cn", "__cb"), "__qn", "__qb")
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(pair, _hit_schema(q, c))

    def streamed() -> DataFrame:
        # Chunks are read as a whole by each task, unless there are too few queries for as many tasks as there is room for.
        room, of = 4 * q.sparkSession.sparkContext.defaultParallelism, grid.where(~few)
        tasks = min(n["q"], max(room, -(-n["bytes"] // TASK_BYTES)))
        left = _packs(dealt(c, of, "chunk_id", "__cn", "__b").drop("__qn", "__cn"), keys, "__b", min(n["c"], -(-room // tasks)), "c")
        right = _packs(dealt(q, of, "query_id", "__qn", "__b").drop("__qn", "__cn"), keys, "__b", tasks, "q")
        # The side on the right is held, the other goes by; neither is shuffled for it. Pairs come in the
        # order of the left side's rows and for each of them in that of the right side's, so that the rows of
        # a pack can go to Python once: with the first pack of the other side in the task, whatever its keys.
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        left, right = (df.select(*(F.col(x).alias(f"__{side}_{x}") for x in keys), f"__{side}", f"__{side}_rows", first.alias(f"__{side}_first")) for df, side in ((left, "c"), (right, "q")))
        alike = reduce(Column.__and__, (F.col(f"__c_{x}") == F.col(f"__q_{x}") for x in keys))
        pairs = left.hint("shuffle_replicate_nl").join(right, alike | F.col("__c_first") | F.col("__q_first"))
        rows = (F.when(F.col(f"__{other}_first"), F.col(f"__{side}_rows")).alias(f"__{side}_rows") for side, other in ("qc", "cq"))
        sent = pairs.select(*(f"__{side}_{x}" for side in "qc" for x in keys), "__q", "__c", *rows)
        return sent.mapInArrow(_streamed(keys, k, size, matrix), _hit_schema(q, c))

    return streamed() if not n["few"] and n["q"] else copied() if not n["q"] else copied().unionByName(streamed())


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found."""
    keys = ["query_id", "namespace", "chunk_id"]
    both = exact.join(found.select(*keys, F.lit(1).alias("__hit")), keys, "left").agg(F.count("__hit").alias("n_found"), F.count(F.lit(1)).alias("n_exact"))
    return both.withColumn("recall", F.try_divide("n_found", "n_exact"))


def assemble(hits: DataFrame, chunks: DataFrame, queries: DataFrame, kinds: list[str] = ALWAYS_KINDS) -> DataFrame:
    """``(query_id, context)``: always-included chunks, then the hits by rank, each once.

    The fixed part is joined to one text per namespace first and then looked up, so
    it is not repeated per query before it has to be.
    """
    fixed = chunks.where(F.lower("kind").isin([k.lower() for k in kinds]))
    by_name = Window.partitionBy("namespace").orderBy("kind", "title", "chunk_id")
    head = ordered_text(fixed.withColumn("o", F.row_number().over(by_name)), ["namespace"], "o", "content", "head", SEPARATOR)
    extra = hits.join(chunks.select("namespace", "chunk_id", "kind", "content"), ["namespace", "chunk_id"])
    extra = extra.where(~F.lower("kind").isin([k.lower() for k in kinds]))
    # A query has k hits, so one list per query is bounded.
    listed = F.array_sort(F.collect_list(F.struct("rank", "content")))
    tail = extra.groupBy("query_id", "namespace").agg(F.array_join(F.transform(listed, lambda e: e["content"]), SEPARATOR).alias("tail"))
    text = F.concat_ws(SEPARATOR, F.col("head"), F.col("tail"))
    return (queries.select("query_id", "namespace").join(head, "namespace", "left").join(tail, ["query_id", "namespace"], "left")
            .select("query_id", F.nullif(text, F.lit("")).alias("context")))


class RetrievalError(RuntimeError):
    """Raised once, with a count, when contexts are missing and that is an error."""

    code = "SCHEMA_RETRIEVAL_ERROR"


def with_fallback(contexts: DataFrame, full_text: str | Column, fail_on_error: bool = False) -> DataFrame:
    """Put the whole document where no context was found, or raise."""
    if fail_on_error:
        missing = contexts.where("context IS NULL OR context = ''").count()
        if missing:
            raise RetrievalError(f"RAG retrieval failed: no context for {missing} queries")
        return contexts
    full = F.lit(full_text) if isinstance(full_text, str) else full_text
    return contexts.withColumn("context", F.coalesce(F.nullif("context", F.lit("")), full))


def fill_prompt(template: str, context: Column | str) -> Column:
    """The template with the context put where it asks for it."""
    return F.replace(F.lit(template), F.lit("{schemaContext}"), F.col(context) if isinstance(context, str) else context)
