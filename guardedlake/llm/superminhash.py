"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its distinct shingles of some words (five, if nothing else is
said; A to Z lower-cased); with fewer words it is the one sequence of them. Each element of a set gives one value to each
slot of the signature, in an order of its own, with ranks that only grow; a document
is done when no slot can fall any more, which for long texts is after a rank or two.

Documents with equal sets are one class from the start and stand behind their smallest
id, so a group of copies, however large, is one node. Classes that share a band are
candidates: each is compared with the smallest of its bucket. Where a bucket then holds
several components, those of its documents that have no link to the smallest are
compared with the others where both differ from the smallest in the same elements to a
degree without which no link can be (``_rest``).
Thus every two candidates end in one component or are shown to have no link, without
all pairs of a group. Links are confirmed on whole sets.

Banding alone is not certain: a pair at the limit of 0.8 shares none of 32 bands of
four with a chance of 5 in 100 million. Set elements are 64-bit hashes.

Defined results: a null or empty text, or one without words, has an empty set, is
linked with nothing and is its own component. Rows that share an id are one node of
the graph and all come out. A null id comes out with a null component and is linked
with nothing; it is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardedlake.llm.components import components
from guardedlake.llm.sieve import may_match
from guardedlake.llm.texts import carried, unpacked
from guardedlake.llm.wordhash import U, Hasher, grams, mix, texts_of, whole
from guardedlake.session import materialise

SLOTS, ROWS = 128, 4
SHINGLE = 5
PERCENT = 80
BLOCK = 1 << 17

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SKETCH = "doc_id long, n long, set_a long, set_b long, bands array<long>"


def shingles(hasher: Hasher, text: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    hashes = hasher.words(text)[2]
    return np.unique(grams(hashes, size) if len(hashes) >= size else whole(hashes))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A SuperMinHash signature for each set: rank plus fraction, smallest per slot."""
    out = np.full((len(sets), slots), np.inf)
    flat = out.reshape(-1)
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for rank in range(slots):
        if not len(items):
            break
        x = mix(items + U((2 * rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        y = mix(items + U((2 * rank + 2) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = rank + (y % U(slots - rank)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(items))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, rank]
        np.minimum.at(flat, owner * slots + slot, (x >> U(11)) * 2.0**-53 + rank)
        going = out.max(axis=1) >= rank + 1
        stay = going[owner]
        items, owner = items[stay], owner[stay]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.int16), (len(items), 1))
            rows = np.arange(len(items))
            order[rows, pick[stay]] = 0
        else:
            order = order[stay]
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each signature; the band's number is part of it."""
    bits = signature.view(U).reshape(len(signature), -1, rows)
    keys = np.broadcast_to(mix(np.arange(1, bits.shape[1] + 1, dtype=U)), bits.shape[:2])
    for r in range(rows):
        keys = mix(keys * U(0xC2B2AE3D27D4EB4F) + bits[:, :, r])
    return keys.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets of some documents at a time."""
    hasher = Hasher()
    for batch in batches:
        ids, block, held, first = batch.column(0), [], 0, 0
        for i, text in enumerate(texts_of(batch.column(1))):
            block.append(shingles(hasher, text, size))
            held += len(block[-1])
            if held >= BLOCK or i + 1 == batch.num_rows:
                yield ids.slice(first, len(block)), block
                block, held, first = [], 0, i + 1


def _sketch(size: int) -> Task:
    return lambda batches: (_rows(ids, block) for ids, block in _blocks(batches, size))


def _rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    keys = band_keys(signatures(sets))
    n = np.array([len(s) for s in sets], dtype=np.int64)
    whole_a = np.array([int((mix(s)).sum(dtype=U)) for s in sets], dtype=U)
    whole_b = np.array([int(np.bitwise_xor.reduce(mix(s * U(0xD1342543DE82EF95) + U(1)))) if len(s) else 0 for s in sets], dtype=U)
    empty = n == 0
    lengths = np.where(empty, 0, keys.shape[1])
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(keys[~empty].reshape(-1)))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(whole_a.view(np.int64)), pa.array(whole_b.view(np.int64)), bands], ["doc_id", "n", "set_a", "set_b", "bands"])


def _sets(size: int) -> Task:
    def rows(ids: pa.Array, block: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum([len(s) for s in block])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(block).view(np.int64)))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), lists], ["doc_id", "items"])

    return lambda batches: (rows(ids, block) for ids, block in _blocks(batches, size))


def _joined(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the whole sets of both."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("of_b")), "b")
    return with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("of_a")), "a")


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = _joined(sets, pairs).withColumn("common", common)
    return both.where(100 * F.col("common") >= PERCENT * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = materialise(source.mapInArrow(_sketch(size), SKETCH), "minhash-sketch")
    full = sketch.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    sets = ["n", "set_a", "set_b"]
    classes = materialise(full.groupBy(*sets).agg(F.min("doc_id").alias("head"), F.count("*").alias("members")), "minhash-classes")
    heads = full.join(classes, sets).where(F.col("doc_id") == F.col("head")).dropDuplicates(["doc_id", *sets])
    keyed = heads.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.count("*").alias("held")).where("held > 1").select("key", F.col("pivot.doc_id").alias("a"), F.col("pivot.n").alias("n_a"))
    members = materialise(keyed.join(buckets, "key"), "minhash-members")
    pairs = members.where((F.col("doc_id") != F.col("a")) & _similar_size("n", "n_a")).select("a", F.col("doc_id").alias("b")).distinct()
    wanted = members.select("doc_id").distinct()
    sets_of = materialise(source.where(F.col("doc_id").isNotNull()).join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, items array<long>"), "minhash-sets")
    links = materialise(confirmed(sets_of, pairs), "minhash-links")
    # Ids that several sets share tie those sets together.
    own = full.join(classes, sets).where(F.col("doc_id") != F.col("head")).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    split_ids = full.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x <> y").select("doc_id")
    ties = own.join(split_ids, own["b"] == split_ids["doc_id"], "left_semi")
    grouped = components(spark, links.unionByName(ties))
    late = materialise(confirmed(sets_of, _rest(sets_of, members, grouped, links)), "minhash-late")
    if not late.isEmpty():
        grouped = components(spark, links.unionByName(ties).unionByName(late))
    by_class = classes.join(grouped.withColumnRenamed("node", "head"), "head", "left").select(*sets, F.least(F.coalesce("component", "head"), "head").alias("component_id"))
    placed = sketch.join(by_class, sets, "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _similar_size(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _rest(sets: DataFrame, members: DataFrame, grouped: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs in different components, of buckets that hold several, which may be links and have not been compared.

    At least one of such a pair, y, has no link to the bucket's smallest, p. With
    x = p - F + E and y = p - F' + E', J(x, y) reaches 0.8 only if they share
    (0.8 |E| + 0.8 |E'| + |F| + |F'| - 0.2 |p|) / 1.8 of these differences from p. For y
    without a link to p that is more than (0.8 |E| + |F|) / 1.8, and if x has none
    either, more than (0.8 |E'| + |F'|) / 1.8 too. So x and y meet in so many of their
    differences, the rarest first, that fewer than they have to share are left over;
    what comes after the place where they meet has to be enough for the rest.
    """
    placed = members.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    linked = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    rows = placed.where(F.col("doc_id") != F.col("a")).join(several, "key", "left_semi").select("a", F.col("doc_id").alias("b"), "component").distinct()
    stars = materialise(rows.join(linked, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select("a", "b", "component", F.col("_b").isNotNull().alias("linked")), "minhash-mixed")
    mixed = stars.groupBy("a").agg(F.min("linked").alias("all_linked"), F.min("component").alias("low"), F.max("component").alias("high")).where("NOT all_linked AND low <> high").select("a")
    sizes = [F.size("more").alias("e"), F.size("less").alias("f"), F.size("of_a").alias("p")]
    apart = _joined(sets, stars.join(mixed, "a", "left_semi")).select("a", "b", "component", "linked", "of_a", F.array_except("of_b", "of_a").alias("more"), F.array_except("of_a", "of_b").alias("less"))
    tagged = F.concat(F.transform("more", lambda t: F.struct(F.lit(True).alias("more"), t.alias("t"))), F.transform("less", lambda t: F.struct(F.lit(False).alias("more"), t.alias("t"))))
    each = apart.select("a", "b", "component", "linked", *sizes, F.explode(tagged).alias("d")).select("a", "b", "component", "linked", "e", "f", "p", "d.more", "d.t")
    each = materialise(each, "minhash-apart")
    q, loose, tied = PERCENT, ~F.col("linked"), F.col("linked")
    weight = q * F.col("e") + 100 * F.col("f")
    most = F.floor(weight / (100 + q)) + 1
    some = F.greatest(F.ceil((weight - (100 - q) * F.col("p")) / (100 + q)), F.lit(1))
    among = _meeting(each.where(loose), [(loose, most), (loose, most)]).where("x < y")
    return among.union(_meeting(each, [(tied, most), (loose, some)])).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _meeting(each: DataFrame, sides: list[tuple[Column, Column]]) -> DataFrame:
    """x, y: pairs of different components, the two sides by a condition and how many differences have to be shared at least, that may share enough of them."""
    token = ["a", "more", "t"]
    usual = each.groupBy(*token).agg(F.count("*").alias("usual")).where("usual > 1")
    ranked = each.join(usual, token, "left").withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("usual", F.lit(1)), "more", "t")))
    left = F.col("e") + F.col("f") - F.col("place")
    x, y = (ranked.where(kind & (left + 1 >= least) & F.col("usual").isNotNull()).select(*token, F.col("b").alias(name), F.col("component").alias(f"of_{name}"), "p", left.alias(f"left_{name}"), (PERCENT * F.col("e") + 100 * F.col("f")).alias(f"weight_{name}"))
            for name, (kind, least) in zip("xy", sides, strict=True))
    enough = (100 + PERCENT) * (1 + F.least("left_x", "left_y")) >= F.col("weight_x") + F.col("weight_y") - (100 - PERCENT) * F.col("p")
    return x.join(y.drop("p"), token).where((F.col("of_x") != F.col("of_y")) & enough).select("x", "y")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, in the columns of ``docs``; of rows that share an id, all stay.

    The ids that go are written first: only rows that a bit table of them holds are
    joined, the others stay where they are.
    """
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    gone = materialise(gone, "minhash-gone")
    keyed = docs.select(carried(docs), F.col("doc_id").cast("bigint").alias("_key"))
    held = may_match(gone, ["_gone"])("_key")
    judged = keyed.where(held).join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    return keyed.where(~held).union(judged).select(*unpacked(docs, {}))
