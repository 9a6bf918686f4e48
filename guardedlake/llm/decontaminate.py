"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into sections of a bounded number of words. A section's seeds are its
rare 3-grams: all but the commonest few, as counted over the passages of all documents.
How many can be left out is not a choice but a bound. A copy that still scores
``LEAKED`` has lost at most (1 - LEAKED) of the best score; a changed or missing word
costs at least as many points as it breaks 3-grams, and so do words put in, if the
document is read in the three patterns of ``PATTERNS``, which skip one word. So some
3-grams of any copy are left (``survivors``), and the commonest ones may be dropped as
long as enough of those that must be left are among the others. Which grams an edit
leaves, or how rare these are, makes no difference.

A passage is what a document holds within reach of its seeds; seeds join passages to
sections, and those with enough seeds in common (two, or one where a section of fewer
than sixteen words can't be sure of more) are aligned word by word, so that edited and
shortened copies score too. What is aligned is the passage as far as a copy of that
score can reach, and no more. An item's score in a document is the best local alignment
of each section, over that of the item with itself. The bound is on a section: an item
of several sections whose copy keeps less than ``LEAKED`` of one of them may be scored
without that one. Sections of ten words or fewer have no bound; they need one seed.

To find seeds, tasks hold bit tables of fixed size; what they let through by chance is
removed by the join on the seed itself. The pairs to be aligned are written as keys and
met with those passages that a bit table of these keys holds, of which only what is
aligned goes on; other passages stay where they were written. A passage with a single seed, as very common
grams make them, is not moved unless some section needs no more than that. A seed of a
passage that very many documents
share makes many rows of one key on one side only, which Spark splits or avoids by
sending the measured small side. Texts are not shuffled, only passages around seeds.

Defined results: words are runs between blanks and ASCII signs, A to Z folded. Null or
empty texts, items of fewer than three words, and empty tables give no pairs. Very long
texts are hashed in pieces and read whole. Rows that repeat an id and a text give one
pair; rows with a null id are told apart by their text and give pairs with a null id.
Items with a null id are left out; items that repeat an id count each by itself, the
best score stays. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardedlake.llm.sieve import may_match
from guardedlake.llm.texts import carried, unpacked
from guardedlake.llm.wordhash import U, Hasher, spaced, texts_of
from guardedlake.session import materialise

GRAM = 3
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # how the three words of a seed may stand in a document
SECTION = 128
MIN_SEEDS = 2
TABLE_BITS = 24
MATCH, MISMATCH, GAP = 2, -1, -1
LEAKED = 0.6
LOST = MATCH * (1 - LEAKED)  # points a word that a copy can have lost: as many 3-grams, as many words put in
REACH = int(SECTION * (1 + LOST)) + 16
ALIGNED = 64

SEEDS = "item_id bigint, copy bigint, section int, place bigint, last bigint, times bigint, gram bigint"

SECTIONS = "item_id bigint, copy bigint, section int, words array<bigint>"


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(plain=True)
    for batch in batches:
        rows = []
        for item, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            words = hasher.words(text)[2].view(np.int64)
            parts = max(1, -(-len(words) // SECTION))
            rows += [(item, copy, i, part.tolist()) for i, part in enumerate(np.array_split(words, parts)) if len(part) >= GRAM]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item_id", "copy", "section", "words"])


def survivors(n: int) -> int:
    """How many 3-grams of a section of ``n`` words any copy holds that scores ``LEAKED``; 0: perhaps none."""
    return max(0, n - GRAM + 1 - int(LOST * n + 1e-9))


def needed(n: int) -> int:
    """How many seeds a passage has to share with a section of ``n`` words."""
    return MIN_SEEDS if survivors(n) >= MIN_SEEDS else 1


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct gram of a section: where it stands first and last, and how often."""
    for batch in batches:
        for item, copy, section, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            all_of = spaced(np.array(words, dtype=np.int64).view(U), PATTERNS[0])
            found, first, times = np.unique(all_of, return_index=True, return_counts=True)
            last = len(all_of) - 1 - np.unique(all_of[::-1], return_index=True)[1]
            n = len(found)
            columns = [pa.array([item] * n, pa.int64()), pa.array([copy] * n, pa.int64()), pa.array([section] * n, pa.int32()), *map(pa.array, (first, last, times, found.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "copy", "section", "place", "last", "times", "gram"])


def rare(grams: DataFrame, hits: DataFrame, needs: DataFrame) -> DataFrame:
    """The grams of each section but its commonest, as far as a copy is sure to hold others.

    ``needs``: item_id, copy, section, need, spare (grams that can be left out).
    """
    counts = hits.groupBy("gram").agg(F.count("*").alias("places"))
    common_first = Window.partitionBy("item_id", "copy", "section").orderBy(F.col("places").desc(), "gram")
    known = grams.join(counts, "gram", "left").withColumn("places", F.coalesce("places", F.lit(0))).join(needs, ["item_id", "copy", "section"])
    return known.withColumn("dropped", F.sum("times").over(common_first)).where(F.col("dropped") > F.col("spare")).select(*grams.columns, "need")


def _table(grams_of: DataFrame) -> np.ndarray:
    """A bit table of the grams, of fixed size however many there are."""
    shift = 64 - TABLE_BITS
    words = grams_of.select(F.shiftrightunsigned("gram", shift).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=U)
    for r in words.toLocalIterator():
        table[r["word"]] = U(r["bits"] & (1 << 64) - 1)
    return table


def _held(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = found >> U(64 - TABLE_BITS)
    return (table[(slot >> U(6)).astype(np.int64)] >> (slot & U(63)) & U(1)).astype(bool)


def _hits(words: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and gram of all word triples of the patterns that the table holds, by place."""
    at, found = [], []
    for pattern in PATTERNS:
        of = spaced(words, pattern)
        here = np.flatnonzero(_held(of, table))
        at.append(here)
        found.append(of[here])
    places = np.concatenate(at)
    order = np.argsort(places, kind="stable")
    return places[order], np.concatenate(found)[order]


def _passages(docs: DataFrame, table: np.ndarray, alone: np.ndarray) -> DataFrame:
    """The words within reach of seeds: _id, _hash, first (place of the first word), words, hits (place and gram).

    ``alone``: the table of grams that are enough by themselves; others have to be several in a passage.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(plain=True)
        table, alone = shared.value
        hit = pa.struct([("at", pa.int64()), ("gram", pa.int64())])
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                words = hasher.words(text)[2]
                at, found = _hits(words, table)
                if not len(at):
                    continue
                edges = np.concatenate(([0], np.flatnonzero(np.diff(at) > REACH) + 1, [len(at)]))
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    group, of = at[low:high], found[low:high]
                    if (high - low < MIN_SEEDS or (of == of[0]).all()) and not _held(of, alone).any():
                        continue
                    first, last = max(0, int(group[0]) - REACH), int(group[-1]) + GRAM + 1 + REACH
                    rows.append((doc, key, first, words[first:last].view(np.int64), pa.StructArray.from_arrays([pa.array(group), pa.array(of.view(np.int64))], fields=list(hit))))
            if rows:
                ids, keys, firsts, lists, hits = zip(*rows, strict=True)
                word_lists = pa.ListArray.from_arrays(_ends(lists), pa.array(np.concatenate(lists)))
                hit_lists = pa.ListArray.from_arrays(_ends(hits), pa.concat_arrays(hits))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.int64()), word_lists, hit_lists], ["_id", "_hash", "first", "words", "hits"])

    return docs.select("_id", "_hash", "_text").mapInArrow(run, "_id bigint, _hash bigint, first bigint, words array<bigint>, hits array<struct<at:bigint,gram:bigint>>")


def _ends(lists: tuple) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each item with its passage, all pairs at once: one step per item word."""
    rows, columns = max(map(len, items)), max(map(len, passages))
    item = np.zeros((len(items), rows), dtype=np.int64)
    passage = np.zeros((len(items), columns), dtype=np.int64)
    in_item, in_passage = np.zeros(item.shape, dtype=bool), np.zeros(passage.shape, dtype=bool)
    for k, (a, b) in enumerate(zip(items, passages, strict=True)):
        item[k, :len(a)], passage[k, :len(b)] = a, b
        in_item[k, :len(a)], in_passage[k, :len(b)] = True, True
    slope = -GAP * np.arange(columns, dtype=np.int32)
    row = np.zeros((len(items), columns), dtype=np.int32)
    best = np.zeros(len(items), dtype=np.int32)
    for i in range(rows):
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        same = (passage == item[:, i:i + 1]) & in_passage & in_item[:, i:i + 1]
        start = np.maximum(np.maximum(diagonal + np.where(same, MATCH, MISMATCH), row + GAP), 0)
        new = np.maximum.accumulate(start + slope, axis=1) - slope  # gaps in the item: the best start to the left, less its distance
        row = np.where(in_item[:, i:i + 1], new, row).astype(np.int32)
        best = np.maximum(best, np.where(in_passage, row, 0).max(axis=1))
    return best


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ALIGNED):
            part = batch.slice(at, ALIGNED)
            items, passages = ([x.values.to_numpy(zero_copy_only=False) for x in part.column(c)] for c in (5, 6))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(smith_waterman(items, passages).astype(np.int64))], ["_id", "_hash", "item_id", "copy", "section", "score"])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _hash (of the text), item_id, score (0 to 1): the pairs that score high enough."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_hash"), F.col(text).cast("string").alias("_text"))
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("copy"), F.col("text").cast("string")).distinct()
    section = ["item_id", "copy", "section"]
    sections = materialise(items.mapInArrow(_sections, SECTIONS), "leak-sections")
    all_grams = materialise(sections.mapInArrow(_gram_rows, SEEDS), "leak-grams")
    survive = F.get(F.array(*[F.lit(survivors(n)) for n in range(SECTION + 1)]), F.size("words"))
    need = F.get(F.array(*[F.lit(needed(n)) for n in range(SECTION + 1)]), F.size("words"))
    needs = sections.select(*section, need.alias("need"), F.greatest(survive - need, F.lit(0)).alias("spare"))
    alone = all_grams.join(needs, section).where(F.col("times") >= F.col("need"))
    passages = materialise(_passages(source, _table(all_grams.select("gram").distinct()), _table(alone.select("gram").distinct())), "leak-passages")
    hits = passages.select("_id", "_hash", "first", F.explode("hits").alias("h")).select("_id", "_hash", "first", "h.at", "h.gram")
    seeds = materialise(rare(all_grams, hits, needs), "leak-seeds")
    joined = hits.join(seeds, "gram").withColumns({"start": F.col("at") - F.col("place"), "least": F.col("at") - F.col("last")})
    key = ["_id", "_hash", "first", *section]
    # Hits of one copy start within two sections' length; a bin and its next are taken together, so no copy is split.
    width = 2 * SECTION
    binned = joined.withColumn("bin", F.explode(F.array(F.floor(F.col("start") / width), F.floor(F.col("start") / width) - 1)))
    by_gram = binned.groupBy(*key, "bin", "gram").agg(F.max("times").alias("times"), F.max("need").alias("need"), F.min("least").alias("low"), F.max("start").alias("high"))
    found = by_gram.groupBy(*key, "bin").agg(F.sum("times").alias("seeds"), F.max("need").alias("need"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("seeds") >= F.col("need"))
    # Written first, as they are read twice: to tell which passages hold a candidate, and to join those alone.
    found = found.drop("bin", "seeds", "need").join(sections.select(*section, F.size("words").alias("n")), section)
    found = materialise(found, "leak-candidates")
    wanted = passages.where(may_match(found, ["_id", "_hash", "first"])("_id", "_hash", "first"))
    both = wanted.select("_id", "_hash", "first", F.col("words").alias("passage")).withColumnsRenamed({"_id": "_p_id", "_hash": "_p_hash", "first": "_p_first"}).join(
        found, F.col("_id").eqNullSafe(F.col("_p_id")) & (F.col("_hash") == F.col("_p_hash")) & (F.col("first") == F.col("_p_first")))
    more = F.ceil(F.col("n") * LOST) + 4
    low = F.greatest(F.col("low") - F.col("first") - more, F.lit(0))
    high = F.col("high") - F.col("first") + F.col("n") + more
    window = F.slice("passage", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    windows = both.select("_id", "_hash", *section, window.alias("window")).join(sections.withColumnRenamed("words", "item_words"), section)
    aligned = windows.select("_id", "_hash", *section, "item_words", "window").mapInArrow(_align, "_id bigint, _hash bigint, item_id bigint, copy bigint, section int, score bigint")
    best = aligned.groupBy("_id", "_hash", *section).agg(F.max("score").alias("score"))
    own = sections.groupBy("item_id", "copy").agg(F.sum(MATCH * F.size("words")).alias("own"))
    scored = best.groupBy("_id", "_hash", "item_id", "copy").agg(F.sum("score").alias("score")).join(own, ["item_id", "copy"])
    share = F.col("score") / F.col("own")
    return scored.where(share >= LEAKED).groupBy("_id", "_hash", "item_id").agg(F.round(F.max(share), 6).alias("score"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item, in the columns of ``docs``.

    The ids found are written first, and tasks get a bit table of them: only the texts
    that it holds are joined, the others stay where they are.
    """
    leaked = materialise(contaminated(docs, benchmark).select("_id", "_hash").distinct(), "leak-ids")
    keyed = docs.select(carried(docs), F.col("doc_id").cast("bigint").alias("_key"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text_hash"))
    held = may_match(leaked, ["_id", "_hash"])("_key", "_text_hash")
    judged = keyed.where(held).join(leaked, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti")
    return keyed.where(~held).union(judged).select(*unpacked(docs, {}))
