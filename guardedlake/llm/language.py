"""Language identification by a bit-sliced Bloom filter of letter trigrams.

One filter serves all languages: each of its rows is a mask with a bit per language,
and the AND of the rows that a trigram hashes to holds the languages that have it, in
one look-up. A document's bits are counted per language, each count is corrected by
the share of false positives that the filter's fill implies for the language, and the
largest corrected count names the language.

A language has a trigram if it is about as usual there as anywhere: its share among the
language's trigrams is at least a quarter of the greatest such share. Counts cover all
labelled documents outside the held-out fifth and are written once. A trigram counts
for a language from a share of 1 in LEAST_SHARE of all its trigrams, at every size of
the input, so no language keeps more than LEAST_SHARE of them. The filter's size is
taken from the number that the richest language keeps: at most an eighth of its bits
are set, and it never has more than ROOM * HASHES * LEAST_SHARE rows (32 MB for each 64
languages). This filter is what reaches the driver and the tasks.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where
nothing has been learned. Null labels teach nothing. Ties go to the first language by
name. Texts of any length are read whole, in pieces; an empty table gives no rows and
teaches nothing. Rows with a null id are not held out. Equal rows give equal results; columns
other than those named are not read, and the label never is for a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.wordhash import U, mix
from guardedlake.session import materialise

FOLDS = 5
HASHES = 2
USUAL = 4
ROOM = 8
LEAST_SHARE = 1 << 18
UNKNOWN = "und"
PIECE = 1 << 18


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


class Letters:
    """Trigrams of a text: three code points in one number, with a blank where words begin and end."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def trigrams(self, text: str) -> Iterator[np.ndarray]:
        """All trigrams that hold a letter, piece by piece; pieces share two characters."""
        text = text.lower()
        for at in range(0, max(len(text), 1), PIECE):
            part = f" {text[at:at + PIECE]} " if at == 0 and len(text) <= PIECE else (" " if at == 0 else "") + text[max(at - 2, 0):at + PIECE] + (" " if at + PIECE >= len(text) else "")
            codes = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32).astype(U)
            codes = np.where(self.letter[codes.astype(np.int64)], codes, U(32))
            codes = codes[np.concatenate(([True], (codes[1:] != U(32)) | (codes[:-1] != U(32))))]
            if len(codes) > 2:
                grams = codes[:-2] << U(42) | codes[1:-1] << U(21) | codes[2:]
                yield grams[codes[1:-1] != U(32)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams per language, summed over each batch."""
    letters = Letters()
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for grams in letters.trigrams(text):
                by.setdefault(lang, []).append(grams)
                size += len(grams)
            if size > 1 << 21:
                yield from _sums(by)
                by, size = {}, 0
        yield from _sums(by)


def _sums(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in by.items():
        grams, counts = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


class Model(NamedTuple):
    """Languages, the filter (a row of masks per slot), and each language's false-positive share."""

    langs: list[str]
    masks: np.ndarray
    false: np.ndarray

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the trigrams each language has."""
        size = len(self.masks).bit_length() - 1
        found = self.masks[slots(grams, 0, size)]
        for k in range(1, HASHES):
            found = found & self.masks[slots(grams, k, size)]
        bits = np.unpackbits(found.view(np.uint8).reshape(len(grams), -1), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)[:len(self.langs)]


def slots(grams: np.ndarray, k: int, size: int) -> np.ndarray:
    """Rows of a filter of 2^size rows."""
    return (mix(grams + U(k * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)) >> U(64 - size)).astype(np.int64)


def _places(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_numpy().view(U)
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots(grams, k, size))], ["lang", "slot"])

    return run


def learn(docs: DataFrame) -> Model:
    """A model of the labelled documents (text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = materialise(known.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "trigrams")
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("of"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    words = max(1, -(-len(langs) // 64))
    if not langs:
        return Model(langs, np.zeros((2, words), dtype=U), np.zeros(1))
    total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(totals[lang]))])
    shares = F.transform("of", lambda x: F.struct(x["lang"].alias("lang"), x["n"].alias("n"), (x["n"] / total[x["lang"]]).alias("share")))
    kept = by_gram.select("gram", F.explode(shares).alias("x"), F.array_max(F.transform(shares, lambda x: x["share"])).alias("top")).where((F.col("x.share") * USUAL >= F.col("top")) & (F.col("x.share") * LEAST_SHARE >= 1)).select("x.lang", "gram")
    kept = materialise(kept, "usual_trigrams")
    richest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = (ROOM * HASHES * richest - 1).bit_length()
    masks = np.zeros((1 << size, words), dtype=U)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])[F.col("lang")]
    bits = kept.mapInArrow(_places(size), "lang string, slot bigint").select("slot", number.alias("i")).groupBy("slot", F.floor(F.col("i") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i % 64 as int))")).alias("mask"))
    for r in bits.toLocalIterator():
        masks[r["slot"], r["word"]] = U(r["mask"] & (1 << 64) - 1)
    filled = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little").mean(axis=0)[:len(langs)]
    return Model(langs, masks, filled**HASHES)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # of the filter's bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = Letters(), Model(*shared.value)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                hits, n = np.zeros(len(m.langs), dtype=np.int64), 0
                for grams in letters.trigrams(text or ""):
                    if len(grams) and m.langs:
                        hits, n = hits + m.counts(grams), n + len(grams)
                if not n:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                real = np.clip((hits - n * m.false) / (1 - m.false + 1e-12), 0, n) / n
                best = int(real.argmax())
                names.append(m.langs[best])
                scores.append(float(real[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all."""
    return predict(docs, learn(docs.where(~held_out())))
