"""Exact duplicates by content-defined chunk recipes.

Texts are equal if they are identical after each run of blanks has become one space. A
text is cut where a rolling hash of its last bytes says so, so equal passages give equal
chunks wherever they stand. A chunk's name is a 128-bit hash, and names are verified:
the chunks, each once per task and then once per name, are grouped by name and the bytes
of a name have to be the same. If any name stands for two chunks, all are named anew by
another hash. From then on a document is its recipe, the list of its chunks' names in
order, and equal texts are equal recipes: 16 bytes for about two kilobytes of text are
grouped and joined, the texts themselves are not moved again.

A chunk that very many documents share is one row per task before it is shuffled, and a
text that a third of all rows repeat is one group with a count and a smallest id per
task; the way back from groups to rows is a join with one row per recipe, whose large
partitions Spark splits.

Defined results: a null text counts as an empty one; empty texts are equal to each
other and a text of blanks is equal to a single space. Rows that share an id and a text stay or go together. A null
id is never the smallest: a row with a null id stays only if no row of its group has an
id, and then ``keep_id`` is null. Very long texts are cut piece by piece. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.wordhash import BLANK_BYTES, U, mix
from guardedlake.session import materialise

WINDOW = 32
LEAST, USUAL_BITS, MOST = 256, 11, 1 << 14
PIECE = 1 << 20
REMEMBERED = 1 << 24

Name = Callable[[bytes, int], bytes]


def strong_name(chunk: bytes, round_: int) -> bytes:
    """128 bits of a chunk; each round has names of its own."""
    return xxhash.xxh3_128_digest(chunk, round_)


class Cutter:
    """Normalised texts and where they are cut."""

    def __init__(self):
        self.gear = (mix(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)
        self.blank = np.zeros(256, dtype=bool)
        self.blank[BLANK_BYTES] = True

    def normal(self, text: np.ndarray) -> np.ndarray:
        """The text with each run of blanks as one space."""
        parts, before = [], False
        for at in range(0, len(text), PIECE):
            part = text[at:at + PIECE]
            blank = self.blank[part]
            if blank.any():
                again = blank.copy()
                again[1:] &= blank[:-1]
                again[0] &= before
                part = np.where(blank, np.uint8(0x20), part)[~again]
            parts.append(part)
            before = bool(blank[-1])
        return np.concatenate(parts) if parts else text

    def marks(self, text: np.ndarray) -> np.ndarray:
        """Ends of the chunks that the bytes before them suggest; those depend on the last ``WINDOW`` bytes alone."""
        found = []
        for at in range(0, len(text), PIECE):
            first = max(at - WINDOW + 1, 0)
            rolled = self.gear[text[first:at + PIECE]]
            for step in (1, 2, 4, 8, 16):
                more = rolled.copy()
                more[step:] += rolled[:-step] << np.uint32(step)
                rolled = more
            here = np.flatnonzero(rolled >> np.uint32(32 - USUAL_BITS) == 0) + first + 1
            found.append(here[here > at])
        return np.concatenate(found)

    def chunks(self, text: np.ndarray) -> Iterator[bytes]:
        """The chunks of a normalised text, in order; none are shorter than ``LEAST``, but for the last, or longer than ``MOST``."""
        at, size = 0, len(text)
        for end in self.marks(text).tolist() if size > LEAST else ():
            if end - at < LEAST:
                continue
            while end - at > MOST:
                yield text[at:at + MOST].tobytes()
                at += MOST
            if end - at >= LEAST:
                yield text[at:end].tobytes()
                at = end
        while size - at > MOST:
            yield text[at:at + MOST].tobytes()
            at += MOST
        if at < size:
            yield text[at:].tobytes()


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for value in pc.fill_null(column.cast(pa.large_binary()), b""):
        yield np.frombuffer(value.as_buffer(), dtype=np.uint8)


def _chunk_rows(name: Name, round_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chunks of a task with their names, each once as long as they fit into the memory set aside for them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen, held = Cutter(), set(), 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                for chunk in cutter.chunks(cutter.normal(text)):
                    if chunk not in seen:
                        seen.add(chunk)
                        held += len(chunk)
                if held > REMEMBERED:
                    yield rows(seen)
                    seen, held = set(), 0
        yield rows(seen)

    def rows(seen: set[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name(c, round_) for c in seen], pa.binary()), pa.array(list(seen), pa.binary())], ["name", "chunk"])

    return run


def _recipe_rows(name: Name, round_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row with the names of its chunks in order, and the digest of its normalised text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            recipes, digests = [], []
            for text in _texts(batch.column(1)):
                text = cutter.normal(text)
                recipes.append(b"".join([name(c, round_) for c in cutter.chunks(text)]))
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipes, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return run


def verified_round(texts: DataFrame, name: Name = strong_name) -> int:
    """The first round of names in which no name stands for two different chunks of ``texts`` (text)."""
    round_ = 0
    while True:
        chunks = texts.mapInArrow(_chunk_rows(name, round_), "name binary, chunk binary")
        both = chunks.groupBy("name").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        if both.where("low <> high").isEmpty():
            return round_
        round_ += 1


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: Name = strong_name) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = _with_recipes(plain, name)
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_recipes(plain: DataFrame, name: Name) -> DataFrame:
    """doc_id, recipe and text_sha256 of each row, written."""
    round_ = verified_round(plain.select("text"), name)
    return materialise(plain.mapInArrow(_recipe_rows(name, round_), "doc_id bigint, recipe binary, text_sha256 string"), "recipes")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, in the columns of ``docs``; ids are taken to be unique."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
