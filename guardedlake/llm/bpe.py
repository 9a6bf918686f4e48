"""Byte-level BPE, encoded by walking a trie of words.

A text is cut into words by the vocabulary's pattern. Of each task's words the distinct
new ones are put in order; that order is the depth-first order of their trie, so one
stack holds the states of the current path and shared prefixes are encoded once. The
state of a prefix is the last token of its encoding: of the tokens that end there, the
one that may follow the last token of what precedes it. Two tokens may stand side by
side if merging their joined bytes gives these two again. A word's ids are then read
backwards from its last state.

Words and token pairs that a task has met are remembered, up to a bound, then forgotten
and met anew: nothing grows with the input. Nothing is shuffled.

Defined results: a null text counts as empty and has no tokens; the string of a special
token in a text gives that token, as the vocabulary's own library has it; equal rows
give equal results; one row comes out for each row that goes in. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies cut a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

REMEMBERED = 300_000
PAIRS = 600_000
BATCH_BYTES = 2 << 20


class Vocabulary(NamedTuple):
    """A vocabulary as the driver has read it; it has a fixed size and travels with the job."""

    tokens: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: dict[str, int]
    mark: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        text = Path(path).read_text(encoding="utf-8")
        model = json.loads(text)
        byte_of = _byte_alphabet()
        raw = lambda s: bytes(byte_of[c] for c in s)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        return cls({raw(s): i for s, i in model["model"]["vocab"].items() if s not in special}, {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}, special, hashlib.sha256(text.encode()).hexdigest())


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it has one, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Trie:
    """Encodings of words by their states; ``words`` are encoded together.

    Whether token b may follow token a is read off their merges. Until something is
    merged across their border, each side grows as it would alone: at the border stand
    in turn the tokens on the right edge of a's merge tree and on the left edge of b's.
    So a merge across comes first if some pair of these has a rank below that of the
    merges that take its two members away; of equal ranks the one further left wins.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.ranks = vocabulary.tokens, vocabulary.ranks
        self.size = 1 + max(self.ids.values())
        self.bytes_of = {i: t for t, i in self.ids.items()}
        made = {a + b: (a, b, r) for (a, b), r in reversed(list(self.ranks.items()))}
        self.made = {self.ids[t]: (self.ids[a], self.ids[b], r) for t, (a, b, r) in made.items()}
        self.one_way = len(made) == len(self.ranks)  # no token is the result of two merges
        self.pair_rank = {self.ids[a] * self.size + self.ids[b]: r for (a, b), r in self.ranks.items()}
        self.endings: dict[bytes, int] = {}  # every ending of a token, and its id if it is a token itself
        for t in self.ids:
            for i in range(len(t)):
                self.endings[t[i:]] = -1
        self.endings.update(self.ids)
        self.fits: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """Plain merging, the lowest rank first."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of a merge tree, each with the rank of the merge that takes it away."""
        found = self.edges.get((token, side))
        if found is None:
            found, until, here = [], 1 << 60, token
            while True:
                found.append((here, until))
                if here not in self.made:
                    break
                until, here = self.made[here][2], self.made[here][side]
            self.edges[token, side] = found
        return found

    def _plain(self, *tokens: int) -> bool:
        text = b"".join(self.bytes_of[t] for t in tokens)
        return self._merged([text[i:i + 1] for i in range(len(text))]) == [self.bytes_of[t] for t in tokens]

    def may_follow(self, last: int, token: int) -> bool:
        """``last`` is -1 at the beginning of a word."""
        key = last * self.size + token
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            if last < 0:
                known = self._plain(token)
            elif not self.one_way:
                known = self._plain(last, token)
            else:
                rank, size, left = self.pair_rank, self.size, self._edge(token, 0)
                known = self.may_follow(-1, token) and not any((r := rank.get(x * size + y)) is not None and r < gone_x and r <= gone_y for x, gone_x in self._edge(last, 1) for y, gone_y in left)
            self.fits[key] = known
        return known

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word of a sorted list."""
        endings, fits, size, lengths = self.endings, self.fits, self.size, {i: len(t) for t, i in self.ids.items()}
        states: list[int] = [-1]
        out, before = [], b""
        for word in words:
            most = min(len(word), len(before))
            shared = most if word[:most] == before[:most] else next(i for i in range(most) if word[i] != before[i])
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                start, found = end - 1, []
                while start >= 0 and (token := endings.get(word[start:end])) is not None:
                    if token >= 0:
                        found.append((token, start))
                    start -= 1
                for token, start in reversed(found):  # the longest first
                    last = states[start]
                    fit = fits.get(last * size + token)
                    if self.may_follow(last, token) if fit is None else fit:
                        states.append(token)
                        break
                else:
                    raise ValueError(f"no token ends after {word[:end][-20:]!r}")
            ids, end = [], len(word)
            while end:
                ids.append(states[end])
                end -= lengths[states[end]]
            out.append(ids[::-1])
            before = word
        return out


class Encoder:
    """Ids of whole texts, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.trie = Trie(vocabulary)
        self.cut = regex.compile(WORD_PATTERN)
        self.special = vocabulary.special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self._add([[i] for i in self.special.values()], list(self.special))

    def _add(self, ids: list[list[int]], words: list[str]) -> None:
        first = len(self.bounds) - 1
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.flat = np.concatenate((self.flat, np.array([i for x in ids for i in x], dtype=np.int32)))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)))

    def words(self, text: str) -> list[str]:
        if self.at_special is None or not self.at_special.search(text):
            return self.cut.findall(text)
        return [w for part in self.at_special.split(text) for w in ([part] if part in self.special else self.cut.findall(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.forget()
        cut = [self.words(t) for t in texts]
        new = sorted({w.encode() for ws in cut for w in set(ws) if w not in self.place})
        if new:
            self._add(self.trie.encode(new), [w.decode() for w in new])
        return [self._ids(ws) for ws in cut]

    def _ids(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        starts, sizes = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        shift = starts - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(rows) else starts
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this Python worker: what it remembers serves all tasks that the worker runs."""
    kept = sys.__dict__.setdefault("_bpe_encoders", {})
    if vocabulary.mark not in kept:
        kept[vocabulary.mark] = Encoder(vocabulary)
    return kept[vocabulary.mark]


def _by_size(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of about ``BATCH_BYTES`` together, and where they begin."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)))
        yield at, [t or "" for t in column.slice(at, to - at).to_pylist()]
        at = to


def _table(vocabulary: Vocabulary) -> list[bytes]:
    both = [*vocabulary.tokens.items(), *((s.encode(), i) for s, i in vocabulary.special.items())]
    table = [b""] * (1 + max(i for _, i in both))
    for token, i in both:
        table[i] = token
    return table


def _text(table: list[bytes], ids: list[int]) -> str:
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) for each row; with ``decoded`` also the text that the ids stand for, in the same pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _encoder(vocabulary), _table(vocabulary)
        for batch in batches:
            for at, block in _by_size(batch.column(1)):
                ids = encoder.encode(block)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32, copy=False)))
                columns, names = [batch.column(0).slice(at, len(block)), lists], ["doc_id", "ids"]
                if decoded:
                    columns, names = [*columns, pa.array([_text(table, x.tolist()) for x in ids], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>" + ", decoded string" * decoded)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``tokens`` (doc_id, ids) with the text that the ids stand for; bytes that are no text become the replacement character."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(vocabulary)
        for batch in batches:
            texts = [_text(table, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    both = encode(docs, vocabulary, decoded=True)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
