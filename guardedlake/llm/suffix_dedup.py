"""Removal of repeated substrings by distributed sorting of sampled suffixes.

The steps are those of the difference-cover construction: a sample of positions is
named by short strings, names are taken further to longer strings, the remaining
positions are placed by their distance to a sampled one, and neighbours in the order
are compared. As only the first 50 bytes of a suffix matter, two rounds of names are
enough. The cover is chosen by content instead of by a period: of each 19 neighbouring
32-byte strings the one with the smallest hash is sampled. Like a difference cover it
gives any two equal 50-byte strings a sampled position at the same offset, but with 10
positions in 100; a periodic cover for that length takes at least 26 (README).

1. Sieve: names of the sampled positions of each block of documents go to buckets,
   once per block, in 32 bits beside the bucket. Names that come from two documents
   are sent back to their blocks. What lies around them is cut out as regions.
2. Names of whole contexts (all 50-byte strings around a sampled position, 68 bytes)
   are sorted with their documents: a context that a smaller document has is removed
   as a whole. This settles the inside of repeated passages.
3. Any 50-byte string around a sampled position holds half of the surroundings on one
   side. Where such a half has different contexts, that is at the ends of repeats, the
   remaining positions are merged in: each 50-byte string around the sampled position
   is named by itself, and removed if a smaller document has it.

A block sends each name once, with its smallest document, and settles its other
documents by itself; so a passage or a copy that a third of all documents share is at
most one entry for each block. Sorting and comparing is done in tasks of bounded size.
Strings are compared by 64-bit hashes.

Defined results: a null text is empty; texts under 50 bytes lose nothing; equal texts
under one id are not smaller than each other and both stay; rows that repeat an id with
other texts are told apart by their text. A null id neither loses nor removes anything.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.wordhash import PIECE, U, Hasher, mix, texts_of

LENGTH, NAME = 50, 32
WINDOW = LENGTH - NAME + 1
BEFORE = LENGTH - NAME
HALF = BEFORE // 2
BLOCK_BYTES = 8 << 20
STEP = PIECE // 2
REGION_BYTES = PIECE // 4

MESSAGE = "to bigint, kind int, block bigint, a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>"
SIEVE = "bucket bigint, block bigint, twice boolean, low array<int>"
REGION = "block bigint, doc bigint, no bigint, start bigint, body binary, at array<int>"
CONTEXT, MIXED, STRING, COVER = range(4)
NONE = np.zeros(0, dtype=np.int64)


class Names:
    """Hashes of substrings of one text at a time."""

    def __init__(self):
        h = Hasher(fold=False)
        self.codes, self.up, self.down = h.codes, h.up, h.down

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.codes[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((sums[high] - sums[low]) * self.down[low])

    def sampled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions of a text and their names, in pieces that share the strings between them."""
        places, names = [], []
        for at in range(0, max(len(data) - LENGTH + 1, 0), STEP):
            part = data[at:at + STEP + LENGTH - 1]
            s = self.sums(part)
            hashes = mix((s[NAME:] - s[:-NAME]) * self.down[:len(part) - NAME + 1])
            least = _slide(hashes, np.minimum)
            padded = np.concatenate((np.zeros(WINDOW - 1, dtype=U), least, np.zeros(WINDOW - 1, dtype=U)))
            found = np.flatnonzero(_slide(padded, np.maximum) == hashes)
            places.append(found + at)
            names.append(hashes[found])
        if not places:
            return NONE, np.zeros(0, dtype=U)
        places, first = np.unique(np.concatenate(places), return_index=True)
        return places, np.concatenate(names)[first]


def _slide(values: np.ndarray, best: np.ufunc) -> np.ndarray:
    """The best of each run of WINDOW values, by doubling."""
    out, size = values, 1
    while 2 * size <= WINDOW:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = WINDOW - size
    return best(out[:len(out) - rest], out[rest:]) if rest else out


def _close(numbers: np.ndarray) -> np.ndarray:
    """A list as steps from each number to the next, their bytes by place: small steps leave runs of zeros, which shuffle files pack."""
    step = np.diff(numbers, prepend=numbers.dtype.type(0))
    step = step << 1 ^ step >> (8 * step.itemsize - 1)
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, step.itemsize).T).reshape(-1).view(step.dtype)


def _open(packed: np.ndarray) -> np.ndarray:
    step = np.ascontiguousarray(packed.view(np.uint8).reshape(packed.itemsize, len(packed)).T).reshape(-1).view(packed.dtype)
    step = step >> 1 & np.iinfo(step.dtype).max ^ -(step & 1)
    return np.cumsum(step, dtype=step.dtype)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), *(pa.list_(pa.int64()),) * 4)
    columns = list(zip(*((*r[:3], *(_close(np.asarray(x, dtype=np.int64)) for x in r[3:])) for r in rows), strict=True)) or [[]] * 7
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["to", "kind", "block", "a", "b", "c", "d"])


def _both(half: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A half name and its context in one number: 28 bits beside the bucket, and 36 bits."""
    return half << U(36) | context >> U(28)


def _dealt_at(kind: int, block: int, buckets: int, key: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
    rows = _dealt(kind, block, buckets, key, np.arange(len(key)))
    return [((*x[:4], NONE, NONE, NONE), x[4]) for x in rows]


def _dealt(kind: int, block: int, buckets: int, key: np.ndarray, *lists: np.ndarray) -> list[tuple]:
    """Messages to the buckets of ``key``, which goes along."""
    to = ((key >> U(32)) % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    rows = []
    for part in np.split(order, cuts) if len(order) else ():
        held = [key[part].view(np.int64), *(x[part] for x in lists)]
        rows.append((int(to[part[0]]), kind, block, *held, *[NONE] * (4 - len(held))))
    return rows


def _covers(block: int, docs: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """One message with the united spans of each document."""
    if not len(docs):
        return []
    order = np.lexsort((low, keys, docs))
    docs, keys, low, high = docs[order], keys[order], low[order], high[order]
    fresh = np.concatenate(([True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])))
    # Ends grow with starts here: spans of a kind have one length, but for those cut at a text's ends.
    fresh[1:] |= low[1:] > high[:-1]
    first = np.flatnonzero(fresh)
    return [(block, COVER, block, docs[first], keys[first], low[first], np.maximum.reduceat(high, first))]


def _later(names: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which entries have a name that also comes with a smaller document."""
    order = np.lexsort((docs, names))
    fresh = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    least = docs[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    out = np.empty(len(names), dtype=bool)
    out[order] = docs[order] > least
    return out


def _list(table: pa.Table, name: str) -> np.ndarray:
    """All entries of a column of closed lists."""
    column = table.column(name).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return NONE
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.concatenate([_open(x) for x in np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])])


def _per_entry(table: pa.Table, name: str, of: str) -> np.ndarray:
    """A plain column, repeated for each entry of a list column."""
    sizes = [len(x) for x in table.column(of)]
    return np.repeat(table.column(name).to_numpy(), sizes)


def _numbers(table: pa.Table) -> np.ndarray:
    """The place of each document among those of its block, by id and key: what messages name it by."""
    pairs = np.stack([table.column(c).to_numpy() for c in ("doc", "key")], axis=1)
    return np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1)


def _leaders(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """The documents of a block by id, with their numbers; what repeats an earlier text of the block says so."""
    ids, numbers = table.column("doc").to_numpy(), _numbers(table)
    seen: dict[bytes, int] = {}
    for i in np.argsort(ids, kind="stable"):
        text = zlib.decompress(table.column("body")[int(i)].as_py())
        mark = hashlib.blake2b(text, digest_size=16).digest()
        first = seen.setdefault(mark, int(ids[i]))
        yield int(ids[i]), int(numbers[i]), np.frombuffer(text, dtype=np.uint8), bool(mark in seen and first != int(ids[i]))


def _codes(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of a name, as the sieve knows it."""
    return ((names >> U(32)) % U(buckets)).astype(np.int64) << 32 | (names & U(0xFFFFFFFF)).astype(np.int64)


def _sieve(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        names, block = Names(), table.column("block")[0].as_py()
        found = [np.unique(names.sampled(text)[1]) for _, _, text, copy in _leaders(table) if not copy]
        if not found:
            return _sieve_rows([])
        one, count = np.unique(_codes(np.concatenate(found), buckets), return_counts=True)
        rows = []
        for twice in (False, True):
            part = one[(count > 1) == twice]
            cuts = np.flatnonzero(np.diff(part >> 32)) + 1
            rows += [(int(x[0] >> 32), block, twice, (x & 0xFFFFFFFF).astype(np.uint32).view(np.int32)) for x in np.split(part, cuts) if len(x)]
        return _sieve_rows(rows)

    return run


def _sieve_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*((*r[:3], _close(r[3])) for r in rows), strict=True)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())), strict=True)], names=["bucket", "block", "twice", "low"])


def _repeated(table: pa.Table) -> pa.Table:
    """The names of a bucket that two documents have, for each block that holds them."""
    low, block = _list(table, "low"), _per_entry(table, "block", "low")
    weight = 1 + _per_entry(table, "twice", "low").astype(np.int64)
    _, place = np.unique(low, return_inverse=True)
    hit = np.bincount(place, weights=weight)[place] > 1
    low, block, bucket = low[hit], block[hit], table.column("bucket")[0].as_py()
    order = np.argsort(block, kind="stable")
    rows = [(bucket, int(block[p[0]]), False, np.unique(low[p])) for p in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(p)]
    return _sieve_rows(rows)


def _regions(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        names, rows = Names(), []
        known = np.sort(_per_entry(told, "bucket", "low") << 32 | _list(told, "low").view(np.uint32).astype(np.int64)) if told.num_rows else NONE
        block = table.column("block")[0].as_py() if table.num_rows else None
        for doc, no, text, copy in _leaders(table) if table.num_rows else ():
            if copy:
                if len(text) >= LENGTH:
                    rows.append((block, doc, no, len(text), None, []))
                continue
            at, name = names.sampled(text)
            code = _codes(name, buckets)
            place = np.searchsorted(known, code)
            at = at[(place < len(known)) & (known[np.minimum(place, len(known) - 1)] == code)] if len(known) else NONE
            if not len(at):
                continue
            low, high = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, len(text))
            cuts = np.flatnonzero((low[1:] > high[:-1]) | (at[1:] // REGION_BYTES != at[:-1] // REGION_BYTES)) + 1
            for part in np.split(np.arange(len(at)), cuts):
                a, b = int(low[part[0]]), int(high[part[-1]])
                rows.append((block, doc, no, a, text[a:b].tobytes(), (at[part] - a).astype(np.int32)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "doc", "no", "start", "body", "at"])

    return run


def _copies(table: pa.Table) -> tuple[list[tuple], pa.Table]:
    """Covers of the documents that are copies as a whole, and the regions without them."""
    copy = table.column("body").is_null()
    whole = table.filter(copy)
    rows = [(b, COVER, b, np.array([d]), np.array([k]), np.array([0]), np.array([n])) for b, d, k, n in zip(*(whole.column(c).to_pylist() for c in ("block", "doc", "no", "start")), strict=True)]
    return rows, table.filter(pc.invert(copy))


class Sampled(NamedTuple):
    """The sampled places of some regions, laid end to end in one text."""

    sums: np.ndarray
    doc: np.ndarray
    no: np.ndarray
    shift: np.ndarray  # from the laid text to the document
    place: np.ndarray
    low: np.ndarray  # of the context, and of its region
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _sampled(table: pa.Table, names: Names) -> Iterator[Sampled]:
    """The regions of a block, some hundred kilobytes at a time."""
    sizes = pc.binary_length(table.column("body")).to_numpy().astype(np.int64)
    doc, no, start = (table.column(c).to_numpy() for c in ("doc", "no", "start"))
    group = np.cumsum(sizes) // (PIECE - 2 * REGION_BYTES)
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1) if len(sizes) else ():
        rows = table.slice(int(part[0]), len(part))
        data = np.frombuffer(b"".join(rows.column("body").to_pylist()), dtype=np.uint8)
        ends = np.cumsum(sizes[part])
        begins = ends - sizes[part]
        at = rows.column("at").combine_chunks()
        at = pa.concat_arrays(at.chunks) if isinstance(at, pa.ChunkedArray) else at
        owner = np.repeat(np.arange(len(part)), at.value_lengths().to_numpy(zero_copy_only=False))
        place = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + begins[owner]
        first, last = begins[owner], ends[owner]
        yield Sampled(names.sums(data), doc[part][owner], no[part][owner], (start[part] - begins)[owner], place, np.maximum(place - BEFORE, first), np.minimum(place + LENGTH, last), first, last)


def _context(names: Names, x: Sampled) -> np.ndarray:
    shape = (x.place - x.low) * 64 + (x.high - x.place)
    return mix(names.of(x.sums, x.low, x.high) + shape.astype(U) * U(0xC2B2AE3D27D4EB4F))


def _halves(names: Names, x: Sampled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the sampled string with half of its surroundings on one side, and where there is such a string.

    A 50-byte string around the place reaches at least that far on one of its sides.
    """
    for side, low, high in ((0, x.place - HALF, x.place + NAME), (1, x.place, x.place + NAME + BEFORE - HALF)):
        there = (low >= x.first) & (high <= x.last)
        yield there, mix(names.of(x.sums, np.where(there, low, x.place), np.where(there, high, x.place)) + U(side))


def _contexts(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        names, block, parts, half_parts = Names(), table.column("block")[0].as_py(), [], []
        table = _copies(table)[1]
        for x in _sampled(table, names):
            context = _context(names, x)
            parts.append((context, x.doc))
            half_parts += [(half[there], context[there]) for there, half in _halves(names, x)]
        if not parts:
            return _rows([])
        context, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        later = _later(context, doc)
        one, first = np.unique(context[~later], return_index=True)
        doc = doc[~later][first]
        order = np.argsort(doc, kind="stable")
        rows = _dealt(CONTEXT, block, buckets, one[order], doc[order])
        half, context = (np.concatenate(c) for c in zip(*half_parts, strict=True))
        order = np.lexsort((context, half))
        first = np.flatnonzero(np.concatenate(([True], half[order][1:] != half[order][:-1]))) if len(half) else NONE
        last = np.concatenate((first[1:] - 1, [len(order) - 1])) if len(first) else NONE
        one, a, b = half[order][first], context[order][first], context[order][last]
        differ = a != b
        half, context = np.concatenate((one, one[differ])), np.concatenate((a, b[differ]))
        rows += [(*x[:3], np.sort(_both(half[at], context[at]).view(np.int64)), *x[4:]) for x, at in _dealt_at(MIXED, block, buckets, half)]
        return _rows(rows)

    return run


def _judged(table: pa.Table) -> pa.Table:
    """For each block: contexts that a smaller document has, and half names that stand in different contexts."""
    rows, kinds = [], table.column("kind").to_numpy()
    for kind in (CONTEXT, MIXED):
        part = table.filter(pa.array(kinds == kind))
        if not part.num_rows:
            continue
        a, block = _list(part, "a"), _per_entry(part, "block", "a")
        if kind == CONTEXT:
            hit = _later(a, _list(part, "b"))
        else:
            both = a.view(U)
            order = np.argsort(both)
            half = both[order] >> U(36)
            fresh = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
            differ = both[order][fresh] != both[order][np.concatenate((fresh[1:] - 1, [len(order) - 1]))]
            hit = np.empty(len(a), dtype=bool)
            hit[order] = np.repeat(differ, np.diff(np.concatenate((fresh, [len(order)]))))
            a = (both >> U(36)).astype(np.int64)
        index = np.flatnonzero(hit)
        index = index[np.argsort(block[index], kind="stable")]
        for p in np.split(index, np.flatnonzero(np.diff(block[index])) + 1) if len(index) else ():
            rows.append((-1, kind, int(block[p[0]]), np.unique(a[p]), NONE, NONE, NONE))
    return _rows(rows)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted list."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def _strings(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        names, block = Names(), table.column("block")[0].as_py()
        rows, table = _copies(table)
        kinds = told.column("kind").to_numpy() if told.num_rows else NONE
        covered, mixed = (np.sort(_list(told.filter(pa.array(kinds == k)), "a").view(U)) if told.num_rows else np.zeros(0, dtype=U) for k in (CONTEXT, MIXED))
        all_contexts = [(_context(names, x), x.doc) for x in _sampled(table, names)]
        later = _later(*(np.concatenate(c) for c in zip(*all_contexts, strict=True))) if all_contexts else NONE
        found, at = [], 0
        for x, (context, doc) in zip(_sampled(table, names), all_contexts, strict=True):
            settled = later[at:at + len(doc)]
            at += len(doc)
            sure = _among(context, covered) | settled
            rows += _covers(block, doc[sure], x.no[sure], (x.low + x.shift)[sure], (x.high + x.shift)[sure])
            open_ = np.zeros(len(doc), dtype=bool)
            for there, half in _halves(names, x):
                open_ |= there & _among(half & U((1 << 28) - 1), mixed)
            here = np.flatnonzero(open_ & ~sure)
            if not len(here):
                continue
            begin = x.place[here][:, None] - np.arange(WINDOW)
            good = (begin >= x.first[here][:, None]) & (begin + LENGTH <= x.last[here][:, None])
            owner = np.broadcast_to(here[:, None], begin.shape)[good]
            begin, keep = np.unique(begin[good], return_index=True)
            owner = owner[keep]
            found.append((names.of(x.sums, begin, begin + LENGTH), doc[owner], x.no[owner], begin + x.shift[owner]))
        if found:
            text, doc, no, begin = (np.concatenate(c) for c in zip(*found, strict=True))
            gone = _later(text, doc)
            rows += _covers(block, doc[gone], no[gone], begin[gone], begin[gone] + LENGTH)
            order = np.lexsort((begin, no, doc))
            order = order[~gone[order]]
            rows += _dealt(STRING, block, buckets, text[order], doc[order], no[order], begin[order])
        return _rows(rows)

    return run


def _settled(table: pa.Table) -> pa.Table:
    """All spans of each block: those that come settled, and strings that a smaller document has."""
    kinds = table.column("kind").to_numpy()
    part, come = (table.filter(pa.array(kinds == k)) for k in (STRING, COVER))
    a, doc, no, begin = (_list(part, c) for c in "abcd")
    rows = [np.stack([_per_entry(come, "block", "a") if come.num_rows else NONE, *(_list(come, c) for c in "bcd")])]
    if len(a):
        later = _later(a, doc)
        block, no, begin = _per_entry(part, "block", "a")[later], no[later], begin[later]
        order = np.lexsort((begin, no, block))
        block, no, begin = block[order], no[order], begin[order]
        fresh = np.concatenate(([True], (block[1:] != block[:-1]) | (no[1:] != no[:-1]) | (begin[1:] > begin[:-1] + LENGTH))) if len(block) else NONE.astype(bool)
        first = np.flatnonzero(fresh)
        last = np.concatenate((first[1:], [len(block)])) - 1 if len(first) else NONE
        rows.append(np.stack([block[first], no[first], begin[first], begin[last] + LENGTH]))
    block, no, start, end = np.concatenate(rows, axis=1)
    order = np.lexsort((start, no, block))
    parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []
    lists = [pa.array([_close(x[p]) for p in parts], pa.list_(pa.int64())) for x in (no, start, end - start)]
    return pa.Table.from_arrays([pa.array([int(block[p[0]]) for p in parts], pa.int64()), *lists], names=["block", "no", "start", "size"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [zlib.compress(text, 1) for text in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["doc", "key", "body"])


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(table: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of each text of a block, and figures about it."""
    found: dict[int, list[tuple[int, int]]] = {}
    for no, low, size in zip(*(_list(spans, c).tolist() for c in ("no", "start", "size")), strict=True) if spans.num_rows else ():
        found.setdefault(no, []).append((low, low + size))
    rows = []
    numbers = _numbers(table).tolist() if found else [-1] * table.num_rows
    for doc, body, no in zip(*(table.column(c).to_pylist() for c in ("doc", "body")), numbers, strict=True) if table.num_rows else ():
        text, runs, kept, at = zlib.decompress(body), [], hashlib.sha256(), 0
        for low, high in sorted(found.get(no, ())):
            if runs and low <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], high)
            else:
                runs.append([low, high])
        for low, high in runs:
            kept.update(text[at:low])
            at = high
        kept.update(text[at:])
        rows.append((doc, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures about texts that lose nothing."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from _cut(table, table.slice(0, 0)).to_batches()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what is left.

    All steps are one job. Texts, packed, are shuffled to their blocks once, and so are
    regions; later steps read the same shuffle files again.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(body).alias("key"), body.alias("body"))
    blocks = 1 + (source.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // BLOCK_BYTES
    block = F.pmod(F.xxhash64("doc", "key"), F.lit(blocks)).cast("bigint").alias("block")
    packed = source.mapInArrow(_packed, "doc bigint, key bigint, body binary")
    texts = packed.where(F.col("doc").isNotNull()).select("doc", "key", "body", block).groupBy("block")
    told = texts.applyInArrow(_sieve(blocks), SIEVE).groupBy("bucket").applyInArrow(_repeated, SIEVE)
    regions = texts.cogroup(told.groupBy("block")).applyInArrow(_regions(blocks), REGION).groupBy("block")
    judged = regions.applyInArrow(_contexts(blocks), MESSAGE).groupBy("to").applyInArrow(_judged, MESSAGE)
    strings = regions.cogroup(judged.groupBy("block")).applyInArrow(_strings(blocks), MESSAGE)
    spans = strings.groupBy("to").applyInArrow(_settled, "block bigint, no array<bigint>, start array<bigint>, size array<bigint>")
    cut = texts.cogroup(spans.groupBy("block")).applyInArrow(_cut, CUT)
    without_id = packed.where(F.col("doc").isNull())
    return cut.unionByName(without_id.mapInArrow(_whole, CUT))
