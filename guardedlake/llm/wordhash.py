"""Texts in Arrow batches as arrays of word hashes, computed on bytes in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The blanks of the contract, and the rolling base with its inverse modulo 2**64.
BLANK_BYTES = [0x20, *range(0x09, 0x0E)]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of the words of a text; ``fold`` takes A to Z as a to z, ``plain`` cuts words at ASCII signs too."""

    def __init__(self, fold: bool = True, plain: bool = False):
        codes = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
        if fold:
            codes[65:91] = codes[97:123]
        self.codes, self.up, self.down = codes, _powers(BASE), _powers(INVERSE)
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[b for b in range(128) if not chr(b).isalnum()] if plain else BLANK_BYTES] = True

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word of one text, as bytes."""
        parts = [self._piece(data, a, b) for a, b in self._pieces(data)]
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0, dtype=U)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _pieces(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pieces that end between words; a single word longer than a piece is a piece by itself."""
        at, n = 0, len(data)
        while at < n:
            end = min(at + PIECE, n)
            if end < n:
                blanks = np.flatnonzero(self.blank[data[at:end]])
                if len(blanks):
                    end = at + int(blanks[-1]) + 1
                else:
                    while end < n and not self.blank[data[end]]:
                        more = np.flatnonzero(self.blank[data[end:end + PIECE]])
                        end = end + int(more[0]) if len(more) else min(end + PIECE, n)
            yield at, end
            at = end

    def _piece(self, data: np.ndarray, a: int, b: int):
        part = data[a:b]
        edge = np.diff(np.concatenate(([0], (~self.blank[part]).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if b - a > PIECE:
            hashes = np.array([self._long(part[s:e]) for s, e in zip(starts, ends, strict=True)], dtype=U)
        else:
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum(self.codes[part] * self.up[:len(part)], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self.down[starts]
        return starts + a, ends + a, mix(hashes)

    def _long(self, word: np.ndarray) -> np.uint64:
        total, scale = 0, 1
        for at in range(0, len(word), PIECE):
            part = word[at:at + PIECE]
            total = (total + scale * int((self.codes[part] * self.up[:len(part)]).sum(dtype=U))) % (1 << 64)
            scale = scale * pow(BASE, len(part), 1 << 64) % (1 << 64)
        return U(total)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U)
    out = hashes[:len(hashes) - n + 1]
    for k in range(1, n):
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + hashes[k:len(hashes) - n + 1 + k])
    return out


def spaced(hashes: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words that stand in ``pattern`` from each place on; the same words hash alike in any pattern."""
    n = max(0, len(hashes) - pattern[-1])
    out = hashes[:n]
    for k in pattern[1:]:
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + hashes[k:k + n])
    return out


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of words, if there are any."""
    out = hashes[:1]
    for h in hashes[1:]:
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + h)
    return out


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a column, without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    valid, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield body[ends[i]:ends[i]] if nulls[i] else body[ends[i]:ends[i + 1]]
