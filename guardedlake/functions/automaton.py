"""Many phrases found in one walk over each text: an automaton of goto and failure links.

The links are resolved into a table of the next state for each state and letter, so a
walk is one look-up per letter, however many phrases there are. Texts are walked side by
side: they are cut into pieces that overlap by the longest phrase less one letter, and
one numpy step moves all pieces on by a letter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np

PIECE = 1_024
LETTERS_AT_ONCE = 1 << 22
MOST_STATES = 1 << 16


class Automaton:
    """Finds which of ``phrases`` each text contains; texts and phrases are compared letter by letter."""

    def __init__(self, phrases: Sequence[str]):
        letters = sorted({c for p in phrases for c in p})
        self.code = np.zeros(0x110000, dtype=np.uint32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width, self.longest = len(letters) + 1, max(map(len, phrases), default=0)
        goto: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, phrase in enumerate(phrases):
            at = 0
            for c in self.code[[ord(c) for c in phrase]].tolist():
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    ends.append([])
                at = goto[at][c]
            ends[at].append(i)
        self.next, self.ends = self._resolved(goto, ends)
        self.says = np.array([bool(e) for e in self.ends])

    def _resolved(self, goto: list[dict[int, int]], ends: list[list[int]]) -> tuple[np.ndarray, list[list[int]]]:
        """Next states with failure links followed, and with the phrases that end on the way of those."""
        table = np.zeros((len(goto), self.width), dtype=np.int32)
        fail, waiting = [0] * len(goto), deque([0])
        while waiting:
            at = waiting.popleft()
            ends[at] = ends[at] + (ends[fail[at]] if fail[at] else [])  # the empty phrase, of state 0, is everywhere anyway
            table[at] = table[fail[at]] if at else 0
            for c, to in goto[at].items():
                fail[to] = int(table[fail[at], c]) if at else 0
                table[at, c] = to
                waiting.append(to)
        return table, ends

    def _pieces(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Text, start and end of each piece, and how many letters a piece has at most."""
        span = max(PIECE, 8 * self.longest)
        step = span - max(self.longest - 1, 0)
        counts = np.maximum(-(-(sizes - (span - step)) // step), 1)
        owner = np.repeat(np.arange(len(sizes)), counts)
        ends = np.cumsum(sizes)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step + (ends - sizes)[owner]
        return owner, start, np.minimum(start + span, ends[owner]), span

    def found(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and phrase of everything found, each pair once."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        owner, start, end, span = self._pieces(sizes)
        seen = [np.arange(len(texts)) * len(self.next)]  # the first state stands for the empty phrase
        flat, rows = self.next.reshape(-1), max(1, LETTERS_AT_ONCE // span)
        for a in range(0, len(owner), rows):
            of, at, stop = owner[a:a + rows], start[a:a + rows], end[a:a + rows]
            order = np.argsort(at - stop, kind="stable")  # the longest first, so that those still walking stand together
            of, at, stop = of[order], at[order], stop[order]
            going = len(of) - np.searchsorted((stop - at)[::-1], np.arange(1, span + 1))
            state = np.zeros(len(of), dtype=np.int64)
            for k in range(int((stop - at).max(initial=0))):
                n = going[k]
                state[:n] = flat[state[:n] * self.width + codes[at[:n] + k]]
                hit = np.flatnonzero(self.says[state[:n]])
                if len(hit):
                    seen.append(of[hit] * len(self.next) + state[hit])
        text, state = np.divmod(np.unique(np.concatenate(seen)), len(self.next))
        sizes = np.array([len(e) for e in self.ends])
        firsts = np.cumsum(sizes) - sizes
        phrase = np.array([p for e in self.ends for p in e], dtype=np.int64)
        n = sizes[state]
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[state], n)
        pairs = np.unique(np.stack((np.repeat(text, n), phrase[which])), axis=1) if len(which) else np.zeros((2, 0), dtype=np.int64)
        return pairs[0], pairs[1]


def automata(phrases: Sequence[str], most_states: int = MOST_STATES) -> Iterator[tuple[int, Automaton]]:
    """Automata of a bounded number of states over all phrases, each with the place of its first phrase."""
    first, states = 0, 1
    for i, phrase in enumerate(phrases):
        if i > first and states + len(phrase) > most_states:
            yield first, Automaton(phrases[first:i])
            first, states = i, 1
        states += len(phrase)
    if len(phrases):
        yield first, Automaton(phrases[first:])
