"""Windows of many texts as sets of numbered 3-grams, met by numpy: containment without a row of the JVM for each gram.

A gram is the number of its three code points, 21 bits each, so grams are told apart exactly. `Windows` has the slices of S3
and the head of S9 of texts that `similarity.plain` made; `Index` finds the windows that are alike to others, with prefix
filtering over the rarest grams and an exact count for each pair that passes. `Hasher` makes the simhashes of S5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pagesift.functions.similarity import HASHED, SLICE, SLICES

U = np.uint64
#: Marks grams of heads, which meet heads only; and what fills up rows of grams.
HEAD, NONE = U(1 << 63), U((1 << 64) - 1)
#: Characters of texts whose windows are made together; numbers of the table in which a gram is looked up first.
TOGETHER, FIRST_LOOK = 300_000, 22
#: Marks of windows for grams, and pairs, that are held at a time.
MARKS, HELD = 16_000_000, 2_000_000
#: Grams whose md5 a task remembers.
REMEMBERED = 1_000_000


def text_slices(texts: list[str], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most `most` characters together (a longer one makes a range of its own)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts from 1 on, two zeros after them, and where each text starts (one more entry than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    return np.append(points, np.zeros(2, U)), np.concatenate([[0], np.cumsum(lengths)])


def expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (`count[0]` numbers), and so on for all entries."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Windows:
    """Of texts: `owner` (the text of each window), `size` (its distinct grams), and all these grams, ascending within a
    window: `grams`, and `window`, which one each is of."""

    def __init__(self, texts: list[str], limit: int = SLICE):
        points, starts = code_points([t[: max(limit, SLICE * SLICES)] for t in texts])
        runs = points[:-2] << U(42) | points[1:-1] << U(21) | points[2:]
        lengths, k = np.diff(starts), np.arange(SLICES) * SLICE
        begin, long = starts[:-1, None] + k, np.clip(lengths[:, None] - k, 0, SLICE)
        owner, head = np.repeat(np.arange(len(texts)), SLICES), np.zeros(SLICES * len(texts), bool)
        begin, long = begin.ravel(), long.ravel()
        if limit != SLICE:  # else the head is the first slice
            begin, long = np.concatenate([begin, starts[:-1]]), np.concatenate([long, np.minimum(lengths, limit)])
            owner, head = np.concatenate([owner, np.arange(len(texts))]), np.concatenate([head, np.ones(len(texts), bool)])
        some = long > 0
        begin, long, self.owner, head = begin[some], long[some], owner[some], head[some]
        wide = np.arange(max(1, int(long.max(initial=0)) - 2))
        count = np.maximum(long - 2, 1)
        m = np.full((len(long), len(wide)), NONE)
        filled = wide < count[:, None]
        m[filled] = runs[expanded(begin, count)]
        # a text of one or two characters is its own gram, whatever follows it
        m[:, 0] = np.where(long == 1, points[begin] << U(42), np.where(long == 2, points[begin] << U(42) | points[begin + 1] << U(21), m[:, 0]))
        m[filled] |= np.repeat(np.where(head, HEAD, U(0)), count)
        m.sort(axis=1)
        m_distinct = m != NONE
        m_distinct[:, 1:] &= m[:, 1:] != m[:, :-1]
        self.size = m_distinct.sum(axis=1)
        self.grams = m[m_distinct]
        self.window = np.repeat(np.arange(len(long)), self.size)


def _spot(grams: np.ndarray) -> np.ndarray:
    return ((grams ^ grams >> U(29)) * U(0x9E3779B97F4A7C15)) >> U(64 - FIRST_LOOK)


class Index:
    """Windows `a` to which others are compared; pairs count from a containment of `least` on, and share a gram."""

    def __init__(self, a: Windows, least: float):
        self.a, self.least = a, least
        self.vocabulary, self.ids = np.unique(a.grams, return_inverse=True)
        self.first_look = np.zeros(1 << FIRST_LOOK, bool)
        self.first_look[_spot(self.vocabulary)] = True
        often = np.bincount(self.ids, minlength=len(self.vocabulary))
        self.rank = np.empty(len(often), np.int64)
        self.rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        self.start = np.cumsum(a.size) - a.size
        self.all = self._postings(self.ids, a.window)
        order = np.lexsort((self.rank[self.ids], a.window))
        nth = np.arange(len(order)) - np.repeat(self.start, a.size)
        prefix = order[nth < np.repeat(a.size - self.needed(a.size) + 1, a.size)]
        self.prefix = self._postings(self.ids[prefix], a.window[prefix])

    def needed(self, size: np.ndarray) -> np.ndarray:
        """Common grams that a pair has at least whose smaller window has `size`; one less where rounding could matter."""
        return np.maximum(1, np.ceil(self.least * size - 1e-6).astype(np.int64))

    def _postings(self, ids: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.bincount(ids, minlength=len(self.vocabulary))
        return np.cumsum(count) - count, count, windows[np.argsort(ids, kind="stable")]

    def pairs(self, b: Windows, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (window of a, window of b, containment). wanted: which windows of a still count; read at every step."""
        if not len(self.vocabulary) or not len(b.grams):
            return
        seen = np.flatnonzero(self.first_look[_spot(b.grams)])
        at = np.minimum(np.searchsorted(self.vocabulary, b.grams[seen]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == b.grams[seen]
        ids, window = at[same], b.window[seen[same]]
        rows = max(1, MARKS // len(self.vocabulary))
        marks = np.zeros((min(rows, len(b.size)), len(self.vocabulary)), bool)
        for first in range(0, len(b.size), rows):
            x, y = np.searchsorted(window, [first, first + rows])
            if x == y:
                continue
            own, w = ids[x:y], window[x:y] - first
            marks[w, own] = True
            yield from self._near(b.size[first : first + rows], own, w, marks, first, wanted)
            marks[w, own] = False

    def _near(self, size: np.ndarray, ids: np.ndarray, w: np.ndarray, marks: np.ndarray, base: int, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # where a has the smaller window, the rarest of its grams meet all of b's; else the rarest of b's meet all of a's
        found = self._meeting(self.prefix, ids, w, size, False)
        common = np.bincount(w, minlength=len(size))
        need = self.needed(size)
        order = np.lexsort((self.rank[ids], w))
        nth = np.arange(len(w)) - np.repeat(np.cumsum(common) - common, common)
        rare = order[nth < np.repeat(common - need + 1, common)]
        found += self._meeting(self.all, ids[rare], w[rare], size, True)
        codes = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        i, j = codes // len(size), codes % len(size)
        step = max(1, HELD // int(self.a.size.max()))
        for s in range(0, len(codes), step):
            p, q = i[s : s + step], j[s : s + step]
            if wanted is not None:
                stay = wanted[p]
                p, q = p[stay], q[stay]
            if not len(p):
                continue
            count = self.a.size[p]
            hit = marks[np.repeat(q, count), self.ids[expanded(self.start[p], count)]]
            both = np.add.reduceat(hit, np.cumsum(count) - count, dtype=np.int64)
            least = np.minimum(count, size[q])
            alike = both >= self.needed(least)
            yield p[alike], q[alike] + base, both[alike] / least[alike]

    def _meeting(self, postings: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, w: np.ndarray, size: np.ndarray, larger: bool) -> list[np.ndarray]:
        """Numbers (window of a) * windows of b + (window of b) of those with a posting in common."""
        start, count, windows = postings
        some = count[ids] > 0
        ids, w = ids[some], w[some]
        ends, out, done = np.cumsum(count[ids]), [], 0
        while done < len(ids):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HELD, "right")))
            part, own = ids[done:stop], w[done:stop]
            a, b = windows[expanded(start[part], count[part])], np.repeat(own, count[part])
            fits = (self.a.size[a] > size[b]) == larger
            out.append(np.unique(a[fits] * len(size) + b[fits]))
            done = stop
        return out


def largest(index: Index, texts: list[str], best: np.ndarray, limit: int) -> None:
    """Raise `best` (an entry for each text of the index) to the largest containment of its windows in those of `texts`.

    What is contained whole is not compared again.
    """
    for start, stop in text_slices(texts):
        wanted = (best < 1.0)[index.a.owner]
        if not wanted.any():
            return
        for a, _, share in index.pairs(Windows(texts[start:stop], limit), wanted):
            np.maximum.at(best, index.a.owner[a], share)
            wanted[:] = (best < 1.0)[index.a.owner]


def contains_some(index: Index, texts: list[str], limit: int) -> np.ndarray:
    """Of each text whether one of its windows and one of the index have all grams of the smaller one in common."""
    out = np.zeros(len(texts), bool)
    for start, stop in text_slices(texts):
        b = Windows(texts[start:stop], limit)
        for _, j, share in index.pairs(b):
            out[start + b.owner[j[share >= 1.0]]] = True
    return out


class Hasher:
    """Simhashes as of `similarity.simhash`, of texts that `similarity.plain` made; md5 is taken once for each gram."""

    def __init__(self):
        self.md5: dict[int, int] = {}

    def _md5(self, grams: np.ndarray) -> np.ndarray:
        if len(self.md5) > REMEMBERED:
            self.md5.clear()
        out = np.empty(len(grams), U)
        for i, g in enumerate(grams.tolist()):
            if (h := self.md5.get(g)) is None:
                text = "".join(chr((g >> shift & 0x1FFFFF) - 1) for shift in (42, 21, 0))
                h = self.md5[g] = int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big")
            out[i] = h
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for start, stop in text_slices(texts):
            points, starts = code_points([t[:HASHED] for t in texts[start:stop]])
            count = np.maximum(np.diff(starts) - 2, 0)
            runs = points[:-2] << U(42) | points[1:-1] << U(21) | points[2:]
            ids, grams = pd.factorize(runs[expanded(starts[:-1], count)])
            hashes, some = self._md5(grams), np.flatnonzero(count)
            value, first = np.zeros(len(count), U), (np.cumsum(count) - count)[some]
            # four bits are counted at once, 16 bits wide each: a text has fewer than 2^16 grams
            for b in range(0, 64, 4) if len(some) else ():
                wide = sum((hashes >> U(b + j) & U(1)) << U(16 * j) for j in range(4))
                ones = np.add.reduceat(wide[ids], first)
                for j in range(4):
                    more = 2 * (ones >> U(16 * j) & U(0xFFFF)).astype(np.int64) > count[some]
                    value[some] |= more.astype(U) << U(b + j)
            out.append(value.view(np.int64))
        return np.concatenate(out)
