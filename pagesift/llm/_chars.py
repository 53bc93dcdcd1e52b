"""Texts of a batch as arrays of code points, so that work per character is vectorised."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: A leading header line: up to three #, the word 来源, a colon, the address.
HEADER = re.compile(r"\A\s*#{0,3}\s*来源\s*[:：]\s*\S+")
#: At most so many characters are worked on at a time (a longer text makes a slice of its own).
SLICE_CHARS = 1_000_000

U = np.uint64


def without_header(text: str | None) -> str:
    return HEADER.sub("", text, count=1) if text else ""


def bare(text: str | None) -> str:
    """Without a leading header line and without Unicode white space."""
    return "".join(without_header(text).split())


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with at most `most` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text starts (one more entry than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def rolling(points: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of `width` code points (a power of two), in log2(width) steps; not yet scrambled."""
    h = points.astype(U) + U(seed)
    step, k = 1, 0
    while step < width:
        factor = U((0x9E3779B97F4A7C15 * (2 * k + 3) + 2 * seed) & 0xFFFFFFFFFFFFFFFF | 1)
        h = h[:-step] * factor + h[step:]
        h ^= h >> U(29)
        step, k = step * 2, k + 1
    return h


def window_owner(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that lie within one text, and the number of that text."""
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(counts.sum()) - first[owner] + starts[:-1][owner], owner


def _normal_forms() -> np.ndarray:
    """For each code point below 0x20000 the letter or digit it counts as, 0 for any other character."""
    forms = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if not ch.isalnum():
            continue
        if 0xFF00 <= c <= 0xFFEF:
            ch = unicodedata.normalize("NFKC", ch)
        low = ch.lower()
        forms[c] = ord(low) if len(low) == 1 else ord(low[0])
    return forms


_forms: np.ndarray | None = None


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in one case and width, and where each text starts."""
    global _forms
    if _forms is None:
        _forms = _normal_forms()
    points, starts = code_points(texts)
    form = _forms[points]
    kept = np.concatenate([[0], np.cumsum(form > 0)])
    return form[form > 0], kept[starts]
