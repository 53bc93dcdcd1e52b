"""Garbled text from wrong character encoding (problem 6).

A hidden Markov model with one clean state and one state per pair of encodings labels the characters of each line; each
labelled span gets the inverse transform of its state, and counts when the result is more likely than the span.

Emissions are trained here: the text of a bounded sample of rows, written in one encoding of a pair and read in the other,
gives the frequencies of the pair's state. Lines that the first model labels are left out of a second training. The clean
frequencies are those of all rows, without the lines that the trained model suspects, so that scripts and rare characters
that the sample happens to lack are known. ASCII says almost nothing and is next to neutral in every state, so only other characters
are counted. Moving between states costs `SWITCH`; states change over the clean one only, and a line ends in it.

Most lines never reach the model: the best that any path can gain over the clean one is the sum of a line's positive
log ratios, so a line in which this sum stays below the cost of a span is clean by any path.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._chars import HEADER, code_points, slices

#: (encoding the text was in, encoding it was read in), the last one first to be undone.
PAIRS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "1252"),),
    (("utf-8", "latin-1"),),
    (("utf-8", "1252"), ("utf-8", "1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "cp1251"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "koi8-r"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "gbk"),),
    (("utf-8", "cp932"),),
    (("utf-8", "big5"),),
    (("utf-8", "cp949"),),
    (("gbk", "1252"),),
    (("gbk", "big5"),),
    (("gbk", "cp932"),),
    (("gbk", "cp949"),),
    (("gbk", "cp1251"),),
    (("big5", "1252"),),
    (("big5", "gbk"),),
    (("gbk", "utf-8"),),
    (("1252", "utf-8"),),
    (("1252", "gbk"),),
)
#: Rows of the bounded training sample.
SAMPLE_ROWS = 1500
SWITCH = 3.0
#: Characters of lines that are labelled together; each takes some 30 bytes.
CELLS = 400_000
ASCII_RATIO = -0.02
CLEAN_FLOOR, STATE_FLOOR = 2e-6, 1e-7
LOST = "�"
_MULTIBYTE = ("utf-8", "gbk", "big5", "cp932", "cp949")

#: Symbols are code points; those below `_LOW` beyond ASCII count apart where they stand next to another of them: most
#: wrong readings make such neighbours, while letters with accents mostly stand alone.
_LOW = 0x3000
_SYMBOLS = 0x110000 + _LOW

_1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
_BYTES_1252 = codecs.charmap_build(_1252)
_RUN = re.compile(r"[^\x00-\x7f]{3}")
#: The one pair that leaves single characters, and characters beyond ASCII that stand by no Latin letter.
_SINGLE = (("1252", "gbk"),)
_BESIDE = re.compile(r"(?<![A-Za-z\-])[^\x00-\x7f](?![A-Za-z\-])|[^\x00-\x7f]{2}")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _read(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", _1252)[0] if encoding == "1252" else data.decode(encoding, "replace")


def _bytes(text: str, encoding: str) -> bytes:
    """Bytes that were read as `text`. Characters that no byte gives are left out; where an encoding leaves a byte open,
    the control character of the same number stands for it."""
    if encoding == "1252":
        return codecs.charmap_encode(text, "ignore", _BYTES_1252)[0]
    if encoding not in _MULTIBYTE and any("\x80" <= c <= "\x9f" for c in text):
        return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode(encoding, "ignore") for c in text)
    return text.encode(encoding, "ignore")


def garble(text: str, pair: tuple[tuple[str, str], ...]) -> str:
    """Text as it looks when it is read in the wrong encoding."""
    for written_in, read_in in pair:
        text = _read(codecs.charmap_encode(text, "ignore", _BYTES_1252)[0] if written_in == "1252" else text.encode(written_in, "ignore"), read_in)
    return text


def symbols(points: np.ndarray) -> np.ndarray:
    low = (points >= 128) & (points < _LOW)
    beside = np.zeros(len(points), bool)
    if len(points) > 1:
        both = low[1:] & low[:-1]
        beside[1:] |= both
        beside[:-1] |= both
    return np.where(beside, points + 0x110000, points).astype(np.int64)


@dataclass
class Model:
    clean: np.ndarray  # ln of the clean frequency of each symbol
    ratio: np.ndarray  # (states, symbols): ln of each state's frequency over the clean one, as numbers of a lookup
    best: np.ndarray  # the largest positive ratio of each symbol
    index: np.ndarray  # symbol -> column of ratio


def _counts(lines: list[str]) -> np.ndarray:
    n = np.zeros(_SYMBOLS, np.float64)
    if lines:
        # a line break between lines keeps neighbours apart
        n += np.bincount(symbols(code_points(["\n".join(lines)])[0]), minlength=_SYMBOLS)
    n[:128] = 0
    return n


def _fit(lines: list[str]) -> Model:
    base = _counts(lines)
    clean = np.log(np.maximum(base / max(1.0, base.sum()), CLEAN_FLOOR))
    for first in (0x80, 0x110080):  # controls are no text
        clean[first : first + 0x20] = np.log(CLEAN_FLOOR / 100)
    seen, logs = base > 0, []
    for pair in PAIRS:
        n = _counts([garble("\n".join(lines), pair)])
        logs.append(np.log(np.maximum(n / max(1.0, n.sum()), STATE_FLOOR)))
        seen = seen | (n > 0)
    columns = np.flatnonzero(seen)
    index = np.zeros(_SYMBOLS, np.int32)
    index[columns] = np.arange(1, len(columns) + 1)
    ratio = np.full((len(PAIRS), len(columns) + 1), np.log(STATE_FLOOR) - np.log(CLEAN_FLOOR), np.float32)
    ratio[:, 1:] = np.array([x[columns] - clean[columns] for x in logs])
    best = np.maximum(ratio.max(axis=0), 0)[index].astype(np.float32)
    best[:128] = 0
    index[:128] = len(columns) + 1
    ratio = np.concatenate([ratio, np.full((len(PAIRS), 1), ASCII_RATIO, np.float32)], axis=1)
    return Model(clean.astype(np.float32), ratio, best, index)


def train(texts: list[str]) -> Model:
    lines = sorted({x for t in texts for x in HEADER.sub("", t, count=1).split("\n") if not x.isascii()})
    model = _fit(lines)
    for _ in range(2):
        marked = suspicious(model, lines)
        labelled = {lines[i] for i, found in zip(marked, spans(model, [lines[i] for i in marked])) if found}
        model = _fit([x for x in lines if x not in labelled])
    return model


def suspicious(model: Model, lines: list[str]) -> np.ndarray:
    """Numbers of the lines in which some path might beat the clean one."""
    points, starts = code_points(lines)
    if not len(points):
        return np.empty(0, np.int64)
    total = np.concatenate([[0.0], np.cumsum(model.best[symbols(points)], dtype=np.float64)])
    return np.flatnonzero(total[starts[1:]] - total[starts[:-1]] >= 2 * SWITCH)


def labels(model: Model, lines: list[str]) -> list[np.ndarray]:
    """State of each character: 0 clean, k + 1 for pair k. All lines advance together, character by character."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(lines)
    s = len(PAIRS)
    a = 0
    while a < len(order):
        # so many lines together that their characters, at the longest one's length, stay within bounds
        b = a + max(1, min(256, CELLS // max(1, len(lines[order[a]]))))
        group, a = [i for i in order[a:b] if lines[i]], b
        if not group:
            continue
        longest = len(lines[group[0]])
        grid = np.zeros((len(group), longest), np.int32)
        sizes = np.array([len(lines[i]) for i in group])
        for r, i in enumerate(group):
            grid[r, : sizes[r]] = model.index[symbols(code_points([lines[i]])[0])]
        clean, bad = np.zeros(len(group)), np.full((len(group), s), -SWITCH)
        left = np.zeros((longest, len(group)), np.int16)  # pair from which the clean state was reached, -1 none
        entered = np.zeros((longest, len(group), s), bool)
        for t in range(longest):
            alive = int(np.searchsorted(-sizes, -t, "left"))  # lines are sorted, longest first
            step = model.ratio[:, grid[:alive, t]].T
            k = bad[:alive].argmax(axis=1)
            back = bad[np.arange(alive), k] - SWITCH
            left[t, :alive] = np.where(back > clean[:alive], k, -1) if t else -1
            start = clean[:alive, None] - SWITCH
            entered[t, :alive] = (start > bad[:alive]) if t else True
            bad[:alive] = np.maximum(bad[:alive], start) + step if t else -SWITCH + step
            if t:
                clean[:alive] = np.maximum(clean[:alive], back)
        for r, i in enumerate(group):
            path = np.zeros(sizes[r], np.int16)
            k = int(bad[r].argmax())
            state = k + 1 if bad[r, k] - SWITCH > clean[r] else 0
            for t in range(sizes[r] - 1, -1, -1):
                path[t] = state
                if state == 0:
                    state = left[t, r] + 1
                elif entered[t, r, state - 1]:
                    state = 0
            out[i] = path
    return out


def _likelihood(model: Model, text: str) -> tuple[float, int]:
    """Clean log likelihood of the characters beyond ASCII, lost ones and controls as unlikely as any, and their number."""
    points = code_points([text])[0]
    value = model.clean[symbols(points)]
    value[(points == ord(LOST)) | ((points >= 0x80) & (points < 0xA0)) | ((points >= 0xE000) & (points < 0xF900))] = np.log(CLEAN_FLOOR)
    return float(value[points >= 128].sum()), int((points >= 128).sum())


def _undo(text: str, pair: tuple[tuple[str, str], ...]) -> str | None:
    """Text by the inverse of the pair; None if the pair cannot have made this text."""
    for written_in, read_in in reversed(pair):
        data = _bytes(text, read_in)
        if read_in != "utf-8" and len(_read(data, read_in)) < 0.97 * (len(text) - text.count(LOST)):
            return None  # it holds what this reading never gives
        if written_in == "utf-8":
            # a stretch may hold bytes that were lost, so what can be read is read and the rest shows as lost
            high = sum(b >= 128 for b in data)
            held = sum(len(m) for m in _SEQUENCE.findall(data))
            if not high or held < 0.6 * high:
                return None
            text = data.decode("utf-8", "replace")
        else:
            text = _read(data, written_in)
    return text


def restore(model: Model, span: str, state: int) -> tuple[bool, str]:
    """Whether a labelled span was decoded wrongly, and its text by the inverse transform of its state.

    What is lost in the wrong reading cannot be had again and stays as U+FFFD. A span counts when the inverse is a
    possible text that is clearly more likely than the span itself, or when characters were lost inside of words. The
    other states are tried after the span's own, as readings that differ in few characters are easily taken for each other.
    """
    before, n = _likelihood(model, span)
    if not n:
        return False, span
    for k in (state - 1, *(j for j in range(len(PAIRS)) if j != state - 1)):
        pair = PAIRS[k]
        if pair[-1][1] == "utf-8":
            continue
        text = _undo(span, pair)
        if text is None or text == span:
            continue
        after, m = _likelihood(model, text)
        if text.count(LOST) > 0.34 * len(text):
            continue
        if pair[0][0] == "utf-8":
            # valid sequences are hard to meet by chance
            if after - before > 4 + 2 * text.count(LOST) and (m > 2 or after > -10.5 * m):
                return True, text
        elif pair == _SINGLE and not _BESIDE.search(span) and n <= 2 * m and after - before > 4.0 * n and after > -9.5 * m:
            return True, text  # accented letters swallow the letter that follows: single characters inside of words
        # any bytes make some text in other encodings: the text must be a common one, by many characters
        elif n >= 4 and m >= 2 and after - before > 2.0 * n and after > -9.0 * m and _RUN.search(span):
            return True, text
    if re.search(r"\w�|�\w|��", span):
        return True, span
    return False, span


def spans(model: Model, lines: list[str]) -> list[list[tuple[int, int, str]]]:
    """Of each line the wrongly decoded stretches: (start, end, restored text)."""
    out = []
    for line, path in zip(lines, labels(model, lines)):
        found = []
        edges = np.flatnonzero(np.diff(path)) + 1 if len(path) else []
        at = [0, *map(int, edges), len(line)]
        for a, b in zip(at, at[1:]):
            if b <= a or not path[a]:
                continue
            while a < b and line[a].isascii():
                a += 1
            while b > a and line[b - 1].isascii():
                b -= 1
            if a < b:
                wrong, text = restore(model, line[a:b], int(path[a]))
                if wrong:
                    found.append((a, b, text))
        out.append(found)
    return out


def repaired(model: Model, lines: list[str]) -> tuple[list[str], dict[int, int]]:
    """The lines with their wrong stretches restored, and how many each line had.

    What was garbled more than once is restored again, as long as restored lines hold wrong stretches that can be put
    right, three times at most.
    """
    lines, had, todo = list(lines), {}, suspicious(model, lines)
    for turn in range(3):
        changed = []
        for j, found in zip(todo, spans(model, [lines[j] for j in todo])):
            if found and turn == 0:
                had[int(j)] = len(found)
            new = lines[j]
            for a, b, text in reversed(found):
                new = new[:a] + text + new[b:]
            if new != lines[j]:
                lines[j] = new
                changed.append(int(j))
        again = suspicious(model, [lines[j] for j in changed])
        todo = np.array(changed, np.int64)[again]
        if not len(todo):
            break
    return lines, had


def _clean_symbols(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = sent.value, np.zeros(_SYMBOLS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                lines = [x for t in texts[a:b] for x in HEADER.sub("", t, count=1).split("\n") if not x.isascii()]
                skip = set(suspicious(model, lines).tolist())
                points = code_points(["\n".join(x for i, x in enumerate(lines) if i not in skip)])[0]
                seen += np.bincount(symbols(points), minlength=_SYMBOLS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["symbol", "n"])

    return run


def recounted(model: Model, counts: dict[int, int]) -> Model:
    """The model with clean frequencies counted over all data; those of the states stay."""
    base = np.zeros(_SYMBOLS)
    base[list(counts)] = list(counts.values())
    base[:128] = 0
    clean = np.log(np.maximum(base / max(1.0, base.sum()), CLEAN_FLOOR)).astype(np.float32)
    for first in (0x80, 0x110080):
        clean[first : first + 0x20] = np.log(CLEAN_FLOOR / 100)
    columns = np.flatnonzero(model.index[128:]) + 128
    ratio = model.ratio.copy()
    ratio[:, model.index[columns]] += model.clean[columns] - clean[columns]
    best = np.maximum(ratio.max(axis=0), 0)[model.index].astype(np.float32)
    best[:128] = 0
    return Model(clean, ratio, best, model.index)


def garbled(rows: DataFrame, key: str = "entry_id", text: str = "body", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows with a wrongly decoded stretch: (`key`, `stretches`, `restored`).

    rows: a table with a bigint `key` and a string `text`, and any other columns. A leading header line does not count.
    restored: the text with every stretch put right where it can be, U+FFFD where bytes were lost. Null and empty texts
    have no stretches; a table without text gives an empty result. The states of the model are trained on `sample_rows`
    rows, those with the least hash of their key, so the same table gives the same model. Each line is handled for itself;
    a line of a million characters takes some 30 MB.
    """
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    # first those that may be among the least hashes, so that no task hands on more than its part of the sample
    share = min(1.0, 2.0 * sample_rows / max(1, source.count()))
    likely = source.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    sample = [r[0] for r in likely.orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 20)), "key", "text").limit(sample_rows).select("text").collect()]
    context, model = rows.sparkSession.sparkContext, train(sample)
    # rows of the histogram: as many as there are different characters
    counts = source.select("text").mapInArrow(_clean_symbols(context.broadcast(model)), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    sent = context.broadcast(recounted(model, {r["symbol"]: r["n"] for r in counts.collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, counts, fixed = [], [], []
            for a, b in slices(texts):
                heads = [m.end() if (m := HEADER.match(t)) else 0 for t in texts[a:b]]
                lines, owner = [], []
                for i, (t, h) in enumerate(zip(texts[a:b], heads)):
                    own = t[h:].split("\n")
                    lines += own
                    owner += [i] * len(own)
                lines, had = repaired(model, lines)
                hit: dict[int, int] = {}
                for j, n in had.items():
                    hit[owner[j]] = hit.get(owner[j], 0) + n
                if hit:
                    own_lines: dict[int, list[str]] = {i: [] for i in hit}
                    for i, line in zip(owner, lines):
                        if i in own_lines:
                            own_lines[i].append(line)
                    for i in sorted(hit):
                        ids.append(keys[a + i])
                        counts.append(hit[i])
                        fixed.append(texts[a + i][: heads[i]] + "\n".join(own_lines[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(fixed, pa.string())], names=["key", "stretches", "restored"])

    return source.mapInArrow(run, "key long, stretches int, restored string").withColumnRenamed("key", key)
