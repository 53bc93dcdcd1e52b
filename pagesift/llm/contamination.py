"""Evaluation texts leaking into training text (problem 7).

Spaced-seed hashing: texts become sequences of letters and digits; fixed masks over 24 of them ignore some positions, and
hashes of the positions that count are joined between evaluation passages and documents, so that a passage is found though
letters at ignored positions were replaced. Around each hit the overlap is verified on its diagonal, first with
substitutions allowed, then as the longest run without any.

Every position of every passage and every document is hashed, so a common run of 24 or more characters always makes hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._chars import U, letters, mix, slices

SPAN = 24
#: Positions that count (1) and that are ignored (0).
MASKS = ("110110100111001011011011", "101101110010110100111101", "111001011101101001101101")
LEAST_RUN = 50
#: Up to so many evaluation characters the passages go to all executors; beyond, hashes are joined by shuffle.
MOST_SENT = 1_000_000
_FILTER_BITS = 22


def seeds(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window lies within one text, and their hashes, a row per mask."""
    n = len(chars) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty((len(MASKS), 0), U)
    at = np.arange(n)
    at = at[np.searchsorted(starts, at, "right") == np.searchsorted(starts, at + SPAN - 1, "right")]
    x = mix(chars.astype(U))
    hashes = np.empty((len(MASKS), len(at)), U)
    for m, mask in enumerate(MASKS):
        h = np.full(n, U(m + 1))
        for k, bit in enumerate(mask):
            if bit == "1":
                h = h * U(0x9E3779B97F4A7C15) + x[k : k + n]
        hashes[m] = mix(h)[at]
    return at, hashes


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, at: int) -> tuple[int, int, int]:
    """Around item position `at`, on the diagonal doc = item + shift: (longest exact run, length and matches of the
    stretch with substitutions allowed). The stretch is the best by matches minus three per substitution, through `at`."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[low + shift : high + shift] == item[low:high]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    score = np.where(same, 1, -3)
    mid = at - low
    right, left = np.cumsum(score[mid:]), np.cumsum(score[:mid][::-1])
    end = mid + int(np.argmax(right)) + 1 if len(right) else mid
    begin = mid - (int(np.argmax(left)) + 1 if len(left) and left.max() > 0 else 0)
    return longest, end - begin, int(same[begin:end].sum())


def _found(texts: list[str], keys: list[int], passages: dict, hashes: np.ndarray, holders: np.ndarray, places: np.ndarray, maybe: np.ndarray) -> list[tuple]:
    chars, starts = letters(texts)
    at, own = seeds(chars, starts)
    hits = []
    for h in own:
        some = np.flatnonzero(maybe[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
        first = np.searchsorted(hashes, h[some], "left")
        last = np.searchsorted(hashes, h[some], "right")
        for pos, a, b in zip(at[some[last > first]], first[last > first], last[last > first]):
            hits += [(int(pos), j) for j in range(a, b)]
    out, done = [], set()
    for pos, j in sorted(hits):
        d = int(np.searchsorted(starts, pos, "right")) - 1
        item, place = int(holders[j]), int(places[j])
        shift = pos - int(starts[d]) - place
        if (d, item, shift) in done:
            continue
        done.add((d, item, shift))
        longest, length, matches = overlap(chars[starts[d] : starts[d + 1]], passages[item], shift, place)
        out.append((item, keys[d], longest, length, matches, len(passages[item])))
    return out


_FORM = "item_id long, doc_id long, run int, length int, matches int, passage int"


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", most_sent: int = MOST_SENT) -> DataFrame:
    """Overlaps of documents and evaluation passages: (`item_id`, `doc_id`, `run`, `share`).

    run: longest run of letters and digits in common without a substitution, on any diagonal with a hit. share: part of the
    passage that the best overlap with substitutions covers. One row per pair with a hit. Letter case, full- or half-width
    form and all other characters do not matter. Null or empty texts and passages, and passages of fewer than 24 letters
    and digits, have no overlap; rows with a null id are left out. Evaluation passages are few: up to `most_sent`
    characters they are sent to all executors; a larger set is joined by its hashes instead.
    """
    tests = items.select(F.col(item).cast("long"), F.col(passage).cast("string")).dropna()
    docs = documents.select(F.col(key).cast("long"), F.col(text).cast("string")).dropna()
    size = tests.agg(F.coalesce(F.sum(F.length(passage)), F.lit(0))).first()[0]
    found = _leaks_sent(docs, tests) if size <= most_sent else _leaks_joined(docs, tests)
    return found.groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), F.max(F.col("matches") / F.col("passage")).alias("share"))


def _leaks_sent(docs: DataFrame, tests: DataFrame) -> DataFrame:
    rows = tests.distinct().collect()
    chars, starts = letters([r[1] for r in rows])
    at, hashes = seeds(chars, starts)
    owner = np.searchsorted(starts, at, "right") - 1
    place = at - starts[owner]
    all_hashes = hashes.reshape(-1)
    order = np.argsort(all_hashes, kind="stable")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(all_hashes >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
    # a passage is known by its row, as an id may come with several passages
    passages = {i: chars[starts[i] : starts[i + 1]] for i in range(len(rows))}
    ids = [r[0] for r in rows]
    sent = docs.sparkSession.sparkContext.broadcast((passages, ids, all_hashes[order], np.tile(owner, len(MASKS))[order], np.tile(place, len(MASKS))[order], np.packbits(maybe)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, ids, hashes, holders, places, bits = sent.value
        maybe = np.unpackbits(bits).view(bool)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for a, b in slices(texts):
                out += _found(texts[a:b], keys[a:b], passages, hashes, holders, places, maybe)
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            columns[0] = [ids[i] for i in columns[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "doc_id", "run", "length", "matches", "passage"])

    return docs.mapInArrow(search, _FORM)


def _seed_rows(rows: DataFrame, names: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            for a, b in slices(texts):
                chars, starts = letters(texts[a:b])
                at, hashes = seeds(chars, starts)
                owner = np.searchsorted(starts, at, "right") - 1
                for h in hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[a:b][owner]), pa.array((at - starts[owner]).astype(np.int32))], names=names.split())

    kinds = dict(zip(names.split(), ("long", "long", "int")))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds.items()))


def _leaks_joined(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """By a join of hashes; diagonals with a hit, then the texts that belong to them."""
    numbered = tests.distinct().withColumn("row", F.xxhash64(*tests.columns))
    diagonals = (
        _seed_rows(docs, "hash doc doc_at").join(_seed_rows(numbered.select("row", tests.columns[1]), "hash item item_at"), "hash")
        .groupBy("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.min("item_at").alias("at"))
    )
    t, d = numbered.toDF("item_id", "passage_text", "item"), docs.toDF("doc", "doc_text")
    joined = diagonals.join(t, "item").join(d, "doc").select("item_id", "passage_text", "doc", "doc_text", "shift", "at")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, p, k, text, shift, at in zip(*(c.to_pylist() for c in batch.columns)):
                item, doc = letters([p])[0], letters([text])[0]
                out.append((i, k, *overlap(doc, item, shift, at), len(item)))
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*out)) or [[]] * 6, types)], names=["item_id", "doc_id", "run", "length", "matches", "passage"])

    return joined.mapInArrow(verify, _FORM)
