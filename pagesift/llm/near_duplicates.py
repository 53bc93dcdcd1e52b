"""Near-duplicate records with small edits (problem 4).

Improved consistent weighted sampling over TF-IDF shingles, banded, verified by the weighted Jaccard similarity of the
whole shingle sets and then by the plain share that defines "alike".

Shingles are the distinct runs of 8 characters of the bare body, the unit in which "alike" is defined for these tables.
The weight of a shingle grows with its frequency in the text and its rarity among all texts, between 1 and
`TF_PART * IDF_PART` = 1.5. The bound matters: "alike" is a plain share, and a reprint of a much-copied text has its
frequent, light shingles in common and its rare, heavy ones not. With the bound a pair with a plain share of 0.6 has a
weighted similarity of 0.5 or more where the shingles of both texts are about as frequent in either, and never less than
0.4, whatever the corpus; so `LEAST_WEIGHTED` = 0.4 drops no pair of the definition.

Document frequencies are counted over all rows in a table of 2**18 hashed counters, whose size does not grow with the
data; a counter is too high by at most the share of all shingles that it receives by chance, the same at every size,
which is what `IDF_FLOOR` levels out.

Sampling cost does not grow with the number of samples: each of 3 repetitions deals the shingles of a text to 48 bins and
keeps the consistent weighted sample of each bin; a bin that is left empty, as in texts with few different shingles, takes
the sample of another one, drawn alike for all texts. The samples of the 3 repetitions in one bin make a band. Two texts
meet in a band with the third power of their weighted similarity, in some of 48 bands with a probability of 0.99998 at 0.6,
0.998 at 0.5 and 0.957 at 0.4. Chance pairs are dropped by their sketches before they leave the join (`_meet`), and a band
that very many texts share is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm._alike import LEAST_CHARS, LEAST_SHARE, RUN, checked_pairs, content_key
from pagesift.llm._chars import U, bare, code_points, mix, rolling, slices, window_owner
from pagesift.llm._meet import ROWS, filled, frequencies, hot_above, meeting, row_batch, sketches, summed
from pagesift.operators.dedup import components
from pagesift.session import written

COUNTERS = 1 << 18
SLICE = 1 << 14
IDF_FLOOR = 0.003
REPEATS = 3
BINS = 48
#: Most that frequency in the text, and rarity among texts, may add to the weight of a shingle.
TF_PART, IDF_PART = 1.2, 1.25
LEAST_WEIGHTED = 0.4
_FREQUENT = 8
_LEVELS = 1 << 12


def _gamma2(levels: int) -> np.ndarray:
    """Mid-quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    q = (np.arange(levels) + 0.5) / levels
    low, high = np.zeros(levels), np.full(levels, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma2(_LEVELS).astype(np.float32)
_LN_C = np.log(_gamma2(_LEVELS)).astype(np.float32)
_BETA = ((np.arange(_LEVELS) + 0.5) / _LEVELS).astype(np.float32)


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (number of the text, hash, how often)."""
    points, starts = code_points(texts)
    if len(points) < RUN:
        none = np.empty(0, np.int64)
        return none, none.astype(U), none
    at, owner = window_owner(starts, RUN)
    both = np.sort((owner.astype(U) << U(44)) | (mix(rolling(points, RUN, 11))[at] >> U(20)))  # 44 bits of hash
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
    tf = np.diff(np.append(first, len(both)))
    both = both[first]
    return (both >> U(44)).astype(np.int64), mix(both & U((1 << 44) - 1)), tf


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its content key; per partition the counters, as slices."""
    counters, rows = np.zeros(COUNTERS, np.int64), 0
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary()), ("texts", pa.int64())])
    for batch in batches:
        kept = [(i, t) for i, t in zip(batch.column(0).to_pylist(), map(bare, batch.column(1).to_pylist())) if len(t) >= LEAST_CHARS]
        texts = [t for _, t in kept]
        for a, b in slices(texts):
            counters += np.bincount((_shingles(texts[a:b])[1] & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        rows += len(kept)
        keys = [content_key(t) for t in texts]
        n = len(kept)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=schema)
    if rows:
        parts = counters.astype("<u4").reshape(-1, SLICE)
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [pa.array(range(n), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([rows] + [0] * (n - 1), pa.int64())], schema=schema)


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(c, "<u8" if len(c) == 8 * SLICE else "<u4").astype(np.uint64) for c in parts["counts"]], axis=0)
    return pd.DataFrame({"slice": [parts["slice"].iloc[0]], "salt": [0], "counts": [total.astype("<u8").tobytes()], "texts": [int(parts["texts"].sum())]})


def document_frequencies(scanned: DataFrame) -> tuple[np.ndarray, int]:
    """The counters added up (in two steps, so that no task sees all partitions), and the number of texts.

    What comes to the driver is 2**18 numbers, whatever the data.
    """
    form = "slice int, salt int, counts binary, texts long"
    rows = summed(scanned.where(F.col("slice").isNotNull()).select("slice", "counts", "texts"), ["slice"], form, _added)
    counts, n = np.zeros(COUNTERS, np.uint64), 0
    for r in rows:
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<u8")
        n += r["texts"]
    return counts, n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    """Of each counter the part of a weight that rarity gives: 1 for shingles of all texts, `IDF_PART` for the rarest."""
    idf = -np.log(np.minimum(1.0, counts / max(1, n) + IDF_FLOOR)) / -np.log(IDF_FLOOR)
    return (1 + (IDF_PART - 1) * idf).astype(np.float32)


def weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + (TF_PART - 1) * np.minimum(1, np.log(tf) / np.log(_FREQUENT))).astype(np.float32) * idf


def band_hashes(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Of each text its `BINS` bands, as scrambled 64-bit numbers."""
    owner, h, tf = _shingles(texts)
    ln_w = np.log(weights(tf, idf[(h & U(COUNTERS - 1)).astype(np.int64)]))
    bands, low, none = np.zeros((len(texts), BINS), U), U(_LEVELS - 1), ~U(0)
    for k in range(REPEATS):
        x = mix(h ^ U(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        r = _R[(x & low).astype(np.int32)]
        beta = _BETA[((x >> U(12)) & low).astype(np.int32)]
        ln_c = _LN_C[((x >> U(24)) & low).astype(np.int32)]
        t = np.floor(ln_w / r + beta)
        ln_a = ln_c - r * (t - beta) - r
        place = owner * BINS + ((x >> U(36)) % U(BINS)).astype(np.int64)
        what = mix(x ^ (t.astype(np.int64).astype(U) * U(0xD6E8FEB86659FD93))) >> U(20)
        packed = (np.clip((ln_a + 70) * (1 << 20) / 84, 0, (1 << 20) - 1).astype(U) << U(44)) | what
        least = np.full(len(texts) * BINS, none, U)
        np.minimum.at(least, place, packed)
        least = least.reshape(len(texts), BINS)
        bands = mix(bands * U(0x9FB21C651E98DF25) ^ (filled(least, least == none, k) & U((1 << 44) - 1)))
    return mix(bands ^ (np.arange(BINS).astype(U) * U(0xC2B2AE3D27D4EB4F)))


def weighted_shingles(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their weights."""
    t = bare(text)
    h, n = np.unique(mix(rolling(code_points([t])[0], RUN, 11)) if len(t) >= RUN else np.empty(0, U), return_counts=True)
    return h, weights(n, idf[(mix(h >> U(20)) & U(COUNTERS - 1)).astype(np.int64)])


def measures(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Of all shingles of two texts: the share that both have, and the sum of the lesser over the sum of the greater
    weights."""
    (h, wx), (g, wy) = x, y
    both, ix, iy = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    common = np.minimum(wx[ix], wy[iy]).sum()
    return both.size / max(1, h.size + g.size - both.size), float(common / max(1e-9, wx.sum() + wy.sum() - common))


_BANDED = "id long, k long, s1 long, s2 long, bands array<long>"


def _banding(idf_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_of.value
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), map(bare, batch.column(1).to_pylist())):
                if len(t) >= LEAST_CHARS:
                    ids.append(i)
                    texts.append(t)
            for a, b in slices(texts):
                bands, drawn = band_hashes(texts[a:b], idf), sketches(texts[a:b])
                keys = pa.array([content_key(t)[0] for t in texts[a:b]], pa.int64())
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * BINS)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), keys, pa.array(drawn[:, 0]), pa.array(drawn[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64)))], names=["id", "k", "s1", "s2", "bands"])

    return run


def _spread(batches: Iterator[pa.RecordBatch], counters: np.ndarray, limits: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(3)
        keys = column.flatten().to_numpy(zero_copy_only=False)
        owners = np.repeat(np.arange(len(batch)), np.diff(column.offsets.to_numpy()))
        k, s1, s2 = (batch.column(i).to_numpy() for i in range(3))
        yield row_batch(keys, owners, k, s1, s2, np.ones(len(keys), np.int64), np.zeros(len(k), np.int64), counters, limits)


def near_duplicates(rows: DataFrame, key: str = "entry_id", text: str = "body", least: float = LEAST_SHARE, least_weighted: float = LEAST_WEIGHTED) -> tuple[DataFrame, DataFrame]:
    """Pairs of different alike texts, and which rows hold each text.

    rows: any table with a unique bigint `key` and a string column `text`; further columns, whatever their names, are
    not read. Result: pairs (`a1`, `a2`, `b1`, `b2`, `share`, `weighted`) between content keys, with
    the share of shingles in both (`least` or more) and the weighted Jaccard similarity (`least_weighted` or more: a
    higher one asks for more than the definition of these tables), and members (`id`, `k1`, `k2`), a row
    for each input row with a bare text of 200 characters or more. Shorter, empty and null texts are never alike and are
    left out; rows with the same text share a content key and make no pair here. A null `key` is kept as a member. An
    empty table gives two empty tables.
    """
    source = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    spark = rows.sparkSession
    scanned = written(source.mapInArrow(_scan, "id long, k1 long, k2 long, slice int, counts binary, texts long"), "shingles")
    members = scanned.where(F.col("slice").isNull()).select("id", "k1", "k2")
    counts, n = document_frequencies(scanned)
    idf = spark.sparkContext.broadcast(inverse_frequencies(counts, n))
    classes = members.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    banded = written(source.mapInArrow(_banding(idf), _BANDED), "bands")
    counters = frequencies(banded, "bands")
    often = spark.sparkContext.broadcast((counters, hot_above(counters)))
    # each distinct text meets others once, by one of its rows
    distinct = banded.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("k", "s1", "s2", "bands")
    met = meeting(distinct.mapInArrow(lambda batches: _spread(batches, *often.value), ROWS))

    @F.pandas_udf(T.StructType([T.StructField("share", T.DoubleType()), T.StructField("weighted", T.DoubleType())]))
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known = lru_cache(256)(lambda t: weighted_shingles(t, idf.value))
        return pd.DataFrame([measures(known(x), known(y)) for x, y in zip(a, b)], columns=["share", "weighted"], dtype="float64")

    pairs = checked_pairs(written(met.select("a", "b"), "met"), classes, source, least, measure)
    return pairs.where(F.col("weighted") >= least_weighted), members


def alike_entries(rows: DataFrame, key: str = "entry_id", text: str = "body", least: float = LEAST_SHARE) -> DataFrame:
    """All pairs of rows with alike texts (`entry_a` < `entry_b`): of one text, and of the texts that pair."""
    pairs, members = near_duplicates(rows, key, text, least)
    pairs = written(pairs, "alike")
    m = members.select(F.col("id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    n = members.select(F.col("id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    same = m.join(n, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y")
    across = pairs.join(m, ["a1", "a2"]).join(n, ["b1", "b2"]).select("x", "y")
    return same.union(across).select(F.least("x", "y").alias("entry_a"), F.greatest("x", "y").alias("entry_b")).distinct()


def groups(rows: DataFrame, key: str = "entry_id", text: str = "body", least: float = LEAST_SHARE) -> DataFrame:
    """Each row with a text of 200 characters or more: (`key`, `group`, `links`).

    group: the least key of the connected component of alike texts; links: with how many other distinct texts the row's
    text pairs. Copies of one text are in one group and share their links.
    """
    pairs, members = near_duplicates(rows, key, text, least)
    pairs, one = written(pairs, "alike"), F.lit(1)
    texts = members.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    ends = pairs.join(texts.toDF("a1", "a2", "a"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "b"), ["b1", "b2"]).select(one.alias("all"), "a", "b")
    labels = components(ends, texts.select(one.alias("all"), F.col("rep").alias("id")), "all")
    links = ends.select("a", "b").union(ends.select("b", "a")).groupBy(F.col("a").alias("rep")).agg(F.count(one).alias("links"))
    known = texts.join(labels.select(F.col("id").alias("rep"), F.col("cluster").alias("group")), "rep").join(links, "rep", "left")
    return members.join(known, ["k1", "k2"]).select(F.col("id").alias(key), "group", F.coalesce("links", F.lit(0)).alias("links"))
