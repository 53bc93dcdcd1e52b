"""Bringing together records that have keys (chunks, bands) in common, whatever the keys' frequencies.

How often keys occur is counted over all records in 2**18 hashed counters, whose number does not grow with the data. The
counters decide nothing but how the work is split: a key that is frequent, above what a counter receives by chance, deals
its records into parts, and any two parts meet under a key of their own, so that no task holds all records of a key and
every pair still meets once.

A pair leaves the join only if the sketches of its texts agree: 128 bits, one from the least hash of the runs of 8
characters in each of 128 bins. Texts alike by 0.6 agree in 102 bits on average, with a standard deviation of 4.5; 86 are
asked for, which loses such a pair with a probability of 0.0003. Texts alike by 0.1 agree in 70.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._alike import RUN
from pagesift.llm._chars import U, code_points, mix, rolling, window_owner

BITS = 128
LEAST_BITS = 86
COUNTERS = 1 << 18
SLICE = 1 << 14
SALTS = 256
#: Records of a key that meet in one task.
HOT = 1000
_DRAWS = 40


def filled(low: np.ndarray, empty: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows of bins in which each empty bin takes the value of another one, drawn alike for all rows.

    Texts with few distinct runs leave bins empty; the draws are the same for every text, so two texts still agree in a
    bin about as often as they are alike. A row without any full bin stays as it is.
    """
    bins = low.shape[1]
    for turn in range(1, _DRAWS):
        at, column = np.nonzero(empty)
        if not len(at):
            break
        source = (mix(U((seed << 48) + (turn << 32)) + column.astype(U)) % U(bins)).astype(np.int64)
        taken = ~empty[at, source]
        low[at[taken], column[taken]] = low[at[taken], source[taken]]
        # bins filled in this turn lend nothing before the next
        empty[at[taken], column[taken]] = False
    return low


def sketches(texts: list[str]) -> np.ndarray:
    """Of each bare text its sketch, as two signed 64-bit numbers."""
    points, starts = code_points(texts)
    none = ~U(0)
    low = np.full(len(texts) * BITS, none, U)
    if len(points) >= RUN:
        at, owner = window_owner(starts, RUN)
        h = mix(rolling(points, RUN, 11))[at]
        np.minimum.at(low, owner * BITS + (h >> U(57)).astype(np.int64), mix(h))
    low = low.reshape(len(texts), BITS)
    return np.packbits((mix(filled(low, low == none)) & U(1)).astype(np.uint8), axis=1).view(np.int64)


def _listed(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.Array], np.ndarray]) -> Iterator[pa.RecordBatch]:
    counters = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        keys = keys_of(batch.column(0)).view(U)
        counters += np.bincount((mix(keys) & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    if counters.any():
        parts = counters.astype("<u4").reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(c, "<u8" if len(c) == 8 * SLICE else "<u4").astype(np.uint64) for c in parts["counts"]], axis=0)
    return pd.DataFrame({"slice": [parts["slice"].iloc[0]], "salt": [0], "counts": [total.astype("<u8").tobytes()]})


def summed(parts: DataFrame, keys: list[str], form: str, added) -> list:
    """Rows of `parts` added up per key by `added`; in two steps, the first by part of the input, where there are many."""
    if parts.rdd.getNumPartitions() > SALTS:
        parts = parts.withColumn("salt", F.spark_partition_id() % SALTS).groupBy(*keys, "salt").applyInPandas(added, form)
    return parts.withColumn("salt", F.lit(0)).groupBy(*keys).applyInPandas(added, form).collect()


def frequencies(rows: DataFrame, column: str, keys_of: Callable[[pa.Array], np.ndarray] = _listed) -> np.ndarray:
    """Counters of all keys in an array column of a table, added up in two steps before they reach the driver (2 MB).

    keys_of: gives the keys in a batch of a column that is no array column.
    """
    form = "slice int, salt int, counts binary"
    out = np.zeros(COUNTERS, np.uint64)
    for r in summed(rows.select(column).mapInArrow(lambda batches: _count(batches, keys_of), "slice int, counts binary"), ["slice"], form, _added):
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<u8")
    return out


def frequency(counters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return counters[(mix(keys.view(U)) & U(COUNTERS - 1)).astype(np.int64)]


def hot_above(counters: np.ndarray) -> tuple[float, float]:
    """What a counter holds by chance, and how many records of a key may meet in one task."""
    usual = float(np.median(counters))
    spread = float(np.median(np.abs(counters.astype(np.float64) - usual)))
    return usual, HOT + 15 * spread


#: A row per record and key; `meta` packs what the key stands for in units (7 bits from bit 20), the units that a pair must
#: share at least (from bit 27), the part that a frequent key dealt the record to (19 bits from bit 1), and in bit 0
#: whether the key brings the records of that part together (else those of two parts).
ROWS = "key long, k long, s1 long, s2 long, meta long"
_PART, _UNITS = (1 << 19) - 1, (1 << 7) - 1


def row_batch(keys: np.ndarray, owners: np.ndarray, k: np.ndarray, s1: np.ndarray, s2: np.ndarray, units: np.ndarray, need: np.ndarray, counters: np.ndarray, limits: tuple[float, float] | None) -> pa.RecordBatch:
    """Rows of records and their keys; with `limits` (`hot_above`), frequent keys are dealt into parts."""
    key, row, part, same = dealt(counters, limits, keys, owners, k) if limits else (keys, np.arange(len(keys)), 0, True)
    o = owners[row]
    meta = (need[o].astype(np.int64) << 27) | (np.minimum(units[row], _UNITS).astype(np.int64) << 20) | (part << 1) | same
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, k[o], s1[o], s2[o], meta)], names=["key", "k", "s1", "s2", "meta"])


def dealt(counters: np.ndarray, limits: tuple[float, float], keys: np.ndarray, owners: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys and the records that own them: (key, number of the row, part, same), frequent keys by parts."""
    usual, most = limits
    often = frequency(counters, keys).astype(np.float64) - usual
    parts = np.minimum(_PART, np.maximum(1, np.ceil(np.where(often > most, 2 * often / most, 1)))).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), parts)
    if len(row) == len(keys):
        return keys, row, np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
    n = parts[row]
    other = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(parts)])[:-1], parts)
    part = (mix(k[owners][row].view(U)) % n.astype(U)).astype(np.int64)
    low, high = np.minimum(part, other).astype(U), np.maximum(part, other).astype(U)
    split = mix(keys[row].view(U) + mix((low << U(32)) + high + U(1))).view(np.int64)
    return np.where(n > 1, split, keys[row]), row, part, (part == other).astype(np.int64)


def decided(shared: DataFrame) -> DataFrame:
    """Of pairs (`a`, `b`, `shared`, `_need`), added up, those that share as much as they must."""
    sums = shared.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("_need").alias("_need"))
    return sums.where("shared >= _need").select("a", "b", "shared")


def meeting(rows: DataFrame, held: DataFrame | None = None, final: bool = True) -> DataFrame:
    """Pairs (`a` < `b`, `shared`: units of the keys in common) whose sketches agree, of rows as in `ROWS`.

    With `held` (`key`, `k`, `s1`, `s2`), pairs of a row and a held one; else pairs of two rows. A pair counts when it
    shares as many units as both of its records ask for; not `final`, it is given with these (`_need`), so that what it
    shares by other keys can be added.
    """
    x = rows.toDF("key", "x", "x1", "x2", "mx")
    y = rows.toDF("key", "y", "y1", "y2", "my") if held is None else held.select("key", F.col("k").alias("y"), F.col("s1").alias("y1"), F.col("s2").alias("y2"), F.lit(0).cast("long").alias("my"))
    apart = F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2")))
    # records of one part meet under that part's own key only
    once = F.expr("x != y") if held is not None else F.expr(f"x < y and ((mx & 1) = 1 or (mx & {_PART << 1}) != (my & {_PART << 1}))")
    need = F.greatest(F.shiftright("mx", 27), F.shiftright("my", 27))
    sums = (
        x.join(y, "key").where(once).where(apart <= BITS - LEAST_BITS)
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.sum(F.shiftright("mx", 20).bitwiseAND(F.lit(_UNITS))).alias("shared"), F.max(need).alias("_need"))
    )
    return sums.where("shared >= _need").select("a", "b", "shared") if final else sums
