"""Alike texts: the exact check that follows the candidate searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm._chars import bare, code_points, mix, rolling, slices

RUN = 8
#: Pairs whose texts are taken apart together.
PAIRS = 64
LEAST_CHARS = 200
LEAST_SHARE = 0.6


def content_key(text: str) -> tuple[int, int]:
    """128 bits of a bare text, as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _runs_of(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the distinct runs of its bare form, sorted."""
    points, starts = code_points(list(map(bare, texts)))
    h = mix(rolling(points, RUN, 11)) if len(points) >= RUN else np.empty(0, np.uint64)
    each = [np.sort(h[a : max(a, b - RUN + 1)]) for a, b in zip(starts[:-1], starts[1:])]
    return [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in each]


def _runs(text: str | None) -> np.ndarray:
    return _runs_of([text])[0]


def _share(x: np.ndarray, y: np.ndarray) -> float:
    all_of = np.sort(np.concatenate([x, y]))
    both = np.count_nonzero(all_of[1:] == all_of[:-1])
    return both / max(1, x.size + y.size - both)


def share_in_both(a: str | None, b: str | None) -> float:
    """Of all distinct runs of 8 characters in either bare body, the share that occurs in both; 0 without runs."""
    return _share(_runs(a), _runs(b))


@F.pandas_udf(T.DoubleType())
def _share_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    # rows come sorted by one of the texts, so that its runs serve for many pairs
    out = []
    for i in range(0, len(a), PAIRS):
        x, y = a.iloc[i : i + PAIRS], b.iloc[i : i + PAIRS]
        texts = list(dict.fromkeys([*x, *y]))
        known = {}
        for start, stop in slices([t or "" for t in texts]):
            known.update(zip(texts[start:stop], _runs_of(texts[start:stop])))
        out += [_share(known[s], known[t]) for s, t in zip(x, y)]
    return pd.Series(out, dtype="float64")


def checked_pairs(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float = LEAST_SHARE, measure=None) -> DataFrame:
    """Of candidate pairs (`a`, `b`: first halves of content keys, a < b), those whose texts are alike.

    classes: (`k1`, `k2`, `rep`), a row per distinct text, `rep` being the id of one row that holds it. texts: (`id`,
    `body`). Result: (`a1`, `a2`, `b1`, `b2`, `share`), and `weighted` if a pandas UDF `measure` of
    both texts is given that gives (`share`, `weighted`). Should two texts agree in the first half of their keys, both are
    checked. Texts move once by their id, for both sides, and once more with each pair.
    """
    left, right = (classes.select(F.col("k1").alias(x), F.col("k2").alias(f"{x}2"), F.col("rep").alias(f"_{x}")) for x in "ab")
    ends = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = ends.join(texts.select(F.col("id").alias("_a"), F.col("body").alias("body_a")), "_a").join(texts.select(F.col("id").alias("_b"), F.col("body").alias("body_b")), "_b")
    keys = [F.col("a").alias("a1"), F.col("a2"), F.col("b").alias("b1"), F.col("b2")]
    if measure is None:
        return both.select(*keys, _share_udf("body_a", "body_b").alias("share")).where(F.col("share") >= least)
    return both.select(*keys, measure("body_a", "body_b").alias("_m")).select("a1", "a2", "b1", "b2", "_m.share", "_m.weighted").where(F.col("share") >= least)
