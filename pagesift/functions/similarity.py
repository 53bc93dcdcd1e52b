"""Expressions for similarity of texts: character 3-grams, slices, simhash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import without_header
from pagesift.functions.urls import let

SLICE, SLICES, HASHED = 512, 4, 2000


def plain(text: Column | str) -> Column:
    """Without a source header and without any Unicode white space."""
    return F.regexp_replace(without_header(text), r"(?U)[\s\x1c-\x1f]+", "")


def grams(text: Column) -> Column:
    """Distinct runs of three characters (S1); a shorter text is its own, an empty one has none."""
    return let(text, lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < 3, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: t.substr(i, F.lit(3))))))


def slices(text: Column) -> Column:
    """The first four stretches of 512 characters (S3)."""
    return let(text, lambda t: F.filter(F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda k: t.substr(k * SLICE + 1, F.lit(SLICE))), lambda s: s != ""))


def containment(a: Column, b: Column) -> Column:
    """Common 3-grams over those of the smaller set (S2); 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(`keys`, `simhash`): 64-bit fingerprint over the 3-grams of the first 2000 characters, weighted by frequency.

    As a signed number; 0 stands for no fingerprint. Grams are counted before the bit sums, both combine before the shuffle.
    """
    t = F.substring(plain(text), 1, HASHED)
    every = let(t, lambda x: F.when(F.length(x) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: x.substr(i, F.lit(3)))).otherwise(F.array().cast("array<string>")))
    counts = rows.select(*keys, F.explode(every).alias("_g")).groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    hashed = counts.withColumn("_h", F.conv(F.substring(F.md5("_g"), 1, 16), 16, -10).cast("long"))
    sums = hashed.groupBy(*keys).agg(*[F.sum(F.when(F.col("_h").bitwiseAND(F.lit(1 << b if b < 63 else -(1 << 63))) != 0, F.col("_n")).otherwise(-F.col("_n"))).alias(f"_b{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"_b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(*keys).distinct().join(sums, keys, "left").select(*keys, F.coalesce(value, F.lit(0).cast("long")).alias("simhash"))
