"""Capping records per dominant contributor (problem 3).

Mergeable histograms of quality per contributor give the bin in which its cap is reached; records of better bins stay,
records of worse bins go, and only the records of that one bin are ranked. Histograms add up before the shuffle, so a
contributor with a third of all rows costs as many histogram rows as any other, and the rows of a contributor are never
brought together: ranking in the borderline bin goes over salted parts first, of which each hands on no more than the
places that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 256
SALTS = 32


def host(url: str = "url") -> Column:
    """Host of an address: lower case, no user, no port, one leading `www.` removed; null if there is none.

    Surrounding blanks do not matter. Other subdomains are other hosts.
    """
    authority = F.regexp_extract(F.lower(F.trim(F.regexp_replace(F.col(url), r"(?U)^\s+|\s+$", ""))), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"^\[(.*)\]$", "$1"), r"^www\.", ""), F.lit(""))


def score_bin(score: Column, low: float, high: float, bins: int = BINS) -> Column:
    """Bin of a score, better ones higher; null and NaN in bin -1, below all."""
    place = F.floor((score - F.lit(low)) / F.lit((high - low) / bins))
    return F.when(score.isNull() | F.isnan(score), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))).cast("int")


def over_cap(items: DataFrame, group: list[str], cap: str, item: str, score: str, low: float = 0.0, high: float = 1.0, bins: int = BINS) -> DataFrame:
    """Items beyond the first `cap` of their group (`group` columns and `item`).

    items: the group columns, an integer column `cap`, the same for all rows of a group (its least value counts), the
    bigint `item`, the double `score`. The order is score descending, null and NaN last and equal, then item ascending.
    Scores outside `low` to `high` share the end bins; the result does not depend on the bins. A repeated item counts
    once, with its best score. Rows with a null item, a null in a group column or a null cap are never over the cap; a cap
    of 0 or less lets none stay. An empty table gives an empty result.
    """
    known = items.select(*group, F.col(cap).alias("_cap"), F.col(item).alias("_item"), F.when(F.isnan(score), None).otherwise(F.col(score)).alias("_score")).dropna(subset=[*group, "_cap", "_item"])
    once = known.groupBy(*group, "_item").agg(F.min("_cap").alias("_cap"), F.max("_score").alias("_score")).withColumn("_bin", score_bin(F.col("_score"), low, high, bins))
    histogram = once.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_cap").alias("_cap"))
    better = Window.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    least = Window.partitionBy(*group)
    cuts = (
        histogram.withColumn("_cap", F.greatest(F.min("_cap").over(least), F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum("_n").over(better), F.lit(0)))
        .where("_before <= _cap and _before + _n > _cap")
        .select(*group, F.col("_bin").alias("_cut"), (F.col("_cap") - F.col("_before")).alias("_places"))
    )
    # a group within its cap has no cut and none of its items is looked at again
    placed = once.join(cuts, group).where("_bin <= _cut")
    border = placed.where("_bin = _cut").withColumn("_salt", F.pmod(F.xxhash64("_item"), F.lit(SALTS)))
    order = [F.desc_nulls_last("_score"), F.asc("_item")]
    stay = (
        border.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where("_r <= _places")
        .withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r <= _places")
        .select(*group, "_item")
    )
    return placed.select(*group, "_item").join(stay, [*group, "_item"], "left_anti").withColumnRenamed("_item", item)
