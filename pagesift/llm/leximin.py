"""One ranking from several differently scaled scores (problem 5).

Leximin ordering: each score becomes a percentile among the scores of its column in its group, each item's percentiles
are sorted ascending, and items are compared by these arrays, largest first, so that a strong score cannot make up for a
weak one and no column decides by its range.

A group is never sorted in one task: ranks come from a sort by range over all groups at once, in which rows of a large
group lie in several partitions, and from counts per group and partition before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.session import written


def running_total(rows: DataFrame, group: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the group up to and with the row, by the columns of `order`.

    `order` must tell the rows of a group apart, and groups must not be null. Partitions by range keep any group, however
    large, in as many tasks as it needs.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that the partition numbers stay what they were when an executor is lost
    ranged = written(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", *group).orderBy(*order)
    return ranged.withColumn("_within", F.sum(weight).over(within)).join(before, ["_part", *group]).withColumn(out, F.col("_within") + F.col("_before")).drop("_within", "_before", "_part")


def leximin(items: DataFrame, group: str, item: str, scores: list[str], missing: float | None = -1.0) -> DataFrame:
    """Order of the items of each group: (`group`, `item`, `p1`, `p2`, ..., `rank`).

    items: one row per `item`, with a `group` and double columns `scores`, larger is better. The percentile of a value is
    the share of the column's present values in the group that are smaller, plus half the share of its equals: it
    depends only on the order of values, so outliers and clipped values do no harm. Null, NaN and `missing` are absent
    scores; they get percentile 0, as nothing is known for the item, and do not count for others. Equal arrays are
    ordered by item. Items labelled twice under different ids are rows of their own. Rows whose group or item is null
    are left out; a null item could not be named. An empty table gives an empty result.
    """
    rows = items.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[F.col(s).cast("double").alias(f"_s{k}") for k, s in enumerate(scores)]).dropna(subset=["_g", "_i"])
    long = rows.select("_g", "_i", F.posexplode(F.array(*[f"_s{k}" for k in range(len(scores))])).alias("_c", "_v"))
    gone = F.col("_v").isNull() | F.isnan("_v") | (F.lit(False) if missing is None else F.col("_v") == F.lit(missing))
    present = long.where(~gone)
    counts = present.groupBy("_g", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts, ["_g", "_c"], ["_v"], "_n", "_upto")
    totals = present.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_all"))
    shares = upto.join(totals, ["_g", "_c"]).select("_g", "_c", "_v", ((2 * F.col("_upto") - F.col("_n")) / (2 * F.col("_all"))).alias("_p"))
    placed = present.join(shares, ["_g", "_c", "_v"]).select("_i", "_p").union(long.where(gone).select("_i", F.lit(0.0).alias("_p")))
    vectors = placed.groupBy("_i").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    names = [f"p{k + 1}" for k in range(len(scores))]
    wide = rows.select("_g", "_i").join(vectors, "_i").select("_g", "_i", *[F.col("_ps")[k].alias(n) for k, n in enumerate(names)], *[(-F.col("_ps")[k]).alias(f"_d{k}") for k in range(len(names))], F.lit(1).alias("_one"))
    ranked = running_total(wide, ["_g"], [*[f"_d{k}" for k in range(len(names))], "_i"], "_one", "rank")
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), *names, "rank")
