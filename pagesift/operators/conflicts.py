"""Numbers in texts that contradict each other (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.functions.urls import let

# What is measured, and amounts of money.
METRICS = ("市场规模", "市场空间", "市场容量")
MONEY = r"(\d+(?:\.\d+)?)\s*(万亿|亿)\s*(美元|欧元|元)"


def amounts(items: DataFrame, key: list[str], text: str = "text", window: int = 60) -> DataFrame:
    """(`key`, `metric`, `unit`, `value`): amounts of money within `window` characters of a metric's name, in units of 亿."""
    names = "|".join(METRICS)
    pieces = F.split(F.coalesce(text, F.lit("")), f"(?<={names})|(?={names})")

    def around(all_):
        return F.filter(F.transform(all_, lambda p, i: F.struct(p.alias("metric"), F.concat(F.right(F.array_join(F.slice(all_, 1, i), ""), F.lit(window)), p, F.substring(F.array_join(F.slice(all_, i + 2, F.size(all_)), ""), 1, window)).alias("near"))), lambda s: s["metric"].isin(*METRICS))

    found = items.where(F.col(text).rlike(names)).select(*key, F.inline(let(pieces, around)))
    number, scale, unit = (F.regexp_extract_all("near", F.lit(MONEY), F.lit(k)) for k in (1, 2, 3))
    rows = found.select(*key, "metric", F.inline(F.arrays_zip(number.alias("number"), scale.alias("scale"), unit.alias("unit"))))
    return rows.select(*key, "metric", "unit", (F.col("number").cast("double") * F.when(F.col("scale") == "万亿", 10000.0).otherwise(1.0)).alias("value")).distinct()


def conflicts(items: DataFrame, batch: str = "batch_id", pos: str = "pos", text: str = "text", own: float = 5.0, distinct: int = 5, across: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Contradictions of a batch, and the items that contradict themselves.

    First: (`batch`, `metric`, `unit`, `selfs`, `distinct`, `lowest`, `highest`), the two with most different values per
    batch; `distinct` and the range are null where values of different items do not conflict. Second: (`batch`, `pos`).
    Texts without an amount take no part.
    """
    found = amounts(items.select(batch, pos, text), [batch, pos], text)
    each = found.groupBy(batch, pos, "metric", "unit").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bad = each.where((F.col("lo") > 0) & (F.col("hi") >= own * F.col("lo")))
    selfs = bad.groupBy(batch, "metric", "unit").agg(F.count(F.lit(1)).alias("selfs"))
    values = found.groupBy(batch, "metric", "unit").agg(F.count_distinct("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    cross = (F.col("n") >= distinct) & (F.col("lo") > 0) & (F.col("hi") >= across * F.col("lo"))
    both = values.join(selfs, [batch, "metric", "unit"], "left").select(batch, "metric", "unit", F.coalesce("selfs", F.lit(0)).alias("selfs"), *[F.when(cross, F.col(c)).alias(n) for c, n in (("n", "distinct"), ("lo", "lowest"), ("hi", "highest"))])
    order = Window.partitionBy(batch).orderBy(F.desc(F.coalesce("distinct", F.lit(0))), "metric", "unit")
    kept = both.where((F.col("selfs") > 0) | F.col("distinct").isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r <= 2").drop("_r")
    return kept, bad.select(batch, pos).distinct()
