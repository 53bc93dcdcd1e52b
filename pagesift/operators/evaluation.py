"""Evaluation of rankings on labelled rows, and counts over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.operators.ranking import first_rows, rank_score


def clean_labels(rows: DataFrame) -> DataFrame:
    """One row per query and url, the first labelled (S11); NaN and -1 count as null, null scores as 0, null `rel` as 0."""
    def number(name: str):
        return F.coalesce(F.when(~F.isnan(name) & (F.col(name) != -1), F.col(name)), F.lit(0.0)).alias(name)

    return first_rows(rows.where(F.col("query").isNotNull() & F.col("url").isNotNull()).select("eval_id", "query", "url", F.coalesce("domain", F.lit("")).alias("domain"), number("form"), number("authority"), number("coverage"), number("rel"), F.coalesce("weak_core", F.lit(False)).alias("weak_core")), ["query", "url"], ["eval_id"])


def replay(rows: DataFrame) -> DataFrame:
    """Per query (A3): (`query`, `top3`, `top1_rel`, `top5_rel`, `off_top5`) of the ranking by form, authority and coverage."""
    ranked = clean_labels(rows).withColumn("rank_score", rank_score(F.col("form"), F.col("authority"), F.col("coverage"), F.col("weak_core")))
    placed = ranked.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank_score"), "eval_id"))).where("r <= 5")
    return placed.groupBy("query").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "url")))), lambda x: x["url"]), " ").alias("top3"),
        F.max(F.when(F.col("r") == 1, F.col("rel"))).alias("top1_rel"), F.round(F.avg("rel"), 4).alias("top5_rel"), F.count_if(F.col("rel") == 0).alias("off_top5"),
    )


def regressions(now: DataFrame, baseline: DataFrame, slack: float = 0.0) -> DataFrame:
    """Queries whose metrics fell below a baseline (A4): (`query`, `metric`, `was`, `is`)."""
    def long(rows: DataFrame, value: str) -> DataFrame:
        return rows.select("query", F.explode(F.create_map(F.lit("top1_rel"), F.col("top1_rel"), F.lit("top5_rel"), F.col("top5_rel"), F.lit("off_top5"), -F.col("off_top5").cast("double"))).alias("metric", value))

    return long(now, "is").join(long(baseline, "was"), ["query", "metric"]).where(F.col("is") < F.col("was") - slack).select("query", "metric", "was", "is")


def weight_grid(rows: DataFrame, least_form: float = 0.35) -> DataFrame:
    """Metrics of each weighting of form, authority and coverage (A5): (`w_form`, `w_authority`, `top5_auth`, `first_auth`, `low_bad`).

    The grid is 40 rows; each labelled row meets each of them once, and top places are taken per query and weighting.
    """
    labels = clean_labels(rows)
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, (35 + 5 * f) / 100, a / 100) for i, (f, a) in enumerate((f, a) for f in range(8) for a in (10, 20, 30, 40, 50))], "g int, w_form double, w_authority double").where(F.col("w_form") >= least_form)
    cells = F.array(*[F.struct(F.lit(r["g"]).alias("g"), F.lit(r["w_form"]).alias("w_form"), F.lit(r["w_authority"]).alias("w_authority")) for r in grid.collect()])
    scored = labels.select("*", F.inline(cells)).withColumn("s", F.round(F.col("w_form") * F.col("form") + F.col("w_authority") * F.col("authority") + F.greatest(F.lit(0.0), 1 - F.col("w_form") - F.col("w_authority")) * F.col("coverage"), 4))
    placed = scored.withColumn("r", F.row_number().over(Window.partitionBy("g", "query").orderBy(F.desc("s"), "eval_id"))).where("r <= 5")
    return placed.groupBy("g", "w_form", "w_authority").agg(
        F.round(F.avg("authority"), 6).alias("top5_auth"), F.round(F.avg(F.when(F.col("r") == 1, F.col("authority"))), 6).alias("first_auth"), F.count_if((F.col("rel") == 0) & (F.col("r") <= 5)).alias("low_bad"),
    ).drop("g")


def best_weights(grid: DataFrame) -> DataFrame:
    """The weighting with the highest `top5_auth`, of these the fewest `low_bad`, then the smallest weights (A5)."""
    return grid.orderBy(F.desc("top5_auth"), "low_bad", "w_form", "w_authority").limit(1)


def leave_one_out(rows: DataFrame, weights: list[tuple[float, float, float]], gap: float = 0.02) -> DataFrame:
    """Per domain, the weighting that is best without it and how it does on it (A6): (`domain`, `w`, `others`, `own`, `stable`)."""
    labels = clean_labels(rows)
    cells = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(float(f)).alias("wf"), F.lit(float(a)).alias("wa"), F.lit(float(c)).alias("wc")) for i, (f, a, c) in enumerate(weights)])
    scored = labels.select("*", F.inline(cells)).withColumn("s", F.round(F.col("wf") * F.col("form") + F.col("wa") * F.col("authority") + F.col("wc") * F.col("coverage"), 4))
    placed = scored.withColumn("r", F.row_number().over(Window.partitionBy("w", "query").orderBy(F.desc("s"), "eval_id"))).where("r <= 5")
    # sums per domain; what is left out is subtracted from the whole
    sums = placed.groupBy("domain", "w").agg(F.sum("rel").alias("x"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy("w").agg(F.sum("x").alias("all_x"), F.sum("n").alias("all_n"))
    both = sums.join(whole, "w").select("domain", "w", F.round(F.try_divide(F.col("all_x") - F.col("x"), F.col("all_n") - F.col("n")), 6).alias("others"), F.round(F.col("x") / F.col("n"), 6).alias("own"))
    best = both.groupBy("domain").agg(F.max_by(F.struct("w", "others", "own"), F.struct(F.coalesce("others", F.lit(-1.0)), -F.col("w"))).alias("b"), F.max("own").alias("_top"))
    return best.select("domain", "b.w", "b.others", "b.own", (F.col("_top") - F.col("b.own") <= gap).alias("stable"))


def profile(rows: DataFrame) -> DataFrame:
    """Rows, queries, hosts and domains of a labelled set (A9), over all and per domain."""
    from pagesift.functions.urls import host_of

    labels = clean_labels(rows).withColumn("host", host_of("url"))
    return labels.rollup("domain").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("query").alias("queries"), F.count_distinct("host").alias("hosts"))


def engine_contribution(candidates: DataFrame, engines: list[str]) -> DataFrame:
    """Hits, solo hits and idleness of each engine (A1): (`engine`, `hits`, `solo`, `idle`)."""
    once = candidates.where(F.col("url").isNotNull()).select("batch_id", "url", "pos", "engine").distinct()
    names = once.select(F.explode("engine").alias("engine"), (F.size("engine") == 1).cast("int").alias("solo")).where("engine is not null and engine != ''")
    hits = names.groupBy("engine").agg(F.count(F.lit(1)).alias("hits"), F.sum("solo").alias("solo"))
    known = candidates.sparkSession.createDataFrame([(e,) for e in engines], "engine string")
    return hits.join(known, "engine", "full").select("engine", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("solo", F.lit(0)).alias("solo"), F.col("hits").isNull().alias("idle"))
