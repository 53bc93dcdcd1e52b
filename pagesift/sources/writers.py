"""Storing results: archives, indexes, snapshots, and the line that sums a search up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.functions.documents import reflowed
from pagesift.functions.text import stripped
from pagesift.functions.urls import comparable, file_name, host_of


def archives(items: DataFrame, batches: DataFrame, most: int = 15, pos: str = "rank") -> DataFrame:
    """One archive per batch (SNK1): (`batch_id`, `name`, `markdown`): the query, then each source under its number.

    items: (`batch_id`, `rank`, `url`, `text`). Sections are whole; those beyond `most` are left out. A batch without
    items has no archive.
    """
    first = items.where(F.col(pos) <= most)
    body = F.regexp_replace(stripped("text"), r"^##\s*来源:\s*\S+\s*", "")
    section = F.concat(F.lit("**["), F.col(pos).cast("string"), F.lit("] "), host_of("url"), F.lit("**\n\n## 来源: "), F.coalesce("url", F.lit("")), F.lit("\n\n"), body)
    joined = first.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("r"), section.alias("s")))), lambda x: x["s"]), "\n\n---\n\n").alias("body"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("# "), F.coalesce("query", F.lit("")), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" sources\n\n"))
    return joined.join(batches.select("batch_id", "query"), "batch_id").select("batch_id", F.concat(F.lpad(F.col("batch_id").cast("string"), 2, "0"), F.lit("_"), file_name("query"), F.lit(".md")).alias("name"), reflowed(F.concat(head, "body")).alias("markdown"))


def next_number(names: DataFrame, name: str = "name") -> DataFrame:
    """The number that the next archive of a folder gets (SNK2)."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int")), F.lit(0)) + 1).alias("next"))


def attachment_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index of attachments after a round (SNK3): (`key`, `url`, `path`, `bytes`, `added`, `reused`).

    index and new: (`url`, `path`, `bytes`, `added`). An attachment is reused if its page was there with the same path and
    size, and then keeps the day it was added.
    """
    key = F.sha1(comparable("url"))
    old = index.select(key.alias("key"), F.col("url").alias("_url"), F.col("path").alias("_path"), F.col("bytes").alias("_bytes"), F.col("added").alias("_added")).dropDuplicates(["key"])
    same = (F.col("path") == F.col("_path")) & (F.col("bytes") == F.col("_bytes"))
    joined = new.withColumn("key", key).dropDuplicates(["key"]).join(old, "key", "full")
    reused = F.coalesce(same, F.lit(False))
    return joined.select("key", F.coalesce("url", "_url").alias("url"), F.coalesce("path", "_path").alias("path"), F.coalesce("bytes", "_bytes").alias("bytes"), F.when(reused | F.col("url").isNull(), F.col("_added")).otherwise(F.col("added")).alias("added"), reused.alias("reused"))


def sources_rows(items: DataFrame, rank: str = "rank") -> DataFrame:
    """Sources as they are shown (T12, D5): numbers rounded, an empty date where none is known."""
    return items.select("batch_id", F.col(rank).alias("n"), F.coalesce("url", F.lit("")).alias("url"), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score"), F.round("authority", 2).alias("authority"), F.round("coverage", 2).alias("coverage"), (F.col("status") != "whole").alias("truncated"), "weak_core", "date")


def short_url(url: Column, most: int = 58) -> Column:
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", "")
    return F.when(F.length(u) > most, F.concat(F.substring(u, 1, most - 1), F.lit("…"))).otherwise(u)


def summary_line(row: dict[str, Column]) -> Column:
    """Fields of a result in a fixed order, joined by points; those that are null or 0 are left out (SNK6)."""
    order = ("fetched", "dedup", "truncated", "mt_flagged", "number_conflict", "skipped_repeats", "cross_round", "pdf_dumps")
    return F.concat_ws(" · ", *[F.when(F.coalesce(row[k], F.lit(0)) > 0, F.concat(F.lit(f"{k}: "), row[k].cast("string"))) for k in order if k in row])


def write_archives(archives_: DataFrame, folder: str) -> None:
    """A markdown file per batch."""
    archives_.select("batch_id", F.col("markdown").alias("value")).repartition("batch_id").write.partitionBy("batch_id").mode("overwrite").text(folder)


def changed(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before (SNK5)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_was", before).where(F.coalesce(F.col(value) != F.col("_was"), F.col(value) != 0)).drop("_was")
