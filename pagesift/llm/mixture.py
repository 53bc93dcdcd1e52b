"""Mixing sources to target weights (problem 8).

Capped water-filling: every source wants its share of the total; a source that cannot give it even when each of its
documents is used as often as allowed is clamped there, and what is missing is shared among the others in proportion to
their targets, until all fits. A source that must be used r times gives every document floor(r) times and, for the rest,
a seeded sample whose tokens reach that rest.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.session import written

BINS = 1024
#: More sources than this are not weighed on the driver.
MOST_SOURCES = 1_000_000
#: Pre-tokens of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(`key`, `source`, `tokens`): tokens of each document by a byte-level vocabulary of ranks (a .tiktoken file).

    A null text has no tokens. The vocabulary is a file of a few MB, sent to all executors.
    """
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["key", "source", "tokens"])

    rows = documents.select(F.col(key).cast("long"), F.col(source).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(count, "key long, source string, tokens long").withColumnRenamed("key", key)


def water_fill(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """How many times each source is used (a fraction counts as part of its tokens).

    sizes: tokens of each source. targets: share and most repetitions of each source; shares need not add up to 1. total:
    tokens wanted; without it, all tokens of the sources with a target. Sources without tokens or with a target of 0 give
    nothing. If all sources together cannot give the total, each is used as often as it may be.
    """
    open_ = {s: w for s, (w, _) in targets.items() if w > 0 and sizes.get(s, 0) > 0}
    most = {s: targets[s][1] * sizes[s] for s in open_}
    left = float(sum(sizes[s] for s in open_) if total is None else total)
    given: dict[str, float] = {}
    while open_:
        per_weight = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * per_weight >= most[s]]
        for s in full or list(open_):
            given[s] = min(float(most[s]), open_[s] * per_weight)
            if full:
                left -= given[s]
                del open_[s]
        if not full:
            break
        left = max(0.0, left)
    return {s: g / sizes[s] for s, g in given.items()}


def mix_sources(counted: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture (`doc_id`, `source`, `tokens`, `copies` >= 1) and its report, a row per source of either table.

    counted: (`doc_id` unique, `source`, `tokens`). targets: (`source` unique, `target_share`, `max_repeats`); a null or
    negative share, or a null or negative number of repetitions, counts as 0. Documents of a null source or of one without
    a target are not drawn; a target without documents gives nothing, and its share goes to the others. Documents without
    tokens are not drawn. Which documents make up the fractional part depends only on `seed` and their ids: a source's
    documents are taken in the order of a seeded hash until their tokens come nearest to the part, found by a histogram of
    tokens per source and hash bin, so that only one bin is ordered; a source of any size is spread over all tasks.

    The report: `source`, `available` (tokens), `documents`, `target_share`, `max_repeats`, `wanted` (tokens), `drawn`
    (tokens), `actual_share`, `repetitions`.
    """
    spark = counted.sparkSession
    sums = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    clean = targets.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    known = clean.join(sums, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    sizes = {r["source"]: r["available"] or 0 for r in known}
    used = water_fill(sizes, {r["source"]: (r["target_share"], r["max_repeats"]) for r in known}, total)
    plan = spark.createDataFrame([(s, int(r), float((r - int(r)) * sizes[s]), float(r * sizes[s])) for s, r in sorted(used.items())], "source string, whole int, part double, wanted double")

    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40))
    docs = counted.where("tokens > 0").join(F.broadcast(plan) if len(known) < 100_000 else plan, "source").withColumn("_at", place).withColumn("_bin", (F.col("_at") / F.lit((1 << 40) // BINS)).cast("int"))
    histogram = docs.where("part > 0").groupBy("source", "_bin").agg(F.sum("tokens").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = histogram.select("source", "_bin", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), "_sum")
    cuts = before.join(plan, "source").where("_before < part and _before + _sum >= part").select("source", F.col("_bin").alias("_cut"), "_before")
    placed = docs.join(cuts, "source", "left")
    border = placed.where("_bin = _cut")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("_at", "doc_id"))
    # the last document is taken if that comes nearer to the part
    extra = border.withColumn("_upto", F.col("_before") + upto).where("_upto - tokens / 2 <= part").select("doc_id", F.lit(1).alias("_extra"))
    copies = F.col("whole") + F.when(F.col("part") <= 0, 0).when(F.col("_cut").isNull(), 1).when(F.col("_bin") < F.col("_cut"), 1).otherwise(F.coalesce("_extra", F.lit(0)))
    mixture = placed.join(extra, "doc_id", "left").select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    mixture = written(mixture, "mixture")
    drawn = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    whole = mixture.agg(F.sum(F.col("tokens") * F.col("copies")).alias("_all"))
    report = (
        clean.join(sums, "source", "full").join(plan.select("source", "wanted"), "source", "left").join(drawn, "source", "left").join(F.broadcast(whole))
        .select(
            "source", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("wanted", F.lit(0.0)).alias("wanted"), F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce(F.try_divide("drawn", "_all"), F.lit(0.0)).alias("actual_share"), F.coalesce(F.try_divide("drawn", "available"), F.lit(0.0)).alias("repetitions"),
        )
    )
    return mixture, report
