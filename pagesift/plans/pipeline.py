"""The search from hits and fetched pages to ranked, de-duplicated and cut sources, one lazy plan per stage.

Texts travel late: stages rank on keys and numbers, and texts are joined to what is delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.config import Config
from pagesift.functions import dates, relevance, text, urls
from pagesift.operators import conflicts, dedup, learning, ranking
from pagesift.session import written


def search_plan(items: DataFrame, batches: DataFrame, candidates: DataFrame, ledger: DataFrame, stats: DataFrame, as_of: str, config: Config = Config(), decoys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Delivered sources of each batch: (`batch_id`, `n`, `item_id`, `url`, `score`, `authority`, `coverage`, `rank_score`,
    `weak_core`, `date`, `status`, `shown`, `self_conflict`, `conflicts`).

    items: (`item_id` unique, `batch_id`, `pos`, `url`, `page_title`, `text`), fetched pages; candidates: (`batch_id`, `pos`,
    `url`, `title`, `date`, `engine`); ledger: (`nurl`, `round_no`, `body`); stats: (`host`, `delta`); decoys: engines whose
    hits alone demote a page. Pages take their places by host and by the four demotions, which tell equal ranks apart. They
    are new to the ledger, by address and by body, score at least `least_score`, pass the title and relevance gates, are
    ranked by form, authority and coverage, thinned of near-copies and cut to the output budget. `self_conflict` marks
    sources whose numbers contradict each other, `conflicts` has those of the batch. Rows without a url or text are never
    delivered.
    """
    hits = candidates.where(F.col("url").isNotNull())
    hit = ranking.first_rows(hits.select("batch_id", "url", F.col("title").alias("hit_title"), F.col("date").alias("hit_date"), "pos"), ["batch_id", "url"], ["pos", "hit_title"]).drop("pos")
    pages = ranking.first_rows(items.where(F.col("url").isNotNull()).select("item_id", "batch_id", "pos", "url", "page_title", "text"), ["batch_id", "url"], ["pos", "item_id"])
    # an address stands for all engines that brought it
    engines = hits.groupBy("batch_id", "url").agg(F.flatten(F.collect_set(F.coalesce("engine", F.array().cast("array<string>")))).alias("engine"))
    # places are told apart by url where a position comes twice
    light = ranking.interleave(pages.select("batch_id", "url", F.struct("pos", "url").alias("pos")), config.per_host)
    new = dedup.known_pages(light.withColumn("nurl", urls.comparable("url")), ledger).where("known_round is null").select("batch_id", "url", F.col("new_pos").alias("pos"))
    known = learning.with_delta(new.join(engines, ["batch_id", "url"], "left"), stats, urls.host_of("url"))
    flags = [urls.low_value_tier("url") > 0, urls.blacklisted("url"), ranking.learned_negative("url", F.col("delta")), ranking.only_decoys("engine", list(decoys))]
    placed = ranking.demote(known, flags).select("batch_id", "url", "delta", F.col("new_pos").alias("pos"))
    scored = pages.drop("pos").join(placed, ["batch_id", "url"]).withColumn("score", text.content_score("text", "url", text.host_weight("url", F.col("delta")))).where(F.col("score") >= config.least_score)
    # scores are used by several stages, and are dear: computed once and kept
    fresh = written(scored.drop("delta"), "scored")
    asked = fresh.join(batches.select("batch_id", "query"), "batch_id").join(hit, ["batch_id", "url"], "left")
    hay = relevance.haystack("page_title", "text")
    gated = asked.where(~relevance.title_mismatch("url", "page_title", "hit_title", "query") & relevance.relevant(relevance.overlap(hay, "query"), relevance.term_hits(hay, "query"), config.least_overlap, config.least_terms))
    marked = gated.withColumns({
        "weak_core": relevance.front_hits("page_title", "text", "query") < config.least_front_hits, "authority": text.authority("url", "text"), "date": dates.best_date("hit_date", "text", as_of),
    }).drop("hit_title", "hit_date", "query")
    marked = written(marked, "marked")
    covered = marked.join(ranking.coverage(marked, batches), ["batch_id", "pos"])
    ranked = written(covered.withColumn("rank_score", ranking.rank_score(F.col("score"), F.col("authority"), F.col("coverage"), F.col("weak_core"))), "ranked")
    light = ranking.zero_coverage_gate(ranked.drop("text"), config.gate_least_items, config.gate_least_kept).drop("rank").join(ranked.select("batch_id", "pos", "text"), ["batch_id", "pos"])
    # mirrors of delivered bodies under new addresses
    light = written(light, "gated")
    mirrors = dedup.known_bodies(light.select("item_id", "text"), ledger.select("body"), config.similar, config.hamming, config.sample_chars)
    light = written(light.join(mirrors.select("item_id"), "item_id", "left_anti"), "unseen")
    clusters = dedup.cluster_batch(light.select("batch_id", "pos", "text"), config.similar, config.hamming)
    kept = light.join(clusters.where("keep").select("batch_id", "pos"), ["batch_id", "pos"])
    best = written(ranking.top(kept, "rank_score", config.deliver), "best")
    across, selfs = conflicts.conflicts(best)
    across = across.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("metric", "unit", "selfs", "distinct", "lowest", "highest"))).alias("conflicts"))
    cut = ranking.truncate(best, config.output_chars, config.cut_remainder).join(selfs.withColumn("self_conflict", F.lit(True)), ["batch_id", "pos"], "left").join(across, "batch_id", "left")
    return cut.select("batch_id", F.col("rank").alias("n"), "item_id", "url", "score", "authority", "coverage", "rank_score", "weak_core", "date", "status", "shown", F.coalesce("self_conflict", F.lit(False)).alias("self_conflict"), "conflicts")
