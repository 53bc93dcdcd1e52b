"""Ranking of candidates and fetched items within their batch.

Order is data: each relation has a batch and a position column, and every order ends in one that tells rows apart. A batch
is what one search brought, some hundred rows, so windows over a batch are small; statistics that go over all rows of a
batch are aggregated before they are joined back. Null scores count as 0, null texts as empty. Empty tables give empty
results; further columns are kept by operators that only mark or order rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift import tables
from pagesift.functions import relevance, urls
from pagesift.functions.text import HAN, stripped, without_footer

KANA = "[\\u3040-\\u30ff]"
PRICE = r"[¥￥$]\s?\d|\d+(?:\.\d+)?\s*元|\d+(?:\.\d+)?\s*折|\d+(?:\.\d+)?\s*%"
# Weights of the candidate score.
WEIGHTS = {"phrase": 0.20, "relevance": 0.38, "quality": 0.18, "source": 0.14, "fresh": 0.05, "depth": 0.05}
AD, BAD = 1.6, 1.15
AD_PARTS = {"host": 0.55, "price": 0.30, "links": 0.20, "burst": 0.15}
BAD_HOST, DECAY, PRIOR = 0.35, 0.35, 0.4


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order` (S10, S11, U1); combined before the shuffle, so no key is brought together."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.struct(*[F.col(c) for c in order])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordered).alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def query_terms(query: Column | str) -> Column:
    """Pairs of Chinese characters (single ones of a run of one) and words of two characters or more (V8)."""
    low = F.lower(F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(f"({HAN}+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(relevance.bigrams(r))))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9][a-z0-9+._-]*)"), F.lit(1)), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(pairs, words))


def phrase_share(title: Column, query: Column) -> Column:
    """Share of the query's parts that stand in the title."""
    parts = F.filter(F.split(F.lower(stripped(query)), r"(?U)\s+"), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) == 0, 0.0).otherwise(F.size(F.filter(parts, lambda p: F.contains(F.lower(title), p))) / F.size(parts))


def language_factor(query: Column, text: Column) -> Column:
    """A quarter for a page with kana under a Chinese query."""
    other = query.rlike(KANA) | ~query.rlike(HAN)
    return F.when(~other & (F.regexp_count(text, F.lit(KANA)) > 0.03 * F.greatest(F.length(text), F.lit(1))), 0.25).otherwise(1.0)


def structure(title: Column, body: Column) -> dict[str, Column]:
    """Signs of an offer, of many links and of a broken snippet (Q13)."""
    n = F.greatest(F.length(body), F.lit(1))
    links = F.least(F.lit(1.0), (F.regexp_count(body, F.lit("https?://")) + F.regexp_count(body, F.lit(r"\]\("))) / 10.0)
    lost = F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit(""))) + F.regexp_count(F.substring(body, 1, 2000), F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    tags = F.aggregate(F.regexp_extract_all(F.substring(body, 1, 3000), F.lit("(<[a-zA-Z/!][^>]*>)"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    broken = (F.length(body) < 30).cast("int") + (lost / n > 0.002).cast("int") + (tags / F.least(n, F.lit(3000)) > 0.05).cast("int")
    return {"price": title.rlike(PRICE).cast("double"), "links": links, "broken": F.least(F.lit(1.0), broken.cast("double"))}


def snippet_quality(title: Column, body: Column) -> Column:
    """Depth, ratio to the title, Chinese runs, punctuation and repetition of a snippet (Q14)."""
    n = F.length(body)
    sentences = F.filter(F.transform(F.split(body, "[。！？\\n]+"), stripped), lambda s: F.length(s) >= 8)
    repeated = F.when(F.size(sentences) >= 4, 1 - F.size(F.array_distinct(sentences)) / F.size(sentences)).otherwise(0.0)
    density = F.regexp_count(body, F.lit(f"{HAN}+")) * 2 / F.greatest(n, F.lit(1))
    marks = F.regexp_count(body, F.lit("[，。！？；：、,.!?;:]")) / F.greatest(F.lit(1.0), n / 120.0)
    return 0.34 * F.least(F.lit(1.0), n / 500.0) + 0.22 * F.least(F.lit(1.0), n / (F.length(title) + 1) / 20.0) + 0.22 * F.least(F.lit(1.0), density / 0.45) + 0.10 * F.least(F.lit(1.0), marks) + 0.12 * (1 - repeated)


def source_score(positions: Column) -> Column:
    """By the best position among the engines (R3); position 20 without one."""
    best = F.coalesce(F.array_min(F.map_values(positions)), F.lit(20))
    return 1.0 / (1.0 + DECAY * (F.greatest(F.lit(1), best) - 1))


def freshness(date: Column, year: int) -> Column:
    """By the leading year of a raw date (R4): full up to two years, gone after seven, a half without a year."""
    age = F.lit(year) - F.nullif(F.regexp_extract(F.coalesce(date, F.lit("")), r"^(\d{4})", 1), F.lit("")).cast("int")
    return F.when(age.isNull(), 0.5).when(age <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (age - 2) / 5.0))


def meta_rank(candidates: DataFrame, batches: DataFrame, year: int, model: DataFrame | None = None, prior: float = PRIOR) -> DataFrame:
    """Score and rank of search hits within their batch (R1): (`batch_id`, `url`, `score`, `rank`).

    candidates: (`batch_id`, `pos`, `url`, `title`, `snippet`, `date`, `engine`, `positions`); of a url in a batch the first
    by position counts, rows without a url are left out. batches: (`batch_id` unique, `query`). model: (`host`, `p_bad`), a
    small table of what was learned; other hosts have the prior. Batch statistics are counted per term and per host and
    joined back, so that the hits themselves are shuffled once.
    """
    pool = first_rows(candidates.where(F.col("url").isNotNull()).select("batch_id", "url", "pos", "title", "snippet", "date", "positions"), ["batch_id", "url"], ["pos", "title", "snippet", "date"])
    asked = batches.select("batch_id", F.coalesce("query", F.lit("")).alias("query"), query_terms("query").alias("terms"))
    title, body = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    base = pool.join(asked, "batch_id").withColumns({"title": title, "body": body, "text": F.concat(title, F.lit("\n"), body), "host": urls.host_with_port("url")})
    items = base.select("batch_id", "url", "host", "positions", "date", "query", "title", "body", "text", "terms")
    hits = items.select(
        "batch_id", "url", F.explode("terms").alias("term"), F.lower("title").alias("tl"), F.lower("text").alias("xl"), "text",
    ).select("batch_id", "url", "term", F.contains("text", "term").cast("int").alias("raw"), F.contains("tl", "term").cast("int").alias("t"), F.contains("xl", "term").cast("int").alias("x"))
    sizes = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    weights = hits.groupBy("batch_id", "term").agg(F.sum("raw").alias("df")).join(sizes, "batch_id").select("batch_id", "term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("w"))
    related = hits.join(weights, ["batch_id", "term"]).groupBy("batch_id", "url").agg(F.least(F.lit(1.0), (1.35 * F.sum(F.col("w") * F.col("t")) + 0.30 * F.sum(F.col("w") * F.col("x"))) / (1.35 * F.sum("w"))).alias("rel"))
    bursts = items.groupBy("batch_id", "host").agg(F.count(F.lit(1)).alias("burst"))
    known = (model if model is not None else items.sparkSession.createDataFrame([], "host string, p_bad double")).select("host", "p_bad")
    s = structure(F.col("title"), F.col("body"))
    lang = language_factor(F.col("query"), F.col("text"))
    p_bad = F.coalesce("p_bad", F.lit(prior))
    good = (
        WEIGHTS["phrase"] * (phrase_share(F.col("title"), F.col("query")) * lang) + WEIGHTS["relevance"] * (F.coalesce("rel", F.lit(0.0)) * lang) + WEIGHTS["quality"] * snippet_quality(F.col("title"), F.col("body"))
        + WEIGHTS["source"] * source_score(F.col("positions")) + WEIGHTS["fresh"] * freshness(F.col("date"), year) + WEIGHTS["depth"] * urls.path_depth("url")
    )
    ad = AD_PARTS["host"] * p_bad + AD_PARTS["price"] * s["price"] + AD_PARTS["links"] * s["links"] + AD_PARTS["burst"] * F.least(F.lit(1.0), (F.col("burst") - 1) / 3.0)
    bad = s["broken"] + BAD_HOST * p_bad
    best = F.coalesce(F.array_min(F.map_values("positions")), F.lit(99))
    scored = (
        items.join(related, ["batch_id", "url"], "left").join(bursts, ["batch_id", "host"]).join(known, "host", "left")
        .select("batch_id", "url", best.alias("best"), F.round(good - AD * F.greatest(F.lit(0.0), F.least(F.lit(1.0), ad)) - BAD * F.greatest(F.lit(0.0), F.least(F.lit(1.0), bad)), 6).alias("score"))
    )
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("score"), "best", "url"))).drop("best")


def rank_score(score: Column, authority: Column, coverage: Column, weak_core: Column, weights: tuple[float, float, float] | None = None) -> Column:
    """Form, authority and coverage together (R8): as a product, or as a weighted sum if `weights` are given."""
    f, a, c = (F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)) for x in (score, authority, coverage))
    if weights:
        return F.round(weights[0] * f + weights[1] * a + weights[2] * c, 4)
    return F.round(f * (0.5 + a) * (0.9 + 0.2 * c) * F.when(F.coalesce(weak_core, F.lit(False)), tables.WEAK_CORE_FACTOR).otherwise(1.0), 4)


def coverage(items: DataFrame, batches: DataFrame, text: str = "text", key: str = "pos") -> DataFrame:
    """Share of the query's terms, weighted by rareness within the batch, that a text has (V6).

    items: (`batch_id`, `key` unique in the batch, `text`). Terms are looked for as they are written in text in lower case,
    so those with capitals are never found, while their rareness counts without regard to case. A half without terms.
    Result: (`batch_id`, `key`, `coverage`).
    """
    terms = batches.select("batch_id", F.array_distinct(relevance.coverage_terms("query")).alias("terms"))
    joined = items.select("batch_id", key, F.lower(F.coalesce(text, F.lit(""))).alias("low")).join(terms, "batch_id")
    hits = joined.select("batch_id", key, "low", F.explode("terms").alias("term")).select("batch_id", key, "term", F.contains("low", F.lower("term")).cast("int").alias("any"), F.contains("low", "term").cast("int").alias("hit"))
    sizes = joined.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    weights = hits.groupBy("batch_id", "term").agg(F.sum("any").alias("df")).join(sizes, "batch_id").select("batch_id", "term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("w"))
    shares = hits.join(weights, ["batch_id", "term"]).groupBy("batch_id", key).agg(F.round(F.sum(F.col("w") * F.col("hit")) / F.sum("w"), 4).alias("coverage"))
    return joined.select("batch_id", key).join(shares, ["batch_id", key], "left").select("batch_id", key, F.coalesce("coverage", F.lit(0.5)).alias("coverage"))


def top(items: DataFrame, score: str, most: int, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """The best `most` items of each batch, with their rank."""
    order = Window.partitionBy(batch).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), pos)
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def zero_coverage_gate(items: DataFrame, least_items: int = 10, least_kept: int = 5, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """Evict items without any coverage that rank below the upper median of a batch of `least_items` or more.

    The best evicted ones come back until `least_kept` remain. items: (`batch`, `pos`, `rank_score`, `coverage`).
    """
    best = Window.partitionBy(batch).orderBy(F.desc("rank_score"), pos)
    whole = Window.partitionBy(batch)
    marked = items.withColumns({"_n": F.count(F.lit(1)).over(whole), "_asc": F.row_number().over(Window.partitionBy(batch).orderBy(F.asc("rank_score"), F.desc(pos)))})
    marked = marked.withColumn("_median", F.max(F.when(F.col("_asc") == F.floor(F.col("_n") / 2) + 1, F.col("rank_score"))).over(whole))
    marked = marked.withColumn("_out", (F.col("_n") >= least_items) & (F.col("coverage") == 0) & (F.col("rank_score") < F.col("_median")))
    marked = marked.withColumns({"_kept": F.count_if(~F.col("_out")).over(whole), "_back": F.when(F.col("_out"), F.row_number().over(Window.partitionBy(batch, "_out").orderBy(F.desc("rank_score"), pos)))})
    return marked.where(~F.col("_out") | (F.col("_kept") + F.col("_back") <= least_kept)).drop("_n", "_asc", "_median", "_out", "_kept", "_back").withColumn("rank", F.row_number().over(best))


def truncate(items: DataFrame, most: int, remainder: int = 100, batch: str = "batch_id", pos: str = "pos", text: str = "text", score: str = "rank_score") -> DataFrame:
    """Whole texts by score until `most` characters are used (R12): adds `status` (whole, cut, dropped) and `shown` characters.

    The first text that does not fit is cut if more than `remainder` characters are left; everything after it is dropped,
    even what would fit. Items with an empty text take no part and are left out.
    """
    t = stripped(text)
    sized = items.withColumn("_len", F.length(t)).where(F.col("_len") > 0)
    order = Window.partitionBy(batch).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), pos).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_sum") - F.col("_len")
    cut = sized.withColumn("_sum", F.sum("_len").over(order)).withColumn("_first", F.min(F.when(F.col("_sum") > most, F.col("_sum"))).over(Window.partitionBy(batch)))
    is_cut = (F.col("_sum") == F.col("_first")) & (F.lit(most) - before > remainder)
    return (
        cut.withColumn("status", F.when(F.col("_first").isNull() | (F.col("_sum") < F.col("_first")), "whole").when(is_cut, "cut").otherwise("dropped"))
        .withColumn("shown", F.when(F.col("status") == "whole", F.col("_len")).when(F.col("status") == "cut", F.lit(most) - before).otherwise(0))
        .drop("_len", "_sum", "_first")
    )


def interleave(rows: DataFrame, per_host: int = 2, batch: str = "batch_id", pos: str = "pos", url: str = "url") -> DataFrame:
    """New positions: at most `per_host` of a host ahead, the others behind, both in their order (R14); hostless rows ahead."""
    host = urls.host_of(url)
    marked = rows.withColumn("_host", host).withColumn("_nth", F.row_number().over(Window.partitionBy(batch, "_host").orderBy(pos)))
    late = ((F.col("_host") != "") & (F.col("_nth") > per_host)).cast("int")
    return marked.withColumn("late", late).withColumn("new_pos", F.row_number().over(Window.partitionBy(batch).orderBy("late", pos))).drop("_host", "_nth")


def demote(rows: DataFrame, flags: list[Column], batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """New positions after stable partitions applied one after the other (R15 to R18): the last flag orders first."""
    names = [f"_f{i}" for i in range(len(flags))]
    marked = rows.withColumns({n: F.coalesce(f, F.lit(False)).cast("int") for n, f in zip(names, flags)})
    return marked.withColumn("new_pos", F.row_number().over(Window.partitionBy(batch).orderBy(*reversed(names), pos))).drop(*names)


def only_decoys(engines: Column | str, decoys: list[str]) -> Column:
    """Whether an item comes from decoy engines only, and from one at least."""
    e = F.filter(F.coalesce(F.col(engines) if isinstance(engines, str) else engines, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return (F.size(e) > 0) & F.forall(e, lambda x: x.isin(*decoys))


def learned_negative(url: Column | str, delta: Column, most: float = -0.4, whitelist=tables.WHITELISTED_HOSTS) -> Column:
    h = urls.host_of(url)
    return (h != "") & ~urls.under(h, whitelist) & (F.coalesce(delta, F.lit(0.0)) <= most)


def fetch_window(attempts: DataFrame, most: int = 29, batch: str = "batch_id", pos: str = "pos", url: str = "url", ok: str = "fetch_ok") -> DataFrame:
    """Which attempts of a serial trace are made (R13, F2): after a failure later pages of the host are skipped at no cost,
    and `most` others are tried."""
    host = urls.host_of(url)
    earlier = Window.partitionBy(batch, "_host").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    marked = attempts.withColumn("_host", host).withColumn("skipped", (F.col("_host") != "") & (F.coalesce(F.max((~F.coalesce(ok, F.lit(False))).cast("int")).over(earlier), F.lit(0)) == 1))
    nth = F.sum((~F.col("skipped")).cast("int")).over(Window.partitionBy(batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("tried", ~F.col("skipped") & (nth <= most)).drop("_host")


def quota(rows: DataFrame, most: int, batch: str = "batch_id", pos: str = "pos", text: str = "digest") -> DataFrame:
    """Characters of each digest that a running total allows (R20): the last one is cut, later ones get none."""
    size = F.length(stripped(text))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(most) - before)
    return rows.withColumn("shown", F.least(size, left)).withColumn("state", F.when(left == 0, "used").when(size == 0, "empty").when(size > left, "cut").otherwise("whole"))


def primary_text(items: DataFrame, most: int = 5, batch: str = "batch_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """Texts of the first results without footers, joined (R19): (`batch`, `text`)."""
    first = items.withColumn("_r", F.row_number().over(Window.partitionBy(batch).orderBy(pos))).where(F.col("_r") <= most)
    cleaned = first.select(batch, "_r", without_footer(text).alias("_t")).where("_t != ''")
    return cleaned.groupBy(batch).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]), "\n\n---\n\n").alias("text"))
