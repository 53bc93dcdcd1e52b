"""One query per group of operators, over whole tables. `oracle.py` has the SQL for the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import tables
from pagesift.config import Config
from pagesift.functions import dates, documents, relevance, similarity, text, urls
from pagesift.operators import conflicts, dedup, evaluation, learning, ranking
from pagesift.plans.pipeline import search_plan
from pagesift.session import table, written
from pagesift.sources import readers, writers

AS_OF, YEAR = "2025-03-15", 2025
ENGINES = ["fathom", "ember", "grove", "brio", "dovetail", "kestrel", "lumen"]
DECOYS = ["fathom", "ember"]
#: Addresses of the classes that the tables do not have.
ADDRESSES = [
    "https://www.toutiao.com/a1", "https://m.sohu.com/a/123_456", "https://www.sohu.com/news/1", "https://www.163.com/dy/article/X.html", "http://lab212.cn.b2b168.com/shop/1", "https://detail.1688.com/offer/9.html",
    "https://www.foo.gov.cn/xwdt/gggs/1.html", "https://foo.com/%E8%AF%A2%E4%BB%B7/1", "https://foo.com/a%2Bb+c/%zz/product/1", "https://www.wenjuan.com/s/abc", "https://vt.quark.cn/blm/quark-doc-ssr?id=1", "https://baike.quark.cn/x",
    "https://www.straitsresearch.com/zh/report/x", "https://straitsresearch.com/report/x", "https://cn.gminsights.com/zh-CN/a", "https://download.ad.example/x", "http://user:pw@WWW.Example.org:8080/P/ATH?q=1#f", "//cdn.example.net/x", "", "not an address", "http://[::1]:80/x",
    "https://news.nature.com/articles/1", "https://pubmed.ncbi.nlm.nih.gov/1", "https://nih.gov/1", "https://www.who.int/x", "https://a.b.edu.cn/x", "https://x.wikipedia.org/wiki/Y",
]


def _address_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ADDRESSES], "url string")


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    seen = [table(spark, d, t).select("url") for t in ("ledger_entry", "fetched_item", "candidate", "eval_item")]
    out = _address_rows(spark)
    for s in seen:
        out = out.union(s)
    return out.where("url is not null").distinct()


def u2_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("url", urls.host_of("url").alias("host"), urls.raw_host("url").alias("raw"), urls.host_with_port("url").alias("with_port"), urls.learner_host("url").alias("learner"), F.round(urls.path_depth("url"), 4).alias("depth"))


def u3_comparable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger_entry").where("url is not null").select("entry_id", urls.comparable("url").alias("page"))


def u4_u7_classes(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("url", urls.blacklisted("url").alias("blacklisted"), urls.low_value_tier("url").alias("tier"), urls.text_soup("url").alias("soup"), urls.report_mill("url").alias("mill"))


def u8_suffix_weights(spark: SparkSession, d: str) -> DataFrame:
    """Longest-suffix lookup by an equi-join of a host's suffixes with a table of domains."""
    weights = {**tables.HOST_WEIGHTS, "gov.test": 1.4, "edu.test": 1.3, "com.example": 0.8, "cn.example": 0.7}
    dim = spark.createDataFrame(list(weights.items()), "domain string, weight double")
    hosts = _addresses(spark, d).select(urls.host_of("url").alias("host")).where("host != ''").distinct()
    hits = hosts.select("host", F.explode(urls.suffixes(F.col("host"))).alias("domain")).join(dim, "domain").groupBy("host").agg(F.max_by("weight", F.length("domain")).alias("w"))
    return hosts.join(hits, "host", "left").select("host", F.coalesce("w", F.lit(1.0)).alias("weight"))


def u1_first_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetched_item").where(F.col("url").rlike("^(?i)https?:"))
    return ranking.first_rows(rows.select("url", "item_id"), ["url"], ["item_id"])


def u9_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    statuses = F.array(*[F.lit(s) for s in (200, 403, 404, 451, 500)])
    rows = table(spark, d, "fetched_item").select("item_id", "url", F.get(statuses, F.col("item_id") % 5).alias("a"), F.get(statuses, (F.col("item_id") / 5).cast("long") % 5).alias("b"), F.when(F.col("item_id") % 3 == 0, "'utf-8' codec can't decode byte").alias("e")).distinct()
    return rows.select("item_id", urls.skip_reason("a", "b", "e", F.concat("url", F.when(F.col("item_id") % 2 == 0, ".pdf").otherwise(""))).alias("reason"))


def u14_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", urls.file_name("title", 20).alias("name"), urls.file_name(F.concat(F.lit(" GB 4789.1:2016 "), "url", F.lit(" . ")), 60, "pdf").alias("pdf"))


def q1_q4_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger_entry").select("entry_id", F.length(text.without_header("body")).alias("n"), text.garbled("body").alias("garbled"), text.template_page("body").alias("template"), text.block_page("body").alias("block"))


def q5_form_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = urls.let(text.without_header("text"), lambda t: F.struct(*[F.round(c, 6).alias(k) for k, c in text.form_parts(t, F.lit(1.0)).items()]))
    return table(spark, d, "documents").select("doc_id", parts.alias("p")).select("doc_id", "p.*")


def q7_content_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all bodies, under their own address and under one of each class."""
    address = F.get(F.array(*[F.lit(a) for a in ADDRESSES]), F.col("entry_id") % len(ADDRESSES))
    rows = table(spark, d, "ledger_entry").select("entry_id", "url", "body", address.alias("other"))
    return rows.select("entry_id", F.round(text.content_score("body", "url"), 4).alias("score"), F.round(text.content_score("body", "other"), 4).alias("other"))


def q8_collected(spark: SparkSession, d: str) -> DataFrame:
    """Fetched items at or above the threshold, once each."""
    rows = table(spark, d, "fetched_item").dropDuplicates(["item_id"])
    return rows.where(~F.isnan("score") & (F.col("score") >= Config().least_score)).select("item_id", "batch_id")


def q9_citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.without_citations("text")).alias("hash"))


def q10_footers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.without_footer("text")).alias("hash"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("|"), F.lit("&middot;"))
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title class='t'>\n "), t, F.lit(" &copy;</title><script>var a = 1;</script></head><body><nav><a href='/'>Home</a></nav><article><p>"), F.replace(body, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></article><footer>f</footer></body></html>"))
    return table(spark, d, "documents").select("doc_id", "url", page.alias("page"))


def q11_page_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", text.page_title("page").alias("title"))


def q12_extracted(spark: SparkSession, d: str) -> DataFrame:
    return text.with_extracted(_pages(spark, d), out="t").select("doc_id", F.length("t").alias("n"), F.md5("t").alias("hash"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "fetched_item").dropDuplicates(["item_id"])
    return items.join(table(spark, d, "search_batch").select("batch_id", "query"), "batch_id")


def v1_v5_relevance(spark: SparkSession, d: str) -> DataFrame:
    hay = relevance.haystack("page_title", "text")
    rows = _asked(spark, d).select("item_id", relevance.overlap(hay, "query").alias("overlap"), relevance.term_hits(hay, "query").alias("hits"), relevance.front_hits("page_title", "text", "query").alias("front"))
    return rows.select("*", relevance.relevant(F.col("overlap"), F.col("hits")).alias("kept"), (F.col("front") < 2).alias("weak_core"))


def v6_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ranking.coverage(table(spark, d, "fetched_item").dropDuplicates(["item_id"]), table(spark, d, "search_batch"), key="item_id")


def v7_title_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d)
    home = F.regexp_replace(urls.trimmed("url"), r"^(https?://[^/]*/).*$", "$1")
    hits = ranking.first_rows(table(spark, d, "candidate").where("url is not null").select("batch_id", "url", "title", "pos"), ["batch_id", "url"], ["pos", "title"])
    return rows.join(hits.select("batch_id", "url", "title"), ["batch_id", "url"]).select("item_id", relevance.title_mismatch(home, "page_title", "title", "query").alias("mismatch"), F.round(relevance.bigram_jaccard(relevance.plain_title("page_title"), relevance.plain_title("query")), 6).alias("likeness"))


def _model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m.relqui.edu.test", 0.9), ("m.linshaqui.com.example", 0.05), ("vorlinmis.edu.test", 0.7)], "host string, p_bad double")


def r1_meta_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.meta_rank(table(spark, d, "candidate"), table(spark, d, "search_batch"), YEAR, _model(spark))


def r6_authority(spark: SparkSession, d: str) -> DataFrame:
    address = F.get(F.array(*[F.lit(a) for a in ADDRESSES]), F.col("doc_id") % len(ADDRESSES))
    marked = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\nDOI: 10.1234/x 收稿日期：2020").when(F.col("doc_id") % 4 == 1, "\nISSN 1000-1234").otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.round(text.authority(address), 4).alias("base"), F.round(text.authority(address, marked), 4).alias("authority"))


def _ranked_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_item").select(F.col("query").alias("batch_id"), F.col("eval_id").alias("pos"), F.least(F.greatest("form", F.lit(0.0)), F.lit(1.0)).alias("score"), F.when(~F.isnan("authority") & (F.col("authority") != -1), F.col("authority")).alias("authority"), F.when(F.col("pos") % 3 == 0, 0.0).otherwise(F.when(~F.isnan("coverage") & (F.col("coverage") != -1), F.col("coverage"))).alias("coverage"), "weak_core")
    return rows.withColumn("rank_score", ranking.rank_score(F.col("score"), F.col("authority"), F.col("coverage"), F.col("weak_core"))).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def r8_rank_items(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked_labels(spark, d)
    linear = ranking.rank_score(F.col("score"), F.col("authority"), F.col("coverage"), F.col("weak_core"), (0.5, 0.4, 0.1))
    return ranking.top(rows.withColumn("linear", linear), "rank_score", 1_000_000).select(F.col("pos").alias("eval_id"), "rank_score", "linear", "rank")


def r10_zero_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ranking.zero_coverage_gate(_ranked_labels(spark, d)).select(F.col("pos").alias("eval_id"), "rank")


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetched_item").dropDuplicates(["item_id"])
    return rows.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def r11_top(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), "score"), "score", 15).select("batch_id", F.col("pos").alias("item_id"), "rank")


def r12_truncate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.truncate(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), "score", "text"), 4000, score="score").select(F.col("pos").alias("item_id"), "status", "shown")


def r13_fetch_window(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("batch_id", "item_id", "pos", "url", (F.col("item_id") % 11 != 0).alias("fetch_ok"))
    return ranking.fetch_window(rows.select("batch_id", F.col("item_id").alias("pos"), "url", "fetch_ok")).select(F.col("pos").alias("item_id"), "skipped", "tried")


def r14_interleave(spark: SparkSession, d: str) -> DataFrame:
    return ranking.interleave(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), "url")).select(F.col("pos").alias("item_id"), "late", "new_pos")


def r15_demote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate").where("url is not null").select("batch_id", "pos", "url", "engine", F.get(F.array(*[F.lit(a) for a in ADDRESSES]), F.col("pos") % 60).alias("other"))
    rows = ranking.first_rows(rows, ["batch_id", "url"], ["pos"]).withColumn("address", F.coalesce("other", "url"))
    known = learning.with_delta(rows, learning.host_stats(table(spark, d, "observation")), urls.host_of("address"))
    flags = [urls.low_value_tier("address") > 0, urls.blacklisted("address"), ranking.learned_negative("address", F.col("delta")), ranking.only_decoys("engine", DECOYS)]
    # places within a batch are told apart by url where a position comes twice
    return ranking.demote(known.withColumn("pos", F.struct("pos", "url")), flags).select("batch_id", "url", "new_pos")


def r19_primary_text(spark: SparkSession, d: str) -> DataFrame:
    return ranking.primary_text(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), "text")).select("batch_id", F.md5("text").alias("hash"))


def r20_quota(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quota(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), F.col("text").alias("digest")), 2000).select(F.col("pos").alias("item_id"), "shown", "state")


def s2_containment(spark: SparkSession, d: str) -> DataFrame:
    """Each entry against the next one of its page title line: containment of the first 512 characters."""
    rows = table(spark, d, "ledger_entry").select("entry_id", similarity.grams(F.substring(similarity.plain("body"), 1, 512)).alias("g"))
    other = rows.select((F.col("entry_id") - 1).alias("entry_id"), F.col("g").alias("h"))
    return rows.join(other, "entry_id").select("entry_id", F.size("g").alias("n"), F.round(similarity.containment(F.col("g"), F.col("h")), 6).alias("containment"))


def s4_slices(spark: SparkSession, d: str) -> DataFrame:
    """Largest containment over slices, of entries of one round."""
    g = dedup.slice_grams(table(spark, d, "ledger_entry").select("round_no", "entry_id", F.coalesce("body", F.lit("")).alias("b")), ["round_no", "entry_id"], "b")
    return dedup.similar_pairs(g, g, ["round_no"], "entry_id").where("similarity > 0.3").select("round_no", F.col("a").alias("entry_a"), F.col("b").alias("entry_b"), F.round("similarity", 6).alias("similarity"))


def s5_simhash(spark: SparkSession, d: str) -> DataFrame:
    return similarity.simhash(table(spark, d, "ledger_entry").select("entry_id", "body"), ["entry_id"], "body")


def s6_hamming(spark: SparkSession, d: str) -> DataFrame:
    h = written(s5_simhash(spark, d), "simhash")
    return h.join(h.select((F.col("entry_id") - 1).alias("entry_id"), F.col("simhash").alias("other")), "entry_id").select("entry_id", similarity.hamming(F.col("simhash"), F.col("other")).cast("long").alias("distance"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ledger_entry").select(F.col("round_no").cast("long").alias("batch_id"), F.col("entry_id").alias("pos"), F.col("body").alias("text"))
    return dedup.cluster_batch(rows)


def s7_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select(F.col("pos").alias("entry_id"), "cluster", "keep")


def a8_cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cluster_stats(_clusters(spark, d))


def s8_known_pages(spark: SparkSession, d: str) -> DataFrame:
    """The address of every entry, looked up among the pages as the ledger holds them."""
    rows = table(spark, d, "ledger_entry")
    pages = rows.where("url is not null").select("entry_id", urls.comparable("url").alias("page"))
    return dedup.known_pages(pages, rows.select(F.col("nurl").alias("page"), "round_no"), "page").select("entry_id", "known_round")


def s9_known_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the last tenth of rounds against the bodies before."""
    rows = table(spark, d, "ledger_entry")
    cut = rows.agg(F.max("round_no")).first()[0]
    cut = 0 if cut is None else cut * 9 // 10
    new = rows.where(F.col("round_no") > cut).select(F.col("entry_id").alias("item_id"), F.col("body").alias("text"))
    return dedup.known_bodies(new, rows.where(F.col("round_no") <= cut).select("entry_id", "body"))


def l1_record(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ledger_entry").select("nurl", "url", "round_no", "body")
    cut = F.col("round_no") % 2 == 0
    done = dedup.record_round(rows.where(cut), rows.where(~cut))
    return done.select("nurl", "round_no", F.length("body").alias("n"))


def l2_evict(spark: SparkSession, d: str) -> DataFrame:
    return dedup.evict_bodies(table(spark, d, "ledger_entry").select("entry_id", "round_no", "body"), 400_000).select("entry_id", F.length("body").alias("n"))


def h1_host_stats(spark: SparkSession, d: str) -> DataFrame:
    s = learning.host_stats(table(spark, d, "observation"))
    return s.select("host", "n", "ok", F.round("score_sum", 4).alias("score_sum"), "low", F.round("lat_sum", 3).alias("lat_sum"), "lat_n", "delta")


def h3_folded_stats(spark: SparkSession, d: str) -> DataFrame:
    return learning.folded_stats(table(spark, d, "observation")).select("host", "n", "ok", F.round("score_sum", 4).alias("score_sum"), "low", F.round("lat_sum", 3).alias("lat_sum"), "lat_n", "delta", "changes")


def h4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same fold as a stream over the table, in order of arrival."""
    import uuid

    from pagesift.session import shared_folder
    from pagesift.streaming.host_state import run_once

    schema = table(spark, d, "observation").schema
    import os
    path = f"{d}/observation.parquet"
    stream = spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else f"{d}/observation*.parquet")
    return run_once(stream, shared_folder(spark), f"host-state-{uuid.uuid4().hex}").select("host", "n", "ok", "low", "lat_n", "delta")


def h5_capped_hosts(spark: SparkSession, d: str) -> DataFrame:
    return learning.capped_hosts(written(learning.host_stats(table(spark, d, "observation")), "hosts"), 60).select("host", "n", "delta")


def h6_deltas(spark: SparkSession, d: str) -> DataFrame:
    return learning.with_delta(_items(spark, d).select("item_id", "url"), learning.host_stats(table(spark, d, "observation")), urls.host_of("url")).select("item_id", "delta")


def h7_observed(spark: SparkSession, d: str) -> DataFrame:
    return learning.one_per_host(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), "url")).select("batch_id", "host", F.col("pos").alias("item_id"))


def a1_engines(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.engine_contribution(table(spark, d, "candidate"), ENGINES)


def a2_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ledger_entry").select(F.col("round_no").alias("batch_id"), F.col("entry_id").alias("pos"), F.col("body").alias("text"))
    return conflicts.conflicts(rows)[0].select(F.col("batch_id").alias("round_no"), "metric", "unit", "selfs", "distinct", F.round("lowest", 4).alias("lowest"), F.round("highest", 4).alias("highest"))


def a2_self_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ledger_entry").select(F.col("round_no").alias("batch_id"), F.col("entry_id").alias("pos"), F.col("body").alias("text"))
    return conflicts.conflicts(rows)[1].select(F.col("pos").alias("entry_id"))


def a3_replay(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.replay(table(spark, d, "eval_item"))


def a4_regressions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_item")
    return evaluation.regressions(evaluation.replay(rows.withColumn("form", F.lit(0.5))), evaluation.replay(rows))


def a5_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.weight_grid(table(spark, d, "eval_item"))


def a6_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.leave_one_out(table(spark, d, "eval_item"), [(0.5, 0.4, 0.1), (0.6, 0.25, 0.15), (0.35, 0.5, 0.15), (0.8, 0.1, 0.1)])


def a7_attachments(spark: SparkSession, d: str) -> DataFrame:
    """The index of attachments after the second half of rounds, over what the first half stored."""
    rows = table(spark, d, "ledger_entry").where(F.col("url").rlike(r"(?i)\.pdf") & (F.coalesce("body", F.lit("")) == ""))
    page = rows.select("url", F.concat(F.lit("/files/"), F.substring(F.sha1(urls.comparable("url")), 1, 8)).alias("path"), (F.length("url") * 1000).cast("long").alias("bytes"), F.date_format("delivered_at", "yyyy-MM-dd").alias("added"), "entry_id")
    one = ranking.first_rows(page.withColumn("half", F.col("entry_id") % 2).withColumn("k", urls.comparable("url")), ["half", "k"], ["entry_id"])
    half = one.drop("k", "entry_id")
    return writers.attachment_index(half.where("half = 0").drop("half"), half.where("half = 1").drop("half")).select("key", "bytes", "added", "reused")


def a9_profile(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.profile(table(spark, d, "eval_item"))


def t1_dates(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "candidate").select("date").union(table(spark, d, "documents").select("page_date")).where("date is not null").distinct()
    return raw.select("date", dates.normalized("date", AS_OF).alias("iso"))


def t2_page_dates(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "Last updated on : 31 August, 2024\n").when(F.col("doc_id") % 3 == 1, "Published: Oct 6, 2023\n").otherwise(""), "text")
    return table(spark, d, "documents").select("doc_id", dates.page_date("text").alias("iso"), dates.page_date(t).alias("labelled"), dates.best_date("page_date", "text", AS_OF).alias("best"))


def t4_reflow(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.reflowed("text").alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("hash"))


def t5_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.generic_title(F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("title", 1, 6), F.lit("最终版"))).otherwise(F.col("title"))).alias("generic"), documents.first_title("text").alias("first"), documents.contents("text").alias("contents"))


def t7_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.digested("text", F.coalesce("title", F.lit(""))).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("hash"))


def t9_pdf_payloads(spark: SparkSession, d: str) -> DataFrame:
    head = F.repeat(F.lit("x"), (F.col("doc_id") % 1100).cast("int"))
    content = F.concat(head, F.when(F.col("doc_id") % 2 == 0, "%PDF-1.7").otherwise("<html>"), "text").cast("binary")
    return table(spark, d, "documents").select("doc_id", documents.is_pdf(content).alias("pdf"))


def t11_sections(spark: SparkSession, d: str) -> DataFrame:
    """Archives of rounds, parsed again."""
    rows = table(spark, d, "ledger_entry").where(F.col("body").startswith("## 来源: "))
    joined = rows.groupBy("round_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "body"))), lambda x: x["body"]), "\n\n").alias("t"))
    return joined.select("round_no", F.inline(documents.sections("t"))).select("round_no", "n", "url", F.length("body").alias("length"))


def src5_first_success(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("url", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.when(F.col("doc_id") % (k + 2) == 0, F.substring("text", 1, 200 * (k + 1))).alias("text")) for k in range(3)])).alias("a")).select("url", "a.*")
    return readers.first_success(rows).select("url", "level", F.length("text").alias("n"))


def snk6_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("template_hit").alias("truncated"), F.count_if("garbled_hit").alias("mt_flagged"), F.max("url").alias("u"))
    return rows.select("batch_id", writers.summary_line({"fetched": F.col("fetched"), "truncated": F.col("truncated"), "mt_flagged": F.col("mt_flagged")}).alias("line"), writers.short_url(F.col("u")).alias("shown"))


def snk1_archives(spark: SparkSession, d: str) -> DataFrame:
    items = ranking.top(_items(spark, d).select("batch_id", F.col("item_id").alias("pos"), "url", "score", "text"), "score", 15)
    return writers.archives(items, table(spark, d, "search_batch")).select("batch_id", "name", F.length("markdown").alias("n"))


def whole_search(spark: SparkSession, d: str) -> DataFrame:
    return search_plan(table(spark, d, "fetched_item"), table(spark, d, "search_batch"), table(spark, d, "candidate"), table(spark, d, "ledger_entry").select("nurl", "round_no", "body"), learning.host_stats(table(spark, d, "observation")), AS_OF, decoys=DECOYS)


QUERIES = (
    u1_first_addresses, u2_hosts, u3_comparable, u4_u7_classes, u8_suffix_weights, u9_skip_reasons, u14_file_names, q1_q4_flags, q5_form_parts, q7_content_score, q8_collected, q9_citations, q10_footers, q11_page_titles, q12_extracted,
    v1_v5_relevance, v6_coverage, v7_title_mismatch, r1_meta_rank, r6_authority, r8_rank_items, r10_zero_coverage, r11_top, r12_truncate, r13_fetch_window, r14_interleave, r15_demote, r19_primary_text, r20_quota,
    s2_containment, s4_slices, s5_simhash, s6_hamming, s7_clusters, a8_cluster_stats, s8_known_pages, s9_known_bodies, l1_record, l2_evict, h1_host_stats, h3_folded_stats, h4_stream, h5_capped_hosts, h6_deltas, h7_observed,
    a1_engines, a2_conflicts, a2_self_conflicts, a3_replay, a4_regressions, a5_grid, a6_leave_one_out, a7_attachments, a9_profile, t1_dates, t2_page_dates, t4_reflow, t5_titles, t7_digests, t9_pdf_payloads, t11_sections,
    src5_first_success, snk1_archives, snk6_summary, whole_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
