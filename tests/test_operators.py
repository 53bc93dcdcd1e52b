"""Operators on small relations: known results, nulls, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import similarity
from pagesift.operators import conflicts, dedup, evaluation, learning, ranking
from pagesift.sources import readers, writers


def test_interleave_and_demote(spark):
    urls_ = ["https://a.com/1", "https://a.com/2", "https://a.com/3", "https://b.com/1", None, "https://www.a.com/4"]
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate(urls_)], "batch_id long, pos long, url string")
    got = [r.pos for r in ranking.interleave(df).orderBy("new_pos").collect()]
    assert got == [0, 1, 3, 4, 2, 5]
    flags = [F.col("pos") % 2 == 0, F.col("pos") == 1]
    assert [r.pos for r in ranking.demote(df, flags).orderBy("new_pos").collect()] == [3, 5, 0, 2, 4, 1]
    assert ranking.interleave(df.where("false")).count() == 0


def test_truncate(spark):
    rows = [(1, 1, 0.9, "a" * 50), (1, 2, 0.8, "b" * 200), (1, 3, 0.7, "c"), (1, 4, None, ""), (2, 1, 0.5, "d" * 100), (3, 1, 0.5, "e" * 30), (3, 2, 0.4, "f" * 400)]
    df = spark.createDataFrame(rows, "batch_id long, pos long, rank_score double, text string")
    got = {(r.batch_id, r.pos): (r.status, r.shown) for r in ranking.truncate(df, 200).collect()}
    assert got == {(1, 1): ("whole", 50), (1, 2): ("cut", 150), (1, 3): ("dropped", 0), (2, 1): ("whole", 100), (3, 1): ("whole", 30), (3, 2): ("cut", 170)}
    assert {r.status for r in ranking.truncate(df.where("batch_id = 3"), 120).collect()} == {"whole", "dropped"}


def test_zero_coverage_gate(spark):
    rows = [(1, i, float(10 - i), 0.0 if i in (1, 7, 8, 9) else 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "batch_id long, pos long, rank_score double, coverage double")
    assert {r.pos for r in ranking.zero_coverage_gate(df).collect()} == {0, 1, 2, 3, 4, 5, 6}
    none = df.withColumn("coverage", F.lit(0.0))
    assert ranking.zero_coverage_gate(none).count() == 5
    assert ranking.zero_coverage_gate(df.limit(9)).count() == 9


def test_fetch_window(spark):
    rows = [(1, 0, "https://a.com/1", False), (1, 1, "https://a.com/2", True), (1, 2, "https://b.com/1", True), (1, 3, "https://c.com/1", True)]
    df = spark.createDataFrame(rows, "batch_id long, pos long, url string, fetch_ok boolean")
    got = {r.pos: (r.skipped, r.tried) for r in ranking.fetch_window(df, 2).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (False, True), 3: (False, False)}


def test_first_rows_with_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, pos long, v string")
    assert sorted(map(tuple, ranking.first_rows(df, ["k"], ["pos", "v"]).collect()), key=str) == [("a", 1, "x"), (None, 3, "z")]


def test_meta_rank_prefers_relevant(spark):
    c = spark.createDataFrame([(1, 0, "https://a.com/1", "钠离子电芯", "钠离子电芯的市场" * 20, "2025-01", ["e"], {"e": 3}), (1, 1, "https://b.com/1", "无关", None, None, [], {}), (1, 2, "https://b.com/1", "again", "x", None, None, None), (1, 3, None, "no url", "", None, [], {})],
                              "batch_id long, pos int, url string, title string, snippet string, date string, engine array<string>, positions map<string,int>")
    b = spark.createDataFrame([(1, "钠离子电芯"), (2, None)], "batch_id long, query string")
    got = ranking.meta_rank(c, b, 2025).orderBy("rank").collect()
    assert [r.url for r in got] == ["https://a.com/1", "https://b.com/1"] and got[0].score > got[1].score
    assert ranking.meta_rank(c.where("false"), b, 2025).count() == 0


def test_only_decoys(spark):
    df = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, []), (4, None), (5, ["x", ""])], "i int, engine array<string>")
    assert [r.i for r in df.where(ranking.only_decoys("engine", ["x"])).orderBy("i").collect()] == [1, 5]


def hashed(text):
    t = "".join(text.split())[:2000]
    sums = [0] * 64
    for i in range(len(t) - 2):
        h = int.from_bytes(hashlib.md5(t[i : i + 3].encode()).digest()[:8], "big")
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    v = sum(1 << b for b in range(64) if sums[b] > 0)
    return v - (1 << 64) if v >= 1 << 63 else v


def test_simhash(spark):
    texts = ["根据统计 市场规模\n约为12亿元。" * 9, "The quick brown fox jumps over the lazy dog", "ab", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.simhash for r in similarity.simhash(df, ["id"], "text").collect()}
    assert got == {i: hashed(t) if t and len("".join(t.split())) >= 3 else 0 for i, t in enumerate(texts)}


def test_clusters(spark):
    a, b = "各地发布新规，要求企业按季度披露能耗数据与减排目标。" * 12, "The committee met on Monday to discuss the harbour extension in detail. " * 10
    rows = [(1, 0, a), (1, 1, "导语若干。" + a), (1, 2, b), (1, 3, None), (1, 4, ""), (2, 0, a), (1, 5, a)]
    df = spark.createDataFrame(rows, "batch_id long, pos long, text string")
    got = {(r.batch_id, r.pos): (r.cluster, r.keep) for r in dedup.cluster_batch(df).collect()}
    assert got == {(1, 0): (0, False), (1, 1): (0, True), (1, 2): (2, True), (1, 3): (3, True), (1, 4): (4, True), (1, 5): (0, False), (2, 0): (0, True)}
    stats = {r.batch_id: (r.before, r.after, r.dropped) for r in dedup.cluster_stats(dedup.cluster_batch(df)).collect()}
    assert stats == {1: (6, 4, 2), 2: (1, 1, 0)}
    assert dedup.cluster_batch(df.where("false")).count() == 0


def test_components_of_a_chain(spark):
    n = 40
    v = spark.createDataFrame([(1, i) for i in range(n)], "batch_id long, id long")
    e = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1) if i != 20], "batch_id long, a long, b long")
    got = {r.id: r.cluster for r in dedup.components(e, v, "batch_id").collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(n)}


def test_ledger(spark):
    old = spark.createDataFrame([("p", "u1", 1, "short"), ("q", "u2", 2, None), (None, "u", 1, "x")], "nurl string, url string, round_no int, body string")
    new = spark.createDataFrame([("p", "u9", 3, "much longer"), ("r", "u3", 3, ""), ("", "u", 3, "x")], "nurl string, url string, round_no int, body string")
    got = {r.nurl: (r.url, r.round_no, r.body) for r in dedup.record_round(old, new).collect()}
    assert got == {"p": ("u1", 1, "much longer"), "q": ("u2", 2, ""), "r": ("u3", 3, "")}
    rounds = spark.createDataFrame([(i, i, "x" * 10) for i in range(1, 5)], "entry_id long, round_no int, body string")
    assert [r.entry_id for r in dedup.evict_bodies(rounds, 25).where("body != ''").orderBy("entry_id").collect()] == [3, 4]
    assert [r.entry_id for r in dedup.evict_bodies(rounds, 5).where("body != ''").collect()] == [4]
    known = dedup.known_pages(spark.createDataFrame([("p",), ("zz",), (None,)], "nurl string"), old)
    assert {(r.nurl, r.known_round) for r in known.collect()} == {("p", 1), ("zz", None), (None, None)}


def test_known_bodies(spark):
    a = "各地发布新规，要求企业按季度披露能耗数据与减排目标。" * 12
    items = spark.createDataFrame([(1, "自己的导语。" + a), (2, "完全无关的另一篇文章，讲的是港口扩建。"), (3, None)], "item_id long, text string")
    ledger = spark.createDataFrame([(9, a), (8, None)], "entry_id long, body string")
    assert [(r.item_id, r.how) for r in dedup.known_bodies(items, ledger, bits=4).collect()] == [(1, "gram")]


def observations(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, host string, fetch_ok boolean, score double, template_hit boolean, garbled_hit boolean, latency double, observed_at string").withColumn("observed_at", F.to_timestamp("observed_at"))


def test_host_judgement(spark):
    def host(name, n, ok, score, bad=False, lat=1.0, start=0):
        return [(start + i, name, ok, score, bad, False, lat, f"2025-01-{i % 28 + 1:02d} 00:00:00") for i in range(n)]

    rows = host("few.com", 4, False, None) + host("dead.com", 8, False, None, start=100) + host("LOW.com", 6, True, 0.1, start=200) + host("https://www.slow.com/x", 6, True, 0.5, lat=30.0, start=300) + host("good.com", 10, True, 0.9, start=400) + host("", 6, True, 0.9, start=500)
    df = observations(spark, rows + rows[:3])
    want = {"few.com": 0.0, "dead.com": -0.5, "low.com": -0.4, "slow.com": -0.3, "good.com": 0.1}
    assert {r.host: r.delta for r in learning.host_stats(df).collect()} == want
    folded = {r.host: (r.n, r.delta) for r in learning.folded_stats(df).collect()}
    assert {h: d for h, (_, d) in folded.items()} == want and folded["few.com"][0] == 4
    assert learning.host_stats(df.where("false")).count() == 0 and learning.folded_stats(df.where("false")).count() == 0


def test_decay(spark):
    s = learning.HostState()
    for _ in range(8):
        s.add(True, 0.5, False, None, 86400.0)
    s.idle(86400.0 * 32)
    assert (s.n, s.score_sum) == (4, 2.0)
    s.add(True, 0.5, False, None, 86400.0 * 200)
    assert s.n == 1  # forgotten after long silence


def test_cap(spark):
    stats = spark.createDataFrame([(f"h{i}", i, -0.5 if i == 0 else 0.0) for i in range(10)], "host string, n long, delta double")
    assert sorted(r.host for r in learning.capped_hosts(stats, 4).collect()) == ["h0", "h7", "h8", "h9"]
    assert learning.capped_hosts(stats, 50).count() == 10


def test_stream_equals_fold(spark, tmp_path):
    from pagesift.streaming.host_state import run_once

    rows = [(i, f"h{i % 3}.com", i % 4 != 0, None if i % 4 == 0 else 0.8, False, i % 7 == 0, 2.0, f"2025-01-{i % 9 + 1:02d} 00:00:00") for i in range(60)]
    observations(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = {r.host: (r.n, r.ok, r.delta) for r in run_once(stream, str(tmp_path), "t").collect()}
    want = {r.host: (r.n, r.ok, r.delta) for r in learning.folded_stats(observations(spark, rows)).collect()}
    assert got == want


def test_conflicts(spark):
    rows = [(1, 1, "市场规模约为10亿元，另一处市场规模为100亿元。"), (1, 2, "市场规模2亿元"), (1, 3, "市场规模30亿元"), (1, 4, "市场规模1.5万亿元 市场容量5亿美元"), (1, 5, None), (2, 1, "无")]
    df = spark.createDataFrame(rows, "batch_id long, pos long, text string")
    found, bad = conflicts.conflicts(df)
    r = found.collect()
    assert len(r) == 1 and (r[0].metric, r[0].unit, r[0].selfs, r[0].distinct, r[0].lowest, r[0].highest) == ("市场规模", "元", 1, 5, 2.0, 15000.0)
    assert [x.pos for x in bad.collect()] == [1]


def test_evaluation(spark):
    rows = [(i, "q", f"https://h{i % 3}.com/{i}", "d" if i % 2 else None, i / 10, -1.0 if i == 3 else 0.5, float("nan") if i == 4 else 0.5, None if i == 5 else float(i % 3), None) for i in range(8)] + [(99, "q", "https://h0.com/0", "d", 9.0, 9.0, 9.0, 9.0, True)]
    df = spark.createDataFrame(rows, "eval_id long, query string, url string, domain string, form double, authority double, coverage double, rel double, weak_core boolean")
    r = evaluation.replay(df).first()
    assert r.top3.split()[0] == "https://h1.com/7" and r.top1_rel == 1.0
    assert evaluation.weight_grid(df).count() == 40 and evaluation.best_weights(evaluation.weight_grid(df)).count() == 1
    assert evaluation.regressions(evaluation.replay(df), evaluation.replay(df)).count() == 0
    assert {(x.domain, x.rows) for x in evaluation.profile(df).collect()} == {(None, 8), ("", 4), ("d", 4)}
    assert evaluation.leave_one_out(df, [(0.5, 0.4, 0.1)]).count() == 2
    assert evaluation.replay(df.where("false")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"url": "u", "title": "t", "positions": {"e": 2}}], "engine_status": [{"engine": "e", "ok": true}]}')
    (tmp_path / "b.json").write_text('[{"url": "v"}]')
    hits, states = readers.search_results(spark, str(tmp_path))
    assert {(r.url, r.pos) for r in hits.collect()} == {("u", 0), ("v", 0)} and [r.engine for r in states.collect()] == ["e"]
    (tmp_path / "q.txt").write_text("# c\n\nquery one\n")
    assert [r.query for r in readers.queries(spark, str(tmp_path / "q.txt")).collect()] == ["query one"]
    assert readers.host_stats(spark, str(tmp_path / "missing")).count() == 0 and readers.domain_model(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "m.json").write_text('{"prior": {}, "dom": {"a.com": [0.7, 3]}}')
    assert [tuple(r) for r in readers.domain_model(spark, str(tmp_path / "m.json")).collect()] == [("a.com", 0.7)]
    (tmp_path / "l.json").write_text('{"items": [{"query": "q", "rel": 1.0}]}')
    assert [r.rel for r in readers.labels(spark, str(tmp_path / "l.json")).collect()] == [1.0]


def test_writers(spark):
    items = spark.createDataFrame([(1, 1, "https://a.com/x", "## 来源: https://a.com/x\n\n正文一。"), (1, 2, "https://b.com", None)], "batch_id long, rank int, url string, text string")
    batches = spark.createDataFrame([(1, "问:题"), (2, "none")], "batch_id long, query string")
    r = writers.archives(items, batches).collect()
    assert len(r) == 1 and r[0].name == "01_问:题.md".replace(":", "-") and "**[1] a.com**" in r[0].markdown and "## 来源: https://a.com/x" in r[0].markdown
    names = spark.createDataFrame([("03_a.md",), ("x.md",)], "name string")
    assert writers.next_number(names).first()[0] == 4
    old = spark.createDataFrame([("https://a.com/1.pdf", "p1", 10, "2025-01-01"), ("https://a.com/2.pdf", "p2", 10, "2025-01-01")], "url string, path string, bytes long, added string")
    new = spark.createDataFrame([("http://a.com/1.pdf?utm_source=x", "p1", 10, "2025-02-01"), ("https://a.com/3.pdf", "p3", 5, "2025-02-01")], "url string, path string, bytes long, added string")
    got = {r.path: (r.added, r.reused) for r in writers.attachment_index(old, new).collect()}
    assert got == {"p1": ("2025-01-01", True), "p2": ("2025-01-01", False), "p3": ("2025-02-01", False)}


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
