"""Searches of the problems against brute force, on small tables with nulls, ties, repeats, empty and clashing columns."""

import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagesift.functions import urls
from pagesift.llm import _meet, contamination, contributor_cap, history, leximin, near_duplicates
from pagesift.llm._alike import share_in_both
from pagesift.llm._chars import bare
from pagesift.session import written

WORDS = "市场 规模 订单 均价 企业 采购 标准 更新 合格率 出货量 连续 季度 下降 上升 新规 要求 标注 样本 覆盖 县区 口岸 通关 时间 缩短 产线 扩至 研发 人员 占比 渠道".split()


def article(rng, n=160):
    return "".join(rng.choice(WORDS) + ("，" if i % 7 == 6 else "。" if i % 13 == 12 else "") + str(rng.randrange(100)) * (i % 5 == 0) for i in range(n))


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        t[rng.randrange(len(t))] = rng.choice("甲乙丙丁戊")
    return "".join(t)


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(5)
    rows, i = [], 0

    def add(round_no, url, body):
        nonlocal i
        i += 1
        rows.append((i, round_no, url, body, "k1 clash", "band clash"))

    for g in range(12):
        base = article(rng)
        add(g % 4 + 1, f"https://a{g}.example/x", "## 来源: https://a.example/x\n\n" + base)
        for k in range(3):
            add(rng.randrange(1, 7), f"https://b{g}-{k}.example/y", edited(rng, base, rng.randrange(0, 14)))
        add(5, f"http://a{g}.example:80/x/?utm_source=q#f", article(rng))
        cut = len(base) // 3
        add(6, None, base[cut:] + "\n\n" + base[:cut] + article(rng, 20))
    for body in (None, "", "短文", "  \n", "x" * 250, "x" * 250):
        add(3, "", body)
    add(None, "https://a0.example/x", rows[0][3])
    add(2, "https://long.example", article(rng, 20_000))
    return rows


FORM = "entry_id long, round_no int, url string, body string, k1 string, band string"


def alike(rows):
    texts = [(r[0], r[3]) for r in rows if len(bare(r[3])) >= 200]
    return {(a, b) for k, (a, x) in enumerate(texts) for b, y in texts[k + 1 :] if share_in_both(x, y) >= 0.6}


def test_alike_pairs(spark, entries):
    df = spark.createDataFrame(entries, FORM)
    want = alike(entries)
    got = {(r.entry_a, r.entry_b) for r in near_duplicates.alike_entries(df.union(df.limit(0))).collect()}
    assert len(want) > 60 and got == want
    assert near_duplicates.alike_entries(df.where("false")).count() == 0


def test_groups(spark, entries):
    df = spark.createDataFrame(entries, FORM)
    label = {r[0]: r[0] for r in entries if len(bare(r[3])) >= 200}
    links = alike(entries)
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.entry_id: r.group for r in near_duplicates.groups(df).collect()} == label


def comparable_forms(addresses):
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(a,) for a in {a for a in addresses if a}] or [("",)], "url string")
    return {r.url: r.page or None for r in df.select("url", urls.comparable("url").alias("page")).collect()}


def repeats_of(rows):
    known = [r for r in rows if r[1] is not None]
    out = set()
    links = alike(known)
    rounds = {r[0]: r[1] for r in known}
    for a, b in links:
        if rounds[a] != rounds[b]:
            out.add(a if rounds[a] > rounds[b] else b)
    form = comparable_forms(r[2] for r in known)
    for r in known:
        page = form.get(r[2])
        if page and any(form.get(s[2]) == page and s[1] < r[1] for s in known):
            out.add(r[0])
    return out


def test_repeats(spark, entries):
    df = spark.createDataFrame(entries, FORM)
    want = repeats_of(entries)
    assert len(want) > 30 and {r.entry_id for r in history.repeats(df).collect()} == want
    assert history.repeats(df.where("false")).count() == 0


def test_history_round_by_round(spark, entries, tmp_path):
    h = history.History(spark, str(tmp_path), buckets=4)
    df = spark.createDataFrame(entries, FORM)
    found = set()
    for low, high in ((1, 2), (3, 4), (5, 5), (6, 9)):
        found |= {r.entry_id for r in h.append(df.where(F.col("round_no").between(low, high))).collect()}
    assert found == repeats_of(entries)
    again = h.append(df.where("entry_id <= 3").withColumn("round_no", F.lit(99)).withColumn("entry_id", F.col("entry_id") + 1000))
    assert {r.entry_id for r in again.collect()} == {1001, 1002, 1003}


def test_over_cap(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        host = "big" if i % 3 == 0 else f"h{rng.randrange(20)}"
        rows.append((i, 1 if i % 5 else 2, host if i % 41 else None, rng.choice([None, float("nan"), 0.5, 0.5, rng.random(), 3.0, -1.0]), 3 if i % 5 else 2, "x"))
    df = spark.createDataFrame(rows + rows[:100], "item_id long, batch_id long, host string, score double, host_cap int, _bin string")
    want, groups = set(), {}
    for r in rows:
        if r[2]:
            groups.setdefault((r[1], r[2]), []).append(r)
    for g in groups.values():
        value = lambda r: float("-inf") if r[3] is None or r[3] != r[3] else r[3]
        want |= {r[0] for r in sorted(g, key=lambda r: (-value(r), r[0]))[g[0][4] :]}
    run = lambda d, **k: {r.item_id for r in contributor_cap.over_cap(d, ["batch_id", "host"], "host_cap", "item_id", "score", **k).collect()}
    assert run(df) == want and run(df, bins=3) == want and run(df.where("false")) == set()
    assert len(run(df.withColumn("host_cap", F.lit(0)))) == sum(map(len, groups.values()))


def test_leximin(spark):
    rng = random.Random(3)
    rows = [(i, "q" if i % 3 else "other", rng.choice([None, float("nan"), -1.0, 1.0, 2.0, rng.random() * 1e6]), rng.random(), rng.choice([0.0, 1.0]), 7) for i in range(120)] + [(500, None, 1.0, 1.0, 1.0, 7)]
    df = spark.createDataFrame(rows, "eval_id long, query string, authority double, coverage double, rel double, rank int")
    want = {}
    for q in ("q", "other"):
        own = [r for r in rows if r[1] == q]

        def share(r, c):
            v = r[c]
            vals = [x[c] for x in own if x[c] is not None and x[c] == x[c] and x[c] != -1.0]
            return 0.0 if v is None or v != v or v == -1.0 else (2 * sum(x < v for x in vals) + sum(x == v for x in vals)) / (2 * len(vals))

        vectors = {r[0]: sorted(share(r, c) for c in (2, 3, 4)) for r in own}
        for k, i in enumerate(sorted(vectors, key=lambda i: ([-p for p in vectors[i]], i)), 1):
            want[i] = k
    got = leximin.leximin(df, "query", "eval_id", ["authority", "coverage", "rel"])
    assert {r.eval_id: r["rank"] for r in got.collect()} == want
    assert leximin.leximin(df.where("false"), "query", "eval_id", ["authority"]).count() == 0


def longest_run(a, b):
    x, y = ["".join(c.lower() for c in t if c.isalnum()) for t in (a, b)]
    best, row = 0, [0] * (len(y) + 1)
    for c in x:
        new = [0] * (len(y) + 1)
        for j, e in enumerate(y):
            if c == e:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


@pytest.mark.parametrize("most_sent", [10**9, -1])
def test_leaks(spark, most_sent):
    rng = random.Random(4)
    items = [(i, article(rng, 40)) for i in range(6)] + [(90, None), (91, ""), (92, "短")]
    docs = []
    for d in range(40):
        t = article(rng, 60)
        if d % 3 == 0:
            p = items[d % 6][1]
            part = p[d % 20 : d % 20 + rng.choice([30, 49, 50, 60, 200])]
            part = part.upper().replace("，", " ** ") if d % 2 else edited(rng, part, d % 4)
            t = t[:100] + part + t[100:]
        docs.append((d, t, 1))
    docs += [(80, None, 1), (81, "", 1), (82, "词", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.item_id, r.doc_id): r.run for r in contamination.leaks(df, it, most_sent=most_sent).collect()}
    for i, p in items:
        for d, t, _ in docs:
            n = longest_run(p or "", t or "")
            if n >= 24:
                assert got[i, d] == n, (i, d, n)
    assert max(got.values()) > 50 and contamination.leaks(df.where("false"), it, most_sent=most_sent).count() == 0 and contamination.leaks(df, it.where("false"), most_sent=most_sent).count() == 0


def test_leak_with_substitutions(spark):
    rng = random.Random(9)
    p = article(rng, 60)
    t = list(p)
    for k in range(20, len(t), 40):
        while not t[k].isalnum():
            k += 1
        t[k] = "ж"
    got = contamination.leaks(spark.createDataFrame([(1, "".join(t))], "doc_id long, text string"), spark.createDataFrame([(1, p)], "item_id long, passage string")).first()
    assert got["run"] < 60 and got["share"] > 0.9


def test_hot_chunks(spark, monkeypatch):
    """Furniture on all pages pairs none of them, and hides no repeat; frequent chunks are dealt into parts."""
    rng = random.Random(8)
    foot = article(rng, 30)
    rows = [(i, i % 5, f"https://h{i}.example", article(rng, 150) + "\n\n" + foot) for i in range(60)]
    rows += [(100 + k, 9, None, edited(rng, rows[k][3], 8)) for k in range(10)]
    rows += [(200 + k, k % 2, None, foot + "\n" + foot[::-1] + article(rng, 8)) for k in range(30)]
    df = spark.createDataFrame(rows, "entry_id long, round_no int, url string, body string")
    want = repeats_of(rows)
    assert {r.entry_id for r in history.repeats(df).collect()} == want
    records = written(history.keyed(df).where(F.size("chunks") > 0).select(F.col("k1").alias("k"), "s1", "s2", "chunks"), "records")
    largest = lambda rows: rows.groupBy("key").count().agg(F.max("count")).first()[0]
    # left out by prefix filtering: furniture is in no search list of the pages that have it beside their own text
    assert largest(history._searched(records)) < largest(records.select(F.explode("chunks").alias("key")))
    monkeypatch.setattr(history, "hot_above", lambda counters: (0.0, 20.0))
    assert {r.entry_id for r in history.repeats(df).collect()} == want


def test_large_family(spark, monkeypatch, tmp_path):
    """Reprints edited throughout keep few chunks but those that all of them carry; split or not, each pair meets once,
    and repeats and append agree."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    parts = [word(n) for _ in range(12) for n in (40, 40, 40, 75)]
    rows = [(i, i, None, "".join(p + word(1) for p in parts)) for i in range(60)]
    df = spark.createDataFrame(rows, "entry_id long, round_no int, url string, body string")
    want, links = repeats_of(rows), alike(rows)
    assert len(want) == 59 and len(links) == 60 * 59 // 2
    records = written(history.keyed(df).where(F.size("chunks") > 0).select(F.col("k1").alias("k"), "s1", "s2", "chunks"), "records")
    whole = {tuple(r) for r in _meet.meeting(history._searched(records)).collect()}
    assert len(whole) == len(links) and {r.entry_id for r in history.repeats(df).collect()} == want
    # as if each counter held much less than the family: the chunks of all are split
    for module in (history, near_duplicates):
        monkeypatch.setattr(module, "hot_above", lambda counters: (0.0, 20.0))
    split = history._searched(records)
    assert split.where("meta & 1 = 0").count() > 0 and split.groupBy("key").count().agg(F.max("count")).first()[0] < 40
    assert {tuple(r) for r in _meet.meeting(split).collect()} == whole
    assert {(r.entry_a, r.entry_b) for r in near_duplicates.alike_entries(df).collect()} == links
    h = history.History(spark, str(tmp_path / "h"), buckets=2)
    assert {r.entry_id for r in h.append(df).collect()} == want


@pytest.mark.parametrize("gap", [33, 36, 40])
def test_regularly_spaced_edits(spark, gap):
    """Texts with one letter changed every 33 to 40 characters are alike by the definition, in any script, and are found."""
    import string

    from tests_llm_words import CHINESE, ENGLISH, GERMAN

    rng = random.Random(gap)
    rows = []
    for kind in (ENGLISH, GERMAN, CHINESE):
        for k in range(12):
            # words of its own in every sentence, so that texts are not alike by their sentences
            own = lambda: "".join(rng.choice(string.ascii_lowercase if kind is not CHINESE else "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未") for _ in range(9))
            t = "".join(rng.choice(kind).format(own(), own()) for _ in range(10))
            t = bare(t)
            u = list(t)
            for j in range(gap // 2, len(u), gap):
                u[j] = "q"
            rows += [(len(rows), 1, None, t), (len(rows) + 1, 2, None, "".join(u))]
    df = spark.createDataFrame(rows, "entry_id long, round_no int, url string, body string")
    links, want = alike(rows), repeats_of(rows)
    assert len(want) >= 12
    assert len(want - {r.entry_id for r in history.repeats(df).collect()}) <= 0.02 * len(want)
    assert len(links - {(r.entry_a, r.entry_b) for r in near_duplicates.alike_entries(df).collect()}) <= 0.01 * len(links)


def test_all_chunks_of_long_texts(spark, monkeypatch, tmp_path):
    """Long texts whose short words stand between marks have few whole chunks in common when they are changed throughout:
    what they share is counted over all chunks, not over some of them."""
    import string

    rng = random.Random(1)
    rows = []
    for _ in range(60):
        t = "".join(rng.choice(string.ascii_lowercase) if i % 6 else "," for i in range(rng.randrange(500, 4000)))
        u = list(t)
        for j in range(16, len(u), 33):
            u[j] = "#"
        n = len(rows)
        rows += [(n, 1, f"https://a{n}.example", t), (n + 1, 2, f"https://b{n}.example", "".join(u))]
    df = spark.createDataFrame(rows, "entry_id long, round_no int, url string, body string")
    want = {r[0] for k, r in enumerate(rows) if k % 2 and share_in_both(rows[k - 1][3], r[3]) >= 0.6}
    assert len(want) == 60 and {r.entry_id for r in history.repeats(df).collect()} == want
    monkeypatch.setattr(history, "TURN_CHUNKS", 5000)  # the same in several turns
    h = history.History(spark, str(tmp_path / "h"), buckets=4)
    assert h.append(df.where("round_no = 1")).count() == 0 and {r.entry_id for r in h.append(df.where("round_no = 2")).collect()} == want
    # chunks of a short text are chunks of every long text that begins with it, but for those that its own end cuts off
    short, long = history.chunks_of([rows[0][3][:200], rows[0][3]])
    assert len(set(short.tolist()) - set(long.tolist())) <= 8 < len(short)


def test_packed_chunks(spark, monkeypatch, tmp_path):
    """Packed chunks bring the same records together as rows of chunks do, and copies add none."""
    rng = random.Random(12)
    bases = [article(rng) for _ in range(30)]
    rows = [(i, i % 7, f"https://p{i}.example", edited(rng, bases[i % 30], i // 30 * 5)) for i in range(120)]
    copies = [(1000 + i, 8, None, rows[i][3] + "\n") for i in range(20)]
    form = "entry_id long, round_no int, url string, body string"
    df = spark.createDataFrame(rows, form)
    h = history.History(spark, str(tmp_path / "h"), buckets=2)
    got = h.append(spark.createDataFrame(rows + copies, form).repartition(4))
    assert {r.entry_id for r in got.collect()} == repeats_of(rows + copies)
    n = sum(map(len, history.chunks_of(sorted({bare(r[3]) for r in rows}))))
    assert n > 8000
    from pagesift.llm import _packed

    stored = _packed.unblocked(h._table([f"{tmp_path}/h/{h._manifests()[0]['folder']}/chunks"], _packed.BLOCKS))
    assert stored.count() == stored.distinct().count() == n
    records = written(history.keyed(df.coalesce(1)).where(F.size("chunks") > 0).select(F.col("k1").alias("k"), "s1", "s2", "chunks"), "records")
    want = {(r.a, r.b) for r in _meet.meeting(history._searched(records)).collect()}
    counters = history._frequencies(records)
    for part_chunks, turn_chunks, often in ((10**6, 10**6, 1000.0), (900, 2500, 1000.0), (900, 2500, 3.0)):
        monkeypatch.setattr(_packed, "PART_CHUNKS", part_chunks)
        monkeypatch.setattr(history, "TURN_CHUNKS", turn_chunks)
        monkeypatch.setattr(history, "hot_above", lambda counters, often=often: (0.0, often))
        assert len(want) > 60 and {(r.a, r.b) for r in history._shared(records, counters).collect()} == want


def test_bytes_a_chunk(spark, tmp_path):
    """The chunk-to-record table takes few bytes a chunk."""
    rng = random.Random(12)
    rows = [(i, i % 7, None, article(rng)) for i in range(1500)]
    history.History(spark, str(tmp_path / "h"), buckets=2).append(spark.createDataFrame(rows, "entry_id long, round_no int, url string, body string"))
    n = sum(map(len, history.chunks_of([bare(r[3]) for r in rows])))
    assert n > 100_000 and sum(f.stat().st_size for f in (tmp_path / "h").rglob("chunks/**/*.parquet")) < 8 * n


def test_long_runs(monkeypatch):
    """Runs of many records are compared in blocks, others by their distance; both find each pair once."""
    import numpy as np
    import pyarrow as pa

    from pagesift.llm import _packed

    rng = np.random.default_rng(3)
    chunks = np.concatenate([(np.sort(rng.choice(30, 12, replace=False)) + 1 << 6) + 20 for _ in range(40)])
    owners = np.repeat(np.arange(40), 12)
    sketch = np.where(rng.random(40) < 0.5, -1, 0)
    records = np.column_stack([rng.permutation(40) - 20, sketch, sketch, np.arange(40)])
    table = pa.Table.from_batches([_packed.exchanged(chunks, owners, records, np.zeros(len(chunks), np.int64), _packed.MET_WIDTH)])
    sets = [set(chunks[owners == i].tolist()) for i in range(40)]
    want = set()
    for x in range(40):
        for y in range(40):
            if records[x, 0] < records[y, 0] and sketch[x] == sketch[y] and sets[x] & sets[y]:
                want.add((int(records[x, 0]), int(records[y, 0]), 20 * len(sets[x] & sets[y]), max(x, y)))
    for long, block, most in ((128, 1 << 20, 10**6), (3, 50, 100), (0, 1 << 20, 10**6)):
        for name, value in (("LONG_RUN", long), ("BLOCK_PAIRS", block), ("MOST_FOUND", most)):
            monkeypatch.setattr(_packed, name, value)
        got = list(zip(*(c.to_pylist() for c in _packed.met(table).columns)))
        assert len(got) == len(set(got)) and set(got) == want


def test_few_shingles_and_common_parts(spark):
    """A text of period 20 with an edit, and reprints of a text that a third of all rows share a part of."""
    rng = random.Random(4)
    period = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(20)) * 12
    rows = [(0, 1, None, period), (1, 2, None, period[:120] + "#" + period[121:])]
    common = bare(article(rng, 90))
    rows += [(10 + k, 1, None, common + bare(article(rng, 12))) for k in range(40)]
    rows += [(100 + k, 1, None, bare(article(rng, 120))) for k in range(80)]
    df = spark.createDataFrame(rows, "entry_id long, round_no int, url string, body string")
    links = alike(rows)
    got = {(r.entry_a, r.entry_b) for r in near_duplicates.alike_entries(df).collect()}
    assert (0, 1) in links and (0, 1) in got
    assert len(links) > 500 and not got - links and len(links - got) <= 0.01 * len(links)
    assert {r.entry_id for r in history.repeats(df).collect()} == repeats_of(rows)


def test_history_is_idempotent_and_compact(spark, entries, tmp_path):
    df = spark.createDataFrame(entries, FORM)
    h = history.History(spark, str(tmp_path / "h"), buckets=4)
    first = h.append(df.where("round_no <= 3"))
    n = h.spark.read.parquet(*(f"{tmp_path}/h/{m['folder']}/chunks" for m in h._manifests())).count()
    assert {r.entry_id for r in h.append(df.where("round_no <= 3")).collect()} == {r.entry_id for r in first.collect()} and len(h._manifests()) == 1
    # a batch that broke off before its manifest was written is no history, and is written anew
    second = h.append(df.where("round_no = 4")).collect()
    h._fs.delete(h._path("manifests/4-4.json"), False)
    again = h.append(df.where("round_no = 4"))
    assert {r.entry_id for r in again.collect()} == {r.entry_id for r in second}
    h.compact()
    assert len(h._manifests()) == 1
    assert h.spark.read.parquet(f"{tmp_path}/h/{h._manifests()[0]['folder']}/chunks").count() > n
    rest = h.append(df.where("round_no > 4"))
    found = {r.entry_id for part in (first, again, rest) for r in part.collect()}
    assert found == repeats_of(entries)
    # batches of whole rounds give the same as one batch
    whole = history.History(spark, str(tmp_path / "w"), buckets=4).accepted(df, batch_rows=30)
    assert {r.entry_id for r in whole.collect()} == repeats_of(entries) and whole.count() == len(repeats_of(entries))
    assert history.History(spark, str(tmp_path / "e"), buckets=4).accepted(df.where("false")).count() == 0


def test_pair_measures():
    import numpy as np

    rng = random.Random(11)
    a = article(rng, 60)
    b = edited(rng, a, 6)
    flat = np.ones(near_duplicates.COUNTERS, np.float32)
    measured = lambda x, y: near_duplicates.measures(near_duplicates.weighted_shingles(x, flat), near_duplicates.weighted_shingles(y, flat))
    share, weighted = measured(a, b)
    assert share == pytest.approx(share_in_both(a, b)) and abs(share - weighted) < 0.05
    assert measured(a, a) == (1.0, 1.0)
    assert measured(a, None) == (0.0, 0.0) and measured("", "短")[0] == 0.0
