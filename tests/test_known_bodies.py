"""S9 against brute force, and what it moves."""

import random

import numpy as np

from pagesift.functions import similarity
from pagesift.functions.windows import Index, Windows, largest
from pagesift.operators import dedup


def bodies(n, seed, most=1600):
    """Texts of words that many share, some copied in part from others, of all lengths from none on."""
    r = random.Random(seed)
    words = ["".join(chr(r.choice((97, 0x4E00, 0x1F600)) + r.randrange(26)) for _ in range(r.randint(1, 9))) for _ in range(400)]
    out = [None, "", " 　\n", "a", "ab", "a b", "abc", "## 来源: https://a.example/x\n\nab", "aaaaaaaaaa"]
    while len(out) < n:
        text = "".join(r.choice(words[:40] if r.random() < 0.4 else words) + r.choice(("", " ", "。\n")) for _ in range(r.randrange(1, most // 6)))
        if len(out) > 20 and r.random() < 0.5:
            old = r.choice(out[9:])
            a = r.randrange(len(old))
            text = r.choice((text[: r.randrange(200)] + old[a : a + r.randrange(900)], old[:a] + text[:30] + old[a:], old[: r.randrange(3, 40)]))
        out.append(text)
    return out


def sets(text, limit):
    t = "".join((text or "").split()) if not (text or "").startswith("## 来源") else "".join(text.split()[3:])

    def grams(s):
        return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) > 2 else {s} - {""}

    return [grams(t[:limit])], [grams(t[k : k + 512]) for k in range(0, min(len(t), 2048), 512)]


def brute(items, ledger, similar, limit):
    known = [sets(t, limit) for t in ledger]
    out = {}
    for k, text in items:
        own = sets(text, limit)
        best = max((len(a & b) / min(len(a), len(b)) for other in known for kind in (0, 1) for a in own[kind] for b in other[kind] if a and b), default=0.0)
        if best > similar:
            out[k] = best
    return out


def run(spark, items, ledger, **settings):
    got = dedup.known_bodies(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(ledger)), "entry_id long, body string"), **settings).collect()
    assert len({r.item_id for r in got}) == len(got) and {r.how for r in got} <= {"gram"}
    return {r.item_id: r.similarity for r in got}


def test_largest_containment_of_each_item(spark, monkeypatch):
    texts = bodies(170, 3)
    items, ledger = list(enumerate(texts[:9] + texts[120:])), texts[:120]
    for similar, limit in ((0.6, 512), (0.6, 300), (0.3, 700)):
        want = {k: round(x, 3) for k, x in brute(items, ledger, similar, limit).items()}
        assert len(want) > 20
        assert {k: round(x, 3) for k, x in run(spark, items, ledger, similar=similar, limit=limit).items()} == want
    # without the search for short ends, and in many blocks
    monkeypatch.setattr(dedup, "MOST_ENDS", 1)
    monkeypatch.setattr(dedup, "BLOCK_CHARS", 9000)
    want = {k: round(x, 3) for k, x in brute(items, ledger, 0.6, 512).items()}
    assert {k: round(x, 3) for k, x in run(spark, items, ledger).items()} == want


def test_pairs_in_small_steps(monkeypatch):
    from pagesift.functions import windows

    monkeypatch.setattr(windows, "HELD", 50)
    monkeypatch.setattr(windows, "MARKS", 20_000)
    monkeypatch.setattr(windows, "TOGETHER", 3000)
    texts = ["".join((t or "").split()) for t in bodies(90, 5)]
    texts = [t for t in texts if t and not t.startswith("##")]
    best = np.zeros(30)
    largest(Index(Windows(texts[:30]), 0.6), texts[30:], best, 512)
    want = brute(list(enumerate(texts[:30])), texts[30:], 0.6, 512)
    assert {k: x for k, x in enumerate(best) if x > 0.6} == want and want


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    summaries = sc.statusStore().executorList(False)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


def test_bodies_do_not_move(spark):
    texts = [t for t in bodies(700, 8) if t]
    size = sum(len(t.encode()) for t in texts)
    before = shuffled(spark)
    items = spark.createDataFrame(list(enumerate(texts[600:])), "item_id long, text string")
    ledger = spark.createDataFrame(list(enumerate(texts[:600])), "entry_id long, body string")
    assert dedup.known_bodies(items, ledger).count() > 50
    assert shuffled(spark) - before < size / 2


def test_hashes_are_those_of_simhash(spark):
    texts = bodies(150, 11, 6000)
    rows = spark.createDataFrame([(i, f"k{i}", t) for i, t in enumerate(texts)], "id long, name string, text string")
    want = {(r.id, r.name): r.simhash for r in similarity.simhash(rows, ["id", "name"], "text").collect() if r.simhash}
    got = dedup._hashes(rows, "text", "id", "name").collect()
    assert {(r.id, r.name): r.simhash for r in got} == want and len(got) == len(want) > 100


def test_hashes_of_bodies_without_moving_their_grams(spark):
    r = random.Random(2)
    body = ["".join(r.sample("一二三四五六七八九十百千万亿零壹贰叁肆", 19)) for _ in range(40)]
    # the same sentences in another order, a few characters off: alike by simhash, as a limit of 1 leaves grams out
    items = [(1, "".join(body[::-1])), (2, "".join(body)), (3, "完全无关的另一篇文章，讲的是港口扩建。" * 5)]
    ledger = ["".join(body), *[t for t in bodies(600, 8) if t]]
    before, size = shuffled(spark), sum(len(t.encode()) for t in ledger)
    found = dedup.known_bodies(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(ledger)), "entry_id long, body string"), similar=1.0, bits=6)
    assert {(r.item_id, r.how) for r in found.collect()} == {(1, "simhash"), (2, "simhash")}
    assert shuffled(spark) - before < size / 2
