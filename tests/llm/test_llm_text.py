"""Text operators of the problems on held-out cases that are made here."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.llm import encoding, link_spam, mixture, residue
from tests_llm_words import CHINESE, ENGLISH, GERMAN


def sentences(rng, kind, n):
    return [rng.choice(kind).format(rng.randrange(1, 500), rng.randrange(1, 99)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, "## 来源: https://a.example/x\n\n" + "\n\n".join("".join(sentences(rng, kind, 4)) for _ in range(4))) for i in range(240) for kind in [(CHINESE, ENGLISH, GERMAN)[i % 3]]]


def test_encodings(spark, corpus):
    rng = random.Random(2)
    rows, wrong = [], {}
    usual = (("utf-8", "1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1251"),), (("utf-8", "gbk"),), (("gbk", "1252"),), (("gbk", "big5"),), (("utf-8", "mac_roman"),), (("utf-8", "1252"), ("utf-8", "1252"))
    for i, t in corpus:
        kind = i % 3
        if i % 10 == 0 and kind != 1:
            pair = usual[(i // 10) % len(usual)]
            if kind == 2 and pair[0][0] == "gbk":
                pair = usual[0]
            lines = t.split("\n")
            wrong[i] = t
            lines[4] = encoding.garble(lines[4], pair)
            t = "\n".join(lines)
        rows.append((i, t, "clash"))
    rows += [(900, None, ""), (901, "", ""), (902, "Ã is the Portuguese nasal A; Â and â mark stress.", ""), (903, "Контакт: отдел поставок | 連絡先：営業部 | ÇÃO", ""), (904, "x" * 300_000, "")]
    df = spark.createDataFrame(rows, "entry_id long, body string, stretches string")
    got = {r.entry_id: r.restored for r in encoding.garbled(df).collect()}
    assert set(got) == set(wrong)
    assert sum(got[i] == wrong[i] for i in wrong) >= 0.6 * len(wrong)
    assert encoding.garbled(df.where("false")).count() == 0


@pytest.mark.parametrize("pair", encoding.PAIRS[:6])
def test_round_trip(pair):
    text = "Prüfung für Käufer"
    assert encoding._undo(encoding.garble(text, pair), pair) == text


def test_residue(spark, corpus):
    good = [(i, t) for i, t in corpus]
    slots = ["欢迎来到{{title}}，频道为您更新。", "欢迎来到${city}，频道为您更新。", "欢迎来到[[price]]，频道为您更新。", "如需报价请致电%(price)s。", "如需报价请致电{{city}}。", "Hello undefined, the price is undefined today.", "Hello None, the price is None today."]
    pages = ["# 标题\n\n502 Bad Gateway\n\nray 5c3d", "导航\n首页甲\n\n本页面依赖 JavaScript 运行，请启用后继续访问。", "Sign in to read the report.", "lorem ipsum dolor sit amet elit sed do tempor magna aliqua enim", "此处为占位内容、点击编辑这段文字、标题文字标题文字"]
    fine = ["模板语法示例：\n```\n<h1>{{ title }}</h1>\n```\n渲染时会把变量换成真实数值。", "示例数据中 null 表示未填报，NaN 表示无法计算，共有 46 条。", "【公告】这一批产品共抽检182份，高于平均水平。", "2019年以来，研发投入连续8个季度走低。", "This site uses cookies. Privacy policy | Site map", None, "", " \n"]
    rows = [*good]
    bad = set()
    for k, s in enumerate(slots):
        rows.append((1000 + k, good[k][1] + "\n\n" + s))
        bad.add(1000 + k)
    for k, s in enumerate(pages):
        rows.append((2000 + k, s))
        bad.add(2000 + k)
    for k, s in enumerate(fine):
        rows.append((3000 + k, s if k > 1 or s is None else good[9 + k][1] + "\n\n" + s))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "entry_id long, body string, name string, part int")
    assert {r.entry_id for r in residue.residue(df).collect()} == bad
    assert residue.residue(df.where("false")).count() == 0


def test_link_spam(spark, corpus):
    good = [(i, t) for i, t in corpus]
    table = "| 企业 | 产品 |\n|---|---|\n" + "\n".join(f"| 甲{i} | 乙{i} |" for i in range(60))
    references = "\n".join(f"[{i}] Somebody. A title, 2020. https://a{i}.example/x" for i in range(60))
    good += [(500, table), (501, good[1][1] + "\n\nReferences\n" + references), (502, None), (503, ""), (504, "词")]
    spam = [
        " ".join(f"#词{i % 7}价格" for i in range(60)), "\n".join(f"[词{i}](https://x{i}.example/a)" for i in range(30)), "，".join(f"甲市产品{i % 5}厂家" for i in range(60)), "\n".join(f"产品 A{i} 红 ￥{i}" for i in range(40)),
        "cheap widget, buy widget, best widget, widget price, " * 10, "\n".join(f"Widget notes number {i}" for i in range(30)), "widget best widget top 10 gadget widget price gadget buy widget gadget " * 6, "".join(f"<a>deal widget {i}</a>" for i in range(30)),
    ]
    rows = good + [(1000 + k, t) for k, t in enumerate(spam)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, share double")
    assert {r.doc_id for r in link_spam.stuffed(df).collect()} == {1000 + k for k in range(len(spam))}
    assert link_spam.stuffed(df.where("false")).count() == 0


PROSE = {
    "es": "El informe señala que las ventas de la empresa bajaron durante el segundo trimestre, pero los directivos esperan que la demanda se recupere antes de que termine el año, cuando entren en servicio las nuevas plantas.",
    "pt": "O relatório mostra que as vendas da empresa caíram no segundo trimestre, mas os diretores esperam que a procura volte a subir antes do fim do ano, quando as novas fábricas começarem a funcionar.",
    "it": "La relazione mostra che le vendite della società sono scese nel secondo trimestre, ma i dirigenti prevedono che la domanda torni a crescere prima della fine dell'anno, quando apriranno i nuovi impianti.",
    "pl": "Z raportu wynika, że sprzedaż firmy spadła w drugim kwartale, ale zarząd liczy na to, że popyt wzrośnie jeszcze przed końcem roku, kiedy ruszą nowe zakłady, na które czeka cały rynek.",
    "ru": "В отчёте говорится, что продажи компании во втором квартале снизились, но руководство надеется, что спрос вырастет ещё до конца года, когда будут пущены новые заводы, которых ждёт рынок.",
}


def test_prose_of_other_languages(spark, corpus):
    """Sentences of languages without a word list are no keywords, learned or not; keyword pages in them are still found."""
    rows = [(i, t, ("zh", "en", "de")[i % 3]) for i, t in corpus]
    for k, (lang, t) in enumerate(PROSE.items()):
        rows += [(1000 + 100 * k + n, "\n\n".join([t, " ".join(reversed(t.split())), t[: 60 + n] + "."]), lang) for n in range(1 if lang in ("it", "ru") else 30)]
    rows.append((2000, PROSE["ru"], None))
    rows.append((3000, "zapato barato, zapato rojo, zapato niño, zapato mujer, zapato oferta, zapato online, zapato cuero, comprar zapato, " * 3, "es"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in link_spam.stuffed(df).collect()} == {3000}


def test_learned_words_are_counted_whole(spark, monkeypatch):
    """A word of three documents in ten is learned however many other words come between; so are all words of one frequency."""
    import string

    monkeypatch.setattr(link_spam, "_HELD", 20_000, raising=False)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(9))
    often, seldom, even = [word() for _ in range(12)], [word() for _ in range(5)], [word() for _ in range(100)]
    rows = []
    for k in range(40):
        own = [word() for _ in range(600)] * 8
        rows.append((k, " ".join(often + seldom * (k % 10 in (2, 5, 8)) + own) + ".", "es"))
    rows += [(100 + k, " ".join(even) + ".", "it") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    limits = link_spam.language_limits(df)
    assert limits.words == {"es": frozenset(often + seldom), "it": frozenset(even)}
    total = sum(len(t.split()) for _, t, lang in rows if lang == "es")
    assert limits.least["es"] == pytest.approx(link_spam.PART**2 * (40 * len(often) + 12 * len(seldom)) / total)
    assert limits.least["it"] == pytest.approx(link_spam.PART**2)


def test_blanks_and_long_pages(spark, corpus):
    filled = [(i, t + f"\n\n尊敬的{name}，您的订单已经发出。") for (i, t), name in zip(corpus[:60:3], ["{{name}}", "【】", "{{user}}", "（ ）"] * 5)]
    page = "本站正在进行系统维护，给您带来不便敬请谅解，维护期间暂停访问请稍后再来。"
    pages = [(5000 + k, f"# 标题{k}\n\n{page}") for k in range(12)] + [(5100, "\n\n".join([page] * 12))]
    df = spark.createDataFrame([r for r in corpus if r[0] not in {i for i, _ in filled}] + filled + pages, "entry_id long, body string")
    got = {r.entry_id for r in residue.residue(df).collect()}
    assert got == {i for i, _ in filled} | {i for i, _ in pages}


def test_single_characters_inside_words(spark, corpus):
    rows, wrong = [], set()
    for i, t in corpus:
        if i % 3 == 2 and i % 4 == 0:
            t = encoding.garble(t, (("1252", "gbk"),))
            wrong.add(i)
        rows.append((i, t))
    got = {r.entry_id for r in encoding.garbled(spark.createDataFrame(rows, "entry_id long, body string")).collect()}
    assert not got - wrong and len(got) >= 0.9 * len(wrong)


def test_keywords_without_separators():
    """One run ten times among many different characters or words is a keyword line, an ordinary sentence is not."""
    zh = "".join("不锈钢管" + w for w in ("厂家", "价格", "批发", "规格", "定制", "加工", "现货", "采购", "标准", "重量"))
    en = " ".join(f"steel pipe {w}" for w in ("price", "maker", "sale", "stock")) + " with twelve further words that each stand here once and raise different"
    assert len(zh) == 60 and len(set(zh)) > 0.3 * len(zh) and len(set(en.split())) > 0.7 * len(en.split())
    assert link_spam.stuffed_share(zh, link_spam.Limits())[0] == 1.0 and link_spam.stuffed_share(en, link_spam.Limits())[0] == 1.0
    prose = "研究人员在三个地区连续两年收集了河流沉积物样本，并且比较了它们在旱季与雨季的重金属含量，发现下游城市附近的浓度明显高于上游山区。"
    assert link_spam.stuffed_share(prose, link_spam.Limits())[0] == 0.0


def test_water_filling():
    sizes = {"a": 100, "b": 1000, "c": 10, "none": 0}
    targets = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 4), "none": (0.5, 9), "absent": (0.1, 1)}
    used = mixture.water_fill(sizes, targets, 1000)
    assert used["a"] == 2 and used["c"] == 4 and used["b"] == pytest.approx(0.76)
    assert mixture.water_fill(sizes, targets, 10**9) == {"a": 2, "b": 1, "c": 4}
    small = mixture.water_fill(sizes, targets, 10)
    assert small["a"] * 100 == pytest.approx(5) and small["b"] * 1000 == pytest.approx(3)
    assert mixture.water_fill({}, targets) == {} and mixture.water_fill(sizes, {}) == {}


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, "big" if i % 3 == 0 else rng.choice(["s1", "s2", "s3", "untargeted"]) if i % 7 else None, rng.randrange(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.2, 1), ("s1", 0.5, 3), ("s2", 0.2, 2), ("s3", None, 5), ("empty", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixture.mix_sources(df, targets, 40_000, seed=1)
    r = {x.source: x for x in report.collect()}
    for s in ("big", "s1", "s2"):
        assert abs(r[s].drawn - r[s].wanted) <= 60, s
    assert sum(x.actual_share for x in r.values()) == pytest.approx(1) and r["empty"].drawn == 0 and r["untargeted"].drawn == 0 and r["s3"].drawn == 0
    limits = {"big": 1, "s1": 3, "s2": 2}
    drawn = mix.collect()
    assert all(1 <= x.copies <= limits[x.source] for x in drawn) and len({x.doc_id for x in drawn}) == len(drawn)
    again, _ = mixture.mix_sources(df.repartition(7), targets, 40_000, seed=1)
    assert {(x.doc_id, x.copies) for x in again.collect()} == {(x.doc_id, x.copies) for x in drawn}
    assert mixture.mix_sources(df.where("false"), targets)[0].count() == 0


def test_tokens(spark):
    import os

    path = os.environ.get("PAGESIFT_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.tokens for r in mixture.token_counts(df, path).collect()} == {1: 2, 2: 0, 3: 0}
