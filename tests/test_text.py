"""Text expressions on cases whose result is known."""

import re

import pytest
from pyspark.sql import functions as F

from pagesift.functions import dates, documents, relevance, text

LONG = "根据统计，市场规模约为12亿元，同比增长三成。" * 20


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("t,want", [(None, True), (" 　", True), ("abc\x01", True), ("x" * 150, True), ("ок" * 120, True), (LONG, False), ("Short text.", False)])
def test_garbled(spark, t, want):
    assert one(spark, text.garbled("t"), t=t) is want


def test_marks(spark):
    assert one(spark, text.template_page("t"), t=LONG * 20 + "请先登录") is True
    assert one(spark, text.block_page("t"), t="Just a moment...") is True
    assert one(spark, text.block_page("t"), t=LONG * 10 + "Just a moment...") is False
    assert one(spark, text.template_page("t"), t=None) is False


def test_content_score(spark):
    s = text.content_score("t", "u")
    assert one(spark, s, t=None, u=None) == 0.0
    assert one(spark, s, t="", u="https://a.com") == 0.0
    assert one(spark, s, t="## 来源: https://a.com\n\n" + LONG, u="https://a.com") > 0.8
    assert one(spark, s, t=LONG, u="https://www.toutiao.com/x") == 0.0
    assert one(spark, s, t=LONG, u="https://x.1688.com/y") == 0.2
    assert one(spark, s, t=LONG + "页面不存在", u="") == 0.05
    half, whole = one(spark, s, t=LONG, u="https://a.com/product/1"), one(spark, s, t=LONG, u="https://a.com/1")
    assert abs(half - whole / 2) < 0.02


def test_header_goes_once(spark):
    assert one(spark, text.without_header("t"), t="  ## 来源： https://a.com/x\n\n正文 来源: b ") == "正文 来源: b"


def test_citations_and_footer(spark):
    assert one(spark, text.without_citations("t"), t="a[1] b [2](x) c<sup>[3]</sup> [4-6]  d") == "a b [2](x) c d"
    t = "这是一段足够长的正文内容，它不会被当作短行删掉。\n短行\n\n另一段足够长的正文内容，同样应当保留下来不变。\n版权所有 2020\n后面的都不要"
    assert one(spark, text.without_footer("t"), t=t) == "这是一段足够长的正文内容，它不会被当作短行删掉。\n另一段足够长的正文内容，同样应当保留下来不变。"
    assert one(spark, text.without_footer("t"), t="一\n二") == "一\n二" and one(spark, text.without_footer("t"), t="一\n二\n三") == ""


def test_title_and_extraction(spark):
    page = "<html><head><TITLE>A &amp; B\n <b>c</b></TITLE></head><body><nav>Home</nav><p>" + "Some words of text. " * 5 + "</p><ul><li><a href=x>link only</a></li></ul><script>no()</script></body></html>"
    assert one(spark, text.page_title("p"), p=page) == "A & B c"
    df = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "<p>short</p>", "u")], "i int, page string, url string")
    got = {r.i: r.text for r in text.with_extracted(df).collect()}
    assert got[1].startswith("## 来源: u\n\nSome words") and "link only" not in got[1] and "no()" not in got[1]
    assert got[2] is None and got[3] is None


@pytest.mark.parametrize("raw,want", [
    ("2025-01-31T08:00:00Z", "2025-01-31"), ("2025/1/5", "2025-01-05"), ("2025.2.30", ""), ("2026年3月", "2026-03-01"), ("2026年 3月 9日", "2026-03-09"), ("Jan 8, 2026", "2026-01-08"), ("Sept. 3rd 2024", "2024-09-03"), ("Foo 3, 2024", ""),
    ("3 months ago", "2024-12-15"), ("1 day ago", "2025-03-14"), ("2 hours ago", "2025-03-15"), ("", ""), (None, ""), ("yesterday", ""), ("999999999999 days ago", ""),
])
def test_dates(spark, raw, want):
    assert one(spark, dates.normalized("d", "2025-03-15"), d=raw) == want


@pytest.mark.parametrize("t,want", [("更新时间：2026年7月16日", "2026-07-16"), ("Last updated on : 31 August, 2026", "2026-08-31"), ("最后更新: October 06, 2026", "2026-10-06"), ("2025年3月1日", ""), ("发布日期: 2026-02-31 posted May 1, 2020", "2020-05-01"), (None, "")])
def test_page_dates(spark, t, want):
    assert one(spark, dates.page_date("t"), t=t) == want


def test_relevance(spark):
    hay = relevance.haystack("ti", "t")
    v = dict(ti="食品包装", t="关于市场的报告 with Film inside")
    assert one(spark, relevance.overlap(hay, "q"), q="食品包装 市场规模", **v) == 4
    assert one(spark, relevance.overlap(hay, "q"), q="film", **v) == 4
    assert one(spark, relevance.overlap(hay, "q"), q="fil", **v) == 0
    assert one(spark, relevance.overlap(hay, "q"), q="a", **v) is None
    assert one(spark, relevance.overlap(hay, "q"), q="食品包装", ti="", t="Only English words here, many of them.") is None
    assert one(spark, relevance.term_hits(hay, "q"), q="食品包装 film 别的词", **v) == 2
    assert one(spark, relevance.term_hits(hay, "q"), q="一词", **v) is None
    assert one(spark, relevance.front_hits("ti", "t", "q"), q="食品包装 市场规模", **v) == 1
    assert one(spark, relevance.front_hits("ti", "t", "q"), q="市场规模", **v) == 99
    m = relevance.title_mismatch("u", "p", "h", "q")
    assert one(spark, m, u="https://a.com/", p="完全不同的首页标题文字", h="搜索结果给出的另一标题", q="别的") is True
    assert one(spark, m, u="https://a.com/x/y", p="完全不同的首页标题文字", h="搜索结果给出的另一标题", q="别的") is False


def test_reflow_keeps_characters(spark):
    t = "第一行没有句末标点而且长度超过三十个字所以应当接上下一行的内容\n接上的部分。\n\n- 一\n- 二\n| a |\n| b |\n```\nx  =  1\n```\n" + "长" * 500 + "\n[链接](http://a.com/" + "b" * 200 + ")"
    out = documents.reflow(t)
    assert re.sub(r"\s+", "", out) == re.sub(r"\s+", "", t)
    assert "下一行的内容接上的部分。" in out and "- 一\n- 二" in out and "x  =  1" in out
    assert documents.reflow(None) == "\n" and documents.reflow("") == "\n"
    for s in ("a\nb", "。\n。", "```\n", "# x\ny\n  z"):
        assert re.sub(r"\s+", "", documents.reflow(s)) == re.sub(r"\s+", "", s)


def test_documents(spark):
    assert one(spark, documents.generic_title("t"), t="23期食品广告.indd") is True
    assert one(spark, documents.generic_title("t"), t=None) is True
    assert one(spark, documents.generic_title("t"), t="GB 4789.1 采样方案") is False
    assert one(spark, documents.contents("t"), t="1.1 范围\n摘要\n正文很长。\n1.1 范围") == "1.1 范围 | 摘要"
    assert documents.digest("short", None) == ""
    d = documents.digest("开头" * 200 + "无关" * 600 + "温度 时间 工艺 参数" * 20 + "无关" * 600, "工艺")
    assert d.startswith("【开头】") and "工艺" in d.split("【关键片段】")[1]
    s = one(spark, documents.sections("t"), t="前言\n## 来源: https://a.com\n\n甲\n## 来源: https://b.com \n乙")
    assert [(x.n, x.url, x.body) for x in s] == [(1, "https://a.com", "甲"), (2, "https://b.com", "乙")]
