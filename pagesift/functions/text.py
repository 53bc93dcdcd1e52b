"""Expressions that judge and clean page texts. All but the HTML parser stay within the JVM.

Null and empty texts count as empty: they are garbled, no template, no block page, and score 0. Lengths are code points.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift import tables
from pagesift.functions import urls
from pagesift.functions.urls import _c, contains_any, let

#: Unicode white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
SCAN = 3000
HAN = "[\\u4e00-\\u9fff]"
# Signs of garbled text.
GARBLED = (r"\{_waf_[a-z0-9]+", "_waf_[a-f0-9]+", "tOYw3VuDHpEZ", "[A-Za-z0-9+/]{100,}={0,2}", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"\x{fffd}", r"[^\x00-\x7f\x{4e00}-\x{9fff}\s]{20,}")
# Signs of scholarly pages.
SCHOLARLY = (r"(?i)doi[\s:：]*10\.\d{3,}", r"(?i)issn[\s:：]?\d{3,4}[-—]?\d{3,4}", "收稿日期|修回日期|录用日期|出版日期", "基金项目|基金资助|国家自然科学基金", "中图分类号|文献标志码|文章编号", "通讯作者|作者简介")


def stripped(text: Column | str) -> Column:
    return F.btrim(F.coalesce(_c(text), F.lit("")), F.lit(WHITE))


def without_header(text: Column | str) -> Column:
    """Without white space at the ends and one leading source header (Q1)."""
    return F.btrim(F.regexp_replace(stripped(text), r"^#{0,3}\s*来源\s*[:：]\s*\S+\s*", ""), F.lit(WHITE))


def han_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN)) / F.greatest(F.length(text), F.lit(1))


def garbled(text: Column | str) -> Column:
    """Blank, protected by a firewall, encoded or undecodable text, or long text in no known language (Q2)."""
    return let(F.coalesce(_c(text), F.lit("")), _garbled)


def _garbled(t: Column) -> Column:
    foreign = (F.length(t) > 200) & (han_share(t) < 0.05) & (F.regexp_count(t, F.lit("[A-Za-z]{2,}")) < 5)
    return (stripped(t) == "") | t.rlike("|".join(f"(?:{p})" for p in GARBLED)) | foreign


def _head(t: Column) -> Column:
    return F.lower(F.substring(t, 1, SCAN))


def _tail(t: Column) -> Column:
    return F.lower(F.right(t, F.lit(SCAN)))


def template_page(text: Column | str, markers: Iterable[str] = tables.TEMPLATE_MARKERS) -> Column:
    """A marker within the first or last 3000 characters (Q3)."""
    t, markers = stripped(text), [m.lower() for m in markers]
    return contains_any(_head(t), markers) | contains_any(_tail(t), markers)


def block_page(text: Column | str, markers: Iterable[str] = tables.BLOCK_MARKERS, most: int = tables.BLOCK_PAGE_LENGTH) -> Column:
    """A short page with the wording of a challenge or refusal (Q4)."""
    t = stripped(text)
    return F.length(t).between(1, most) & contains_any(F.lower(t), [m.lower() for m in markers])


def suffix_value(host: Column, values: dict[str, float], default: float) -> Column:
    """Value of the longest listed domain that is the host or above it."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(F.get(F.filter(F.transform(urls.suffixes(host), lambda s: F.try_element_at(table, s)), lambda v: v.isNotNull()), 0), F.lit(float(default)))


def host_weight(url: Column | str, delta: Column | float = 0.0, weights: dict[str, float] = tables.HOST_WEIGHTS, whitelist: Iterable[str] = tables.WHITELISTED_HOSTS) -> Column:
    """Static weight of the host plus what was learned about it; hosts of the whitelist keep the static one (Q6)."""
    h = urls.host_of(url)
    static = suffix_value(h, weights, 1.0)
    learned = F.greatest(F.lit(0.1), F.least(F.lit(1.5), static + F.coalesce(delta if isinstance(delta, Column) else F.lit(delta), F.lit(0.0))))
    return F.when(urls.under(h, whitelist), static).otherwise(learned)


def _paragraphs(lines: Column) -> Column:
    size = F.size(lines)
    whole = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    full = F.size(F.filter(lines, lambda x: F.length(stripped(x)) >= 15))
    many = F.least(F.lit(1.0), 0.5 * (full / size) + 0.5 * F.least(F.lit(1.0), size / 6.0))
    return F.when(size == 0, 0.0).when(size <= 2, F.when(whole >= 300, 1.0).otherwise(0.3)).otherwise(many)


def form_parts(t: Column, weight: Column) -> dict[str, Column]:
    """The five parts of the form score, each from 0 to 1 (Q5)."""
    n = F.length(t)
    per = F.greatest(n, F.lit(1))
    long_ = F.when(n > 8000, F.greatest(F.lit(0.7), 1 - (n - 8000) / 40000.0 * 0.3)).otherwise(1.0)
    length = F.when(n >= 200, long_).when(n >= 30, (n - 30) / 170.0).otherwise(0.0)
    p = (n - F.length(F.translate(t, tables.PUNCTUATION, ""))) / per
    punctuation = F.when(p < 0.01, p / 0.01).otherwise(F.least(F.lit(1.0), p / 0.05) * F.when(p > 0.3, 0.5).otherwise(1.0))
    paragraphs = let(F.filter(F.split(t, "\n"), lambda x: stripped(x) != ""), _paragraphs)
    latin = F.aggregate(F.regexp_extract_all(t, F.lit("([A-Za-z]{2,})"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x)) / per
    language = F.least(F.lit(1.0), F.greatest(F.regexp_count(t, F.lit(HAN)) / per, latin) / 0.4)
    host = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight - 0.5))
    return {"length": length, "punctuation": punctuation, "paragraphs": paragraphs, "language": language, "host": host}


FORM_WEIGHTS = {"length": 0.35, "punctuation": 0.20, "paragraphs": 0.20, "language": 0.15, "host": 0.10}


def form_score(t: Column, weight: Column) -> Column:
    parts = form_parts(t, weight)
    return sum((FORM_WEIGHTS[k] * parts[k] for k in FORM_WEIGHTS), F.lit(0.0))


def _hits(scan: Column, markers: Iterable[str]) -> Column:
    markers = F.array(*[F.lit(m) for m in markers])
    return let(scan, lambda s: F.size(F.filter(markers, lambda m: F.contains(s, m))))


def content_score(text: Column | str, url: Column | str, weight: Column | None = None) -> Column:
    """How much a text looks like content, from 0 to 1 with 4 digits (Q7).

    Vetoes come first and are cheap, so that the marks of quality are only counted where they matter. Positive markers are
    compared as they are written with text in lower case, so those with capitals never count.
    """
    return let(without_header(text), lambda t: _content_score(t, F.coalesce(_c(url), F.lit("")), weight))


def _content_score(t: Column, u: Column, weight: Column | None) -> Column:
    def marked(scan: Column) -> Column:
        return (
            form_score(t, host_weight(u) if weight is None else weight)
            - F.least(F.lit(0.30), 0.03 * _hits(scan, [m.lower() for m in tables.WEAK_MARKERS]))
            - F.least(F.lit(0.30), 0.10 * _hits(scan, tables.NEGATIVE_MARKERS))
            + F.least(F.lit(0.15), 0.03 * _hits(scan, tables.POSITIVE_MARKERS))
        ) * F.least(F.lit(1.0), F.length(t) / 200.0)

    tier = urls.low_value_tier(u)
    factor = F.when(tier == 1, tables.LOW_VALUE_FACTOR).otherwise(1.0)
    most = F.when((tier == 2) | urls.text_soup(u), tables.LOW_VALUE_CAP).otherwise(1.0)
    score = let(F.concat(_head(t), _tail(t)), marked)
    return (
        F.when((t == "") | urls.blacklisted(u) | block_page(t) | garbled(t), 0.0)
        .when(template_page(t), 0.05)
        .otherwise(F.round(F.greatest(F.lit(0.0), F.least(most, score * factor)), 4))
    )


def authority(url: Column | str, text: Column | str | None = None, tiers: dict[str, float] = tables.AUTHORITY, cap: float = 0.75) -> Column:
    """Authority of the host (R6), raised by signs of a scholarly page up to `cap`."""
    base = suffix_value(urls.raw_host(url), tiers, tables.AUTHORITY_DEFAULT)
    if text is None:
        return base
    t = F.coalesce(_c(text), F.lit(""))
    kinds = sum((t.rlike(p).cast("int") for p in SCHOLARLY), F.lit(0))
    return F.when((base >= cap) | (kinds == 0), base).otherwise(F.least(F.lit(cap), base + 0.10 * F.least(kinds, F.lit(2))))


def without_citations(text: Column | str) -> Column:
    """Without citation marks such as [3], [2-5] or <sup>[1]</sup>; links keep theirs (Q9)."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?i)<sup>\s*\[[^\]]*\]\s*</sup>", "")
    t = F.regexp_replace(t, r"\[\d+(?:\s*[-–,，]\s*\d+)*\](?!\()", "")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"[ \t]+\n", "\n")


# Where page footers begin.
FOOTERS = (
    r"(?dms)\n#{1,6}\s*(?:VIP|APP专享|热门推荐|滚动播报|文章来源|AI声明|发布时间|最后更新|编辑推荐|大家都在看).*$",
    r"(?dms)\n---+\s*$",
    r"(?dms)\n(?:©|Copyright|版权所有|All Rights Reserved).*$",
    r"(?dms)\n(?:声明|免责|注意|提示|免责声明).*?$",
    r"(?dms)\n(?:责任编辑|责编|编辑[:：]|审核[:：]|校对[:：]|作者[:：]).*?$",
)


def without_footer(text: Column | str) -> Column:
    """Without footers, blank lines and short lines that are no sentences (Q10); one or two such lines at the end stay."""
    t = F.coalesce(_c(text), F.lit(""))
    for pattern in FOOTERS:
        t = F.regexp_replace(t, pattern, "")
    # of each line: itself, whether it is blank, whether it is a sentence or long
    lines = F.transform(F.split(t, "\n"), lambda x: let(stripped(x), lambda s: F.struct(x.alias("line"), (s == "").alias("blank"), ((F.length(s) > 20) | s.rlike("[。！？.!?]")).alias("full"))))

    def kept(rows: Column) -> Column:
        last = F.array_max(F.transform(rows, lambda r, i: F.when(r["full"] | r["blank"], i).otherwise(-1)))
        # where the short lines at the end begin, if they stay
        tail = let(last, lambda at: F.when(F.size(rows) - 1 - at < 3, at).otherwise(F.size(rows)))
        return let(tail, lambda at: F.array_join(F.transform(F.filter(rows, lambda r, i: ~r["blank"] & (r["full"] | (i > at))), lambda r: r["line"]), "\n"))

    return let(lines, kept)


def unescaped(text: Column) -> Column:
    """The most frequent entities as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_title(page: Column | str) -> Column:
    """Inner text of the first title element, 200 characters at most (Q11)."""
    inner = F.regexp_extract(F.coalesce(_c(page), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(F.btrim(F.regexp_replace(unescaped(F.regexp_replace(inner, "<[^>]+>", "")), r"(?U)\s+", " "), F.lit(WHITE)), 1, 200)


class _Blocks(HTMLParser):
    """Text of a page by blocks, without what no reader sees and without navigation."""

    HIDDEN = {"script", "style", "noscript", "template", "nav", "footer", "header", "aside", "form", "button", "svg", "head", "iframe"}
    BREAKS = {"p", "div", "section", "article", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote", "pre", "main", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = [["", 0, ""]]
        self.hidden: list[str] = []
        self.links = 0

    def _new(self, prefix: str = "") -> None:
        if self.blocks[-1][0].strip():
            self.blocks.append(["", 0, prefix])
        else:
            self.blocks[-1][2] = prefix or self.blocks[-1][2]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        if tag in self.BREAKS:
            self._new({"li": "- "}.get(tag, "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else ""))
        if tag == "a":
            self.links += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
        if tag in self.BREAKS:
            self._new()
        if tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.blocks[-1][0] += data
            if self.links:
                self.blocks[-1][1] += len(data.strip())


def main_text(page: str | None) -> str:
    """Blocks of a page that are text rather than links, one to a paragraph."""
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    out = []
    for text, linked, prefix in parser.blocks:
        text = " ".join(text.split())
        if text and 2 * linked <= len(text):
            out.append(prefix + html.unescape(text))
    return "\n\n".join(out)


@F.pandas_udf(T.StringType())
def _main_text(page: pd.Series) -> pd.Series:
    return page.map(main_text)


def with_extracted(pages: DataFrame, page: str = "page", url: str = "url", out: str = "text", least: int = 30) -> DataFrame:
    """Add the text of each page under its source header (Q12); null for a block page or one with little text.

    The contract of this extractor is its own: blocks without hidden elements, navigation and link lists.
    """
    parsed = pages.withColumn("_t", _main_text(page))
    cleaned = let(without_citations(without_footer("_t")), lambda t: F.when(~block_page(t) & (F.length(t) > least), F.concat(F.lit("## 来源: "), F.col(url), F.lit("\n\n"), t)))
    return parsed.withColumn(out, cleaned).drop("_t")
