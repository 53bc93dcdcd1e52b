"""Expressions over addresses against the standard library."""

from urllib.parse import parse_qsl, quote, urlencode, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import urls

SAME = [
    ("https://a.com/x", "http://a.com/x/"), ("https://a.com/x?utm_source=1&b=2", "https://a.com/x?b=2#top"), ("https://A.com:443/x", "https://a.com/x"), ("http://a.com:80/", "http://a.com"),
    ("https://a.com/数据", "https://a.com/%e6%95%b0%e6%8d%ae"), ("https://a.com/?q=a+b", "https://a.com/?q=a%20b"), ("https://a.com/?b=2&a=1", "https://a.com/?a=1&b=2"), ("https://a.com/?w", "https://a.com/?w="),
]
DIFFERENT = [("https://a.com/x", "https://www.a.com/x"), ("https://a.com/a%2Fb", "https://a.com/a/b"), ("https://a.com:8443/x", "https://a.com/x"), ("https://a.com/?q=1", "https://a.com/?q=2")]


def form(spark, rows):
    return [r.c for r in spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i int, u string").select("i", urls.comparable("u").alias("c")).orderBy("i").collect()]


@pytest.mark.parametrize("pairs,equal", [(SAME, True), (DIFFERENT, False)])
def test_comparable_pairs(spark, pairs, equal):
    for a, b in pairs:
        x, y = form(spark, [a, b])
        assert (x == y) is equal, (a, b, x, y)


def test_comparable_odd(spark):
    assert form(spark, ["", None, "  ", "no host", "http://a.com:99999999/X", "https:///lost"]) == ["", "", "", "no host", "http://a.com:99999999/x", "https:///lost"]


def expected(u):
    p = urlparse(u)
    path = quote(p.path, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").rstrip("/") or "/"
    qs = urlencode(sorted(x for x in parse_qsl(p.query, keep_blank_values=True) if x[0].lower() not in urls.TRACKING))
    return (p.hostname or "") + path + ("?" + qs if qs else "")


def test_comparable_property(spark):
    found = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text("abz09-._~ 数é/", max_size=8), max_size=3), st.lists(st.tuples(st.text("abz*~ 数_", min_size=1, max_size=4), st.text("ab+ 数*&", max_size=4)), max_size=4))
    def gather(path, query):
        found.append("https://h.example/" + "/".join(path) + ("?" + urlencode(query) if query else ""))

    gather()
    rows = [u.strip() for u in found]
    assert form(spark, rows) == [expected(u) for u in rows]


def test_hosts(spark):
    rows = ["https://WWW.A.com:80/x", "http://u:p@b.org/", "//c.net/x", "d.net/x", "", None, " https://e.com/x ", "https://www.www.f.com"]
    got = [r.h for r in spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i int, u string").select("i", urls.host_of("u").alias("h")).orderBy("i").collect()]
    assert got == ["a.com", "b.org", "c.net", "", "", "", "e.com", "www.f.com"]


def test_classes_of_nothing(spark):
    r = spark.createDataFrame([(None,), ("",)], "u string").select(urls.blacklisted("u").alias("b"), urls.low_value_tier("u").alias("t"), urls.text_soup("u").alias("s"), urls.report_mill("u").alias("m")).distinct().collect()
    assert [tuple(x) for x in r] == [(False, 0, False, False)]


def test_suffixes(spark):
    assert spark.range(1).select(urls.suffixes(F.lit("a.b.cn")).alias("s")).first().s == ["a.b.cn", "b.cn", "cn"]


def test_skip_reason(spark):
    rows = [(404, None, None, "u", "404/410 gone"), (403, 451, None, "u", "403/451 blocked at both L0 and L1"), (403, 200, None, "u", ""), (None, None, "x codec can't decode y", "a.PDF", "binary decode failure on a PDF"), (None, None, None, None, "")]
    df = spark.createDataFrame(rows, "a int, b int, e string, u string, want string")
    assert df.where(urls.skip_reason("a", "b", "e", "u") != F.col("want")).count() == 0
