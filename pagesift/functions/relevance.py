"""Expressions that compare texts with a query. The query is a column, so that one plan serves all batches.

What depends on the query alone (`terms_of`, `fragments_of`, ...) is computed once per batch and joined to its items. Null
results mean that the query or the page does not allow a judgement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift import tables
from pagesift.functions.text import HAN, han_share, stripped, without_header
from pagesift.functions.urls import _c, let, path_of

SEPARATORS = r"(?U)[\s,，、;；]+"
WORD_BREAKS = r"[^\p{L}\p{N}\p{M}_]+"
LEAST_HAN = 0.05


def coverage_terms(query: Column | str) -> Column:
    """Parts of two characters or more."""
    return F.filter(F.split(stripped(query), SEPARATORS), lambda t: F.length(t) >= 2)


def lettered_terms(query: Column | str) -> Column:
    return F.transform(F.filter(coverage_terms(query), lambda t: t.rlike("[\\u4e00-\\u9fffA-Za-z]")), F.lower)


def han_runs(query: Column | str) -> Column:
    return F.regexp_extract_all(stripped(query), F.lit(f"({HAN}+)"), F.lit(1))


def latin_words(query: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(stripped(query), F.lit("([A-Za-z]{3,})"), F.lit(1)), F.lower)


def fragments(query: Column | str) -> Column:
    """Every substring of every run of Chinese characters."""
    def of(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(run))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(run) - i + 1), lambda n: run.substr(i, n))))

    return F.array_distinct(F.flatten(F.transform(han_runs(query), of)))


def haystack(title: Column | str, text: Column | str) -> Column:
    return F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit("\n"), without_header(text)))


def words_in(hay: Column) -> Column:
    return F.split(hay, WORD_BREAKS)


def overlap(hay: Column, query: Column | str) -> Column:
    """Longest part of the query in the text (V1): substring of its Chinese runs, or whole Latin word."""
    return let(F.struct(hay.alias("hay"), han_runs(query).alias("runs"), latin_words(query).alias("words"), fragments(query).alias("parts")), _overlap)


def _overlap(x: Column) -> Column:
    hay, runs, words = x["hay"], x["runs"], x["words"]
    judged = (F.size(words) > 0) | F.exists(runs, lambda r: F.length(r) >= 3)
    longest = F.array_max(F.concat(
        F.array(F.lit(0)), F.transform(F.filter(x["parts"], lambda f: F.contains(hay, f)), lambda f: F.length(f)),
        F.transform(F.array_intersect(words, words_in(hay)), lambda w: F.length(w)),
    ))
    return let(longest, lambda n: F.when(~judged, None).when(stripped(hay) == "", 0).when(~((n == 0) & (F.size(runs) > 0) & (F.size(words) == 0) & (han_share(hay) < LEAST_HAN)), n))


def term_hits(hay: Column, query: Column | str) -> Column:
    """How many terms of the query the text has (V2); null for fewer than two terms."""
    return let(F.struct(hay.alias("hay"), lettered_terms(query).alias("terms"), words_in(hay).alias("words")), _term_hits)


def _term_hits(x: Column) -> Column:
    hay, terms = x["hay"], x["terms"]
    hit = F.size(F.filter(terms, lambda t: F.when(t.rlike(HAN), F.contains(hay, t)).otherwise(F.array_contains(x["words"], t))))
    foreign = F.forall(terms, lambda t: t.rlike(HAN)) & (han_share(hay) < LEAST_HAN)
    return F.when(F.size(terms) < 2, None).when(stripped(hay) == "", 0).when(~foreign, hit)


def relevant(overlap_: Column, hits: Column, least_overlap: int = 3, least_terms: int = 2) -> Column:
    """The gate (V3): kept if either signal is high enough or cannot be judged."""
    return overlap_.isNull() | (overlap_ >= least_overlap) | hits.isNull() | (hits >= least_terms)


def front_hits(title: Column | str, text: Column | str, query: Column | str, head: int = 500, generic=tables.GENERIC_TERMS) -> Column:
    """How often the most frequent core term stands in title and first 500 characters (V4); 99 if that cannot be judged."""
    terms = F.filter(F.filter(coverage_terms(query), lambda t: t.rlike("[\\u4e00-\\u9fffA-Za-z]")), lambda t: ~t.isin(*generic))
    window = F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit("\n"), F.substring(F.coalesce(_c(text), F.lit("")), 1, head)))
    return let(F.struct(window.alias("window"), F.transform(terms, lambda t: F.lower(t)).alias("terms")), _front_hits)


def _front_hits(x: Column) -> Column:
    window, terms = x["window"], x["terms"]
    often = F.array_max(F.transform(terms, lambda t: ((F.length(window) - F.length(F.replace(window, t, F.lit("")))) / F.length(t)).cast("int")))
    foreign = F.exists(terms, lambda t: t.rlike(HAN)) & (han_share(window) < LEAST_HAN)
    return F.when((F.size(terms) == 0) | (stripped(window) == "") | foreign, 99).otherwise(often)


def plain_title(title: Column | str) -> Column:
    """Letters, digits and underscores of a title in lower case."""
    return F.regexp_replace(F.lower(stripped(title)), r"[^\p{L}\p{N}\p{M}_]", "")


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: text.substr(i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when((a == "") | (b == ""), 0.0).when((F.length(a) == 1) & (F.length(b) == 1), F.when(a == b, 1.0).otherwise(0.0)).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def title_mismatch(url: Column | str, page_title: Column | str, candidate_title: Column | str, query: Column | str, depth: int = 1, least: float = 0.15, length: int = 8) -> Column:
    """Whether a home page has another title than the search hit promised (V7)."""
    levels = F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != ""))
    page, hit, asked = plain_title(page_title), plain_title(candidate_title), plain_title(query)
    echo = (asked != "") & (F.length(hit) >= 6) & (bigram_jaccard(hit, asked) > 0.8)
    return (levels <= depth) & (F.length(hit) >= length) & (F.length(page) >= length) & ~echo & (bigram_jaccard(hit, page) < least)
