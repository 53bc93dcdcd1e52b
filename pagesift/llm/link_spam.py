"""Keyword-stuffed and link-list pages (problem 9).

Each line of a text is judged by the share of its characters in links, by the density of separators and prices, by how
often runs of its words recur, by missing function words, by the share of its most frequent word, by how often it stands in
the text (duplicate lines), and by whether it stands in a run of lines that are titles without a sentence; what the lines of
keywords, links, tags or codes make of the whole text decides.

Per language, over the whole corpus: what counts as too few function words is half of the 10 % quantile of their share in
lines that end as sentences; what counts as too much of one word is one and a half times the 99.9 % quantile of the most
frequent word's share in such lines. Function words of Chinese, English, German and French are listed; those of any other
language that the corpus names (`lang`) are learned as the words that most of its documents have. A line in a language of
which nothing is known has no such limits, and only links, tags, bars, recurrence and titles tell there.

Lines that only look alike are named: table rows, headings, numbered references, and contents that point into the page
itself are not counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm._chars import without_header
from pagesift.session import written

MORE_THAN = 0.5
LEAST_ITEMS = 4
LEAST_TITLES = 4
LEAST_BARS = 5
MOST_RECURRING = 0.5
_BINS = 200
QUANTILE, PART = 0.1, 0.5
TOP_QUANTILE, TOP_PART = 0.999, 1.5
#: A line that stands so often in a text, and is no sentence, is a duplicate.
DUPLICATE = 3
#: Words that so many documents of a language have are function words of it; fewer documents than this teach none.
LEARNED_SHARE, LEARNED_WORDS, LEAST_DOCUMENTS = 0.25, 80, 20
#: Word counts that a task holds before it hands them on, to be added up with those of all tasks.
_HELD = 200_000

# Frequent function words.
FUNCTION_WORDS = {
    "en": "the of to and in a is that for with by as at from on its it an be which while though are was were has have had this these or not but than into will can may over after before under more most their they each no some".split(),
    "de": "der die das und in zu den von mit auf für ist im dem nicht ein eine als auch an bei nach aus um über noch wie einen werden sich des wird war sind oder wenn seit laut bis zum zur rund bei".split(),
    "fr": "le la les de des du et à en un une que qui dans pour sur par au aux est ce cette selon plus ne pas son sa ses dont sont a ont été ou avec malgré depuis tandis".split(),
}
FUNCTION_CHARACTERS = "的了在是为与和及对由从被把将使按据以其于至较不未也都而且但仍约已可应后前上下中年每到则"

_ENDS = re.compile(r"[。！？；.!?;…][\"'”’)）」』]*\s*$")
_STOP = re.compile(r"[。！？]|[.!?](?=\s|$)")
_SENTENCES = re.compile(r"(?<=[。！？])|(?<=[.!?])\s")
_TABLE, _HEADING, _REFERENCE, _INSIDE = re.compile(r"\s*\|"), re.compile(r"\s*#{1,6}\s"), re.compile(r"\s*\[\d+\]\s"), re.compile(r"\]\(#")
_LINKS = re.compile(r"\[[^\]\n]*\]\((?!#)[^)\n]*\)|<a\b[^>]*>.*?</a>|https?://\S+|(?<!\S)#[^\s#]+|(?<!\S)[»›▸►]\s*\S[^»›▸►#\[<]*")
_PRICE = re.compile(r"[￥¥$€£]\s?\d")
_SEPARATORS = re.compile(r"[，、,;；|｜/·•»›]|\s[-–—]\s|\t|\s{2,}")
_SEPARATORS_HAN = re.compile(r"[，、,;；|｜/·•»›\s]+|\s[-–—]\s")
_BARS = re.compile(r"[|｜·•»›]|\s[-–—/]\s")
#: Words, without the letters of codes.
_WORDS = re.compile(r"(?<![\w-])[^\W\d_]+(?:[-'’][^\W\d_]+)*(?![\w-])")
_HAN, _HAN_RUN = re.compile("[㐀-鿿]"), re.compile("[㐀-鿿]+")
#: Letters of alphabets other than the Latin one, kana and hangul.
_OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u3040-\u30ff\uac00-\ud7a3]+")
_FUNCTION_CHARACTER = re.compile(f"[{FUNCTION_CHARACTERS}]")
_LATIN = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}


@dataclass
class Limits:
    """What is known of languages: least share of function words, most of one word, and learned function words."""

    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    words: dict[str, frozenset] = field(default_factory=dict)


def language(label: str | None) -> str:
    """Two letters of a language label, empty for a missing one or one that names no language."""
    code = (label or "").strip().lower().replace("_", "-").partition("-")[0]
    return code if len(code) == 2 and code.isascii() and code.isalpha() else ""


def _read(line: str, label: str = "", learned: dict[str, frozenset] = {}) -> tuple[str, float, list[str] | None]:
    """Language of a line as far as function words tell it, their share of its words (Chinese: of its characters), and the
    words of a line that is not Chinese. The language is empty where nothing is known of it."""
    han = sum(map(len, _HAN_RUN.findall(line)))
    if 3 * han > len(line):
        return ("zh", len(_FUNCTION_CHARACTER.findall(line)) / han, None) if label != "ja" else ("", 0.0, None)
    words = _WORDS.findall(line.lower())
    if not words:
        return "en", 0.0, words
    counts = {lang: sum(w in known for w in words) for lang, known in _LATIN.items()}
    lang = max(counts, key=lambda k: (counts[k], k == "en", k))
    if label and label not in counts and label != "zh":
        if label not in learned:
            return "", 0.0, words
        own = sum(w in learned[label] for w in words)
        # a page may hold lines in another language than its own
        if own >= counts[lang]:
            return label, own / len(words), words
    elif 2 * counts[lang] < len(words) and sum(map(len, _OTHER_SCRIPT.findall(line))) * 2 > sum(map(len, words)):
        return "", 0.0, words
    return lang, counts[lang] / len(words), words


def _ordinary(line: str) -> bool:
    return bool(_TABLE.match(line) or _HEADING.match(line) or _REFERENCE.match(line) or _INSIDE.search(line))


def _recurring(line: str) -> float:
    """Part of the line in sentences that hold one run of two words (in Chinese: of three characters) three times."""
    part = 0
    for sentence in _SENTENCES.split(line):
        han = _HAN.findall(sentence)
        chinese = 3 * len(han) > len(sentence)
        w = han if chinese else _WORDS.findall(sentence.lower())
        # a run that stands three times repeats three characters or words at least
        if len(set(w)) > len(w) - 3:
            continue
        units = list(zip(w, w[1:], w[2:]) if chinese else zip(w, w[1:]))
        if units and Counter(units).most_common(1)[0][1] >= 3:
            part += len(sentence)
    return part / len(line)


def _top_share(words: list[str], known: frozenset = frozenset()) -> float:
    """Share of the most frequent word of a line that is no function word."""
    counts = Counter(w for w in words if w not in known)
    return max(counts.values(), default=0) / max(1, len(words))


def _stuffed(line: str, limits: Limits, label: str = "") -> bool:
    """Whether the line is made of links, tags, codes or keywords."""
    links = sum(len(m[0]) for m in _LINKS.finditer(line))
    if 2 * links > len(line):
        return True
    rest = _LINKS.sub(" ", line) if links else line
    lang, share, words = _read(rest, label, limits.words)
    few = share < limits.least.get(lang, 0.0)
    if few and 4 * links > len(line) and not _STOP.search(rest):
        return True
    prices = len(_PRICE.findall(rest))
    if prices and few and prices * 60 >= len(rest) and not _STOP.search(rest):
        return True
    if len(rest) >= 60 and _recurring(rest) > MOST_RECURRING:
        return True
    if (bars := len(_BARS.findall(rest))) >= LEAST_BARS and len(_STOP.findall(rest)) < bars:
        return True
    if not few or len(rest) < 24:
        return links > 0 and few
    words = _WORDS.findall(rest.lower()) if words is None else words
    items = [x for x in (_SEPARATORS_HAN if lang == "zh" else _SEPARATORS).split(rest) if x.strip()]
    if len(_STOP.findall(rest)) * 120 > len(rest) + 60:
        return False
    if len(items) >= LEAST_ITEMS and len(rest) / len(items) <= (16 if lang == "zh" else 48):
        return True
    if len(words) < 8:
        return False
    grams = Counter(words if lang == "zh" else zip(words, words[1:]))
    return sum(n for n in grams.values() if n > 1) >= 0.4 * len(words) or _top_share(words) > limits.most.get(lang, 1.0)


def stuffed_share(text: str | None, limits: Limits, more_than: float = -1.0, label: str = "") -> tuple[float, float, float]:
    """Of the characters in lines: share in keyword, link, tag and title lines; of lines: share that repeat an earlier one;
    of words: share of the most frequent one. Zeros for a text without lines; the last two are only counted for texts
    whose share is above `more_than`."""
    lines = [x.strip() for x in without_header(text).split("\n")]
    lines = [x for x in lines if x]
    total = sum(map(len, lines))
    if not total:
        return 0.0, 0.0, 0.0
    bad, run, run_chars = 0, 0, 0
    often = Counter(lines) if len(set(lines)) <= len(lines) - DUPLICATE + 1 else {}
    for line in [*lines, "."]:
        ordinary = _ordinary(line)
        duplicate = bool(often) and often[line] >= DUPLICATE and not _ENDS.search(line)
        if not ordinary and (duplicate or _stuffed(line, limits, label)):
            bad += len(line)
            continue  # neither ends nor lengthens a run of titles
        if not ordinary and not _ENDS.search(line) and len(line) <= 120:
            run, run_chars = run + 1, run_chars + len(line)
            continue
        if run >= LEAST_TITLES:
            bad += run_chars
        run, run_chars = 0, 0
    if bad <= more_than * total:
        return bad / total, 0.0, 0.0
    words = Counter(_WORDS.findall(" ".join(lines).lower()))
    return bad / total, 1 - len(set(lines)) / len(lines), max(words.values(), default=0) / max(1, sum(words.values()))


def language_limits(documents: DataFrame, text: str = "text", lang: str = "lang") -> Limits:
    """What sentences of each language are like, gathered over all rows as histograms and counts of all words.

    Words as frequent as the last one that is learned are learned too.
    """
    listed = {*_LATIN, "zh", ""}

    def partial(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["kind", "lang", "what", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held: Counter = Counter()
        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), map(language, batch.column(1).to_pylist())):
                lines = [x for x in without_header(t).split("\n") if len(x) >= 30 and _ENDS.search(x) and not _ordinary(x) and not _LINKS.search(x)]
                if label not in listed and lines:
                    words = [w for x in lines for w in _WORDS.findall(x.lower())]
                    held.update(("df", label, w) for w in set(words))
                    held.update(("tf", label, w) for w in words)
                    held["documents", label, ""] += 1
                    held["words", label, ""] += len(words)
                    if len(held) > _HELD:
                        yield partial([(*k, n) for k, n in held.items()])
                        held.clear()
                    continue
                for line in lines:
                    found, share, words = _read(line, label)
                    if found:
                        seen["least", found, min(_BINS - 1, int(share * _BINS))] += 1
                        if words:
                            seen["most", found, min(_BINS - 1, int(_top_share(words) * _BINS))] += 1
        yield partial([(kind, found, str(b), n) for (kind, found, b), n in seen.items()] + [(*k, n) for k, n in held.items()])

    labels = F.col(lang).cast("string") if lang in documents.columns else F.lit(None).cast("string")
    sums = documents.select(F.col(text).cast("string"), labels).where(F.length(text) > 0).mapInArrow(gather, "kind string, lang string, what string, n long").groupBy("kind", "lang", "what").agg(F.sum("n").alias("n"))
    sums = written(sums, "languages")
    limits = Limits()
    bins = sums.where(F.col("kind").isin("least", "most", "documents", "words")).collect()  # languages times bins
    for kind, quantile, part, out in (("least", QUANTILE, PART, limits.least), ("most", TOP_QUANTILE, TOP_PART, limits.most)):
        for name in {r["lang"] for r in bins if r["kind"] == kind}:
            each, upto = sorted((int(r["what"]), r["n"]) for r in bins if r["kind"] == kind and r["lang"] == name), 0
            for b, n in each:
                upto += n
                if upto >= quantile * sum(m for _, m in each):
                    out[name] = part * (b + (kind == "most")) / _BINS
                    break
    sizes = {(r["kind"], r["lang"]): r["n"] for r in bins if r["what"] == ""}
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n")))
    total = sums.where("kind = 'documents'").select("lang", F.col("n").alias("documents"))
    common = sums.where("kind = 'df'").join(total, "lang").where((F.col("documents") >= LEAST_DOCUMENTS) & (F.col("n") >= LEARNED_SHARE * F.col("documents")))
    common = common.withColumn("place", place).where(F.col("place") <= LEARNED_WORDS).select("lang", "what")
    times = sums.where("kind = 'tf'").join(common, ["lang", "what"]).select("lang", "what", "n").collect()  # LEARNED_WORDS a language, and ties
    for name in {r["lang"] for r in times}:
        own = {r["what"]: r["n"] for r in times if r["lang"] == name}
        limits.words[name] = frozenset(own)
        limits.least[name] = PART * PART * sum(own.values()) / max(1, sizes["words", name])
    return limits


def stuffed(documents: DataFrame, key: str = "doc_id", text: str = "text", more_than: float = MORE_THAN, lang: str = "lang") -> DataFrame:
    """Documents of whose characters more than `more_than` are keywords, links, tags, titles or codes: (`key`, `share`,
    `repeated_lines`, `top_word`).

    documents: a table with a bigint `key`, a string `text`, and any other columns; a string `lang`, where there is one,
    names the language. Null, empty and blank texts are not
    listed; a leading header line does not count. A corpus without any sentence has no limits for function words, and only
    links, tags and runs of titles tell then. Each document is judged by its whole text. An empty table gives an empty
    result.
    """
    limits = language_limits(documents, text, lang)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [stuffed_share(t, limits, more_than, language(x)) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[i] for s in shares], pa.float64()) for i in range(3))], names=["key", "share", "repeated_lines", "top_word"])

    labels = F.col(lang).cast("string") if lang in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col(key).cast("long"), F.col(text).cast("string"), labels)
    return rows.mapInArrow(judge, "key long, share double, repeated_lines double, top_word double").where(F.col("share") > more_than).withColumnRenamed("key", key)
