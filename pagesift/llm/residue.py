"""Template residue and error-page text (problem 2).

Records made from one template are aligned on the words around its slots. A slot is induced where records have, between
the same neighbours, different fillings that name a variable or say that there is no value; a slot that keeps such a
filling is flagged. Words that always stand in the same place (a text that explains what `null` means) vary in no record
and make no slot. Variable names are learned from fillings whose notation leaves no doubt, and then known in any brackets.

Whole pages: what is left of a short page without title and navigation is compared by its runs of characters with all
pages. Runs that are much more frequent as whole short pages than within ordinary text belong to repeated page templates,
and a page made of them is an error, block, sign-in or default page. A short true notice is made of runs that ordinary
pages have as well. Both frequencies are counted over all rows in 2**20 hashed counters, whose number does not grow with
the data. Rare messages are known by their wording, filler by its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._chars import U, code_points, mix, rolling, slices, window_owner, without_header
from pagesift.llm._meet import summed
from pagesift.session import written

COUNTERS = 1 << 20
SLICE = 1 << 16
#: Longest page core, in letters and digits, from which page templates are learned; pages of any length are judged.
MOST_CORE = 260
#: Runs of 4 characters with a Chinese one, of 8 otherwise.
RUN_HAN, RUN_OTHER = 4, 8
LEAST_RATIO, RATE_FLOOR = 2.0, 0.001
#: Part of a page that runs of page templates cover, in pages as short as those that teach them and in longer ones, and
#: most of its runs that ordinary text may have.
LEAST_COVERED, LEAST_COVERED_LONG, MOST_USUAL = 0.33, 0.6, 0.5
CONTEXT = 5
LEAST_FILLINGS = 2
MOST_FILLER_LEFT = 0.4

_FENCED, _INLINE = re.compile(r"```.*?(?:```|\Z)", re.S), re.compile(r"`[^`\n]+`")
_NAME = r"[^\W\d][\w.\- ]{0,40}"
#: Notations that leave no doubt.
_SURE = re.compile(
    rf"\{{\{{\s*({_NAME}?)\s*\}}\}}|[$#]\{{\s*({_NAME}?)\s*\}}|\{{%\s*(?:block |if |for |include )?\s*({_NAME}?)\s*%\}}|<%=?\s*({_NAME}?)\s*%>|\*\|\s*({_NAME}?)\s*\|\*|%\(({_NAME}?)\)[sd]"
    rf"|\[\s*(?:INSERT|insert|Insert)\s+({_NAME}?)\s+(?:HERE|here|Here)\s*\]|[【《\[（(]\s*(?:请填写|请输入|此处插入|此处填写|待补充[：:]?|待填写[：:]?)\s*({_NAME}?)\s*[】》\]）)]"
)
#: Brackets of any kind around what may be a name.
_MAYBE = re.compile(
    rf"\[\[({_NAME}?)\]\]|@@({_NAME}?)@@|%%?([A-Za-z_][A-Za-z_.]{{2,30}})%%?|(?<!\w)__({_NAME}?)__(?!\w)|[×xX]{{2}}({_NAME}?)[×xX]{{2}}|\[({_NAME}?)\](?!\()|\{{({_NAME}?)\}}|<({_NAME}?)>|[«‹]({_NAME}?)[»›]|[｛〔【［〈]({_NAME}?)[｝〕】］〉]"
)
# Words by which programs say that there is no value.
_NO_VALUE = re.compile(r"(?<![\w.])(?:N/A undefined|\[object Object\]|undefined|null|NULL|None|NaN|nan|nil|NULL VALUE|#N/A|#REF!|#VALUE!)(?![\w])")

#: A place left blank: it tells only between neighbours that hold different fillings elsewhere.
_BLANK = re.compile(r"_{3,}|＿{2,}|【\s*】|［\s*］|（\s*）|\(\s*\)|《\s*》|\[\s*\](?!\()|\{\s*\}")
BLANK = "blank"

# Words of navigation, filler and messages.
NAVIGATION = {"导航", "首页", "热门推荐", "相关推荐", "推荐阅读", "网站导航", "菜单", "menu", "home", "most read", "navigation", "related", "startseite", "accueil", "popular"}
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
FILLER = re.compile(r"点击编辑(?:这段)?文字|请在后台替换本段|此处为占位内容|占位文字|示例文本(?:仅供排版)?|这里是示例文字|(?:标题文字)+|(?:正文内容)+|图片说明文字|默认文章摘要|(?:测试){2,}|your text (?:goes )?here|sample text|placeholder text|blindtext|texte d.exemple", re.I)
MESSAGE = re.compile(
    r"(?:enable|activate|turn(?:ed)? on|requires?|need|activer|aktivieren|启用|开启|打开|依赖|未启用)[^。.!?]{0,25}(?:javascript|\bjs\b|scripts?\b|cookies?\b|脚本)|(?:javascript|\bjs\b|cookies?|脚本)[^。.!?]{0,25}(?:enabled?|disabled|turned on|erlaubt|erlauben|aktivier|禁用|关闭|启用|开启)"
    r"|\b(?:40[0134]|410|429|50[0234])\b[^。]{0,14}(?:error|not found|forbidden|gateway|unavailable|nothing|找不到|不存在|seite|page)|(?:error|fehler|erreur)\s*(?:40\d|50\d)|page (?:could )?not (?:be )?found|could not find that page|not found on this server|access (?:to this page has been )?denied|accès refusé|zugriff verweigert"
    r"|页面(?:不存在|走丢|已失效|已删除)|(?:没有|无)权限|访问(?:过于频繁|受限|被拒绝)|已被?(?:拦截|删除|下架)|维护中|系统繁忙|建设中|即将上线|已到期|暂无数据|没有找到(?:相关)?结果|默认首页|登录后(?:查看|阅读|继续)|仅对会员开放|打开(?:客户端|app)|下载(?:客户端|app)"
    r"|(?:sign|log) in to (?:read|view|continue)|subscribers only|open our app|verify (?:that )?you are human|checking (?:that you are human|your browser)|complete the puzzle|out of date|under construction|coming soon|down for maintenance|this domain|it works!|hello world!|no results|has been removed|traceback \(most|uncaught \w*exception|nullpointerexception|internal server error|bad gateway|service (?:is )?unavailable|too many (?:connections|requests)|permission to view",
    re.I,
)
_SENTENCE = re.compile(r"[。！？；.!?;]\W*$")
_LINK_LINE = re.compile(r"\[[^\]]*\]\([^)]*\)")
_LETTERS = re.compile(r"[\W_]+")


def core(text: str | None) -> str:
    """A page without header line, headings, navigation and links back."""
    kept = []
    for paragraph in re.split(r"\n\s*\n", without_header(text)):
        lines = [x.strip().lstrip(">").strip() for x in paragraph.split("\n")]
        lines = [x for x in lines if x and not re.match(r"#{1,6}\s", x) and not _LINK_LINE.fullmatch(x)]
        if lines and lines[0].lower() in NAVIGATION:
            continue
        kept += lines
    return "\n".join(kept)


def letters_of(text: str) -> str:
    return _LETTERS.sub("", text.lower())


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counter of each run of characters, where it starts in all texts together, and its width. Digits are all alike."""
    points, starts = code_points(texts)
    none = np.empty(0, np.int64)
    if not len(points):
        return none, none, none
    points = np.where((points >= 48) & (points <= 57), 48, points)
    han = (points >= 0x3400) & (points < 0xA000)
    ahead = np.concatenate([[0], np.cumsum(han)])
    out, places, widths = [], [], []
    for width, wanted in ((RUN_HAN, True), (RUN_OTHER, False)):
        at, _ = window_owner(starts, width)
        if not len(at):
            continue
        has = ahead[at + width] > ahead[at]
        at = at[has == wanted]
        out.append((mix(rolling(points, width, 5 + width))[at] & U(COUNTERS - 1)).astype(np.int64))
        places.append(at)
        widths.append(np.full(len(at), width))
    return (np.concatenate(out), np.concatenate(places), np.concatenate(widths)) if out else (none, none, none)


def template_parts(texts: list[str], template: np.ndarray, ordinary: np.ndarray) -> list[tuple[int, float, float]]:
    """Of the letters of each text: how many runs of page templates they have, which part of them such runs cover, and
    which part of all runs ordinary text has too (1 for a text without runs)."""
    runs, places, widths = _runs(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    owners = np.searchsorted(starts, places, "right") - 1
    odd, n = template[runs], starts[-1]
    covered = np.cumsum(np.bincount(places[odd], minlength=n + 1)[: n + 1] - np.bincount(places[odd] + widths[odd], minlength=n + 1)[: n + 1]) > 0
    upto = np.concatenate([[0], np.cumsum(covered)])
    many = np.bincount(owners, minlength=len(texts))
    usual = np.where(many > 0, np.bincount(owners, ordinary[runs], len(texts)) / np.maximum(1, many), 1.0)
    part = (upto[starts[1:]] - upto[starts[:-1]]) / np.maximum(1, lengths)
    return list(zip(np.bincount(owners[odd], minlength=len(texts)).tolist(), part.tolist(), usual.tolist()))


def candidates(text: str) -> list[tuple[str, str, str, bool, bool]]:
    """Possible fillings of slots in running text: (left neighbours, right neighbours, name or word, sure, repeated)."""
    if "```" in text:
        text = _FENCED.sub("\n", text)
    if "`" in text:
        text = _INLINE.sub("", text)
    found: dict[int, tuple[int, str, bool, bool]] = {}
    for m in _MAYBE.finditer(text):
        name = next(g for g in m.groups() if g is not None)
        found[m.start()] = (m.end(), name.strip().lower(), False, False)
    for m in _BLANK.finditer(text):
        found[m.start()] = (m.end(), BLANK, False, False)
    for m in _NO_VALUE.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
        found[m.start()] = (m.end(), m[0], False, len(re.findall(rf"(?<![\w.]){re.escape(m[0])}(?!\w)", line)) > 1)
    for m in _SURE.finditer(text):
        found[m.start()] = (m.end(), next((g for g in m.groups() if g), "").strip().lower(), True, False)
    out = []
    for start, (end, name, sure, again) in found.items():
        # neighbours of the same line
        left, right = text[max(0, start - CONTEXT) : start].rpartition("\n")[2], text[end : end + CONTEXT]
        out.append((re.sub(r"\d", "0", left), re.sub(r"\d", "0", right), name, sure, again))
    return out


_SCAN = "id long, lo string, hi string, name string, sure boolean, again boolean, part int, short binary, long binary, shorts long, longs long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    short, long_, shorts, longs = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, np.int64), 0, 0
    names = [x.split()[0] for x in _SCAN.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        rows = [(i, *c) for i, t in zip(ids, texts) for c in candidates(without_header(t))]
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)] + [pa.nulls(len(rows), t) for t in types[6:]], names=names)
        cores = [letters_of(core(t)) for t in texts]
        brief = [c for c in cores if 0 < len(c) <= MOST_CORE]
        full = [c for c in cores if len(c) > MOST_CORE]
        shorts, longs = shorts + len(brief), longs + len(full)
        for group, counters in ((brief, short), (full, long_)):
            for a, b in slices(group):
                counters += np.bincount(_runs(group[a:b])[0], minlength=COUNTERS)
    if shorts or longs:
        n = COUNTERS // SLICE
        cut = [pa.array([x.tobytes() for x in c.astype("<u4").reshape(-1, SLICE)], pa.binary()) for c in (short, long_)]
        yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in types[:6]] + [pa.array(range(n), pa.int32()), *cut, pa.array([shorts] + [0] * (n - 1), pa.int64()), pa.array([longs] + [0] * (n - 1), pa.int64())], names=names)


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    sums = {c: np.sum([np.frombuffer(x, "<u8" if len(x) == 8 * SLICE else "<u4").astype(np.uint64) for x in parts[c]], axis=0).astype("<u8").tobytes() for c in ("short", "long")}
    return pd.DataFrame({"part": [parts["part"].iloc[0]], "salt": [0], "short": [sums["short"]], "long": [sums["long"]], "shorts": [int(parts["shorts"].sum())], "longs": [int(parts["longs"].sum())]})


def page_template_runs(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which counters stand for runs of page templates, and which for runs of ordinary text."""
    form = "part int, salt int, short binary, long binary, shorts long, longs long"
    parts = scanned.where(F.col("part").isNotNull()).select("part", "short", "long", "shorts", "longs")
    short, long_, n, m = np.zeros(COUNTERS), np.zeros(COUNTERS), 0, 0
    for r in summed(parts, ["part"], form, _added):
        at = slice(r["part"] * SLICE, (r["part"] + 1) * SLICE)
        short[at], long_[at] = np.frombuffer(r["short"], "<u8"), np.frombuffer(r["long"], "<u8")
        n, m = n + r["shorts"], m + r["longs"]
    often, usual = short / max(1, n), long_ / max(1, m)
    template = (short >= 3) & (often >= LEAST_RATIO * (usual + RATE_FLOOR))
    return template, (usual > 2 * RATE_FLOOR) & ~template


def is_template_page(page: str, chars: str, parts: tuple[int, float, float], ordinary: np.ndarray) -> bool:
    """Whether a page is a message, default page or filler, by its core, the letters of it and their `template_parts`."""
    if not page:
        return False
    words = re.findall(r"[a-z]+", page.lower()) if page.isascii() else re.findall(r"[^\W\d_]+", page.lower())
    if len(words) >= 8 and sum(w in LOREM for w in words) >= 0.7 * len(words):
        return True
    filler = sum(len(m[0]) for m in FILLER.finditer(page))
    if filler and filler >= MOST_FILLER_LEFT * len(page):
        return True
    if not chars:
        return False
    if 2 * len(chars) < sum(not c.isspace() for c in page):
        return False  # not a text but garbled
    odd, covered, usual = parts
    if odd and usual < MOST_USUAL and covered >= (LEAST_COVERED if len(chars) <= MOST_CORE else LEAST_COVERED_LONG):
        return True
    if len(chars) > MOST_CORE and usual >= MOST_USUAL:
        return False  # most of it is as ordinary text
    # by its wording: some line is a message, and no other line is a sentence as ordinary pages have them
    told = 0
    for line in page.split("\n"):
        if MESSAGE.search(line):
            told += len(letters_of(line))
        elif _SENTENCE.search(line) and len(own := _runs([letters_of(line)])[0]) >= 5 and ordinary[own].mean() >= 0.4:
            return False
    if len(chars) > MOST_CORE:  # a long page tells by most of its letters
        return told > 0.5 * len(chars)
    return told > 0 or (usual < 0.3 and bool(MESSAGE.search(page.replace("\n", " "))))


def residue(rows: DataFrame, key: str = "entry_id", text: str = "body") -> DataFrame:
    """Rows to keep out: (`key`, `slot`, `page`), an unfilled slot in running text, or a page without content.

    rows: a table with a bigint `key` and a string `text`, and any other columns. A leading header line, fenced and inline
    code do not count. Null, empty and blank texts are not listed; rows with a null key are listed if their text is. In a
    table too small for templates to repeat, only sure notations, repeated words for no value, filler and known wordings
    tell. An empty table gives an empty result.
    """
    source = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    scanned = written(source.mapInArrow(_scan, _SCAN), "residue")
    kept = scanned.where(F.col("part").isNull()).select("id", "lo", "hi", "name", "sure", "again")
    # names that sure notations use in two records or more
    names = kept.where("sure and name != ''").groupBy("name").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("name", F.lit(True).alias("known"))
    left = kept.groupBy("lo").agg(F.approx_count_distinct("name").alias("_n")).where(F.col("_n") >= LEAST_FILLINGS).select("lo", F.lit(True).alias("slot_left"))
    right = kept.groupBy("hi").agg(F.approx_count_distinct("name").alias("_n")).where(F.col("_n") >= LEAST_FILLINGS).select("hi", F.lit(True).alias("slot_right"))
    # neighbours between which sure notations stand; a bare start of a line is none
    sure = kept.where(F.col("sure") & F.col("lo").rlike(r"^.{3,}$")).groupBy("lo").agg(F.approx_count_distinct("name").alias("_n")).where(F.col("_n") >= LEAST_FILLINGS).select("lo", F.lit(True).alias("slot_sure"))
    is_word = F.col("name").rlike(f"^(?:{_NO_VALUE.pattern})$") | (F.col("name") == BLANK)
    slots = (
        kept.join(names, "name", "left").join(left, "lo", "left").join(right, "hi", "left").join(sure, "lo", "left")
        .where(F.col("sure") | (~is_word & (F.col("known") | F.col("slot_sure"))) | (is_word & (F.col("again") | (F.col("slot_left") & F.col("slot_right")))))
        .select("id").distinct()
    )
    template, ordinary = page_template_runs(scanned)
    sent = rows.sparkSession.sparkContext.broadcast((np.packbits(template), np.packbits(ordinary)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, ordinary = (np.unpackbits(x).view(bool) for x in sent.value)
        for batch in batches:
            out, ids = [], batch.column(0).to_pylist()
            pages = list(map(core, batch.column(1).to_pylist()))
            letters = list(map(letters_of, pages))
            for a, b in slices(letters):
                parts = template_parts(letters[a:b], template, ordinary)
                out += [i for i, p, c, m in zip(ids[a:b], pages[a:b], letters[a:b], parts) if is_template_page(p, c, m, ordinary)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])

    pages = source.mapInArrow(judge, "id long").distinct()
    both = slots.select("id", F.lit(True).alias("slot"), F.lit(False).alias("page")).union(pages.select("id", F.lit(False), F.lit(True)))
    return both.groupBy(F.col("id").alias(key)).agg(F.max("slot").alias("slot"), F.max("page").alias("page"))
