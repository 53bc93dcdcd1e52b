"""Expressions that read dates out of text. Results are ISO strings; an empty string stands for no date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import stripped
from pagesift.functions.urls import _c, let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Days of a unit of relative time.
UNIT_DAYS = {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}
LABELS_CN = "最后更新|更新时间|发布时间|发布日期|发表于|更新于"
LABELS_EN = r"last\s+updated|updated(?:\s+on)?|published|posted|最后更新|更新于|发布于"


def iso(year: Column, month: Column, day: Column) -> Column:
    """ISO date, empty if there is no such day."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"), F.lit(""))


def month_number(name: Column) -> Column:
    """01 to 12 by the first three letters, empty for no month."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("string")).otherwise("")


def normalized(raw: Column | str, as_of: str) -> Column:
    """A raw date as ISO date (T1). The first notation that fits decides; relative times count back from `as_of`.

    Notations: 2025-01-31..., 2025/1/31 or 2025.1.31, 2025年1月31日 (the first without a day), Jan 31, 2025, and 3 days ago.
    """
    return let(stripped(raw), lambda s: _normalized(s, as_of))


def _normalized(s: Column, as_of: str) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    numeric = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})"
    chinese = r"^(\d{4})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?"
    english = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    ago = r"(?i)^(\d+)\s*(minute|hour|day|week|month|year)s?\s+ago$"
    out = F.when(s == "", "")
    for p in numeric:
        out = out.when(s.rlike(p), iso(part(p, 1), part(p, 2), part(p, 3)))
    day = F.when(part(chinese, 3) == "", "1").otherwise(part(chinese, 3))
    out = out.when(s.rlike(chinese), iso(part(chinese, 1), part(chinese, 2), day))
    month = month_number(part(english, 1))
    out = out.when(s.rlike(english) & (month != ""), iso(part(english, 3), month, part(english, 2)))
    per = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    # no date before the year 1
    days = F.try_multiply(F.substring(part(ago, 1), 1, 6).try_cast("int"), F.try_element_at(per, F.lower(part(ago, 2))))
    return out.when(s.rlike(ago) & (days > 700_000), "").when(s.rlike(ago), F.coalesce(F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd"), F.lit(""))).otherwise("")


def page_date(text: Column | str, head: int = 2000) -> Column:
    """Date that a page states under a label near its start (T2): a numeric one under a Chinese label, else a month by name."""
    return let(F.substring(F.coalesce(_c(text), F.lit("")), 1, head), _page_date)


def _page_date(s: Column) -> Column:
    cn = rf"(?i)(?:{LABELS_CN})\s*[:：]?\s*(\d{{4}})\s*[-/年]\s*(\d{{1,2}})\s*[-/月]\s*(\d{{1,2}})"
    name, day = r"([A-Za-z]{3,9})\.?", r"(\d{1,2})(?:st|nd|rd|th)?"
    en = rf"(?i)(?:{LABELS_EN})(?:\s+on)?\s*[:：]?\s*(?:{name}\s+{day}|{day}\s+{name})\s*,?\s+(\d{{4}})"
    first = iso(F.regexp_extract(s, cn, 1), F.regexp_extract(s, cn, 2), F.regexp_extract(s, cn, 3))
    month = month_number(F.concat(F.regexp_extract(s, en, 1), F.regexp_extract(s, en, 4)))
    second = iso(F.regexp_extract(s, en, 5), month, F.concat(F.regexp_extract(s, en, 2), F.regexp_extract(s, en, 3)))
    return F.when(s.rlike(cn) & (first != ""), first).when(s.rlike(en) & (month != ""), second).otherwise("")


def best_date(raw: Column | str, text: Column | str, as_of: str) -> Column:
    """The date of the search hit, else the one of the page."""
    return F.coalesce(F.nullif(normalized(raw, as_of), F.lit("")), page_date(text))
