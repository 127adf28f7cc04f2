"""Headings: detect, classify, merge chapter titles, carry forward to the lines below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, let, strip, text_or_empty
from .lines import NUMERALS, normalize_spaces

LEVELS = ("part", "chapter", "section", "subsection", "subsubsection")
#: Headings of front matter.
LOW_VALUE = ("版权", "图书在版编目", "CIP", "编委", "主编简介", "副主编简介", "新形态教材", "获取数字资源", "读者信息反馈", "修订说明", "目录")
#: Level by pattern, the first that matches. \b follows Unicode letters, as CJK numerals do.
PATTERNS = (
    (1, f"(?U)^第[{NUMERALS}]+篇\\b"),
    (2, f"(?U)^第[{NUMERALS}]+章\\b"),
    (2, r"(?U)^绪\s*论$"),
    (3, f"(?U)^第[{NUMERALS}]+节\\b"),
    (4, r"(?U)^[一二三四五六七八九十百千万]+[、.．]\s*\S+"),
    (5, r"(?U)^（[一二三四五六七八九十百千万]+）\s*\S+"),
    (6, r"(?U)^\(?\d+\)?[、.．]\s*\S+"),
)
#: Patterns of a page number at a title's end and of a chapter's number alone.
TRAILING_PAGE = r"(?U)^(.+?)(?:\s|\.|·|…)+(\d{1,4})\s*$"
BARE_CHAPTER = f"^第[{NUMERALS}]+章$"


def is_low_value(title) -> Column:
    return text_or_empty(title).rlike("(?iu)" + "|".join(LOW_VALUE))


def heading_level(title) -> Column:
    """1 to 6, or null if the text is no heading."""
    t = text_or_empty(title)
    out = F.when(F.lit(False), F.lit(0))
    for level, pattern in PATTERNS:
        out = out.when(t.rlike(pattern), F.lit(level))
    return out.when((F.length(t) <= 36) & ~t.rlike("[。；！？]"), F.lit(4))


def split_page(title) -> tuple[Column, Column]:
    """(title without its trailing page number, the number or null)."""
    t = text_or_empty(title)
    has = t.rlike(TRAILING_PAGE)
    clean = normalize_spaces(F.regexp_replace(F.regexp_extract(t, TRAILING_PAGE, 1), "[.·… ]+$", ""))
    return F.when(has, clean).otherwise(t), F.when(has, F.regexp_extract(t, TRAILING_PAGE, 2).try_cast("int"))


def detect_heading(line) -> Column:
    """struct(level, title, page); null where the line is none."""
    raw = F.regexp_extract(text_or_empty(line), r"(?U)^\s{0,3}#{1,6}\s*(.+?)\s*$", 1)

    def found(title, page):
        clean = strip(F.regexp_replace(F.replace(title, F.lit("|"), F.lit(" ")), r"(?U)\s+", " "))
        return let(clean, lambda t: let(heading_level(t), lambda lv: F.when((t != "") & lv.isNotNull() & ~is_low_value(t), F.struct(lv.alias("level"), t.alias("title"), page.alias("page")))))

    return F.when(text_or_empty(line).rlike(r"^\s{0,3}#"), let(normalize_spaces(raw), lambda x: found(*split_page(x))))


def markdown_heading(line) -> Column:
    """struct(level, title) by the number of hashes; null where the line is none."""
    t = text_or_empty(line)
    pattern = r"(?U)^(#{1,6})\s+(.+?)\s*$"
    return F.when(t.rlike(pattern), F.struct(F.length(F.regexp_extract(t, pattern, 1)).alias("level"), strip(F.regexp_extract(t, pattern, 2)).alias("title")))


def bare_chapter(t: Column, lv: Column) -> Column:
    return (lv == 2) & t.rlike(BARE_CHAPTER)


def short_title(t: Column, lv: Column) -> Column:
    return (lv == 4) & (F.length(t) <= 40) & ~t.rlike("[。；！？]")


def merged_titles(heads: Column) -> Column:
    """The same over a document's headings as an array of structs in their order, with level and title: those that stay."""

    def one(hs):
        def seen(h, i):
            before, after = F.get(hs, i - 1), F.get(hs, i + 1)
            gone = F.coalesce(bare_chapter(before["title"], before["level"]) & short_title(h["title"], h["level"]), F.lit(False))
            longer = bare_chapter(h["title"], h["level"]) & F.coalesce(short_title(after["title"], after["level"]), F.lit(False))
            return F.when(~gone, h.withField("title", F.when(longer, F.concat(h["title"], F.lit(" "), after["title"])).otherwise(h["title"])))

        return F.array_compact(F.transform(hs, seen))

    return let(heads, one)


def merge_chapter_titles(headings: DataFrame, key: str, order: str) -> DataFrame:
    """headings: (key, order, level, title, ...). A bare chapter followed by a short level-4 title becomes one heading; the title's row goes."""
    w = Window.partitionBy(key).orderBy(order)
    lv, t = F.col("level"), F.col("title")
    out = headings.withColumn("__gone", F.coalesce(bare_chapter(F.lag("title").over(w), F.lag("level").over(w)) & short_title(t, lv), F.lit(False)))
    merged = bare_chapter(t, lv) & F.coalesce(short_title(F.lead("title").over(w), F.lead("level").over(w)), F.lit(False))
    out = out.withColumn("title", F.when(merged, F.concat(t, F.lit(" "), F.lead("title").over(w))).otherwise(t))
    return out.filter(~F.col("__gone")).drop("__gone")


def carry_forward(rows: DataFrame, key, order, level: str = "level", title: str = "title") -> DataFrame:
    """Adds part .. subsubsection to every row: the last title of each level that no shallower heading came after; '' if none."""
    w = Window.partitionBy(*[col(k) for k in ([key] if isinstance(key, str) else key)]).orderBy(*[col(o) for o in ([order] if isinstance(order, str) else order)]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lv = F.when(F.col(level) > 5, 5).otherwise(F.col(level))
    out = {}
    for k, name in enumerate(LEVELS, start=1):
        last = F.last(F.when(lv <= k, F.struct(lv.alias("lv"), F.col(title).alias("t"))), ignorenulls=True).over(w)
        out[name] = F.when(last["lv"] == k, last["t"]).otherwise(F.lit(""))
    return rows.withColumns(out)


def section_path(*levels) -> Column:
    return F.array_join(F.filter(F.array(*[text_or_empty(c) for c in (levels or LEVELS)]), lambda x: x != ""), " > ")
