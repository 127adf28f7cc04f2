"""Structure-aware chunking: blocks, typed paragraphs, continuations, packing, overlapping pieces, ids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, let, occurrences, strip, strip_end, text_or_empty
from .headings import LEVELS, carry_forward, markdown_heading, section_path
from .lines import explode_lines, is_table_line

#: Fixed value: the pattern of a numbered item's marker (12. or 3、), not a decimal.
MARKER = r"(?U)(?=\d)(?<![\d.])\d{1,2}[.．、](?!\d)"  # a digit is looked for first: most characters are none
MARKED = r"(?U)^\d{1,2}[.．、](?!\d)"
#: Words of explanatory text.
EXPLANATORY = (
    "位于", "起自", "止于", "作用", "功能", "组成", "分为", "包括", "表现", "症状",
    "诊断", "治疗", "适用于", "禁忌", "原因", "机制", "导致", "引起", "可见", "常见",
)
#: Fixed value: what ends a sentence.
SENTENCE_END = "。！？!?；;：:"
ALONE = ("table", "short_label_list", "numbered_item")


def line_class(line) -> Column:
    return F.when(markdown_heading(line).isNotNull(), "heading").when(is_table_line(line), "table").when(strip(line) == "", "blank").otherwise("paragraph")


def islands(rows: DataFrame, key, order, kind: str = "kind") -> DataFrame:
    """Adds island: numbers runs of one kind within key; every heading and blank is a run by itself."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind)) | F.col(kind).isin("blank", "heading")
    return rows.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("__new")


def split_numbered(text) -> Column:
    """The text cut before each marker: a prefix if there is one, then the items, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text_or_empty(text), r"(?U)(?=\d{1,2}[.．、](?!\d))(?<![\d.])", -1), strip), lambda x: x != "")


def n_markers(text) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(MARKER))


def without_number(item) -> Column:
    """Without the first marker, wherever it is."""
    t = text_or_empty(item)
    return strip(F.regexp_replace(t, r"(?U)^((?s:.*?))(?=\d)(?<![\d.])\d{1,2}[.．、](?!\d)\s*", "$1"))


def _kind_of(t: Column, items: Column) -> Column:
    mean = F.aggregate(items, F.lit(0.0), lambda s, x: s + F.length(without_number(x))) / F.size(items)
    marks = occurrences(t, "；") + occurrences(t, ";")
    hits = F.lit(0)
    for w in EXPLANATORY:
        hits = hits + occurrences(t, w)

    def judged(m):
        labels = (F.size(items) >= 3) & (m <= 28) & (marks >= F.greatest(F.lit(3), F.floor(F.size(items) / 2)))
        return F.when(labels, "short_label_list").when((m >= 45) | (hits >= 2), "explanatory").otherwise("none")

    return F.when((n_markers(t) < 2) | (F.size(items) < 2), "none").otherwise(let(mean, judged))


def list_kind(text) -> Column:
    """short_label_list, explanatory or none."""
    return let(text_or_empty(text), lambda t: let(split_numbered(t), lambda items: _kind_of(t, items)))


def numbered_list(text) -> Column:
    """struct(kind, items): ``list_kind`` and ``split_numbered`` with the text cut once."""
    return let(text_or_empty(text), lambda t: let(split_numbered(t), lambda items: F.struct(_kind_of(t, items).alias("kind"), items.alias("items"))))


def is_lone_item(text) -> Column:
    t = text_or_empty(text)
    body = without_number(t)
    return t.rlike(MARKED) & ((F.length(body) >= 24) | contains_any(body, EXPLANATORY))


def typed_parts(paragraph) -> Column:
    """array<struct(text, block_type)> of a paragraph."""

    def parts(t, items, kind):
        def one(block_type):
            return F.array(F.struct(t.alias("text"), F.lit(block_type).alias("block_type")))

        each = F.transform(items, lambda x: F.struct(x.alias("text"), F.when(x.rlike(MARKED), "numbered_item").otherwise("paragraph").alias("block_type")))
        return F.when((kind == "explanatory") & (F.size(items) >= 2), each).when(kind == "short_label_list", one("short_label_list")).when(is_lone_item(t), one("numbered_item")).otherwise(one("paragraph"))

    clean = strip(F.regexp_replace(F.regexp_replace(text_or_empty(paragraph), "[ \\t]+", " "), "\n+", "\n"))
    return let(clean, lambda t: let(split_numbered(t), lambda items: let(_kind_of(t, items), lambda kind: parts(t, items, kind))))


def parse_blocks(docs: DataFrame) -> DataFrame:
    """docs: (source_id, text). source_id, block_no, block_type, text, the five levels, section_path, line_start, line_end."""
    lines = explode_lines(docs).withColumn("line", strip_end("line"))
    lines = lines.withColumn("kind", line_class("line")).withColumn("h", markdown_heading("line")).select("source_id", "line_no", "line", "kind", "h.level", "h.title")
    lines = islands(carry_forward(lines, "source_id", "line_no"), "source_id", "line_no").filter(F.col("kind").isin("table", "paragraph"))
    shown = F.when(F.col("kind") == "table", F.col("line")).otherwise(strip("line"))
    runs = lines.withColumn("line", shown).groupBy("source_id", "island", "kind", *LEVELS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
    )
    parts = F.when(F.col("kind") == "table", F.array(F.struct(strip("body").alias("text"), F.lit("table").alias("block_type")))).otherwise(typed_parts("body"))
    out = runs.select("source_id", "island", *LEVELS, "line_start", "line_end", F.posexplode(parts).alias("part_no", "p"))
    out = out.select("source_id", "island", "part_no", F.col("p.text").alias("text"), F.col("p.block_type").alias("block_type"), *LEVELS, section_path().alias("section_path"), "line_start", "line_end").filter("text <> ''")
    return join_continuations(out, "source_id", ["island", "part_no"])


def continues(previous: Column, text: Column) -> Column:
    return (text != "") & ~text.rlike(MARKED) & ~previous.rlike(r"(?U)[。！？!?；;]\s*$")


def join_continuations(blocks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Paragraphs that go on a numbered item above become part of it. Adds block_no (from 0).
    Links are between neighbours only; a run of links is merged if its first block is a numbered item."""
    w = Window.partitionBy(key).orderBy(*order)
    link = (F.col("block_type") == "paragraph") & F.lag("block_type").over(w).isin("numbered_item", "paragraph") & (F.lag("section_path").over(w) == F.col("section_path"))
    link = link & (F.col("line_start") - F.lag("line_end").over(w) <= 4) & continues(F.lag("text").over(w), F.col("text"))
    b = blocks.withColumn("__link", F.coalesce(link, F.lit(False))).withColumn("__before", F.lag("text").over(w))
    b = b.withColumn("__run", F.sum((~F.col("__link")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = b.withColumn("__place", F.row_number().over(Window.partitionBy(key, "__run").orderBy(*order)))
    b = b.withColumn("__merged", F.first("block_type").over(Window.partitionBy(key, "__run").orderBy(*order)) == "numbered_item")
    b = b.withColumn("__group", F.when(F.col("__merged"), F.lit(1)).otherwise(F.col("__place")))
    close = F.col("__before").rlike("[一-鿿]$") & F.col("text").rlike("^[一-鿿]")
    piece = F.when((F.col("__place") == 1) | ~F.col("__merged"), F.col("text")).when(close, F.col("text")).otherwise(F.concat(F.lit(" "), F.regexp_replace("text", r"(?U)^\s+", "")))
    b = b.withColumn("__piece", piece)
    first = {c: F.min_by(c, "__place").alias(c) for c in blocks.columns if c not in (key, "text", "line_end")}
    out = b.groupBy(key, "__run", "__group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", "__piece"))), lambda x: x["__piece"]), "").alias("text"), F.max_by("line_end", "__place").alias("line_end"), *first.values())
    out = out.withColumn("block_no", F.row_number().over(Window.partitionBy(key).orderBy("__run", "__group")) - 1)
    return out.select(*blocks.columns, "block_no")


def group_numbers(lengths, alone, paths, max_chars: int, min_chars: int) -> list[int]:
    out, group, held, path, closed = [], -1, 0, None, True
    for n, by_itself, p in zip(lengths, alone, paths, strict=True):
        if by_itself or closed or p != path or held + n > max_chars or held >= min_chars:
            group, held = group + 1, 0
        held, path, closed = held + n, p, by_itself
        out.append(group)
    return out


def pack(blocks: DataFrame, key: str = "source_id", order: str = "block_no", max_chars: int = 1200, min_chars: int = 250) -> DataFrame:
    """Adds group_no (from 0): tables, label lists and numbered items stand alone; paragraphs of one section are gathered while
    the group holds less than min_chars and stays within max_chars. An ordered fold over a document's block lengths, without
    their texts: each step depends on the one before, so it is an Arrow function over arrays, linear in the blocks."""

    @F.pandas_udf("array<long>")
    def fold(n: pd.Series, alone: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([group_numbers(a, b, c, max_chars, min_chars) for a, b, c in zip(n, alone, paths, strict=True)])

    one = F.struct(F.col(order).cast("long").alias("o"), F.length("text").alias("n"), F.col("block_type").isin(*ALONE).alias("alone"), F.col("section_path").alias("p"))
    docs = blocks.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("b"))
    groups = docs.select(key, F.arrays_zip(F.col("b.o").alias("o"), fold("b.n", "b.alone", "b.p").alias("g")).alias("z")).select(key, F.inline("z")).toDF(key, "__o", "group_no")
    return blocks.withColumn("__o", F.col(order).cast("long")).join(groups, [key, "__o"]).drop("__o")


_END = re.compile(rf"(?s)^.*[{SENTENCE_END}]\s{{0,3}}")


def cut_points(text: str, size: int = 1200, overlap: int = 150) -> list[tuple[int, int]]:
    """(start, end) of the pieces: an end is the last sentence end in the second half of the piece, else the full size."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        hard = min(start + size, len(text))
        end = hard
        if hard < len(text):
            low = min(start + max(1, (hard - start) // 2), hard)
            m = _END.match(text[max(0, low - 3) : hard])
            if m and max(0, low - 3) + m.end() > low:
                end = max(0, low - 3) + m.end()
        out.append((start, end))
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def split_overlap(text, size: int = 1200, overlap: int = 150) -> Column:
    """array<string> of a text's overlapping pieces, stripped, blanks dropped (a short text as it is)."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [t] if len(t) <= size else [p for a, b in cut_points(t, size, overlap) if (p := t[a:b].strip())])

    return cut(F.col(text) if isinstance(text, str) else text)


def search_text(doc_type, stem, path, body) -> Column:
    """The body under the header lines whose values are there."""
    def line(name, v):
        return F.when(text_or_empty(v) != "", F.concat(F.lit(f"{name}："), text_or_empty(v)))

    head = F.concat_ws("\n", line("文档类型", doc_type), line("书名", stem), line("章节路径", path))
    return F.concat(head, F.lit("\n正文："), text_or_empty(body))


def stem_of(path) -> Column:
    name = F.regexp_extract(text_or_empty(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def chunk_id(source_id, index, text) -> Column:
    key = F.concat_ws("\n", text_or_empty(source_id), index.cast("string"), F.substring(text_or_empty(text), 1, 200))
    return F.concat_ws(":", stem_of(source_id), index.cast("string"), F.substring(F.sha1(key), 1, 16))


def build_chunks(docs: DataFrame, doc_type: str = "", max_chars: int = 1200, overlap: int = 150, min_chars: int = 250) -> DataFrame:
    """docs: (source_id, text). The chunk records, with nested metadata."""
    blocks = pack(parse_blocks(docs), max_chars=max_chars, min_chars=min_chars)
    first = {c: F.min_by(c, "block_no").alias(c) for c in (*LEVELS, "section_path", "line_start")}
    groups = blocks.groupBy("source_id", "group_no").agg(
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n")).alias("text"),
        F.when(F.count("*") > 1, "paragraph_group").otherwise(F.min("block_type")).alias("block_type"), F.max_by("line_end", "block_no").alias("line_end"), *first.values(),
    ).filter("text <> ''")
    pieces = groups.withColumn("pieces", split_overlap("text", max_chars, overlap)).withColumn("piece_count", F.size("pieces"))
    rows = pieces.select("*", F.posexplode("pieces").alias("piece_index", "piece")).withColumn("answer_text", strip("piece"))
    index = (F.row_number().over(Window.partitionBy("source_id").orderBy("group_no", "piece_index")) - 1).cast("int")
    rows = rows.withColumn("chunk_index", index).withColumn("source_file", F.regexp_extract("source_id", r"([^/]*)$", 1)).withColumn("source_stem", stem_of("source_id")).withColumn("doc_type", F.lit(doc_type))
    rows = rows.withColumn("chunk_id", chunk_id("source_id", F.col("chunk_index"), "answer_text")).withColumn("search_text", search_text("doc_type", "source_stem", "section_path", "answer_text"))
    meta = F.struct("doc_type", "source_id", "source_file", "source_stem", *LEVELS, "section_path", "block_type", "line_start", "line_end", "piece_index", "piece_count")
    return rows.select("chunk_id", "chunk_index", "source_id", "source_file", "source_stem", "doc_type", F.col("section_path").alias("section"), "answer_text", "search_text", meta.alias("metadata"))
