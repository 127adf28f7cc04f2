"""Book Markdown cleaning, and rendering of parsed document elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .headings import carry_forward, detect_heading, merge_chapter_titles, merged_titles
from .lines import body_lines, explode_lines, finish_markdown, is_empty_heading, is_table_line, normalize_line, normalize_spaces, without_images


def clean_lines(docs: DataFrame, keep_front_matter: bool = False) -> DataFrame:
    """docs: (source_id, text). source_id, line_no, line ('' for blank ones), level, title, page of the body's lines."""
    lines = explode_lines(docs)
    if not keep_front_matter:
        lines = body_lines(lines)
    def heading(line):
        return F.struct(line.alias("line"), F.when(~is_table_line(line), detect_heading(line)).alias("h"))

    def cleaned(plain):  # of one line, so that each pattern runs once; nothing for an empty heading or images alone
        bare = let(without_images(plain), lambda b: F.when(is_table_line(b), b).otherwise(normalize_spaces(b)))
        return F.transform(F.filter(F.array(bare), lambda x: ~is_empty_heading(plain) & ((plain == "") | (x != ""))), heading)

    return lines.select("source_id", "line_no", F.explode(let(normalize_line("line"), cleaned)).alias("x")).select("source_id", "line_no", "x.line", "x.h.level", "x.h.title", "x.h.page")


def heading_records(lines: DataFrame) -> DataFrame:
    """A row for each heading of the cleaned lines, chapter titles merged: level, heading, the five levels, page, line_no."""
    heads = merge_chapter_titles(lines.filter("level is not null"), "source_id", "line_no")
    return carry_forward(heads, "source_id", "line_no").select("source_id", F.col("level").alias("heading_level"), F.col("title").alias("heading"), "part", "chapter", "section", "subsection", "subsubsection", "page", "line_no")


def clean_markdown(docs: DataFrame, keep_front_matter: bool = False) -> DataFrame:
    """source_id, text: headings rewritten at their level between blank lines; a body line is never lost to a merged title."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line", "level", "title")))
    whole = clean_lines(docs, keep_front_matter).groupBy("source_id").agg(lines.alias("x"))

    def text(lines):
        def row(line, out):
            return F.struct(line["line_no"].alias("line_no"), out.alias("out"))

        heads = merged_titles(F.filter(lines, lambda x: x["level"].isNotNull()))
        heads = F.transform(heads, lambda h: row(h, F.concat(F.lit("\n"), F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"], F.lit("\n"))))
        body = F.transform(F.filter(lines, lambda x: x["level"].isNull()), lambda x: row(x, x["line"]))
        return F.array_join(F.transform(F.array_sort(F.concat(heads, body)), lambda x: x["out"]), "\n")

    return whole.select("source_id", finish_markdown(text(F.col("x"))).alias("text"))


def render_elements(elements: DataFrame, key: str = "source_id", order: str = "element_no") -> DataFrame:
    """elements: (key, order, category, text) of a parsed file. Its Markdown, number of elements, characters, and a map of categories."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "[ \\t]+", " "), "\n{3,}", "\n\n")
    rows = elements.withColumn("text", F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    before = F.lag("category").over(Window.partitionBy(key).orderBy(order))
    plain = F.when(before.isNotNull() & (before != F.col("category")), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    shown = F.when(F.col("category").isin("Title", "Header"), F.concat(F.lit("## "), "text")).when(F.col("category") == "ListItem", F.concat(F.lit("- "), "text")).when(F.col("category") == "Table", F.col("text")).otherwise(plain)
    rows = rows.withColumn("__shown", shown)
    counts = category_counts(rows, key)
    whole = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__shown"))), lambda x: x["__shown"]), "\n").alias("body"), F.count("*").alias("elements"), F.sum(F.length("text")).alias("text_chars"))
    return whole.select(key, finish_markdown(F.concat(F.lit("# "), F.col(key).cast("string"), F.lit("\n\n"), F.col("body"))).alias("markdown"), "elements", "text_chars").join(counts, key)


def category_counts(rows: DataFrame, key: str, category: str = "category") -> DataFrame:
    n = rows.groupBy(key, category).count()
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "count")))).alias("categories"))
