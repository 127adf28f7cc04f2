"""Web pages: HTML to text, context of cached pages, links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text_or_empty

SKIPPED = ("script", "style", "noscript", "svg")
#: The entities that pages use most.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Fixed value: what stands between pages of a context.
DIVIDER = "\n-------------分割线--------------\n"


def html_to_text(html) -> Column:
    """Text nodes on lines of their own, stripped, without blank lines or the subtrees of SKIPPED. Patterns only: no Python."""
    t = text_or_empty(html)
    for tag in SKIPPED:
        t = F.regexp_replace(t, f"(?is)<{tag}\\b.*?</{tag}\\s*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", "\n"), r"(?s)<[^>]*>", "\n")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "[\r\n]+", -1), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def text_of_html(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(x for line in "\n".join(p.parts).splitlines() if (x := line.strip()))


def parse_html(html) -> Column:
    """The same with a real parser, all entities and broken markup: the slow, exact form."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(text_of_html)

    return run(html)


def cached_pages(pages: DataFrame, order: str, name: str = "title", max_docs: int = 6, max_chars: int = 2500) -> DataFrame:
    """pages: (name, html, order). The first max_docs by name (equal names: the page written last, which is the largest order), then without empty
    ones: name, text cut to max_chars."""
    names = pages.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).limit(max_docs)  # before any html moves
    first = pages.join(F.broadcast(names), name).groupBy(name).agg(F.max_by("html", order).alias("html"))
    return first.withColumn("text", html_to_text("html")).filter("text <> ''").select(name, F.substring("text", 1, max_chars).alias("text"))


def context_of(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row: the texts in order, with dividers."""
    return docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), DIVIDER).alias("context"))


def without_fragment(url) -> Column:
    return F.split_part(text_or_empty(url), F.lit("#"), F.lit(1))


def host_of(url) -> Column:
    return F.regexp_extract(text_or_empty(url), "^[a-z]+://([^/?#]*)", 1)


def top_links(pages: DataFrame, group: Column, order: str, n: int = 3) -> DataFrame:
    """The first n pages of each group, their addresses without fragments."""
    ranked = pages.withColumn("grp", group).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(order)))
    return ranked.filter(F.col("rank") <= n).withColumn("link", without_fragment("url"))


def markdown_link(title, url) -> Column:
    return F.concat(F.lit("["), text_or_empty(title), F.lit("]("), text_or_empty(url), F.lit(")"))


def sub_questions(question) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(question), "[;；]", -1), strip), lambda x: x != "")
