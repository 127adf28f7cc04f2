"""Web search as a source. The engine is a plug-in, since it needs a network: a function from a query to (url, title, status, html)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.html import html_to_text, without_fragment

Result = tuple[str, str, int, str]


def search_pages(queries: DataFrame, engines: dict[str, Callable[[], Callable[[str], Iterable[Result]]]], n: int = 3) -> DataFrame:
    """queries: (id, query). id, engine, rank, url, title, html of the first n pages of each query and engine that came with status 200,
    addresses without fragments, each once. A call that fails gives no rows. Engines are made once per batch."""
    out = None
    for name, make in engines.items():
        rows = queries.filter(F.trim("query") != "").select("id", F.lit(name).alias("engine"), F.posexplode(_fetched("query", make)).alias("pos", "r")).select("id", "engine", "pos", "r.*")
        out = rows if out is None else out.unionByName(rows)
    found = out.filter("status = 200").withColumn("url", without_fragment("url"))
    once = found.groupBy("id", "engine", "url").agg(F.min_by(F.struct("pos", "title", "html"), "pos").alias("p")).select("id", "engine", "url", "p.*")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("id", "engine").orderBy("pos")))
    return ranked.filter(F.col("rank") <= n).select("id", "engine", "rank", "url", "title", "html")


def _fetched(query: str, make) -> Column:
    @F.pandas_udf("array<struct<url:string,title:string,status:int,html:string>>")
    def run(parts: pd.Series) -> pd.Series:
        fetch = make()

        def one(q):
            try:
                return [dict(zip(("url", "title", "status", "html"), r, strict=True)) for r in fetch(q)]
            except Exception:
                return []

        return parts.map(one)

    return run(F.col(query))


def page_texts(pages: DataFrame, order: str, max_docs: int = 6, max_chars: int = 2500) -> DataFrame:
    """pages: (id, title, html, order). Per id the first max_docs by title (equal titles: the last by order), then without empty ones, cut."""
    named = pages.groupBy("id", "title").agg(F.max_by("html", order).alias("html"))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("title"))).filter(F.col("n") <= max_docs)
    return first.withColumn("text", html_to_text("html")).filter("text <> ''").select("id", "title", F.substring("text", 1, max_chars).alias("text"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """The cache of a request: what an earlier one left goes."""
    pages.write.mode("overwrite").parquet(folder)
