"""Connected components over an edge table by alternating large-star and small-star steps.

Each step is a min per node (partially aggregated) and an equi-join, so no neighbourhood is ever gathered in one row. The
edges of each round go to the checkpoint folder. The number of rounds grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), any order, repeats allowed. Returns (node, root) for each node that isn't its own root; root is the smallest node."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a")
        e = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().checkpoint()
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
