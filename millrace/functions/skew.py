"""Joins in which one key may hold a large share of a side's rows; small files with much work a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most so many keys are; and from so many rows on.
SHARE, LEAST = 1000, 1 << 10


def hot_keys(rows: DataFrame, key: str) -> list:
    """At most SHARE keys, whatever the data: counted with map-side combining."""
    counts = rows.groupBy(key).count()
    total = rows.count()
    return [r[0] for r in counts.filter(F.col("count") >= max(LEAST, -(-total // SHARE))).select(key).collect() if r[0] is not None]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by their keys. A file of one row group is one task, however much work a row takes after it."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def spread_join(many: DataFrame, few: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """many join few on key. Rows of a hot key are dealt by their other columns over all partitions, and few's rows of it are copied to each."""
    if not hot:
        return many.join(few, key, how)
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(key).isin(hot)
    dealt = F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.lit(parts)).cast("int")
    many = many.withColumn("__salt", F.when(is_hot, dealt).otherwise(0))
    few = few.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(few, [key, "__salt"], how).drop("__salt")
