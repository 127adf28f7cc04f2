"""Chat history as message lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "You are a helpful assistant."


def messages(turns: DataFrame, system: str = SYSTEM, key: str = "conv_id") -> DataFrame:
    """turns: (conv_id, turn, role, text). key, messages: the system's word first, then users' and assistants' turns in order."""
    rows = turns.filter(F.col("role").isin("user", "assistant"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return rows.groupBy(key).agg(said.alias("said")).select(key, F.concat(first, "said").alias("messages"))
