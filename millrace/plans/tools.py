"""Tools by intent, and clients that call out. What calls a model or a network is a plug-in: off unless one is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import LETTERS, encode, letter_encoder, lexical_encoder  # noqa: F401
from ..operators import evidence, routing


class Tools:
    """Functions (questions -> answers, both DataFrames) by name; a question goes to the tool of its intent."""

    def __init__(self):
        self._of: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, tool: Callable[[DataFrame], DataFrame]) -> None:
        if name not in routing.TOOLS.values():
            raise KeyError(f"no intent leads to {name}")
        self._of[name] = tool

    def answer(self, questions: DataFrame) -> DataFrame:
        """questions: (id, question, has_image, model_label). id, tool, answer; an intent without a tool gives null."""
        routed = questions.withColumn("code", routing.code_of(routing.intent_label("question", F.col("has_image"), F.col("model_label"))))
        routed = routed.withColumn("tool", routing.tool_of(F.col("code")))
        out = routed.filter(~F.col("tool").isin(*self._of)).select("id", "tool", F.lit(None).cast("string").alias("answer"))
        for name, tool in self._of.items():
            mine = routed.filter(F.col("tool") == name)
            out = out.unionByName(mine.join(tool(mine.select("id", "question")), "id", "left").select("id", "tool", "answer"))
        return out


def complete(prompts: Column, make_client: Callable[[], Callable[[str], str]]) -> Column:
    """Prompts through a client that each task makes once; a failed call gives null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()

        def one(p):
            try:
                return None if p is None else client(p)
            except Exception:
                return None

        for s in parts:
            yield s.map(one)

    return run(prompts)


def retrieval_tool(search: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """search: (id, question) -> (id, rank, text). The prompt over what it finds; nothing found is an empty context."""

    def tool(questions: DataFrame) -> DataFrame:
        hits = search(questions).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
        return questions.join(hits, "id", "left").select("id", evidence.answer_prompt("question", "context").alias("answer"))

    return tool
