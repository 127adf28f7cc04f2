"""Texts to vectors by an encoder that each task makes once, and encoders without a model for tests and plain searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(texts: Column, make_encoder: Callable[[], Callable[[list[str]], tuple[list, list]]]) -> Column:
    """struct(vector, sparse_vector) of texts through an encoder that each task makes once: list of texts -> (dense, sparse)."""

    @F.pandas_udf("struct<vector:array<float>,sparse_vector:map<int,double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for s in parts:
            dense, sparse = encoder([x or "" for x in s])
            yield pd.DataFrame({"vector": dense, "sparse_vector": [{int(k): float(v) for k, v in m.items() if v > 0} for m in sparse]})

    return run(texts)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_encoder():
    """How often a text has each letter, and no sparse vector: a stand-in for a learned encoder whose results can be told in SQL."""

    def run(texts):
        return [[float(t.count(c) + t.count(c.upper())) for c in LETTERS] for t in texts], [{} for _ in texts]

    return run


def lexical_encoder(dim: int = 64):
    """A deterministic stand-in for a learned encoder, for tests: hashed word counts, scaled to length one."""
    import math
    import zlib

    def run(texts):
        dense, sparse = [], []
        for t in texts:
            v, m = [0.0] * dim, {}
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0
                m[h & 0x7FFFFFFF] = m.get(h & 0x7FFFFFFF, 0.0) + 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            dense.append([x / n for x in v])
            sparse.append(m)
        return dense, sparse

    return run
