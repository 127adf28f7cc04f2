"""Long runs of white space in token counts, and vectors whose squares over- or underflow."""

import random
import re

import numpy as np

from millrace.llm import ann, tokencount


def test_long_white_space_has_the_pattern_s_ids(monkeypatch):
    coder = tokencount.encoding(tokencount.rank_file())
    run = tokencount.RUN.pattern
    monkeypatch.setattr(tokencount, "RUN", re.compile(run.replace("10000", "3")))
    rng = random.Random(1)
    letters = [*"ab's 1 2 \n\t\r\x0b\x1c\x1d\x85\xa0　é日.,", "   ", "    \n", "\n\n\n", " ", " "]
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert tokencount.ids_of(coder.encode_ordinary, coder._encode_single_piece, text) == coder.encode_ordinary(text)


def test_counts_of_millions_of_spaces(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 5_000_000 + "b"), (2, "\n" * 1_000_000), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs).collect()}
    coder = tokencount.encoding(tokencount.rank_file())
    assert got == {1: 2 + len(coder._encode_single_piece(" " * 4_999_999)), 2: len(coder._encode_single_piece("\n" * 1_000_000)), 3: 2}


def test_cosines_of_extreme_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1.0, 0.1]), (3, [1e-200, 1e-200]), (4, [1e200, 0.0]), (5, [-1e-308, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    order = [r.vec_id for r in sorted(got, key=lambda r: r["rank"])]
    assert set(order[:2]) == {1, 3} and order[2:] == [2, 4, 5]  # the first two differ in a last digit
    exact = {1: 1.0, 3: 1.0, 2: 1.1 / (2**0.5 * 1.01**0.5), 4: 0.5**0.5, 5: -(0.5**0.5)}
    assert all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in got)
    x = np.random.default_rng(1).normal(size=(50, 8))
    assert (ann.cosines(x[0], x) == (x * x[0]).sum(axis=1) / (np.sqrt((x[0] * x[0]).sum()) * np.sqrt((x * x).sum(axis=1)))).all()
