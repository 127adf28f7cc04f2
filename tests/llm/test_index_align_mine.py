"""Keyed token files, alignment of tokenizers and hard negatives against brute-force versions on awkward rows."""

import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, hardneg, pieces, queries, tokenindex

LETTERS = [*"ab'stREvelmd 1 2 \n\t\r\x0b\x1c\x85\xa0　 é日́\x00<|>,.;)", "<|endoftext|>", "<s>", "<0x41>", "  ", "▁", "'ll", " ", " ", "\n", "\n"]


@pytest.fixture(scope="module")
def a():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def b():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_ids_of_pieces_are_those_of_the_text(a, b):
    config = tokenindex.bpe_file()
    kept = pieces.packed_ids(config, "H")
    aligner = alignment.Aligner(config, open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for text in odd_texts(4000):
        a.encode_special_tokens = False
        assert np.frombuffer(b"".join(kept.of(text)), "<u2").tolist() == a.encode(text, add_special_tokens=False).ids
        if text and "▁" not in text:
            a.encode_special_tokens = True
            cut = pieces.CUT.split(" " + text)
            assert [i for ids in aligner.a(cut) for i in ids] == a.encode(" " + text, add_special_tokens=False).ids
            assert [i for ids in aligner.b(cut) for i in ids] == b.encode(text)


def test_chunks_make_the_text():
    for text in [*odd_texts(200, 2), "", "x" * 50, "a b " * 100, " " * 90 + "x"]:
        got = list(pieces.chunks(text, 7))
        assert "".join(got) == text
        assert [p for c in got for p in pieces.CUT.split(c) if p] == [p for p in pieces.CUT.split(text) if p]


# Token index.


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        k1, k2 = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in "ab")
        k1[: n // 3] = 7  # keys that share half their bits
        sizes, bits = tokenindex.perfect_hash(k1, k2)
        assert sorted(tokenindex.PerfectHash(sizes, bits)(k1, k2).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        tokenindex.perfect_hash(np.ones(2, np.uint64), np.ones(2, np.uint64))


def plain_index(rows, a):
    """rows: (doc_id, text). Documents by ascending id, nulls last; those of one id by lengths and sums, since their order is by a hash."""
    a.encode_special_tokens = False
    return [(d, [*a.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in sorted(rows, key=lambda r: (True,) if r[0] is None else (False, r[0]))]


def test_token_index(spark, edge, a):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{edge}/documents.parquet").to_pylist()]
    got = queries.QUERIES["op12_token_index"](spark, edge)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = got.collect()
    want, starts = collections.defaultdict(list), {}
    at = 0
    for d, ids in plain_index(rows, a):
        want[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        starts.setdefault(d, at)
        at += len(ids)
    have = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        have[r.doc_id].append((r.n_tokens, r.ids_crc32))
        assert r.start == starts[r.doc_id] + sum(n for n, _ in have[r.doc_id][:-1])
    assert {d: sorted(x) for d, x in have.items()} == {d: sorted(x) for d, x in want.items()}


def test_token_index_with_many_copies_of_a_key_and_keys_that_are_absent(spark, a):
    rows = [(5, f"copy {i % 7}") for i in range(9000)] + [(i, "one two three " * i) for i in range(40)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = tokenindex.write_tokens(docs, shard_bytes=20_000, index_keys=1000)
    want = collections.Counter(tuple(ids) for d, ids in plain_index(rows, a) if d == 5)
    keys = spark.createDataFrame([(5,), (5,), (77,), (-1,)], "doc_id long")
    got = index.ids(keys).collect()
    assert {r.doc_id for r in got} == {5} and collections.Counter(tuple(r.ids) for r in got) == want
    assert sorted(r["copy"] for r in got) == list(range(9001))
    assert index.shards.count() > 3
    every = index.checksums(docs)
    assert every.count() == len(rows) and every.agg(F.sum("n_tokens")).first()[0] == sum(len(x) for _, x in plain_index(rows, a))
    assert every.select("start").distinct().count() == len(rows)


def test_token_index_of_long_and_unbroken_texts_and_text_keys(spark, a):
    rows = [("a", " " * 300_000), ("b", "x" * 300_000), ("c", "word, " * 400_000), ("", "\n" * 1000), (None, "end")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.ids for r in tokenindex.write_tokens(docs, width=4).ids(docs).collect()}
    assert got == dict(plain_index([(d, t) for d, t in rows if d is not None], a)) | {None: [*a.encode("end").ids, 2]}


# Alignment.


def bytes_of_a(config):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}
    return {i: bytes(of[c] for c in e) for e, i in config["model"]["vocab"].items()}


def plain_alignment(rows, a, b, weight="occurrences"):
    a.encode_special_tokens = True
    table = bytes_of_a(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))))
    per, links = [], collections.Counter()
    for d, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        x = [table[i] for i in ids_a]
        y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        raw = b"" if not text else (" " + text).encode()
        if b"".join(x) != raw or b"".join(y) != raw or not raw:
            per.append((d, 0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in x]).tolist(), np.cumsum([len(p) for p in y]).tolist()
        groups, own = [], []
        low_a = low_b = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end), ends_b.index(end)
            groups.append((tuple(ids_a[low_a : i + 1]), tuple(ids_b[low_b : j + 1])))
            own.append((ids_a[i], ids_b[j]))
            low_a, low_b = i + 1, j + 1
        per.append((d, len(ids_a), len(ids_b), groups, own))
        if weight == "occurrences":
            links.update(own)
        else:
            links.update([(g[0][-1], g[1][-1]) for g in set(groups)])
    highest = collections.Counter()
    for (_, y), n in links.items():
        highest[y] = max(highest[y], n)
    out = []
    for d, n_a, n_b, groups, own in per:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((d, n_a, n_b, len(groups), len(own), sum(links[p] == highest[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, links


def test_alignment(spark, edge, a, b):
    rows = [(r["doc_id"], (r["text"] or "")[:20_000] if r["text"] is not None else None) for r in pq.read_table(f"{edge}/documents.parquet").to_pylist()]
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts(120, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("groups", F.lit(1))
    for weight in ("occurrences", "documents"):
        want, links = plain_alignment(rows, a, b, weight)
        got = alignment.align(docs, weight=weight, block=3000)
        have = got.documents()
        assert have.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert collections.Counter(tuple(r) for r in have.collect()) == collections.Counter(want)
        assert {(r.a, r.b): r["count"] for r in got.pairs.collect()} == dict(links)


def test_alignment_query(spark, edge, a, b):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{edge}/documents.parquet").to_pylist() if len(r["text"] or "") < 50_000]
    got = queries.QUERIES["op11_token_alignment"](spark, edge).filter("n_a < 10000")
    docs = {d: (n_a, n_b, n_groups, sha) for d, n_a, n_b, n_groups, _, _, _, sha in plain_alignment(rows, a, b)[0]}
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.groups_sha256) for r in got.collect()} == docs


# Hard negatives.


def plain_negatives(rows, digits=256):
    r = []
    for i, x, label in rows:
        if i is None or label is None or x is None or not x or any(c is None or c != c or abs(c) == float("inf") for c in x):
            continue
        v = tuple(int(c * digits // 1) for c in x)
        if sum(c * c for c in v) < 1 << 56:
            r.append((i, (label + 1) % 10 if i % 7 == 0 else label, v))
    dims = collections.Counter(len(v) for _, _, v in r)
    r = [x for x in set(r) if len(x[2]) == min(dims, key=lambda d: (-dims[d], d))]
    out = []
    for i, label, v in r:
        if i % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w in r if j != i)
        for p, j, m in [x for x in s if x[2] == label][:5]:
            top = [(n, k) for n, k, o in s if o != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(top)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))


def some_vectors(n=700, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, np.round(rng.normal(size=dim) + 0.7, 2).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    return rows + [(n + i, [1.0] * dim, i % 2) for i in range(200)]  # copies of one vector


def test_hard_negatives(spark):
    rows = some_vectors() + [(None, [1.0] * 5, 1), (50, None, 1), (60, [1.0, None, 1.0, 1.0, 1.0], 1), (61, [float("nan")] * 5, 1), (62, [float("inf")] * 5, 1), (63, [1e300] * 5, 1), (64, [1.0] * 5, None), (65, [1.0] * 4, 1), (66, [], 1), (100, [1.5] * 5, 2), some_vectors()[3]]
    want = plain_negatives(rows)
    assert len({p for _, _, _, _, p, _ in want}) > 20
    for block in (1 << 24, 200):
        got = hardneg.mine(vectors(spark, rows).repartition(7), "id % 50 = 0", F.expr(hardneg.SHIFTED), block_bytes=block)
        assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)


def test_hard_negatives_beyond_double_precision(spark):
    rows = [(i, [(c + i % 3 / 256) * 30_000.0 + 1 / 256 for c in x], label) for i, x, label in some_vectors(200, 3, 5)]
    assert max(sum(int(c * 256 // 1) ** 2 for c in x) for _, x, _ in rows) > 1 << 44
    rows.append((350, [600_000.0 + 3 / 256] * 3, 1))  # a squared length over 2^53
    assert sum(int(c * 256 // 1) ** 2 for c in rows[-1][1]) >= 1 << 53
    got = hardneg.mine(vectors(spark, rows), "id % 50 = 0", F.expr(hardneg.SHIFTED))
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(plain_negatives(rows))


def test_hard_negatives_against_sql(spark, tmp_path):
    rows = some_vectors(400, 6, 9)
    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}), tmp_path / "embeddings.parquet")
    got = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    cur = con.execute(queries.SQL["op13_hard_negatives"])
    assert [c[0] for c in cur.description] == got.columns
    want = cur.fetchall()
    assert want and collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
