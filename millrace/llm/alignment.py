"""Alignment of two tokenizers over a corpus by a dictionary of groups.

A text with a space before it is encoded by A (byte-level BPE) and the text by B (sentence pieces, which add that space). Byte
offsets at which a token of either ends cut the tokens into groups; a group is written as its ids, ``a1,a2|b1``. As every token
has at least one byte, the tokens of a group whose byte ranges end together are its last of A and its last of B: one link a group.

First pass. Texts are cut where both tokenizers cut anyway (``pieces``), so a piece is encoded and aligned once by a worker
for all its places. Texts go in blocks of bounded size; a block is one row: its documents' results, its distinct groups
(interned, numbered within the block) with their occurrences and documents, and each document's groups as numbers. It is
written once. Dictionary. Distinct groups of all blocks are summed by key (combined before the shuffle), their links expanded
once, and weighed by the group's occurrences or by the documents that hold it; from these come the counts of id pairs and the
highest count of each B id. Back. What a group is worth goes by its key to the blocks that hold it, and each block adds up
its documents. No row is made for a link's occurrences or for a document's group.

Null and empty texts, and texts whose joined A or B bytes differ from space and text (such as those with U+2581): no tokens,
zeros and an empty groups column. Repeated rows count as often as they are there. A long text is taken in chunks; only
its numbers (8 bytes a piece) are held whole. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of, small_batches, staged, tokenizer_dir
from .pieces import CUT, byte_bpe_batch, chunks

#: Characters of text in a block.
BLOCK = 1 << 23
MARK = "▁"


def byte_table(config: str) -> list[bytes]:
    """Bytes of A's ids: entries of a byte-level vocabulary, in which printable bytes stand for themselves and the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    parsed = json.loads(config)
    vocab = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return out


def piece_table(model) -> list[bytes]:
    """Bytes of B's ids."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


class Aligner:
    """Groups of pieces by both tokenizers, many pieces at once."""

    def __init__(self, config: str, proto: bytes):
        import sentencepiece

        self.a = byte_bpe_batch(config, plain=True)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.a_bytes, self.b_bytes = byte_table(config), piece_table(self.model)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        n, m = range(len(self.a_bytes)), range(len(self.b_bytes))
        #: Ids as text, each with what follows it: A's within and at the end of a group's A ids, then B's.
        self.written = pa.array([f"{i}{end}" for ids, ends in ((n, ",|"), (m, ",;")) for end in ends for i in ids])

    def b(self, pieces: list[str]) -> list[list[int]]:
        """A piece that begins with a line feed has no word mark of its own."""
        out = self.model.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1)
        return [ids if p[:1] == " " or not ids or self.b_bytes[ids[0]] != b" " else ids[1:] for p, ids in zip(pieces, out, strict=True)]

    def align(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, list[str]]:
        """Of each piece whether its bytes are those of its tokens, the numbers of A and B tokens and of groups; all groups in order, each with a
        closing semicolon; and each piece's groups joined."""
        a, b, raw = self.a(pieces), self.b(pieces), [p.encode() for p in pieces]
        ok = np.array([b"".join([self.a_bytes[i] for i in x]) == r and b"".join([self.b_bytes[i] for i in y]) == r for x, y, r in zip(a, b, raw, strict=True)], bool)
        n_a, n_b = (np.where(ok, np.fromiter(map(len, x), np.int64, len(x)), 0) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x[k] for k in np.flatnonzero(ok).tolist()), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])  # within all pieces' bytes, so a piece's end is common
        last_a, last_b = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a, ends_a[np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + upto_b[group_a]] = ids_a + len(self.a_size) * last_a
        order[np.arange(len(ids_b)) + (upto_a[group_b] if len(upto_a) else 0)] = ids_b + 2 * len(self.a_size) + len(self.b_size) * last_b
        text = self.written.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1) if len(text) else np.zeros(1, np.int32)
        stops = at[upto_a + upto_b[1:]]
        n_groups = np.zeros(len(pieces), np.int64)
        np.add.at(n_groups, np.repeat(np.arange(len(pieces)), n_a)[last_a], 1)
        by_piece = at[np.cumsum(n_a + n_b)]
        return ok, n_a, n_b, n_groups, _slices(text, stops), _slices(text, by_piece).to_pylist()


def _slices(text: pa.Array, stops: np.ndarray) -> pa.Array:
    """The characters of consecutive strings, cut anew: no copy."""
    if not len(text):
        return pa.array([""] * len(stops), pa.string())
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    return pa.StringArray.from_buffers(len(stops), pa.py_buffer(offsets), text.buffers()[2])


class Grown:
    """Whole numbers that are appended to."""

    def __init__(self):
        self.held, self.n = np.empty(1 << 10, np.int64), 0

    def add(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Interned:
    """Pieces and groups by numbers, which hold until ``fresh``."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.fresh()

    def fresh(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: dict[str, int] = {}
        self.joined: list[str] = []
        self.ok, self.n_a, self.n_b, self.n_groups, self.of = (Grown() for _ in range(5))  # of: all pieces' groups in order

    def add(self, pieces: list[str]) -> None:
        ok, n_a, n_b, n_groups, groups, joined = self.aligner.align(pieces)
        found = groups.dictionary_encode()
        numbers = np.array([self.groups.setdefault(g, len(self.groups)) for g in found.dictionary.to_pylist()], np.int64)
        self.number.update((p, len(self.joined) + i) for i, p in enumerate(pieces))
        self.joined += joined
        for kept, x in ((self.ok, ok), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.of, numbers[found.indices.to_numpy()] if len(groups) else np.empty(0, np.int64))):
            kept.add(x)


_WORKERS: dict = {}


def _worker(config: str, proto: bytes) -> Interned:
    """A Python worker's pieces outlive its tasks."""
    if (key := hash((config, proto))) not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Interned(Aligner(config, proto))
    return _WORKERS[key]


DOCUMENT = "n_a: bigint, n_b: bigint, n_groups: bigint, sha: string"
#: Pieces or groups after which a worker starts anew, at the end of a block; characters whose new pieces are aligned together.
MOST, TOGETHER = 1 << 19, 1 << 20


class Block:
    """Documents of a block as they are taken."""

    def __init__(self, own: Interned):
        self.own, self.size = own, 0
        self.ids, self.waiting, self.waits = [], [], 0  # waiting: (document, pieces of a chunk)
        self.sha: dict = {}
        self.docs, self.numbers = [], []  # a document and the numbers of pieces, of each chunk

    def take(self, doc_id, text: str | None) -> None:
        self.size += len(text or "") + 64
        for chunk in chunks(" " + text) if text else ():
            self.waiting.append((len(self.ids), CUT.split(chunk)))
            self.waits += len(chunk)
            if self.waits >= TOGETHER:
                self.settle()
        self.ids.append(doc_id)

    def settle(self) -> None:
        """Pieces that wait become numbers, and their groups part of their documents' digests."""
        own = self.own
        if new := list({p for _, parts in self.waiting for p in parts if p not in own.number}):
            own.add(new)
        for doc, parts in self.waiting:
            numbers = np.fromiter(map(own.number.__getitem__, parts), np.int64, len(parts))
            self.docs.append(doc)
            self.numbers.append(numbers)
            if doc in self.sha:
                self.sha[doc].update(b";")
            self.sha.setdefault(doc, hashlib.sha256()).update("".join([own.joined[k] for k in numbers.tolist()])[:-1].encode())
        self.waiting, self.waits = [], 0

    def row(self, number: int, id_type) -> pa.RecordBatch:
        self.settle()
        own, n = self.own, len(self.ids)
        docs = np.repeat(np.array(self.docs, np.int64), np.array([len(x) for x in self.numbers], np.int64))
        numbers = np.concatenate(self.numbers) if self.numbers else np.empty(0, np.int64)
        good = np.bincount(docs, 1 - own.ok.all()[numbers], n) == 0
        docs, numbers = docs[good[docs]], numbers[good[docs]]
        n_a, n_b, n_groups = (np.bincount(docs, x.all()[numbers], n).astype(np.int64) for x in (own.n_a, own.n_b, own.n_groups))
        pair, times = np.unique(docs * len(own.joined) + numbers, return_counts=True)  # a document's pieces
        docs, numbers = np.divmod(pair, max(1, len(own.joined)))
        size = own.n_groups.all()[numbers]
        start = (np.cumsum(own.n_groups.all()) - own.n_groups.all())[numbers]
        groups = own.of.all()[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)]
        pair, back = np.unique(np.repeat(docs, size) * max(1, len(own.groups)) + groups, return_inverse=True)  # a document's groups
        times = np.bincount(back, np.repeat(times, size), len(pair)).astype(np.int64)
        docs, groups = np.divmod(pair, max(1, len(own.groups)))
        used, at = np.unique(groups, return_inverse=True)
        names = list(own.groups)
        sha = [self.sha[i].hexdigest() if g and i in self.sha else "" for i, g in enumerate(good.tolist())]
        rows = pa.StructArray.from_arrays([pa.array(self.ids, id_type), *[pa.array(x) for x in (n_a, n_b, n_groups)], pa.array(sha, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "sha"])
        occurrences, holding = np.bincount(at, times, len(used)).astype(np.int64), np.bincount(at, minlength=len(used)).astype(np.int64)
        lists = [rows, pa.array([names[g][:-1] for g in used.tolist()], pa.string()), pa.array(occurrences), pa.array(holding), pa.array(np.bincount(docs, minlength=n), pa.int32()), pa.array(at, pa.int32()), pa.array(times, pa.int32())]
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *one], ["block", "docs", "groups", "occurrences", "documents", "pairs", "at", "n"])


class Alignment:
    """A corpus in blocks of aligned documents, and what follows from its dictionary of groups."""

    def __init__(self, blocks: DataFrame, weight: str, id_type: str):
        self.blocks, self.id_type = blocks, id_type
        self.parts = blocks.select("block", F.posexplode(F.arrays_zip("groups", weight)).alias("i", "g")).select("block", "i", F.col("g.groups").alias("group"), F.col(f"g.{weight}").alias("weight"))
        last = F.substring_index("group", ",", -1)
        words = self.parts.groupBy("group").agg(F.sum("weight").alias("weight"))
        #: Distinct groups: group, weight, a and b (the ids its link holds).
        self.groups = staged(words.select("group", "weight", F.substring_index(F.substring_index("group", "|", 1), ",", -1).cast("int").alias("a"), F.substring_index(last, "|", -1).cast("int").alias("b")), "groups")
        pairs = self.groups.groupBy("a", "b").agg(F.sum("weight").alias("count"))
        #: Linked id pairs: a, b, count, best (the count is the highest of its B id).
        self.pairs = staged(pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))), "id-pairs")

    def documents(self) -> DataFrame:
        worth = self.groups.join(self.pairs, ["a", "b"]).select("group", "count", "best")
        worth = self.parts.select("block", "i", "group").join(worth, "group").groupBy("block").agg(F.collect_list(F.struct("i", "count", "best")).alias("worth"))
        both = self.blocks.select("block", "docs", "pairs", "at", "n").join(worth, "block", "left")

        def add(batches):
            for b in batches:
                for docs, pairs, at, n, found in zip(*(b.column(c) for c in ("docs", "pairs", "at", "n", "worth")), strict=True):
                    docs, pairs, at, n = docs.values, pairs.values.to_numpy(), at.values.to_numpy(), n.values.to_numpy().astype(np.int64)
                    count, best = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64), np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
                    if found.is_valid and len(count):
                        w = found.values
                        i = w.field("i").to_numpy()
                        count[i], best[i] = w.field("count").to_numpy(), w.field("best").cast(pa.int64()).to_numpy()
                    upto = np.concatenate([[0], np.cumsum(pairs)])
                    sums = [np.concatenate([[0], np.cumsum(n * x[at])]) for x in (best, count)]
                    n_groups = docs.field("n_groups")
                    yield pa.RecordBatch.from_arrays(
                        [docs.field("doc_id"), docs.field("n_a"), docs.field("n_b"), n_groups, n_groups, *[pa.array(s[upto[1:]] - s[upto[:-1]]) for s in sums], docs.field("sha")],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                    )

        return both.mapInArrow(add, f"doc_id {self.id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, weight: str = "occurrences", block: int = BLOCK) -> Alignment:
    """weight: what a group's links count for, its ``occurrences`` or the ``documents`` that hold it."""
    spark = session_of(docs)
    small_batches(spark)
    with open(a_path or f"{tokenizer_dir()}/byte_bpe_50k.json", encoding="utf-8") as f, open(b_path or f"{tokenizer_dir()}/piece_bpe_32k.model", "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, number, held, kind = _worker(*files.value), TaskContext.get().partitionId() << 32, None, None
        for b in batches:
            kind = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                if held is None:
                    if len(own.joined) > MOST or len(own.groups) > MOST:
                        own.fresh()
                    held = Block(own)
                held.take(doc.as_py(), text.as_py())
                if held.size >= block:
                    yield held.row(number, kind)
                    number, held = number + 1, None
        if held is not None:
            yield held.row(number, kind)

    schema = f"block long, docs array<struct<doc_id: {id_type}, {DOCUMENT}>>, groups array<string>, occurrences array<long>, documents array<long>, pairs array<int>, at array<int>, n array<int>"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return Alignment(staged(rows.mapInArrow(run, schema), "aligned-blocks"), weight, id_type)


def query(docs: DataFrame) -> DataFrame:
    return align(docs).documents()
