"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments of about ``segment_tokens`` words, whole documents each. A segment is one row of
the index: its documents with their word counts, its terms, and per term the sorted positions (delta-coded, compressed)
in the segment's own position space, in which documents are one position apart. The index holds every word of every text
and is stored once, in the shared folder.

A search takes the test windows in blocks of bounded size, and stores a block's hits before it takes the next. Windows hang on
their rarest word among the block's; a segment looks at those whose word it has. A window's posting lists are taken from
the rarest of the segment on, shifted by the term's offset, and intersected until empty or exhausted. Segments are independent;
a hot passage or term is spread over as many segments as its documents.

Words: A-Z lower-cased, runs of characters outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``. Null text has no words and no
windows. Items shorter than the window are one window. Empty tables give no hits. Repeated documents are reported each;
repeated item ids count once. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_keys, packed, small_batches, staged, unpacked

WINDOW = 10
_TABLE = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _squeeze(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b)


def _open(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def _pack(a: np.ndarray) -> bytes:
    return _squeeze(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_open(b), kind)


def build_index(docs: DataFrame, segment_tokens: int = 1 << 20) -> DataFrame:
    """A row for each segment: segment, doc_ids, n_words, starts, terms, counts, postings."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: segments(batches, segment_tokens), f"segment long, doc_ids array<{id_type}>, n_words array<long>, starts binary, terms binary, counts binary, postings binary")


def segments(batches, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``build_index``. A document's words become numbers as it is read: no more than its own are held as words."""
    ids, parts, local, total, id_kind = [], [], defaultdict(itertools.count().__next__), 0, None

    def segment():
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.concatenate(parts)
        at = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(size), dtype=np.int32), size)  # a gap after each document
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        deltas = np.diff(at, prepend=np.int32(0))
        deltas[first] = at[first]
        row = [[uuid.uuid4().int >> 65], [ids], [size], [_pack(np.cumsum(size + 1) - size - 1)], [_squeeze(b"\n".join(local))], [_pack(np.diff(first, append=len(codes)).astype(np.int32))], [_pack(deltas)]]
        kinds = [pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], COLUMNS)

    for b in batches:
        id_kind = b.column("doc_id").type
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            words = words_of(text.as_py())
            parts.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            total += len(words) + 1
            if total >= segment_tokens:
                yield segment()
                ids, parts, local, total = [], [], defaultdict(itertools.count().__next__), 0
    if ids:
        yield segment()


COLUMNS = ["segment", "doc_ids", "n_words", "starts", "terms", "counts", "postings"]


class Segment:
    """A segment's postings in memory. Terms are numbered in the order of their list."""

    def __init__(self, row: dict):
        self.starts, self.lens = _unpack(row["starts"], np.int64), np.array(row["n_words"], np.int64)
        names = _open(row["terms"])
        self.terms = dict(zip(names.split(b"\n"), itertools.count(), strict=False)) if names else {}
        counts = _unpack(row["counts"], np.int32)
        self._to = np.cumsum(counts, dtype=np.int64)
        self._from, self._deltas = self._to - counts, _unpack(row["postings"], np.int32)
        self._lists: dict[bytes, np.ndarray] = {}

    def count(self, term: bytes) -> int:
        k = self.terms.get(term)
        return 0 if k is None else int(self._to[k] - self._from[k])

    def positions(self, term: bytes) -> np.ndarray:
        found = self._lists.get(term)
        if found is None:
            k = self.terms.get(term)
            found = self._lists[term] = np.empty(0, np.int64) if k is None else np.cumsum(self._deltas[self._from[k] : self._to[k]], dtype=np.int64)
        return found

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the terms stand in this order, one after the other."""
        counts = [self.count(t) for t in terms]
        order = sorted(range(len(terms)), key=counts.__getitem__)
        if not terms or not counts[order[0]]:
            return np.empty(0, np.int64)
        at = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            there = self.positions(terms[k])
            spot = np.searchsorted(there, at + k)
            at = at[(spot < len(there)) & (there[np.minimum(spot, len(there) - 1)] == at + k)]
        return at

    def proximity(self, terms: tuple[bytes, ...], span: int) -> np.ndarray:
        """Positions of the rarest term around which every other term stands within span words, in the same document."""
        distinct = sorted(set(terms), key=lambda t: (self.count(t), t))
        if not distinct or not self.count(distinct[0]):
            return np.empty(0, np.int64)
        at = self.positions(distinct[0])
        doc = np.searchsorted(self.starts, at, side="right") - 1
        low, high = np.maximum(at - span, self.starts[doc]), np.minimum(at + span, self.starts[doc] + self.lens[doc] - 1)
        live = np.ones(len(at), bool)
        for t in distinct[1:]:
            there = self.positions(t)
            live &= np.searchsorted(there, low) < np.searchsorted(there, high, side="right")
        return at[live]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in blocks of about block_words words; one block at a time is on the driver."""
    block, n = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        if words := words_of(r["text"]):
            block.append((r["item_id"], words))
            n += len(words)
            if n >= block_words:
                yield block
                block, n = [], 0
    if block:
        yield block


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


HITS = "segment long, ord int, spans array<struct<s:long,e:long>>, items array<string>"


def search(index: DataFrame, block: list[tuple[str, list[bytes]]], window: int = WINDOW, span: int | None = None) -> DataFrame:
    """Documents with a window of a block's items: segment, ord (place in it), spans (words that are hit), items.
    With span, proximity matches instead: all words of a window within span words of its rarest; the hit word is that one."""
    of: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in block:
        for w in windows_of(words, window):
            of.setdefault(w, set()).add(item)
    often = Counter(t for w in of for t in set(w))
    hung: dict[bytes, list] = {}
    for w, ids in of.items():
        hung.setdefault(min(w, key=lambda t: (often[t], t)), []).append((w, ids))
    asked = index.sparkSession.sparkContext.broadcast(hung)

    def run(batches):
        hung = asked.value
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                seg = Segment(row)
                marks: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                here = hung.keys() & seg.terms.keys()
                for phrase, ids in (x for t in here for x in hung[t]):
                    at = seg.phrase(phrase) if span is None else seg.proximity(phrase, span)
                    if not len(at):
                        continue
                    width = len(phrase) if span is None else 1
                    docs = seg.doc_of(at)
                    for d, s in zip(docs.tolist(), (at - seg.starts[docs]).tolist(), strict=True):
                        marks.setdefault(d, []).append((s, s + width))
                        items.setdefault(d, set()).update(ids)
                merged = {d: _union(v) for d, v in marks.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(merged), pa.int64()), pa.array(list(merged), pa.int32()), pa.array([[{"s": s, "e": e} for s, e in v] for v in merged.values()], kind), pa.array([sorted(x for x in items[d] if x is not None) for d in merged], pa.list_(pa.string()))],
                    ["segment", "ord", "spans", "items"],
                )

    return index.select("segment", "n_words", "starts", "terms", "counts", "postings").mapInArrow(run, HITS)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None, segment_tokens: int = 1 << 20, block_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), of every document."""
    index = staged(build_index(docs, segment_tokens), "positions")
    table = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ord", "d")).select("segment", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    found = None
    for block in item_blocks(items, block_words):
        hits = staged(search(index, block, window, span), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return table.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = found.groupBy("segment", "ord").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.expr("aggregate(spans, struct(0L as n, 0L as upto), (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.upto)) as n, greatest(a.upto, x.e) as upto), a -> a.n)")
    found = found.select("segment", "ord", covered.alias("n_hit"), "items")
    return table.join(found, ["segment", "ord"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows without a hit, in their own columns."""
    keyed = docs.select(packed(docs), "text", F.struct(*doc_keys(F.col("doc_id"), F.col("text"))).alias("key"))
    hit = contamination(keyed.select(F.col("key").alias("doc_id"), "text"), items, **options).filter("n_hit > 0").select(F.col("doc_id").alias("key"))
    return keyed.join(hit, "key", "left_anti").select(*unpacked(docs))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
        FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
        FROM (SELECT d.*, lens.n, unnest(range(1, len(w) - lens.n + 2)) AS i FROM d, lens WHERE len(w) >= lens.n)),
hit AS (SELECT occ.r, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.n = win.n AND occ.p = win.p),
spots AS (SELECT r, COUNT(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
ids AS (SELECT r, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN ids USING (r)
"""
