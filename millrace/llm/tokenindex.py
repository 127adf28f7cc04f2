"""Token ids on disk with keyed access: raw id shards and a minimal perfect hash index from document keys to their places.

Write. Rows are range partitioned and sorted by doc_id; each partition is one shard, a file of nothing but ids
(little-endian, 16 or 32 bits), the end id after each document. Texts are encoded in chunks of a megabyte, cut where the
tokenizer cuts anyway, so no text is held as tokens. A shard's name is its attempt's own, and what stands in it is told by
the rows of the same task, so a retried task leaves no wrong pair, at most an orphan file.

Index. A key is (doc_id, copy), copy counting the rows of one doc_id from 0 in their order, so a doc_id that a third of
all rows have is as many keys, not one. Keys are dealt by hash to index files. In each, levels of bit arrays give every key
a number below the count of keys: a key that shares its bit with none at a level stays there, the others go on to the next,
and a bit's rank over all levels is the number (``perfect_hash``). The record of that number holds a 32-bit fingerprint of the key,
shard, offset, length, the place among all ids and how many copies there are. A lookup touches one bit a level (1.6 levels on average), one
rank and one record, however large the index is. A key that isn't in it is told by its fingerprint, but for one in 2^32.

Read. Looked-up places are sorted by shard and offset, neighbours are read in one request of bounded size.

Null text: empty, a document of the end id alone. Null doc_id: a key like any other, after all others. Rows of one doc_id
are copies in the order of their text's hash; equal rows can't be told apart. Empty table: no shard, and every
lookup is empty. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_fs, put_file, session_of, small_batches, staged, tokenizer_dir, work_dir
from .pieces import chunks, packed_ids

EOD = 2
#: Text bytes a shard, keys an index file, rows of one id in a run, ids read at once.
SHARD_BYTES, INDEX_KEYS, RUN, READ = 1 << 25, 1 << 16, 4096, 1 << 20
RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8"), ("start", "<u8"), ("copies", "<u8")])
LEVELS = 64


def bpe_file(path: str | None = None) -> str:
    with open(path or f"{tokenizer_dir()}/byte_bpe_50k.json", encoding="utf-8") as f:
        return f.read()


def write_shards(docs: DataFrame, folder: str, path: str | None = None, eod: int = EOD, width: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards. Returns their runs, staged: shard, file, run (its number in the shard), doc_id, offsets and lengths (in ids, the end id
    counted) of consecutive rows of one doc_id, at most RUN."""
    spark = session_of(docs)
    small_batches(spark)
    config = spark.sparkContext.broadcast(bpe_file(path))
    id_type, kind = docs.schema["doc_id"].dataType, {2: "H", 4: "I"}[width]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(spark.sparkContext.defaultParallelism, size // shard_bytes + 1))
    # equal rows are told apart by nothing, so any order of them is the same; the last key only spreads many of them over shards
    rows = rows.withColumn("k", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id() % 1021)
    rows = rows.repartitionByRange(parts, F.asc_nulls_last("doc_id"), "k", "spread").sortWithinPartitions(F.asc_nulls_last("doc_id"), "k").select("doc_id", "text")

    def run(batches):
        kept, end = _kept(config.value, kind), np.array([eod], f"<u{width}").tobytes()
        shard, fs, out, at, n_runs, last = TaskContext.get().partitionId(), None, None, 0, 0, None
        for b in batches:
            runs = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if out is None:
                    uri = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.ids"
                    fs, name = open_fs(uri)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name)
                n = width
                for chunk in chunks(text or ""):
                    if chunk:
                        ids = b"".join(kept.of(chunk))
                        out.write(ids)
                        n += len(ids)
                out.write(end)
                n //= width
                if not runs or last != (doc,) or len(runs[-1][2]) >= RUN:
                    runs.append((n_runs, doc, [], []))
                    n_runs += 1
                runs[-1][2].append(at)
                runs[-1][3].append(n)
                last, at = (doc,), at + n
            if runs:
                c = list(zip(*runs, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(runs), pa.int32()), pa.array([uri] * len(runs)), pa.array(c[0], pa.int64()), pa.array(c[1], b.column("doc_id").type), pa.array(c[2], pa.list_(pa.int64())), pa.array(c[3], pa.list_(pa.int64()))],
                    ["shard", "file", "run", "doc_id", "offsets", "lengths"],
                )
        if out is not None:
            out.close()

    return staged(rows.mapInArrow(run, f"shard int, file string, run long, doc_id {id_type.simpleString()}, offsets array<long>, lengths array<long>"), "token-runs")


_KEPT: dict = {}


def _kept(config: str, code: str):
    """A Python worker's pieces outlive its tasks."""
    if (key := (hash(config), code)) not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = packed_ids(config, code)
    return _KEPT[key]


def _mix(k1: np.ndarray, k2: np.ndarray, level: int) -> np.ndarray:
    x = k1 + k2 * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def perfect_hash(k1: np.ndarray, k2: np.ndarray, gamma: float = 2.0) -> tuple[list[int], np.ndarray]:
    """Bits of each level, and all levels' bits as bytes, of which the set ones number the keys (uint64 pairs, no two equal)."""
    sizes, parts = [], []
    while len(k1):
        if len(sizes) == LEVELS:
            raise ValueError("equal keys have no perfect hash")
        size = max(64, -(-int(gamma * len(k1)) // 64) * 64)
        spot = (_mix(k1, k2, len(sizes)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(spot, minlength=size) == 1
        sizes.append(size)
        parts.append(np.packbits(bits))
        left = ~bits[spot]
        k1, k2 = k1[left], k2[left]
    return sizes, np.concatenate(parts) if parts else np.empty(0, np.uint8)


class PerfectHash:
    """Numbers of keys by a bit a level and a rank."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        words = np.bitwise_count(bits.reshape(-1, 8)).sum(axis=1)
        self.rank = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)  # set bits before each word of 64

    def __call__(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """-1 for a key that meets no set bit; any other key that was never put in gets some number."""
        out, left, start = np.full(len(k1), -1), np.arange(len(k1)), 0
        for level, size in enumerate(self.sizes):
            spot = start + (_mix(k1[left], k2[left], level) % np.uint64(size)).astype(np.int64)
            word = self.bits.reshape(-1, 8)[spot >> 6]
            inner = np.unpackbits(word, axis=1)
            at = spot & 63
            hit = inner[np.arange(len(at)), at] == 1
            before = np.where(np.arange(64) < at[:, None], inner, 0).sum(axis=1)
            out[left[hit]] = (self.rank[spot >> 6] + before)[hit]
            left, start = left[~hit], start + size
        return out


def fingerprint(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return (_mix(k2, k1, LEVELS) >> np.uint64(32)).astype(np.uint32)


def _uint64(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _numbered(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its key, and the shards with the ids before them."""
    shards = runs.groupBy("shard").agg(F.first("file").alias("file"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = staged(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), "token-shards")
    same, order = Window.partitionBy("doc_id"), ("shard", "run")  # rows of RUN documents each
    w = runs.withColumn("m", F.size("lengths").cast("long"))
    w = w.withColumn("seen", F.coalesce(F.sum("m").over(same.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).withColumn("copies", F.sum("m").over(same))
    docs = w.select("doc_id", "shard", "seen", "copies", F.posexplode(F.arrays_zip("offsets", "lengths")).alias("i", "p")).select("doc_id", (F.col("seen") + F.col("i")).alias("copy"), "copies", "shard", F.col("p.offsets").alias("offset"), F.col("p.lengths").alias("n"))
    return docs.join(shards.select("shard", "base"), "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base"), shards


def keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """rows: (doc_id, copy, ...) with their key's 128 bits and its index file's number."""
    return rows.withColumn("k1", F.xxhash64("doc_id", "copy")).withColumn("k2", F.xxhash64(F.lit(7), "copy", "doc_id")).withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int"))


class TokenIndex:
    """Shards and index files of a folder, and what reads them."""

    def __init__(self, shards: DataFrame, files: DataFrame, buckets: int, width: int, id_type: str):
        self.shards, self.files, self.buckets, self.width, self.id_type = shards, files, buckets, width, id_type

    def find(self, keys: DataFrame) -> DataFrame:
        """keys: (doc_id). The places of all their documents: doc_id, copy, copies, shard, offset, n, start. Keys that aren't there: no row."""
        first = staged(self._probe(keys.select("doc_id").distinct().withColumn("copy", F.lit(0).cast("long"))), "token-places")
        more = first.filter("copies > 1").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 2) / RUN))).alias("part"), "copies")
        more = more.repartition(self.buckets, "doc_id", "part").select("doc_id", F.explode(F.sequence(F.col("part") * RUN + 1, F.least(F.col("copies") - 1, (F.col("part") + 1) * RUN))).alias("copy"))
        return first.unionByName(self._probe(more))

    def _probe(self, keys: DataFrame) -> DataFrame:
        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows and right.num_rows:
                hash_of, records = read_index(right["file"][0].as_py())
                k1, k2 = _uint64(left["k1"]), _uint64(left["k2"])
                slot = hash_of(k1, k2)
                there = slot >= 0
                there[there] = records["fingerprint"][slot[there]] == fingerprint(k1, k2)[there]
                found, hits = left.filter(pa.array(there)), records[slot[there]]
            else:
                found, hits = left.slice(0, 0), np.empty(0, RECORD)
            return pa.table({"doc_id": found["doc_id"], "copy": found["copy"], **{c: pa.array(hits[c].astype(np.int64)) for c in ("copies", "shard", "offset", "n", "start")}})

        left = keyed(keys.select("doc_id", "copy"), self.buckets).groupBy("bucket")
        return left.cogroup(self.files.groupBy("bucket")).applyInArrow(probe, f"doc_id {self.id_type}, copy long, copies long, shard long, offset long, n long, start long")

    def _read(self, places: DataFrame, take, schema: str, names: list[str]) -> DataFrame:
        """take(one document's parts of ids, in order) -> a tuple of values."""
        width = self.width
        spread = places.withColumn("slice", F.floor(F.col("offset") / (READ * 8)))
        tasks = max(1, self.shards.count())  # a row for each shard
        rows = spread.join(self.shards.select(F.col("shard").cast("long").alias("shard"), "file"), "shard").repartition(tasks, "shard", "slice").sortWithinPartitions("shard", "offset").drop("slice")

        def run(batches):
            held_name, f, low, block = None, None, 0, b""
            for b in batches:
                made = []
                for file, offset, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "n")), strict=True):
                    if file != held_name:
                        fs, path = open_fs(file)
                        if f is not None:
                            f.close()
                        held_name, f, block = file, fs.open_input_file(path), b""

                    def parts(offset=offset, n=n):
                        nonlocal low, block
                        at = offset
                        while at < offset + n:
                            if not low <= at * width < low + len(block):
                                f.seek(at * width)
                                low, block = at * width, f.read(READ * width)
                                if not block:
                                    raise OSError(f"{held_name} ends before id {at}")
                            piece = block[at * width - low : (offset + n) * width - low]
                            yield np.frombuffer(piece, f"<u{width}")
                            at += len(piece) // width

                    made.append(take(parts()))
                if made:
                    keep = [b.column(c) for c in b.schema.names if c != "file"]
                    cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(keep + cols, [c for c in b.schema.names if c != "file"] + names)
            if f is not None:
                f.close()

        kinds = [pa.list_(pa.int64()) if "array" in s else pa.int64() for s in schema.split(",")]
        return rows.mapInArrow(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema if c.name != "file") + ", " + schema)

    def ids(self, keys: DataFrame) -> DataFrame:
        """keys: (doc_id). Each document's ids, the end id included: doc_id, copy, start, ids."""
        return self._read(self.find(keys), lambda parts: (np.concatenate(list(parts)).tolist(),), "ids array<long>", ["ids"]).select("doc_id", "copy", "start", "ids")

    def checksums(self, keys: DataFrame) -> DataFrame:
        """keys: (doc_id). doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

        def take(parts):
            crc = 0
            for p in parts:
                crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
            return (crc,)

        return self._read(self.find(keys), take, "ids_crc32 long", ["ids_crc32"]).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")


def read_index(uri: str) -> tuple[PerfectHash, np.ndarray]:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        data = f.read()
    n, levels = np.frombuffer(data, "<u8", 2)
    sizes = np.frombuffer(data, "<u8", int(levels), 16).astype(np.int64).tolist()
    at, total = 16 + 8 * int(levels), sum(sizes) // 8
    return PerfectHash(sizes, np.frombuffer(data, np.uint8, total, at)), np.frombuffer(data, RECORD, int(n), at + total)


def build_index(documents: DataFrame, folder: str, buckets: int) -> DataFrame:
    """documents: (doc_id, copy, copies, shard, offset, n, start). Writes the index files; bucket, file of each, staged."""

    def build(key, t):
        k1, k2 = _uint64(t["k1"]), _uint64(t["k2"])
        sizes, bits = perfect_hash(k1, k2)
        records = np.zeros(len(k1), RECORD)
        rows = np.zeros(len(k1), RECORD)
        rows["fingerprint"] = fingerprint(k1, k2)
        for c in ("shard", "offset", "n", "start", "copies"):
            rows[c] = t[c].to_numpy()
        records[PerfectHash(sizes, bits)(k1, k2)] = rows
        uri = f"{folder}/{key[0].as_py():06d}-{uuid.uuid4().hex}.idx"
        put_file(uri, [np.array([len(k1), len(sizes), *sizes], "<u8").tobytes(), bits.tobytes(), records.tobytes()])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "file": [uri]})

    return staged(keyed(documents, buckets).drop("doc_id", "copy").groupBy("bucket").applyInArrow(build, "bucket int, file string"), "token-index")


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, eod: int = EOD, width: int = 2, shard_bytes: int = SHARD_BYTES, index_keys: int = INDEX_KEYS) -> TokenIndex:
    """Encodes, writes shards and index under folder (one of its own unless given), and opens them."""
    spark: SparkSession = session_of(docs)
    folder = folder or work_dir(spark, "token-index")
    runs = write_shards(docs, folder, path, eod, width, shard_bytes)
    documents, shards = _numbered(runs)
    n = runs.agg(F.sum(F.size("lengths"))).first()[0] or 0
    buckets = int(max(min(n, 2 * spark.sparkContext.defaultParallelism), -(-n // index_keys), 1))
    return TokenIndex(shards, build_index(documents, folder, buckets), buckets, width, docs.schema["doc_id"].dataType.simpleString())


def query(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back by its key."""
    return write_tokens(docs).checksums(docs)
