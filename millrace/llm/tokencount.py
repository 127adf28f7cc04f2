"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of fixed-width little-endian ids in which an end-of-document id closes each document; nothing says
where documents begin. Files are cut into blocks of a fixed number of ids. A block is searched for the separator with one
vectorised comparison and reduced to its documents that lie inside, the ids before its first separator (head) and after
its last (tail). A prefix scan over the blocks of a file stitches heads to the open ids before them and numbers the
documents. Blocks are read by range, so a file of any size is spread over tasks.

``write_tokens`` makes such files from texts with a public tokenizer, and a manifest of which document is the how-manieth
of which file. A file's name is its attempt's own, and the manifest is written by the same task, so a retried task leaves
no wrong pair, at most an orphan file.

Null text: no tokens, a document of length 0. Ids after the last separator are an unclosed document if there are any.
Empty files and tables: no documents. Repeated rows are documents of their own. Other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, put_file, small_batches, staged, tokenizer_dir, work_dir

EOD = 50256
BLOCK = 1 << 20


def encoding(ranks: bytes):
    """Byte-level BPE from the lines of a rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


#: Runs of white space from this length on go round the pre-tokenizer's pattern, which fails on them.
RUN = re.compile(r"[^\S\x1c-\x1f]{10000,}")


def ids_of(encode, whole_piece, text: str) -> list[int]:
    """A text's ids. Of a run of white space all but what stands before a word is one piece of the pattern, so long runs are encoded as that piece."""
    out, at = [], 0
    for m in RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            out += encode(text[at : m.start()])
        out += whole_piece(text[m.start() : end])
        at = end
    return out + encode(text[at:]) if at < len(text) else out


def rank_file(path: str | None = None) -> bytes:
    with open(path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken", "rb") as f:
        return f.read()


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, eod: int = EOD, file_tokens: int = 1 << 24, file_docs: int = 1 << 16) -> DataFrame:
    """Writes 16-bit token files under folder. Manifest: file, bytes, doc_ids (in the order of the file)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(rank_file(path))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import uuid

        coder = encoding(shared.value)
        ids, parts, n, id_kind = [], [], 0, None

        def close():
            uri = f"{folder}/{uuid.uuid4().hex}.u16"
            put_file(uri, parts)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([2 * n], pa.int64()), pa.array([ids], pa.list_(id_kind))], ["file", "bytes", "doc_ids"])

        for b in batches:
            id_kind = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = ids_of(coder.encode_ordinary, coder._encode_single_piece, text) if text else []
                tokens.append(eod)
                parts.append(np.array(tokens, "<u2").tobytes())
                ids.append(doc)
                n += len(tokens)
                if n >= file_tokens or len(ids) >= file_docs:
                    yield close()
                    ids, parts, n = [], [], 0
        if ids:
            yield close()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(run, f"file string, bytes long, doc_ids array<{id_type}>"), "token-manifest")


def scan(files: DataFrame, eod: int = EOD, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """files: (file, bytes). A row for each document: file, ordinal (from 0), n_tokens (without the separator)."""
    width = np.dtype(kind).itemsize
    files = files.filter("bytes > 0").withColumn("blocks", F.floor((F.col("bytes") - 1) / (block * width)) + 1)
    n = files.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    cores = files.sparkSession.sparkContext.defaultParallelism  # a row stands for a block, so tasks are counted by blocks
    blocks = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).repartition(int(max(1, n // 32, min(n, 4 * cores))), "file", "block")

    def run(batches):
        for b in batches:
            out = []
            for file, size, k in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "block")), strict=True):
                fs, path = open_fs(file)
                with fs.open_input_file(path) as f:
                    f.seek(k * block * width)
                    ids = np.frombuffer(f.read(min(block * width, size - k * block * width)), kind)
                at = np.flatnonzero(ids == eod)
                out.append((file, k, len(ids), len(at), int(at[0]) if len(at) else len(ids), len(ids) - int(at[-1]) - 1 if len(at) else len(ids), (k + 1) * block * width >= size, np.diff(at) - 1))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:6]], pa.array(cols[6]), pa.array(cols[7], pa.list_(pa.int64()))], ["file", "block", "n", "n_eod", "head", "tail", "last", "inner"])

    parts = blocks.mapInArrow(run, "file string, block long, n long, n_eod long, head long, tail long, last boolean, inner array<long>")
    return stitch(staged(parts, "token-blocks"))


def stitch(parts: DataFrame, group: int = 1024) -> DataFrame:
    """parts: a row for each block. The prefix scan has two levels, groups of blocks and blocks in a group, over a few numbers
    each; the documents' lengths stay where they are until every block knows what is before it."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def scanned(rows, order, closed):
        """seen, number and closed: ids, separators and the place after the last separator before each row, from the window's start."""
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("seen", F.coalesce(F.sum("n").over(before), zero)).withColumn("number", F.coalesce(F.sum("n_eod").over(before), zero))
        return rows.withColumn("ends", F.when(F.col("n_eod") > 0, F.col("seen") + closed)).withColumn("closed", F.max("ends").over(before))

    light = parts.drop("inner").withColumn("g", F.floor(F.col("block") / group))
    light = scanned(light, Window.partitionBy("file", "g").orderBy("block"), F.col("n") - F.col("tail"))
    groups = light.groupBy("file", "g").agg(F.sum("n").alias("n"), F.sum("n_eod").alias("n_eod"), F.max("ends").alias("upto"))
    groups = scanned(groups, Window.partitionBy("file").orderBy("g"), F.col("upto")).select("file", "g", F.col("seen").alias("seen0"), F.col("number").alias("number0"), F.col("closed").alias("closed0"))
    light = light.join(groups, ["file", "g"]).select("file", "block", (F.col("number0") + F.col("number")).alias("number"), (F.col("seen0") + F.col("seen") - F.coalesce(F.col("seen0") + F.col("closed"), F.col("closed0"), zero)).alias("held"))
    parts = parts.join(light, ["file", "block"])
    some = F.when(F.col("n_eod") > 0, F.concat(F.array(F.col("held") + F.col("head")), F.col("inner"))).otherwise(none)
    left = F.when(F.col("n_eod") > 0, F.col("tail")).otherwise(F.col("held") + F.col("n"))
    open_end = F.when(F.col("last") & (left > 0), F.array(left)).otherwise(none)
    return parts.select("file", "number", F.posexplode(F.concat(some, open_end)).alias("pos", "n_tokens")).select("file", (F.col("number") + F.col("pos")).alias("ordinal"), "n_tokens")


def token_files(spark, folder: str) -> DataFrame:
    """The files of a folder, without reading them."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def count_tokens(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens."""
    manifest = write_tokens(docs, work_dir(docs.sparkSession, "tokens"), path)
    found = scan(manifest.select("file", "bytes"), block=block)
    names = manifest.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return names.join(found.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")  # no side is bounded: packed, both look small
