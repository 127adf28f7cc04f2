"""What the training-data operators share: work folder, staged tables, small helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of at most so many rows, so that a Python worker holds few long texts at once.
BATCH_ROWS = 512


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under spark.checkpoint.dir, else under the checkpoint folder that was set, else (a
    local master) an own one, else under the warehouse."""
    conf, given = spark.sparkContext.getConf(), spark.sparkContext._jsc.sc().getCheckpointDir()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not base and conf.get("spark.master", "").split("[")[0] == "local":
        base = work_dir.own = getattr(work_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="millrace-")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/millrace-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoints"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = session_of(df)
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, *without: str) -> Column:
    """All columns but some as one struct, so that no name of theirs can clash."""
    return F.struct(*[named(c).alias(c) for c in docs.columns if c not in without]).alias("row")


def unpacked(docs: DataFrame) -> list[Column]:
    """docs' columns out of the struct."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def doc_keys(*columns: Column) -> tuple[Column, Column]:
    """k1, k2: 128 bits over some columns. Rows equal in them are one document."""
    return F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(7), *reversed(columns)).alias("k2")


def hot_keys(counts: DataFrame, key: str, total: int, share: int = 1000, least: int = 1 << 10) -> list[int]:
    """counts: (key, n). The keys that hold a share-th of the total or more: at most ``share`` longs, whatever the data."""
    return [r[0] for r in counts.filter(F.col("n") >= max(least, total // share)).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, hot: list[int], how: str = "inner", by: tuple[str, ...] = ("k1", "k2")) -> DataFrame:
    """left join right on key, of which right has one row each. Rows of hot keys are dealt over all partitions by a hash of ``by``."""
    if not hot:
        return left.join(right, key, how)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(key).isin(hot)
    left = left.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(parts))).otherwise(0).cast("int"))
    right = right.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "salt"], how).drop("salt")


#: Bits of a Bloom filter a key, and at most (a 32 MB broadcast); hash functions.
BITS, MOST_BITS, HASHES = 16, 1 << 28, 3


def _spots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    k = keys.view(np.uint64)
    for x in (k, k >> np.uint64(32), (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)):
        yield (x & np.uint64(bits - 1)).astype(np.int64)


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of hashes (longs): built in parts on the executors, merged by part. Its size follows the number of
    keys up to a bound; beyond it more keys pass falsely."""
    part = 1 << 19
    bits = min(MOST_BITS, max(part, 1 << (BITS * keys.count()).bit_length()))
    name = keys.columns[0]

    def run(batches):
        found = [np.empty(0, np.int64)]
        for b in batches:
            found += [np.unique(s) for s in _spots(b.column(name).to_numpy(zero_copy_only=False).astype(np.int64), bits)]
            if sum(map(len, found)) > 1 << 22:
                found = [np.unique(np.concatenate(found))]
        spots = np.unique(np.concatenate(found))
        for p in np.unique(spots // part):
            row = np.zeros(part, np.uint8)
            row[spots[spots // part == p] - p * part] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([zlib.compress(np.packbits(row).tobytes(), 1)], pa.binary())], ["part", "bits"])

    def merge(key, rows):
        out = np.zeros(part // 8, np.uint8)
        for x in rows["bits"].to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(run, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter holds (or seems to)."""
    out = np.ones(len(keys), bool)
    for spot in _spots(np.ascontiguousarray(keys), 8 * len(bitmap)):
        out &= (bitmap[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def tokenizer_dir() -> str:
    return os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")


def open_fs(uri: str):
    """(file system, path) for a URI of the shared folder, for raw bytes that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else ("file://" + uri.removeprefix("file:") if uri.startswith(("/", "file:")) else uri))


def put_file(uri: str, data) -> None:
    """Writes a whole file under a name of its own attempt, then moves it into place."""
    fs, path = open_fs(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(tmp) as out:
        for piece in data:
            out.write(piece)
    fs.move(tmp, path)


def highest(counts: DataFrame, most: int) -> DataFrame | None:
    """The rows of the highest c, at most ``most``: all those over a threshold read from a histogram of a few hundred rows."""
    bins = sorted(((r["b"], r["n"], r["low"]) for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()), reverse=True)
    total, threshold = 0, None
    for _, n, low in bins:
        if total + n > most:
            break
        total, threshold = total + n, low
    return None if threshold is None else counts.filter(F.col("c") >= threshold)


def gathered(batches, rows: int):
    """Arrow batches of few small rows as tables of at least so many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
