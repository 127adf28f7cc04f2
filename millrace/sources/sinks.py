"""Sinks: chunk files, cleaned Markdown, catalog, and a table that is upserted by key."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import text_or_empty
from .readers import exists


#: Characters of a file, and records of a catalog document, at about which the next begins.
FILE_CHARS, DOCUMENT_RECORDS = 1 << 27, 1 << 14


def in_order(rows: DataFrame, keys: list, chars: Column, file_chars: int = FILE_CHARS) -> DataFrame:
    """Rows by keys over as many partitions as their characters need: files written from it are in order one after the other, and of bounded size
    however many or few sources there are. Names of files follow the order."""
    total = rows.agg(F.sum(chars)).first()[0] or 0
    return rows.repartitionByRange(int(total // file_chars) + 1, *keys).sortWithinPartitions(*keys)


def write_chunks(chunks: DataFrame, folder: str, file_chars: int = FILE_CHARS) -> None:
    """JSON lines in the order of sources and their chunks; a large source goes on in the next file."""
    size = F.length(F.coalesce("answer_text", F.lit(""))) + F.length(F.coalesce("search_text", F.lit(""))) + 500
    in_order(chunks, ["source_id", "chunk_index"], size, file_chars).write.mode("overwrite").json(folder)


def write_markdown(docs: DataFrame, folder: str, file_chars: int = FILE_CHARS) -> None:
    """docs: (source_id, text). JSON lines (source_id, text) in the order of sources."""
    text = F.regexp_replace(text_or_empty("text"), "\n$", "")
    in_order(docs.select("source_id", text.alias("text")), ["source_id"], F.length("text") + 50, file_chars).write.mode("overwrite").json(folder)


def write_catalog(catalog: DataFrame, path: str, records: int = DOCUMENT_RECORDS) -> None:
    """Documents of at most so many records by Latin, then Chinese name: version, count (of all), part (from 0, in order), pathogens."""
    fields = ["type", "species_latin", "species_latin_space", "species_chinese", "genus_latin", "genus_latin_space", "genus_chinese", "aliases", "source_count"]
    total, keys = catalog.count(), ["species_latin", "species_chinese"]
    placed = catalog.select(*fields).repartitionByRange(max(1, -(-total // records)), *keys).sortWithinPartitions(*keys).withColumn("i", F.monotonically_increasing_id())
    placed = placed.withColumn("p", F.shiftright("i", 33)).withColumn("part", F.struct("p", F.floor((F.col("i") - F.shiftleft("p", 33)) / records).alias("q")))
    docs = placed.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("pathogens"))
    docs = docs.withColumn("part", F.row_number().over(Window.orderBy("part")) - 1)  # a row for each document; their records are in them already
    if total == 0:
        docs = catalog.sparkSession.createDataFrame([(0,)], "part int").select("part", F.array().cast(docs.schema["pathogens"].dataType).alias("pathogens"))
    docs.select(F.lit("1").alias("version"), F.lit(total).cast("long").alias("count"), "part", "pathogens").repartitionByRange(max(1, -(-total // records)), "part").sortWithinPartitions("part").write.mode("overwrite").json(path)


def last_wins(rows: DataFrame, keys, order) -> DataFrame:
    """Of each key the row that comes last by order (a list of columns; ties are settled by the whole row)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def collection_rows(chunks: DataFrame, vector: str = "vector", sparse: str = "sparse_vector") -> DataFrame:
    """Chunks with encoded vectors as rows of a collection: fixed columns, texts cut to their limits."""
    return chunks.select(
        F.substring("chunk_id", 1, 512).alias("id"), F.col(vector).cast("array<float>").alias("vector"), F.map_filter(sparse, lambda _, w: w > 0).alias("sparse_vector"),
        F.substring("search_text", 1, 32768).alias("text"), F.substring("answer_text", 1, 32768).alias("answer_text"), F.substring("source_id", 1, 512).alias("source_id"),
        F.substring("source_file", 1, 512).alias("source_file"), F.substring("doc_type", 1, 64).alias("doc_type"), F.substring("section", 1, 1024).alias("section_path"),
        F.col("chunk_index").cast("long").alias("chunk_index"), "metadata",
    )


REQUIRED = ("id", "vector", "sparse_vector", "text", "answer_text", "source_id", "source_file", "doc_type", "section_path", "chunk_index")


def check_fields(df: DataFrame, required=REQUIRED) -> None:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"the collection lacks {', '.join(missing)}")


class KeyedTable:
    """A Parquet table upserted by key. Rows lie in buckets by their keys' hash; an upsert writes the buckets it touches anew, beside the old
    ones, and then a pointer file that says which version of each bucket is current. A reader sees all of an upsert or none of it, and a write
    that fails leaves nothing that is read. Writers must not overlap: the second to finish fails. ``vacuum`` drops what no kept version names."""

    def __init__(self, spark: SparkSession, path: str, keys, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), [keys] if isinstance(keys, str) else list(keys), buckets

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        if not exists(self.spark, folder):
            return []
        fs, p = self._hadoop(folder)
        return [f.getPath().getName() for f in fs.listStatus(p)]

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json"))

    def pointer(self, version: int | None = None) -> dict | None:
        """schema, keys, buckets, the version of each bucket, and the last batch of a stream. A few numbers a bucket."""
        v = self.versions()
        if not v:
            return None
        fs, p = self._hadoop(f"{self.path}/versions/{v[-1] if version is None else version}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, version: int, pointer: dict) -> None:
        fs, p = self._hadoop(f"{self.path}/versions/{version}.json")
        _, tmp = self._hadoop(f"{self.path}/versions/{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise RuntimeError(f"another writer made version {version} of {self.path}")

    def _files(self, pointer: dict, buckets=None) -> DataFrame | None:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in pointer["at"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(pointer["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last unless given."""
        p = self.pointer(version)
        if p is None:
            return None
        rows = self._files(p)
        return self.spark.createDataFrame([], StructType.fromJson(p["schema"])) if rows is None else rows

    def drop(self) -> None:
        fs, p = self._hadoop(self.path)
        fs.delete(p, True)

    def upsert(self, rows: DataFrame, order, over_table: bool = False, batch: int | None = None) -> list[int]:
        """Rows replace those of their key; of rows with one key the last by order stays. over_table: a row of the table stays if it comes later.
        batch: a stream's batch number; one that the table has seen is skipped. Returns the buckets written."""
        old, v = self.pointer(), self.versions()
        if old and batch is not None and old["batch"] is not None and old["batch"] >= batch:
            return []
        version, n = (v[-1] + 1 if v else 0), old["buckets"] if old else self.buckets
        if old and old["keys"] != self.keys:
            raise ValueError(f"the table's keys are {old['keys']}")
        incoming = f"{self.path}/incoming/v{version}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")
        last_wins(rows, self.keys, order).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(incoming)
        touched = {int(x.removeprefix("bucket=")) for x in self._names(incoming) if x.startswith("bucket=")}
        schema = rows.schema if not old else StructType([*StructType.fromJson(old["schema"]).fields, *[f for f in rows.schema if f.name not in {x["name"] for x in old["schema"]["fields"]}]])
        if touched:
            new = self.spark.read.schema(rows.schema).parquet(*[f"{incoming}/bucket={b}" for b in sorted(touched)])
            before = self._files(old, touched) if old else None
            if before is not None:
                first = [] if over_table else ["__new"]
                both = new.withColumn("__new", F.lit(1)).unionByName(before.withColumn("__new", F.lit(0)), allowMissingColumns=True)
                new = last_wins(both, self.keys, [*first, *order])
            new.select(*schema.names).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        at = (old["at"] if old else {}) | {str(b): version for b in touched}
        self._point(version, {"schema": schema.jsonValue(), "keys": self.keys, "buckets": n, "at": at, "batch": batch if batch is not None else old["batch"] if old else None})
        fs, p = self._hadoop(incoming)
        fs.delete(p, True)
        return sorted(touched)

    def vacuum(self, keep: int = 1) -> int:
        """Drops the pointers before the last ``keep`` and the buckets that no other names; how many buckets went."""
        versions = self.versions()
        named = {(v, int(b)) for n in versions[-keep:] for b, v in self.pointer(n)["at"].items()}
        gone = 0
        for n in versions[:-keep]:
            fs, p = self._hadoop(f"{self.path}/versions/{n}.json")
            fs.delete(p, False)
        for folder in self._names(f"{self.path}/data"):
            for b in self._names(f"{self.path}/data/{folder}"):
                if b.startswith("bucket=") and (int(folder[1:]), int(b.removeprefix("bucket="))) not in named and (not versions or int(folder[1:]) <= versions[-1]):
                    fs, p = self._hadoop(f"{self.path}/data/{folder}/{b}")
                    fs.delete(p, True)
                    gone += 1
        return gone


def progress(rows: DataFrame, key: str, batch: int, parts: int = 1024) -> DataFrame:
    """Batch number, rows so far and share done of an ordered load. No window goes over all rows: a batch's number follows from the rows
    before it, so only the batches' ends are needed, and these from counts."""
    total = rows.count()
    ends = rows.sparkSession.range(1, -(-total // batch) + 1, numPartitions=max(1, min(parts, total // batch // 1024 + 1))).withColumnRenamed("id", "batch")
    done = F.least(F.col("batch") * batch, F.lit(total))
    return ends.select("batch", done.alias("done"), F.lit(total).cast("long").alias("total"), (done / F.lit(total)).alias("share"))


def create_collection(spark: SparkSession, name: str, dim: int, drop: bool = False) -> None:
    """The table of a collection, if it isn't there: fixed columns, vectors of one dimension (checked on write by ``checked_vectors``)."""
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (id STRING, vector ARRAY<FLOAT>, sparse_vector MAP<INT, DOUBLE>, text STRING, answer_text STRING, source_id STRING,
        source_file STRING, doc_type STRING, section_path STRING, chunk_index BIGINT) USING parquet TBLPROPERTIES ('dim' = '{dim}')""")


def checked_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """The write fails on the first vector of another dimension."""
    return rows.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector isn't of dimension {dim}")).cast("array<float>")))
