"""Hard negatives by exact inner products: blocks of anchors against blocks of candidates.

Components become whole numbers, floor(256 x), so a score is a whole number too. Anchors go to the executors in blocks of
bounded bytes, one at a time. Every task multiplies the block with blocks of its own candidates (BLAS in double precision,
exact as long as no squared length reaches 2^53; else whole-number products) and keeps the best of each anchor, so what is
shuffled is a few rows an anchor and task, and merging those is again taking the best. The first pass finds
each anchor's best rows of its own label (positives); with their scores known, the second finds for each positive the best rows
of other labels whose score lies in the window that its score sets. A block's result is written before the next block.

No row is left out of the search. The work is anchors times rows by the contract; neither pairs nor groups are rows.

Takes no part: a row with a null id, label, vector or component, a non-finite component, no component, another dimension than the
commonest (ties: the smaller), or a squared length of 2^56 or more after scaling, whose scores would not fit a long a hundredfold. Equal
rows count once. Rows that share the anchor's id are neither its positives nor its negatives. Ties go to the smaller id. Empty table, or no anchor: no
rows. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, staged, work_dir

SCALE = 256
#: Bytes of a block's anchors on the driver and in each task; candidates and anchors multiplied at once.
BLOCK_BYTES, CANDIDATES, ANCHORS = 1 << 24, 4096, 256
#: Stands for no score: below every score.
NONE = -(1 << 62)
EXACT, MOST = 1 << 53, 1 << 56
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(rows: DataFrame, label: Column | str = "label") -> DataFrame:
    """Rows that take part: id, label, v (whole numbers as doubles), once each."""
    v = F.col("embedding").cast("array<double>")
    r = rows.select(F.col("vec_id").cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), v.alias("x")).filter("id is not null and label is not null and x is not null")
    r = r.filter("size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")
    r = r.select("id", "label", F.expr(f"transform(x, c -> c * {SCALE}D)").alias("x")).filter(f"aggregate(x, 0D, (s, c) -> s + c * c) < {4 * MOST}D")
    r = r.select("id", "label", F.expr("transform(x, c -> double(floor(c)))").alias("v")).filter(f"aggregate(v, 0D, (s, c) -> s + c * c) < {MOST}D")
    return r.distinct()


class Best:
    """The k best (score, id) of each of n anchors so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, first: int, score: np.ndarray, may: np.ndarray, ids: np.ndarray) -> None:
        """score, may: (anchors from ``first`` x candidates); may says which candidates count."""
        own = slice(first, first + len(score))
        row, col = np.nonzero(may & (score >= self.score[own, -1:]))
        if not len(row):
            return
        touched = np.unique(row)
        old = np.repeat(touched, self.k)
        rows = np.concatenate([old, row])
        scores = np.concatenate([self.score[own][touched].ravel(), score[row, col].astype(np.int64)])
        names = np.concatenate([self.id[own][touched].ravel(), ids[col]])
        order = np.lexsort((names, -scores, rows))
        rows, scores, names = rows[order], scores[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < self.k
        self.score[own][rows[top], place[top]] = scores[top]
        self.id[own][rows[top], place[top]] = names[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = np.nonzero(self.score > NONE)
        return row, self.score[row, at], self.id[row, at]


def _tables(batches):
    for t in gathered(batches, CANDIDATES):
        v = t["v"].combine_chunks()
        yield t["id"].to_numpy(), t["label"].to_numpy(), v.flatten().to_numpy().reshape(len(v), -1)


def _products(anchors: np.ndarray, batches, kind):
    """(first anchor, ids, labels, scores) of each block of candidates and anchors."""
    a = anchors.astype(kind)
    for ids, labels, v in _tables(batches):
        v = v.astype(kind)
        for lo in range(0, len(ids), CANDIDATES):
            c = slice(lo, lo + CANDIDATES)
            for i in range(0, len(a), ANCHORS):
                yield i, ids[c], labels[c], a[i : i + ANCHORS] @ v[c].T


def _best_of(rows: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column | str, label: Column | str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows: (vec_id, embedding, label); is_anchor: a condition on id. For each anchor and each of its first ``positives`` rows of the same label,
    the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    r = staged(scaled(rows, label), "vectors")
    dims = r.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    r = r.filter(F.size("v") == dims["d"])
    longest = r.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()[0]
    kind, out = np.float64 if longest < EXACT else np.int64, work_dir(spark, "hard-negatives")
    anchors = r.filter(is_anchor).toLocalIterator()
    empty = True
    while some := list(islice(anchors, max(1, block_bytes // (8 * dims["d"])))):  # one block is on the driver
        empty = False
        own = spark.sparkContext.broadcast((np.array([x["id"] for x in some]), np.array([x["label"] for x in some]), np.array([x["v"] for x in some])))

        def near(batches, own=own):
            ids, labels, v = own.value
            best = Best(len(ids), positives)
            for i, c_ids, c_labels, s in _products(v, batches, kind):
                a = slice(i, i + len(s))
                best.take(i, s, (labels[a, None] == c_labels) & (ids[a, None] != c_ids), c_ids)
            row, score, found = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(score), pa.array(found)], ["a", "score", "id"])

        top = _best_of(r.mapInArrow(near, "a int, score long, id long"), ("a",), positives).collect()  # a few rows for each anchor of the block
        p_score, p_id = np.full((len(some), positives), NONE, np.int64), np.zeros((len(some), positives), np.int64)
        for x in top:
            p_score[x["a"], x["rank"] - 1], p_id[x["a"], x["rank"] - 1] = x["score"], x["id"]
        there = p_score > NONE
        least, most = np.where(there, -((-low * np.where(there, p_score, 0)) // 100), 1), np.where(there, (high * np.where(there, p_score, 0)) // 100, 0)
        window = spark.sparkContext.broadcast((p_id, p_score, least, most))

        def hard(batches, own=own, window=window):
            ids, labels, v = own.value
            p_id, p_score, least, most = window.value
            best = [Best(len(ids), negatives) for _ in range(positives)]
            for i, c_ids, c_labels, s in _products(v, batches, kind):
                a = slice(i, i + len(s))
                other = (labels[a, None] != c_labels) & (ids[a, None] != c_ids)
                for j in range(positives):
                    best[j].take(i, s, other & (s >= least[a, j, None]) & (s <= most[a, j, None]), c_ids)
            for j in range(positives):
                row, score, found = best[j].found()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int32()), pa.array([j] * len(row), pa.int32()), pa.array(ids[row], pa.int64()), pa.array(p_id[row, j]), pa.array(p_score[row, j]), pa.array(score), pa.array(found)],
                    ["a", "j", "anchor_id", "positive_id", "positive_score", "score", "id"],
                )

        found = _best_of(r.mapInArrow(hard, "a int, j int, anchor_id long, positive_id long, positive_score long, score long, id long"), ("a", "j"), negatives)
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        own.destroy()
        window.destroy()
    return spark.createDataFrame([], RESULT) if empty else spark.read.schema(RESULT).parquet(out)


#: Labels as the digest's contract shifts them.
SHIFTED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def query(rows: DataFrame) -> DataFrame:
    return mine(rows, "id % 50 = 0", F.expr(SHIFTED))


SQL = f"""WITH x AS (SELECT DISTINCT vec_id AS id, {SHIFTED} AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
r AS (SELECT * FROM x WHERE len(v) = (SELECT len(v) FROM x GROUP BY len(v) ORDER BY COUNT(*) DESC, len(v) LIMIT 1)),
a AS (SELECT row_number() OVER () AS a, * FROM r WHERE id % 50 = 0),
s AS (SELECT a.a, a.id AS anchor_id, r.label = a.label AS same, r.id, list_inner_product(a.v, r.v)::BIGINT AS score FROM a JOIN r ON a.id <> r.id),
p AS (SELECT * FROM (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
h AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3"""
