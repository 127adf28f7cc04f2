"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Index. Equal vectors collapse into one class first, so copies, however many, are one row; a class keeps the ``k + 1``
smallest ids, as no other of its ids can be among anyone's k nearest when ties go to the smaller id. Vectors are scaled
to length one and turned by a seeded random rotation, so a block of leading dimensions is a random projection.
Centroids are fitted by k-means on at most ``sample`` classes (the only bounded sample); every class is then put in its
nearest list. A list over ``slice_rows`` is cut into slices by hash.

Search. A query goes to its nearest lists, all slices of each: so many that, among the sampled classes, ``target`` of the
nearest neighbours lie in them, at least ``probes``, and more until they hold ``least`` classes. Within
a slice the vectors lie in column blocks of ``block`` dimensions. Squared distances are accumulated block by block for
all queries of the slice at once; after each, a candidate is abandoned if its partial distance, scaled to all dimensions,
exceeds the k-th best so far by the test's margin (1 + epsilon / sqrt(dimensions seen))^2. Survivors are scored exactly in
double precision on the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part; neither do those whose dimension isn't
the commonest (ties: the smaller), nor rows with null ids. Repeated rows of an id count once. Fewer than k candidates: all
of them. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of one vector with rows, in double precision; equal rows get equal bits. Vectors are scaled by powers of two first, which rounds nothing, so
    that no square overflows or vanishes."""
    q, x = _scaled(q[None])[0], _scaled(x)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def kmeans(x: np.ndarray, n: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        at = nearest(x, centers, 1)[:, 0]
        total, count = np.zeros_like(centers), np.bincount(at, minlength=len(centers))
        np.add.at(total, at, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centers))])
    return centers.astype(np.float32)


def nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(n, len(centers))), np.int64)
    half = (centers * centers).sum(axis=1) / 2
    for i in range(0, len(x), 2048):
        d = half - x[i : i + 2048] @ centers.T
        part = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[i : i + 2048] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


def needed_probes(x: np.ndarray, centers: np.ndarray, k: int, target: float, queries: int = 256, seed: int = 5) -> int:
    """How many nearest lists hold a share of target of the k nearest neighbours within the sample x, over some of its rows as queries.
    Neighbours in the whole table are nearer than those in a sample, so it errs on the side of more."""
    if len(x) <= k:
        return len(centers)
    at = nearest(x, centers, 1)[:, 0]
    picked = np.random.default_rng(seed).permutation(len(x))[:queries]
    place = np.argsort(nearest(x[picked], centers, len(centers)), axis=1)
    d = -(x[picked] @ x.T)
    d[np.arange(len(picked)), picked] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return int(np.quantile(np.take_along_axis(place, at[near], 1), target, method="higher")) + 1


def scan_slice(ids: np.ndarray, x: np.ndarray, raw: np.ndarray, q: np.ndarray, q_raw: np.ndarray, k: int, block: int, epsilon: float, chunk: int = 64):
    """The adaptive scan of a slice. Yields (query index, ids, exact scores) of each query's k best."""
    dim, n = x.shape[1], len(x)
    columns = [np.ascontiguousarray(x[:, a : a + block]) for a in range(0, dim, block)]
    norms = [(c * c).sum(axis=1) for c in columns]
    for lo in range(0, len(q), chunk):
        qs = q[lo : lo + chunk]
        first = norms[0][None, :] - 2 * (qs[:, :block] @ columns[0].T) + (qs[:, :block] ** 2).sum(axis=1)[:, None]
        for i in range(len(qs)):
            one = qs[i]
            warm = np.argpartition(first[i], k - 1)[:k] if n > k else np.arange(n)
            full = ((x[warm] - one) ** 2).sum(axis=1)
            bound = float(full.max()) if len(warm) >= k else np.inf
            partial, alive = first[i], None
            for b in range(len(columns)):
                seen = min(dim, (b + 1) * block)
                if b:
                    at = one[b * block : seen]
                    c, m = (columns[b], norms[b]) if alive is None else (columns[b][alive], norms[b][alive])
                    partial = partial + m - 2 * (c @ at) + float(at @ at)
                if seen < dim:
                    keep = np.flatnonzero(partial * (dim / seen) <= bound * (1 + epsilon / seen**0.5) ** 2 + 1e-5)
                else:
                    if len(partial) > k:
                        bound = min(bound, float(np.partition(partial, k - 1)[k - 1]))
                    keep = np.flatnonzero(partial <= bound + 1e-5)
                partial = partial[keep]
                alive = keep if alive is None else alive[keep]
            score = cosines(q_raw[lo + i], raw[alive])
            best = np.lexsort((ids[alive], -score))[:k]
            yield lo + i, ids[alive][best], score[best]


def _matrix(column, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(len(column), -1)


def valid_vectors(rows: DataFrame) -> DataFrame:
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    return v.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)").filter("forall(v, x -> x is not null) and exists(v, x -> x <> 0)")


def search(rows: DataFrame, is_query, k: int = 5, probes: int = 8, target: float = 0.98, least: int = 256, sample: int = 16384, slice_rows: int = 8192, block: int = 16, epsilon: float = 2.1, seed: int = 5) -> DataFrame:
    """rows: (vec_id, embedding); is_query: a condition on vec_id. query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    v = staged(valid_vectors(rows), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return empty
    v = v.filter(F.size("v") == dims["d"])
    smallest = v.distinct().withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("i") <= k + 1)
    classes = staged(smallest.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.col("ids")[0]), "vector-classes")
    asked = v.filter(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().join(classes.select("id", "v"), "v").select("query_id", "id", "v")
    asked = staged(asked, "vector-queries")
    n = classes.count()
    most = max(1, min(sample, (1 << 23) // dims["d"]))
    picked = classes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    turn = rotation(dims["d"], seed)
    train = unit(_matrix(picked["v"].combine_chunks())) @ turn
    lists = max(1, min(int(n**0.5 / 2), len(train) // 16, 4096))
    centers = kmeans(train, lists, seed=seed)
    probes = max(probes, needed_probes(train, centers, k, target, seed=seed))
    shared = spark.sparkContext.broadcast((centers, turn))

    def assign(batches):
        centers, turn = shared.value
        for b in batches:
            if b.num_rows:
                at = nearest(unit(_matrix(b.column("v"))) @ turn, centers, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(at.astype(np.int32))], ["id", "v", "list"])

    placed = staged(classes.select("id", "v").mapInArrow(assign, "id long, v array<double>, list int"), "vector-lists")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list: bounded by the number of centres
        sizes[r["list"]] = r["count"]
    slices = np.maximum(1, -(-sizes // slice_rows)).astype(np.int64)
    probing = spark.sparkContext.broadcast((centers, turn, sizes, slices))

    def probe(batches):
        centers, turn, sizes, slices = probing.value
        for b in batches:
            if not b.num_rows:
                continue
            order = nearest(unit(_matrix(b.column("v"))) @ turn, centers, len(centers))
            need = np.maximum(probes, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
            row, lst, slc = [], [], []
            for i, m in enumerate(need):
                for c in order[i, :m]:
                    if sizes[c]:
                        row += [i] * int(slices[c])
                        lst += [int(c)] * int(slices[c])
                        slc += range(int(slices[c]))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), b.column("v").take(pa.array(row, pa.int64())), pa.array(lst, pa.int32()), pa.array(slc, pa.int32())], ["id", "v", "list", "slice"])

    queries = asked.select("id", "v").dropDuplicates(["id"]).mapInArrow(probe, "id long, v array<double>, list int, slice int")
    per_list = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(slices)], "list int, slices int"))
    parts = placed.join(per_list, "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        _, turn = shared.value
        qs, ids, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            raw, q_raw = _matrix(left["v"].combine_chunks()), _matrix(right["v"].combine_chunks())
            q_ids = right["id"].to_numpy()
            for i, best, score in scan_slice(left["id"].to_numpy(), unit(raw) @ turn, raw, unit(q_raw) @ turn, q_raw, k + 1, block, epsilon):
                qs.append(np.full(len(best), q_ids[i]))
                ids.append(best)
                scores.append(score)
        return pa.table({"q": np.concatenate(qs), "id": np.concatenate(ids), "score": np.concatenate(scores)})

    found = parts.groupBy("list", "slice").cogroup(queries.groupBy("list", "slice")).applyInArrow(scan, "q long, id long, score double")
    best = found.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("i") <= k + 1)
    named = best.join(classes.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id"))
    top = named.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("top"))
    out = asked.select("query_id", "id").join(top, F.col("id") == F.col("q"))
    own = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(own).alias("i", "t")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
