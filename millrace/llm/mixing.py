"""Mixing sources to target weights by systematic sampling.

Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, repeating; shares of all words are held to
``max_epochs`` times a source's own words, the excess going to the others by weight until none is above (water level
found by one pass over the sources sorted by cap / weight). A document expects target / source_size copies. Documents
of a source are laid out by size class, then by hash (of doc_id, or where it is null of the text); their expected copies are prefix-summed, one random offset per
source is added, and a copy is emitted at each integer crossed. Neighbours in that order are of one size, so a source's
taken words follow its target closely.

The prefix sum has two levels: counts per (source, size class, hash digit), at most a few ten thousand rows a source
whatever the corpus, and row numbers inside such a bucket. A source with a third of all rows is spread over all its
buckets. No text is shuffled.

Null text: size 0, never takes words. Null source: a source of its own, last. Empty table: no rows. Repeated rows are
separate documents (``emit`` merges equal rows and adds up their copies). Columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_keys, packed, staged, unpacked

WORD = r"[^\x20\x09-\x0D]+"


def size_class(size):
    """Eight classes to each power of two: integer arithmetic only, so any engine gets the same."""
    log2 = F.length(F.bin(size)) - 1
    return F.when(size < 8, size).otherwise(F.expr("8L * (length(bin(size)) - 1)") + F.floor(size * 8 / F.pow(F.lit(2.0), log2)) - 8).cast("long")


def targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes: (s_null, s, source_size), a row for each source. Adds target."""
    order = Window.orderBy("s_null", "s")
    level = Window.orderBy("ratio", "s_null", "s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    out = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    out = out.withColumn("before", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(level), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(level), F.lit(0))))
    out = out.withColumn("water", F.min(F.when(F.col("ratio") > F.col("before"), F.struct("ratio", "before"))).over(everything)["before"])
    return out.withColumn("target", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("water"))).select("s_null", "s", "source_size", "target")


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies, taken, and the columns named in keep."""
    keep = keep or []
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("s_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.coalesce("text", F.lit(""))))).alias("h"),
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
    ).withColumn("bin", size_class(F.col("size"))).withColumn("digit", F.substring("h", 1, 2))
    rows = staged(rows, "mix-sizes")
    buckets = rows.groupBy("s_null", "s", "bin", "digit").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(buckets.groupBy("s_null", "s").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    along = Window.partitionBy("s_null", "s").orderBy("bin", "digit").rowsBetween(Window.unboundedPreceding, -1)
    start = buckets.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).join(goal, ["s_null", "s"]).select("s_null", "s", "bin", "digit", "start", "source_size", "target")
    inside = Window.partitionBy("s_null", "s", "bin", "digit").orderBy("h", "doc_id", "size")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("s_null"), "n").otherwise("s"), "s")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)
    out = rows.withColumn("rank", F.row_number().over(inside).cast("long")).join(start, ["s_null", "s", "bin", "digit"])
    out = out.withColumn("rank", F.col("rank") + F.col("start")).withColumn("u", offset).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    crossed = F.floor(F.col("u") + F.col("rate") * F.col("rank")) - F.floor(F.col("u") + F.col("rate") * (F.col("rank") - 1))
    out = out.withColumn("copies", F.least(crossed, F.lit(max_epochs)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep])


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row once for each copy taken, with mix_copy (from 1), mix_size and mix_target (its source's); columns of
    docs that have these names go."""
    keyed = docs.select(packed(docs, "mix_size", "mix_target", "mix_copy"), "doc_id", "text", "source", *doc_keys(F.col("doc_id"), F.col("text"), F.col("source")))
    taken = mix(keyed, keep=["k1", "k2"], **options).groupBy("k1", "k2").agg(F.sum("copies").alias("n"), F.first("size").alias("mix_size"), F.first("target").alias("mix_target")).filter("n > 0")
    own = unpacked(docs.drop("mix_size", "mix_target", "mix_copy"))
    return keyed.dropDuplicates(["k1", "k2"]).join(taken, ["k1", "k2"]).select(*own, "mix_size", "mix_target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("mix_copy"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         source IS NULL AS s_null, COALESCE(source, '') AS s, md5(COALESCE(doc_id::VARCHAR, 'n' || COALESCE(text, ''))) AS h FROM documents),
binned AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE 8 * (length(bin(size)) - 1) + floor(size * 8 / pow(2.0, length(bin(size)) - 1))::BIGINT - 8 END AS bin FROM rows),
sizes AS (SELECT s_null, s, SUM(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY s_null, s) - 1) % 3 AS w FROM sizes),
capped AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM weighed),
levels AS (
  SELECT *, ((SUM(source_size) OVER ())::DOUBLE - COALESCE(SUM(cap) OVER b, 0)::DOUBLE) / ((SUM(w) OVER ()) - COALESCE(SUM(w) OVER b, 0))::DOUBLE AS before
  FROM capped WINDOW b AS (ORDER BY ratio, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(before, ratio) AS water FROM levels WHERE ratio > before),
goal AS (
  SELECT s_null, s, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap::DOUBLE ELSE w * water END AS target FROM levels LEFT JOIN water ON true),
ranked AS (
  SELECT binned.*, row_number() OVER (PARTITION BY s_null, s ORDER BY bin, h, doc_id, size) AS rank FROM binned),
rated AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.rank, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || CASE WHEN r.s_null THEN 'n' ELSE 's' END || r.s), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM ranked r JOIN goal g ON r.s_null = g.s_null AND r.s = g.s)
SELECT doc_id, size, source_size, target, least(floor(u + rate * rank) - floor(u + rate * (rank - 1)), 3)::BIGINT AS copies,
       least(floor(u + rate * rank) - floor(u + rate * (rank - 1)), 3)::BIGINT * size AS taken FROM rated
"""
