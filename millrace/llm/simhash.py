"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: A-Z lower-cased, words, 4-word shingles with repeats, XXH64 (seed 42) of each; a bit is set if it is set in
over half the hashes. Equal fingerprints collapse first, so a group of copies, however large, is one entry. Two
fingerprints within ``radius`` bits agree on one of radius + 1 bands at least (pigeonhole, exact), so they meet in a
bucket; of more fingerprints, more bands are made and several must agree, so buckets stay small. A bucket is stored vertically: blocks of 64 fingerprints, one 64-bit word per bit position. A fingerprint is
compared with a block by XORing each plane and adding it into three carry-save counter words with a sticky overflow; at
fixed planes, blocks in which every lane has exceeded the radius are abandoned. A bucket leaves a spanning forest of its
links, not its pairs. Buckets over ``slice_rows`` distinct fingerprints are cut into slices, and each pair of slices is a
task of its own. The forests meet in distributed connected components.

``keep_one`` serves a similarity of 0.8 over sets of five-word shingles, which is about 10 of 64 bits, and 20 with its spread: more than
bands of a fingerprint can reach without buckets that hold everything. So there documents meet under keys of three minimal
shingle hashes each, the buckets are compared bit-sliced within 20 bits, and the closest links of a bucket are confirmed by the
exact similarity of the two sets. Where that leaves links open, the sets are sent to the bucket, which confirms the rest where it is and
gives a forest of what it confirmed: so rows grow with a group, not with its pairs.

Fewer than four words: one shingle of them all. No words or null text: fingerprint zero, linked like any other. Null
doc_id: keeps its row; it is never the smallest id unless its whole component has none. Empty table: no rows. Repeated
rows share a component. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import accumulate, combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, doc_keys, hot_keys, packed, passes, small_batches, split_join, staged, unpacked
from .components import components

SHINGLE, SEED, BITS = 4, 42, 64
#: Hashes of sets in a slice of a bucket: 16 MB.
SLICE_HASHES = 1 << 22


def shingle_hashes(text: str | None, width: int = SHINGLE):
    """The XXH64 of each shingle in order, as arrays of up to 65,536."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        yield np.frombuffer(digest(joined, SEED), ">u8")
        return
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts, n = [0, *(x + 1 for x in ends)], len(words) - width + 1
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        yield np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)]), ">u8")


def majority(blocks) -> int:
    """The bits set in over half of the hashes."""
    set_bits, n = np.zeros(BITS, np.int64), 0
    for h in blocks:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += (np.ones(len(bits), np.float32) @ bits.astype(np.float32)).astype(np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint over shingles of so many words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(radius: int, n: int, fill: int = 512) -> list[int]:
    """Bit masks such that fingerprints within the radius agree under one of them at least: the 64 bits are cut into bands, and of b
    bands some b - radius are untouched (pigeonhole). The fewest bands are taken whose masks spread n fingerprints to about
    ``fill`` a bucket."""
    for b in range(radius + 1, radius + 5):
        if n <= fill * 2 ** (BITS * (b - radius) // b) or b == radius + 4:
            break
    cuts = [BITS * i // b for i in range(b + 1)]
    bands = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(bands, b - radius)]


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """lanes: (blocks, 64) fingerprints. Returns (64, blocks): plane p of a block holds bit p of its 64 lanes."""
    out = np.empty((BITS, len(lanes)), np.uint64)
    for p in range(BITS):
        bit = ((lanes >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        out[p] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def within(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, active: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, block) a word whose lanes within the radius are set. active: the lanes that count."""
    if not 0 <= radius <= 30:
        raise ValueError("five counter words hold a radius of 0 to 30")
    limit = radius + 1
    words = limit.bit_length()
    out = np.zeros(len(queries), np.uint64)
    at = np.arange(len(queries))
    counters = [np.zeros(len(queries), np.uint64) for _ in range(words + 1)]  # the last one: overflow, which stays
    q, bl, act = queries, block, active
    for p in range(BITS):
        x = planes[p][bl] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
        for word in counters[:-1]:
            carry = word & x
            word ^= x
            x = carry
        counters[-1] |= x
        if p in (15, 23, 31, 43, 63):
            # counters >= limit, most significant word first
            more, same = counters[-1].copy(), ~counters[-1]
            for k in range(words - 1, -1, -1):
                word = counters[k]
                if limit >> k & 1:
                    same &= word
                else:
                    more |= same & word
                    same &= ~word
            near = ~(more | same) & act
            if p == BITS - 1:
                out[at] = near
            else:
                live = np.flatnonzero(near)
                if len(live) < 0.8 * len(at):
                    at, q, bl, act = (v[live] for v in (at, q, bl, act))
                    counters = [v[live] for v in counters]
                    if not len(at):
                        break
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n nodes under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        moved = low != high
        if not moved.any():
            break
        a, b, low, high = a[moved], b[moved], low[moved], high[moved]
        np.minimum.at(root, high, low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
    return root


def closest_forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Indexes of the links (a, b) that make a spanning forest of the least distances: each component takes its closest link out."""
    order = np.lexsort((b, a, far))
    taken, root = [np.empty(0, np.int64)], np.arange(n)
    while True:
        x, y = root[a[order]], root[b[order]]
        apart = x != y
        order, x, y = order[apart], x[apart], y[apart]
        if not len(order):
            return np.concatenate(taken)
        best, at = np.full(n, len(order)), np.arange(len(order))[::-1]
        best[x[::-1]] = at
        other = np.full(n, len(order))
        other[y[::-1]] = at
        best = np.minimum(best, other)
        taken.append(order[np.unique(best[best < len(order)])])
        root = forest(n, a[np.concatenate(taken)], b[np.concatenate(taken)])


def links_of(fp: np.ndarray, group: np.ndarray, cross: np.ndarray, left: np.ndarray, radius: int, chunk: int = 1 << 17):
    """fp: uint64, sorted by group. Links within each group: of all pairs, or where cross is set of left against the rest only. Yields index pairs."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    blocks = -(-sizes // 64)
    first_block = np.r_[0, np.cumsum(blocks)]
    inside = np.arange(len(fp)) - np.repeat(starts, sizes)
    own = np.repeat(first_block[:-1], sizes) + inside // 64
    lanes, who = np.zeros((first_block[-1], 64), np.uint64), np.full((first_block[-1], 64), -1, np.int64)
    lanes[own, inside % 64], who[own, inside % 64] = fp, np.arange(len(fp))
    planes = planes_of(lanes)
    filled = np.packbits((who >= 0).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    is_left = np.packbits(((who >= 0) & left[np.maximum(who, 0)]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    last = np.repeat(first_block[1:], sizes)
    many = np.where(np.repeat(sizes, sizes) > 1, last - own, 0)  # blocks from its own to its group's last
    ends = np.cumsum(many)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, chunk):
        k = np.arange(lo, min(lo + chunk, int(ends[-1])))
        i = np.searchsorted(ends, k, side="right")
        b = own[i] + (k - (ends[i] - many[i]))
        active = filled[b].copy()
        same = b == own[i]
        lane = (inside[i] % 64).astype(np.uint64)
        active[same] &= ~(((np.uint64(1) << lane[same]) - np.uint64(1)) | (np.uint64(1) << lane[same]))
        x = cross[i]
        active[x] &= np.where(left[i[x]], ~is_left[b[x]], is_left[b[x]])
        keep = np.flatnonzero(active)
        hit = within(fp[i[keep]], planes, b[keep], active[keep], radius)
        some = np.flatnonzero(hit)
        bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, ln = np.nonzero(bits)
        yield i[keep[some[r]]], who[b[keep[some[r]]], ln]


def links(distinct: DataFrame, radius: int = 4, slice_rows: int = 8192, bands: list[int] | None = None) -> DataFrame:
    """distinct: (fp); bands: masks, else by their number. A spanning forest of the links in each bucket: (a, b)."""
    under = masks(radius, distinct.count()) if bands is None else bands
    keys = F.array(*[F.struct(F.lit(j).alias("band"), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)).alias("key")) for j, m in enumerate(under)])

    def joined(cols, pairs):
        fp = cols["fp"]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x, y in pairs:
            a.append(x)
            b.append(y)
            if sum(map(len, a)) > 1 << 21:  # a dense group: what is joined already needs no more links
                root = forest(len(fp), np.concatenate(a), np.concatenate(b))
                a, b = [np.flatnonzero(root != np.arange(len(fp)))], [root[root != np.arange(len(fp))]]
        root = forest(len(fp), np.concatenate(a), np.concatenate(b))
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.array(fp[child].view(np.int64)), pa.array(fp[root[child]].view(np.int64))

    return bucket_links(distinct.select("fp", F.inline(keys)), radius, slice_rows, joined, ("a", "b"))


def similar_links(nodes: DataFrame, similarity: float, radius: int, forests: int = 1, only: DataFrame | None = None, slice_rows: int = 8192) -> DataFrame:
    """nodes: (node, root, fp, n, keys), n the size of a set. Links within the radius between different roots, of sets whose sizes allow
    the similarity. Each bucket gives the forest of its closest links, of the rest the next, ...: rows (a, b, null), repeats among
    buckets; and where links are left over, a row (null, null, g) for the bucket. only: (g), the buckets to look at."""

    def joined(cols, pairs):
        fp, n, node, root = cols["fp"], cols["n"].astype(np.int64), cols["node"].astype(np.int64), cols["root"].astype(np.int64)
        x, y, far, held, left_over = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), [], []

        def reduced():
            a, b, d = (np.concatenate([o, *(h[k] for h in held)]) for k, o in enumerate((x, y, far)))
            rest, keep = np.arange(len(a)), [np.empty(0, np.int64)]
            for _ in range(forests):
                if not len(rest):
                    break
                took = closest_forest(len(fp), a[rest], b[rest], d[rest])
                keep.append(rest[took])
                rest = np.delete(rest, took)
            left_over.append(np.unique(cols["g"][a[rest]]))
            keep = np.concatenate(keep)
            return a[keep], b[keep], d[keep]

        for i, j in pairs:
            fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            held.append((i, j, np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)))
            if sum(len(h[0]) for h in held) > 1 << 20:
                (x, y, far), held = reduced(), []
        x, y, far = reduced()
        g = np.unique(np.concatenate(left_over)).astype(np.int64)
        a, b = np.r_[np.minimum(node[x], node[y]), g], np.r_[np.maximum(node[x], node[y]), g]
        is_link = np.arange(len(a)) < len(x)
        return pa.array(a, mask=~is_link), pa.array(b, mask=~is_link), pa.array(a, mask=is_link)

    rows = nodes.select("node", "root", "fp", "n", F.posexplode("keys").alias("band", "key"))
    return bucket_links(rows, radius, slice_rows, joined, ("a", "b", "g"), ("node", "root", "n"), only)


class Sets:
    """Sets of hashes in a row, and where each ends; hashes as numbers from 0."""

    def __init__(self, hashes: np.ndarray, ends: np.ndarray):
        values, self.code = np.unique(hashes, return_inverse=True)
        self.ends, self.size = ends, np.diff(ends, prepend=0)
        self.marked = np.zeros(len(values), bool)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """How many hashes a set shares with each of some others, none of them empty."""
        own = self.code[self.ends[one] - self.size[one] : self.ends[one]]
        self.marked[own] = True
        size = self.size[others]
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(self.ends[others] - stop, size)
        out = np.add.reduceat(self.marked[self.code[at]], stop - size, dtype=np.int64)
        self.marked[own] = False
        return out


def confirmed_forest(sets: Sets, root: np.ndarray, pairs, similarity: float, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs (index arrays) those between different roots whose sets are so similar, without those that earlier ones have joined:
    a spanning forest of all of them."""
    label = np.unique(root, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for x, y in pairs:
        some = np.flatnonzero((label[x] != label[y]) & (np.minimum(sets.size[x], sets.size[y]) >= similarity * np.maximum(sets.size[x], sets.size[y])))
        some = some[np.argsort(x[some], kind="stable")]
        x, y = x[some], y[some]
        for a, z in pairwise(np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]).tolist() if len(x) else []):
            one, others = int(x[a]), y[a:z]
            others = others[label[others] != label[one]]
            while len(others):
                k = max(1, int(np.searchsorted(np.cumsum(sets.size[others]), at_once)))
                shared = sets.shared(one, others[:k])
                for other in others[:k][shared >= similarity * (sets.size[one] + sets.size[others[:k]] - shared)].tolist():
                    if label[other] != label[one]:
                        out.append((one, other))
                        label[label == label[other]] = label[one]
                others = others[k:]
                others = others[label[others] != label[one]]
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def confirmed_links(nodes: DataFrame, sets: DataFrame, similarity: float, radius: int, only: DataFrame, slice_rows: int = 8192) -> DataFrame:
    """nodes: (node, root, fp, n, keys); sets: (node, hashes), of all nodes with links; only: (g). (a, b): a spanning forest of the links between
    different roots in the buckets named, each link confirmed by its sets."""

    def joined(cols, pairs):
        node = cols["node"].astype(np.int64)
        x, y = confirmed_forest(Sets(cols["hashes"], cols["ends"]), cols["root"], pairs, similarity)
        return pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))

    more = ("node", "root", "n")
    rows = nodes.select("node", "root", "fp", "n", F.posexplode("keys").alias("band", "key"))
    open_ = dealt(rows, slice_rows, more).join(only, "g", "left_semi").groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("g")
    return bucket_links(rows, radius, slice_rows, joined, ("a", "b"), more, open_, sets)


def dealt(rows: DataFrame, slice_rows: int, more: tuple[str, ...] = ()) -> DataFrame:
    """rows: (band, key, fp, more). g (the hash of a bucket, or of a pair of its slices), cross, left, fp, more. With n, the size of a set,
    among them a slice has at most about ``SLICE_HASHES`` hashes too."""
    size = F.col("count") / slice_rows
    if "n" in more:
        size = F.greatest(size, F.col("weight") / SLICE_HASHES)
    large = rows.groupBy("band", "key").agg(F.count("*").alias("count"), F.sum("n" if "n" in more else F.lit(1)).alias("weight")).filter(size > 1)
    rows = rows.join(large.select("band", "key", F.ceil(size).cast("int").alias("slices")), ["band", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", *more[:1]), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "fp", *more)
    group = F.xxhash64("band", "key", "i", "j")
    return rows.select(group.alias("g"), (F.col("i") != F.col("j")).alias("cross"), "left", "fp", *more)


def bucket_links(rows: DataFrame, radius: int, slice_rows: int, joined, out: tuple[str, ...], more: tuple[str, ...] = (), only: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """rows: (band, key, fp, more). ``joined`` makes of a run of whole buckets' columns and their links within the radius the columns
    ``out``, all longs. only: (g), the hashes of the buckets (or pairs of slices) to look at. sets: (node, hashes), a row for each node that
    takes part; its lists come as hashes, all in a row, and ends."""
    rows = dealt(rows, slice_rows, more)
    names = rows.columns
    rows = rows if only is None else rows.join(only, "g", "left_semi").select(names)
    with_sets = sets is not None
    if with_sets:
        rows = rows.join(sets, "node").select(*names, "hashes")

    def run(batches):
        def done(t):
            t = t.combine_chunks()
            cols = {c: t[c].to_numpy() for c in names}
            cols["fp"] = cols["fp"].astype(np.int64).view(np.uint64)
            if with_sets:
                lists = t["hashes"].combine_chunks()
                cols["hashes"], cols["ends"] = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
            return pa.RecordBatch.from_arrays(list(joined(cols, links_of(cols["fp"], cols["g"], cols["cross"], cols["left"], radius))), list(out))

        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n > 1 << 16 or size > 1 << 26:
                t = pa.Table.from_batches(held)
                g = t["g"].to_numpy()
                cut = len(g) - int(np.argmax(g[::-1] != g[-1])) if (g != g[-1]).any() else 0  # the last group may go on
                if cut:
                    yield done(t.slice(0, cut))
                    t = t.slice(cut).combine_chunks()
                held, n, size = t.to_batches(), t.num_rows, 0
        if n:
            yield done(pa.Table.from_batches(held))

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, ", ".join(f"{c} long" for c in out))


def component_roots(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct: (fp, first). fp, least: the smallest ``first`` of each fingerprint's component. A component that holds many
    fingerprints is dealt over all partitions."""
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = staged(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    return split_join(rooted.select("fp", "root"), least.select("root", "least"), "root", hot_keys(least, "root", rooted.count()), by=("fp",)).select("fp", "least")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id."""
    prints = staged(fingerprints(docs), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    hot = hot_keys(distinct, "fp", prints.count())  # large groups of copies
    least = component_roots(distinct.select("fp", "first"), radius).withColumnRenamed("least", "component_id")
    return split_join(prints, least, "fp", hot, by=("doc_id",)).select("doc_id", "fp", "component_id")


#: Keys of a document and minimal hashes in each: two sets of similarity 0.8 share none of the keys once in 1,300.
KEYS, EACH = 10, 3


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    blocks = [np.unique(h.astype(np.uint64)) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(blocks)) if len(blocks) > 1 else blocks[0] if blocks else np.empty(0, np.uint64)


def cut_hashes(h: np.ndarray) -> np.ndarray:
    return np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def sketch(text: str | None, width: int = 5) -> tuple[int, int, list[int], int]:
    """Of the set of shingles: a hash of it all, its fingerprint, its keys, and how many hashes it has when they are cut to 32 bits."""
    import xxhash

    h = shingle_set(text, width)
    if not len(h):
        return 0, 0, [], 0
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, KEYS * EACH, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.min([(h[at : at + 4096, None] * odd).min(axis=0) for at in range(0, len(h), 4096)], axis=0).reshape(KEYS, EACH)
    keys = [xxhash.xxh64_intdigest(least[k].tobytes(), k) for k in range(KEYS)]
    whole = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    print_ = majority(h[at : at + 65536].astype(">u8") for at in range(0, len(h), 65536))
    return whole, print_, keys, len(cut_hashes(h))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs: (id, text). id, node, fp, n, keys."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            made = [sketch(t, width) for t in b.column("text").to_pylist()]
            node, fp = (pa.array(np.array([m[k] for m in made], np.uint64).view(np.int64)) for k in (0, 1))
            keys = pa.array([np.array(m[2], np.uint64).view(np.int64) for m in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), node, fp, pa.array([m[3] for m in made], pa.int32()), keys], ["id", "node", "fp", "n", "keys"])

    rows = docs.select("id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node long, fp long, n int, keys array<long>")


def may_have(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with may: false where k1 isn't among the keys (k1)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(keys.select("k1")))

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, k.to_numpy().astype(np.int64)))

    return docs.withColumn("may", may("k1"))


def sets_of(docs: DataFrame, owners: DataFrame, width: int = 5) -> DataFrame:
    """docs: (k1, k2, text); owners: (k1, k2, node), one document of each node. node, hashes: cut to 32 bits. Only texts that are asked for
    are hashed and moved."""

    def run(batches):
        for b in batches:
            hashes = pa.array([cut_hashes(shingle_set(t, width)) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("node"), hashes], ["node", "hashes"])

    few = may_have(docs, owners).filter("may").select("k1", "k2", F.col("text").cast("string").alias("text"))
    return few.join(owners, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, hashes array<int>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs: (a, b); sets: (node, hashes), a row per node. The pairs whose sets are so similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("n")).filter(F.col("s") >= F.lit(similarity) * (F.col("n") - F.col("s"))).select("a", "b")


def similar_components(nodes: DataFrame, docs: DataFrame, similarity: float, radius: int, width: int = 5) -> DataFrame:
    """nodes: (node, fp, n, keys, first); docs: (k1, k2, text). (node, root) as by ``components``, of the links that the sets
    confirm. A refused link may have stood for others of its bucket, so buckets with links left over between different components
    are looked at once more, with the sets of their nodes: then each link of a bucket was confirmed, refused, or lies within a component."""
    rooted = nodes.withColumn("root", F.col("node"))
    found = staged(similar_links(rooted, similarity, radius), "simhash-links")
    pairs = staged(found.filter("a is not null").select("a", "b").distinct(), "simhash-pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()  # whoever has links has one in a first forest
    owners = staged(nodes.join(met, "node").select("first.k1", "first.k2", "node"), "simhash-owners")
    sets = staged(sets_of(docs, owners, width), "simhash-sets")
    good = staged(confirmed(pairs, sets, similarity), "simhash-confirmed")
    roots = components(good)
    only = found.filter("g is not null").select("g").distinct()
    if only.isEmpty():
        return roots
    rooted = staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("first"), "simhash-rooted")
    return components(good.union(staged(confirmed_links(rooted, sets, similarity, radius, only), "simhash-rest")))


def keep_one(docs: DataFrame, similarity: float = 0.8, radius: int = 20, width: int = 5) -> DataFrame:
    """Of each component the row with the smallest doc_id (null ids last), in its own columns; of equal rows one. Links: sets of
    shingles of so many words with that similarity or more (Jaccard). Texts of one set of shingles are one, and so are those without
    words. A link is missed if the two share no key or differ in more bits than the radius."""
    keyed = docs.select(packed(docs), "doc_id", "text", *doc_keys(F.col("doc_id"), F.col("text")))
    made = staged(sketches(keyed.select(F.struct("doc_id", "k1", "k2").alias("id"), "text"), width).select("id.*", "node", "fp", "n", "keys"), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k1", "k2")
    nodes = staged(made.groupBy("node", "fp", "n", "keys").agg(F.min(place).alias("first")), "simhash-distinct")
    roots = similar_components(nodes, keyed.select("k1", "k2", "text"), similarity, radius, width)
    firsts = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.k1", "first.k2", F.lit(True).alias("stays"))
    firsts = staged(firsts, "simhash-firsts")
    touched = made.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(firsts, ["k1", "k2"], "left").filter("n > 1 or stays is null")
    marked = may_have(keyed, staged(touched.select("k1"), "simhash-touched"))
    some = marked.filter("may").join(firsts, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row")
    return marked.filter("not may").select("row").unionByName(some).select(*unpacked(docs))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
