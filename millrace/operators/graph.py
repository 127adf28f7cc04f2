"""Knowledge graph: entity linking in text, one-hop expansion, relation strings.

Names are found in texts by hashes of byte windows, in one pass over the texts for a dictionary of any size: a window as
long as the largest power of two in a name is looked up in a filter of the names' beginnings, then the whole of each length that names
of that class have in a filter of whole names, and what passes is joined with the names themselves, which compares the text. Joins with
edges deal the edges of hubs over all partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import Windows, bit_filter, held
from ..functions.skew import hot_keys, spread_join
from ..functions.text import text_or_empty

SEPARATOR = "；"
#: Bytes of a text that are looked at together.
CHUNK = 1 << 20


def named_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that have a name; of equal names the last inserted (largest id)."""
    return nodes.filter(text_or_empty("name") != "").groupBy("name").agg(F.max_by(F.struct(*nodes.columns), "id").alias("n")).select("n.*")


def _hashes(names: DataFrame) -> DataFrame:
    """size, low (hash of the beginning) and whole of each name, in bytes."""

    def run(batches):
        for b in batches:
            raw = [x.encode() for x in b.column("name").to_pylist()]
            n = np.array([len(x) for x in raw], np.int64)
            w, start = Windows(np.frombuffer(b"".join(raw), np.uint8)), np.cumsum(n) - n
            low = w(start, 1 << (np.frexp(n)[1] - 1).astype(np.int64)) if len(n) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(low.view(np.int64)), pa.array(w(start, n).view(np.int64) if len(n) else np.empty(0, np.int64))], ["size", "low", "whole"])

    return names.mapInArrow(run, "size long, low long, whole long")


def occurrences(data: np.ndarray, sizes: dict[int, list[int]], lows: np.ndarray, wholes: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (below upto) and sizes of the windows of data that both filters hold. sizes: of each class (a power of two) the sizes of its names."""
    w, starts, found = Windows(data), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low, some in sizes.items():
        at = np.arange(max(0, min(upto, len(data) - low + 1)))
        at = held(lows, w(at, low))
        for size in some if len(at) else ():
            own = at[at + size <= len(data)]
            own = own[held(wholes, w(own, size))]
            starts.append(own)
            found.append(np.full(len(own), size))
    return np.concatenate(starts), np.concatenate(found)


def match_names(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence, overlapping ones too, of a name in a text: key, name, start (from 1, code points), ordered by nothing. One scan of the
    texts; what is broadcast is bounded (two filters of at most 32 MB, and the sizes that names have). Null and empty texts and names: none."""
    spark = texts.sparkSession
    names = names.select("name").filter(text_or_empty("name") != "").distinct()
    hashes = _hashes(names)
    sizes = sorted(r[0] for r in hashes.select("size").distinct().collect())  # numbers up to the longest name's
    n = names.count()
    if not sizes:
        return texts.select(key, F.lit("").alias("name"), F.lit(0).alias("start")).limit(0)
    classes: dict[int, list[int]] = {}
    for s in sizes:
        classes.setdefault(1 << (s.bit_length() - 1), []).append(s)
    shared = spark.sparkContext.broadcast((classes, bit_filter(hashes.select("low"), n), bit_filter(hashes.select("whole"), n), sizes[-1]))

    def run(batches):
        classes, lows, wholes, longest = shared.value
        for b in batches:
            rows, found, places = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                raw, before = (t or "").encode(), 0
                data = np.frombuffer(raw, np.uint8)
                for lo in range(0, len(data), CHUNK):
                    part = data[lo : lo + CHUNK + longest - 1]
                    first = (part & 0xC0) != 0x80
                    char = before + np.cumsum(first)  # code points up to here
                    start, size = occurrences(part, classes, lows, wholes, min(CHUNK, len(part)))
                    ok = first[start]
                    for a, s in zip(start[ok].tolist(), size[ok].tolist(), strict=True):
                        try:
                            found.append(raw[lo + a : lo + a + s].decode())
                        except UnicodeDecodeError:  # it ends inside a character, so it is no name
                            continue
                        rows.append(i)
                        places.append(int(char[a]))
                    before += int(first[:CHUNK].sum())
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int32())], [key, "name", "start"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, name string, start int").join(names, "name", "left_semi").select(key, "name", "start")


def one_hop(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """entities: (name). name, start_name, rel, end_name of every edge that touches the entity, in either direction, once."""
    ids = entities.select("name").distinct().join(nodes.select("id", "name"), "name")
    e = edges.select("src", "rel", "dst")
    hubs = {end: hot_keys(e, end) for end in ("src", "dst")}

    def touching(end):
        return spread_join(e, ids.select(F.col("id").alias(end), "name"), end, hubs[end]).select("name", "src", "rel", "dst")

    touched = touching("src").unionByName(touching("dst"))
    for end, name in (("src", "start_name"), ("dst", "end_name")):
        touched = spread_join(touched, nodes.select(F.col("id").alias(end), F.col("name").alias(name)), end, hubs[end])
    return touched.select("name", "start_name", "rel", "end_name").distinct()


def relation_rows(matches: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """matches: (key, name). key, r: the distinct relations of its entities, properties and edges, a row each, so a hub is nowhere gathered."""
    wanted = matches.select(key, "name").distinct()
    own = named_nodes(nodes).select("name", F.explode("props").alias("__k", "__v"))
    props = wanted.join(own, "name").select(key, F.concat("name", F.lit(" "), "__k", F.lit(": "), "__v").alias("r"))
    hops = one_hop(wanted, nodes, edges).select("name", F.concat_ws(" ", "start_name", "rel", "end_name").alias("r"))
    return props.unionByName(spread_join(hops, wanted, "name", hot_keys(hops, "name")).select(key, "r")).distinct()


def relation_strings(matches: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, relations: the rows of ``relation_rows``, sorted and joined; null if none. A key's relations are one value here."""
    rows = relation_rows(matches, nodes, edges, key).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("r")), SEPARATOR).alias("relations"))
    return matches.select(key).distinct().join(rows, key, "left")


def present(texts: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return texts.join(matches.select(key).distinct(), key, "left_semi")
