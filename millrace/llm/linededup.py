"""Line dedup by content-defined line chunks.

Words are runs without ASCII white space; a character of a script written without spaces (U+3000 to U+DFFF) is a word by
itself. Lines end at line feeds. Long lines are folded first: of every ``FOLD`` words of a text the one that begins the
smallest two-word hash closes a line, so lines lie alike wherever a passage stands in a paragraph.

A line's hash is built from its words' and the white space between them. A rolling hash runs over each two lines; where it
is smaller than at its neighbours it closes a chunk. A chunk so holds two lines at least (but for a text's ends), about
three, and its boundaries follow the content: a passage of 50 words brings its own chunks along. Lines without a smallest
place are cut after ``MOST``.

Chunks whose hash occurs more than once are the repeated ones. The first of each (smallest doc_id; in it, the first place)
stays. Elsewhere neighbouring ones go together if they have ``SEED`` words, and ``least`` with what they grow by. They grow
at both ends of a run of repeated chunks, word by word, as far as the text there equals that at the same end in the earliest
document whose run ends with that chunk: a passage's first and last words lie in chunks shared with what surrounds it. Carried
along for that are the neighbouring chunk and ``NEAR`` more words, beyond which equal text would make a repeated chunk.
Nothing is cut inside a word or a character, and words that what went had kept apart get a space. Short repeated lines stay.

Byte comparison: the distinct pairs of hash and text are counted for every repeated hash; a hash with two texts removes
nothing, and what a chunk grows by is compared byte by byte. The first pass gathers a hash, a count and a first place per
chunk. Texts follow only for runs that pass a Bloom filter of the repeated hashes (``BITS`` a key, at most ``MOST_BITS``);
runs are cut anew where a chunk passed falsely, so the filter's size costs rows, not results. Whole documents are shuffled only
if they pass a like filter of the documents that lose something. Hashes that hold a thousandth of all rows or more, at most a
thousand, are salted in joins.

Null text stays null, an empty one empty. Null doc_id comes last in the order. Rows of one doc_id don't lose to each other, rows
equal in doc_id and text lose alike; ids that aren't integers are ordered by a hash. A text of which nothing is left becomes
empty. Extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, doc_keys, hot_keys, packed, passes, small_batches, split_join, staged

FOLD, MOST, SEED, LEAST, NEAR = 5, 8, 10, 20, 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd multipliers of the hashes of words, lines and chunks.
B_BYTE, B_WORD, B_LINE, B_GAP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


TABLE = 1 << 18
_BYTES, _BACK, _WORDS, _LINES = _powers(B_BYTE, TABLE), _powers(pow(B_BYTE, -1, 1 << 64), TABLE), _powers(B_WORD, 4096), _powers(B_LINE, MOST)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(B_WORD)
    return x ^ (x >> np.uint64(29))


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over x[i : i + width] for each i that has so many."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def word_edges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in bytes of UTF-8 that end with white space."""
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(a) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    wide = np.flatnonzero((a >= 0xE3) & (a <= 0xED))  # first bytes of the characters that are words by themselves
    if len(wide):
        after = np.minimum(wide + 3, len(a) - 1)
        more = np.concatenate([wide, after[~space[after]]])
        start, stop = np.union1d(start, more), np.union1d(stop, np.concatenate([wide[(wide > 0) & ~space[wide - 1]], after]))
    return start, stop


def word_hashes(a: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sum of byte x B_BYTE^place (modulo TABLE), mixed."""
    if len(a) <= TABLE:  # no word is longer than the table: differences of one running sum
        total = np.concatenate([[np.uint64(0)], np.cumsum(a * _BYTES[: len(a)], dtype=np.uint64)])
        return _mix((total[stop] - total[start]) * _BACK[start])
    inside = np.arange(len(a))
    inside -= np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(a)]])))
    value = a * _BYTES[inside & (TABLE - 1)]
    value[_SPACE[a]] = 0
    return _mix(np.add.reduceat(value, start))


class Chunks:
    """The chunks of some texts: document, first byte, end of content, first byte of what follows (in the document), words, hash."""

    def __init__(self, texts: list[bytes]):
        buf = b"\n".join(texts) + b"\n"
        self.buf = buf
        a = np.frombuffer(buf, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(sizes + 1) - sizes - 1  # of each document in buf
        start, stop = self.start, self.stop = word_edges(a)
        n = len(start)
        if not n:
            self.doc = self.begin = self.end = self.next = self.words = self.first = self.last = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        word = word_hashes(a, start, stop)
        doc = np.searchsorted(self.at, start, side="right") - 1
        new_doc = np.empty(n, bool)
        new_doc[0], new_doc[1:] = True, doc[1:] != doc[:-1]
        ends_doc = np.append(new_doc[1:], True)
        # lines
        feeds = np.searchsorted(start, np.flatnonzero(a == 10))
        new_line = new_doc.copy()
        new_line[feeds[feeds < n]] = True
        two = word.copy()
        two[:-1] = _mix(word[:-1] * np.uint64(3) + word[1:])
        two[ends_doc] = word[ends_doc]
        if n >= FOLD:
            low = _sliding(np.minimum, two, FOLD)
            low[doc[: n - FOLD + 1] != doc[FOLD - 1 :]] = 0  # windows lie within a document
            pad = np.zeros(FOLD - 1, np.uint64)
            closes = _sliding(np.maximum, np.concatenate([pad, low, pad]), FOLD) == two
            new_line[1:] |= closes[:-1]
        line = np.flatnonzero(new_line)
        size = np.diff(line, append=n)
        gap = np.zeros(n, np.uint64)
        gap[:-1] = (start[1:] - stop[:-1]).astype(np.uint64) * np.uint64(B_GAP)
        gap[ends_doc] = 0
        last = line + size - 1
        closing = gap[last]
        gap[last] = 0  # what follows a line belongs to the chunk, if it goes on
        place = np.arange(n) - np.repeat(line, size)
        of_line = _mix(np.add.reduceat((word + gap) * _WORDS[place & 4095], line) + size.astype(np.uint64))
        # chunks
        m = len(line)
        first_of_doc = new_doc[line]
        rolled = np.empty(m + 1, np.uint64)
        rolled[1:m] = _mix(of_line[:-1] * np.uint64(B_LINE) + of_line[1:])
        rolled[np.append(first_of_doc, True)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        opens = first_of_doc.copy()
        opens[2:] |= (rolled[1 : m - 1] < rolled[: m - 2]) & (rolled[1 : m - 1] <= rolled[2:m])
        cut = np.flatnonzero(opens)
        inside = np.arange(m) - np.repeat(cut, np.diff(cut, append=m))
        opens[inside % MOST == 0] = True
        inside %= MOST
        cut = np.flatnonzero(opens)
        closing[np.append(cut[1:], m) - 1] = 0
        self.first, self.last = line[cut], last[np.append(cut[1:], m) - 1]  # words of chunks
        self.doc, self.words = doc[self.first], self.last - self.first + 1
        self.hash = _mix(np.add.reduceat((of_line + closing) * _LINES[inside], cut) + self.words.astype(np.uint64))
        origin = self.at[self.doc]
        self.begin, self.end = start[self.first] - origin, stop[self.last] - origin
        same = np.append(self.doc[1:] == self.doc[:-1], False)
        self.next = np.where(same, np.append(self.begin[1:], 0), sizes[self.doc])


PART = 1 << 17


def parts_of(batch):
    """(rows, their texts): a batch in runs of about PART bytes, so that what is computed on stays in a processor's cache."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]  # UTF-8 as it came
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) + i - lo >= TABLE:
            yield batch.slice(lo, i - lo), texts[lo:i]
            lo, size = i, 0
        size += len(t)
        if size >= PART or i + 1 == len(texts):
            yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
            lo, size = i + 1, 0


def repeated_hashes(docs: DataFrame) -> DataFrame:
    """hash, n, first (the smallest ord) of the chunks that occur more than once."""

    def counted(held):
        h, ord_, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ord_, h))
        h, ord_, n = h[order], ord_[order], n[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(n, at) if len(at) else n), pa.array(ord_[at])], ["hash", "n", "first"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for rows, texts in parts_of(b):
                c = Chunks(texts)
                held.append((c.hash, rows.column("ord").to_numpy()[c.doc], np.ones(len(c.hash), np.int64)))
                size += len(c.hash)
            if size > 1 << 17:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return docs.select("ord", "text").mapInArrow(run, "hash long, n long, first long").groupBy("hash").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter("n > 1")


RUNS = "ord long, k1 long, k2 long, run int, units array<struct<hash:long,s:int,e:int,f:int,words:int,again:boolean>>, body binary, left binary, right binary"


def candidates(docs: DataFrame, bitmap: np.ndarray, seed: int) -> DataFrame:
    """Runs of chunks that pass the filter, of at least seed words: document, first chunk's number, chunks (again: the document has
    it before), their text, and what is around."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("hash", pa.int64()), *[(n, pa.int32()) for n in ("s", "e", "f", "words")], ("again", pa.bool_())]))

    def run(batches):
        for b, texts in (x for whole in batches for x in parts_of(whole)):
            c = Chunks(texts)
            hit = passes(shared.value, c.hash.view(np.int64))
            same = c.doc[1:] == c.doc[:-1]
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~(hit[:-1] & same)
            closes[:-1] &= ~(hit[1:] & same)
            first, last = np.flatnonzero(opens), np.flatnonzero(closes)
            total = np.concatenate([[0], np.cumsum(c.words)])
            enough = total[last + 1] - total[first] >= seed
            first, last = first[enough], last[enough]
            every = np.flatnonzero(hit)
            order = every[np.lexsort((c.hash[every], c.doc[every]))]
            again = np.zeros(len(hit), bool)
            again[order[1:]] = (c.hash[order[1:]] == c.hash[order[:-1]]) & (c.doc[order[1:]] == c.doc[order[:-1]])
            size = last - first + 1
            at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            doc, o = c.doc[first], c.at[c.doc[first]]
            stop = np.append(c.at[1:] - 1, len(c.buf) - 1)[doc] if len(doc) else doc
            s, e = o + c.begin[first], o + c.end[last]
            edge = np.flatnonzero(np.append(True, ~same)) if len(hit) else np.empty(0, np.int64)
            low = edge[np.searchsorted(edge, first, side="right") - 1]  # the document's first and last chunk
            high = np.append(edge[1:], len(hit))[np.searchsorted(edge, first, side="right") - 1] - 1
            near = c.first[np.maximum(first - 1, low)] - NEAR
            left = np.where(near <= c.first[low], o, c.start[np.maximum(near, c.first[low])])
            near = c.last[np.minimum(last + 1, high)] + NEAR
            right = np.where(near >= c.last[high], stop, c.stop[np.minimum(near, c.last[high])])
            left, s, e, right = (x.tolist() for x in (left, s, e, right))
            parts = pa.StructArray.from_arrays([pa.array(c.hash[at].view(np.int64)), *[pa.array(x[at].astype(np.int32)) for x in (c.begin, c.end, c.next, c.words)], pa.array(again[at])], fields=list(kind.value_type))
            units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), parts)
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n).take(row) for n in ("ord", "k1", "k2")], pa.array((first - low).astype(np.int32)), units, *[pa.array([c.buf[x:y] for x, y in zip(p, q, strict=True)], pa.binary()) for p, q in ((s, e), (left, s), (e, right))]],
                ["ord", "k1", "k2", "run", "units", "body", "left", "right"],
            )

    return docs.select("ord", "k1", "k2", "text").mapInArrow(run, RUNS)


def without_false(x: dict, false: set[int]):
    """The runs that are left of a candidate without the places of chunks that passed falsely."""
    units, body = x["units"], x["body"]
    real = [i for i in range(len(units)) if i not in false]
    opens = [k for k in range(len(real)) if not k or real[k] != real[k - 1] + 1]
    for a, z in pairwise([*opens, len(real)] if real else []):
        part = units[real[a] : real[z - 1] + 1]
        s, e = part[0]["s"] - units[0]["s"], part[-1]["e"] - units[0]["s"]
        yield x | {"run": x["run"] + real[a], "units": part, "body": body[s:e], "left": x["left"] + body[:s], "right": body[e:] + x["right"]}


def runs_of(found: DataFrame, marks: DataFrame) -> DataFrame:
    """The candidates, cut anew where chunks only passed the filter. These are few, so the texts stay where they are while the list of
    them is small enough to be sent out; adaptive execution sees to that."""
    place = ("k1", "k2", "run")
    false = marks.filter("first is null").groupBy(*place).agg(F.collect_set("i").alias("false"))

    def run(batches):
        for b in batches:
            names = [n for n in b.schema.names if n != "false"]
            whole = pc.is_null(b.column("false"))
            yield b.filter(whole).select(names)
            rows = [{n: y[n] for n in names} for x in b.filter(pc.invert(whole)).to_pylist() for y in without_false(x, set(x["false"]))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([b.schema.field(n) for n in names]))

    return found.join(false, list(place), "left").select("ord", *place, "units", "body", "left", "right", "false").mapInArrow(run, RUNS)


def shared_end(a: bytes, b: bytes) -> tuple[int, int]:
    """(bytes, words) of the whole words that both end with, white space between them and after them included."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[-n - 1] == b[-n - 1]:
        n += 1
    starts, stops = (x.tolist() for x in word_edges(np.frombuffer(a + b"\n", np.uint8)))
    other = set((len(b) - word_edges(np.frombuffer(b + b"\n", np.uint8))[0]).tolist())
    for i, s in enumerate(starts):
        if len(a) - s <= n and len(a) - s in other:
            return len(a) - s, len(starts) - i
    return 0, 0


def shared_start(a: bytes, b: bytes) -> tuple[int, int]:
    """The same at the start."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    stops = word_edges(np.frombuffer(a + b"\n", np.uint8))[1].tolist()
    other = set(word_edges(np.frombuffer(b + b"\n", np.uint8))[1].tolist())
    for i in range(len(stops) - 1, -1, -1):
        if stops[i] <= n and stops[i] in other:
            return stops[i], i + 1
    return 0, 0


def ranges_of(units: list[tuple], least: int, seed: int) -> list[tuple[int, int]]:
    """units: (number, s, e, f, words, bytes and words to add left, the same right) of one document's repeated chunks that aren't
    the first of their kind. Byte ranges that go, merged."""
    out: list[tuple[int, int]] = []
    held: list[tuple] = []

    def close():
        words = sum(u[4] for u in held)
        if held and words >= seed and words + held[0][6] + held[-1][8] >= least:
            a, z = held[0], held[-1]
            # up to what follows; where it grew to the right, up to the grown end
            out.append((a[1] - a[5], z[2] + z[7] if z[7] else z[3]))

    for u in sorted(units):
        if held and u[0] != held[-1][0] + 1:
            close()
            held = []
        held.append(u)
    close()
    merged: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def _grown(side: str) -> Column:
    @F.pandas_udf("struct<bytes:int,words:int>")
    def run(own: pd.Series, first: pd.Series) -> pd.DataFrame:
        f = shared_end if side == "left" else shared_start
        return pd.DataFrame([f(a, b) for a, b in zip(own, first, strict=True)], columns=["bytes", "words"]).astype("int32")

    return run.asNondeterministic()(F.col(side), F.col(f"first_{side}"))  # else a filter on what it returns runs it twice, in two workers a task


def order_of(doc_id: Column, kind: str, key: Column) -> Column:
    """A long that puts documents in order: an integer doc_id, null last; else a hash."""
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1)) if kind in ("byte", "short", "integer", "long") else key


def removals(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """texts: (ord, k1, k2, text). k1, k2, gone: byte ranges (s, e), in order, of the documents that lose some."""
    texts = texts.filter("text is not null and text <> ''")
    repeated = staged(repeated_hashes(texts), "line-repeats")
    n_chunks = repeated.agg(F.sum("n")).first()[0] or 0
    found = staged(candidates(texts, bloom_filter(repeated.select("hash")), seed), "line-candidates")
    hot = hot_keys(repeated.select("hash", "n"), "hash", n_chunks)
    units = found.select("ord", "k1", "k2", "run", F.posexplode("units").alias("i", "u")).select("ord", "k1", "k2", "run", "i", "u.*")
    marks = staged(split_join(units, repeated.select("hash", "first"), "hash", hot, "left").select("ord", "k1", "k2", "run", "i", "hash", "s", "e", "f", "words", "again", "first"), "line-marks")
    runs = staged(runs_of(found, marks), "line-runs")
    start = F.col("units")[0]["s"]
    bodies = runs.select(F.explode(F.transform("units", lambda u: F.struct(u["hash"].alias("hash"), F.substring("body", u["s"] - start + 1, u["e"] - u["s"]).alias("text")))).alias("u")).select("u.*")
    unlike = staged(bodies.distinct().groupBy("hash").count().filter("count > 1").select("hash"), "line-unlike")  # two texts with one 64-bit hash: next to none
    later = marks.filter("first is not null and (ord > first or again)")
    later = (later if unlike.isEmpty() else later.join(unlike, "hash", "left_anti")).select("k1", "k2", (F.col("run") + F.col("i")).alias("unit"), "s", "e", "f", "words")

    def grown(side):
        edge = F.element_at("units", 1 if side == "left" else -1)
        ends = runs.filter(F.octet_length(side) > 0).select("ord", "k1", "k2", (F.col("run") + (0 if side == "left" else F.size("units") - 1)).cast("int").alias("unit"), edge["hash"].alias("hash"), side)
        firsts = ends.groupBy("hash").agg(F.min_by(side, F.struct("ord", "k1", "unit")).alias(f"first_{side}"), F.min("ord").alias("q"), F.max("ord").alias("z"), F.count("*").alias("n")).filter("z > q").select("hash", f"first_{side}", "q", "n")
        firsts = staged(firsts, "line-ends")
        hot = hot_keys(firsts, "hash", firsts.agg(F.sum("n")).first()[0] or 0)
        return split_join(ends, firsts.drop("n"), "hash", hot).filter("ord > q").select("k1", "k2", "unit", _grown(side).alias("g")).filter("g.bytes > 0")

    names = ("kind", "unit", "s", "e", "f", "words")
    rows = later.select("k1", "k2", F.lit(0).alias("kind"), *names[1:])
    for kind, side in enumerate(("left", "right"), start=1):
        rows = rows.unionByName(grown(side).select("k1", "k2", F.lit(kind).alias("kind"), "unit", F.col("g.bytes").alias("s"), F.col("g.words").alias("e"), F.lit(0).alias("f"), F.lit(0).alias("words")))
    lists = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("rows"))
    found_kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def cut(batches):
        for b in batches:
            column = b.column("rows")
            flat = column.flatten()
            fields = list(zip(*(flat.field(i).to_pylist() for i in range(len(names))), strict=True))
            cuts = (np.asarray(column.offsets) - np.asarray(column.offsets)[0]).tolist()
            gone = [[{"s": s, "e": e} for s, e in ranges_of(assembled(fields[x:y]), least, seed)] for x, y in pairwise(cuts)]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(gone, found_kind)], ["k1", "k2", "gone"])

    return lists.mapInArrow(cut, "k1 long, k2 long, gone array<struct<s:int,e:int>>").filter(F.size("gone") > 0)


def assembled(rows: list[tuple]) -> list[tuple]:
    """rows: (0, unit, s, e, f, words) of a chunk that goes, (1 or 2, unit, bytes, words, ..) of what it grows by to the left or right.
    The chunks with their growth. Equal rows, of equal documents, count once."""
    grow = ({}, {}, {})
    for r in rows:
        grow[r[0]][r[1]] = r[1:] if r[0] == 0 else r[2:4]
    return [(*u, *grow[1].get(k, (0, 0)), *grow[2].get(k, (0, 0))) for k, u in grow[0].items()]


#: Neither white space nor a character that is a word by itself.
INNER = r"[^\x09-\x0D\x20\u3000-\uD7FF]"


def without(text, gone) -> Column:
    """The text without byte ranges; a space where two words would meet that only what went had kept apart."""
    raw = F.encode(text, "UTF-8")
    n = F.size(gone)
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i > 0, F.get(gone, i - 1)["e"]).otherwise(0).alias("s"), F.when(i < n, F.get(gone, i)["s"]).otherwise(F.octet_length(text)).alias("e")))
    parts = F.transform(kept, lambda r: F.decode(F.substring(raw, r["s"] + 1, r["e"] - r["s"]), "UTF-8"))
    meet = lambda left, right: F.substring(left, -1, 1).rlike(INNER) & F.substring(right, 1, 1).rlike(INNER)
    return F.aggregate(parts, F.lit(""), lambda left, right: F.concat(left, F.when(meet(left, right), " ").otherwise(""), right))


def shortened(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """row (a struct of all columns but text), text as it is left, gone (the byte ranges removed; null: none)."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    keyed = docs.select(packed(docs, "text"), text.alias("text"), *doc_keys(F.col("doc_id"), text))
    order = order_of(F.col("row.doc_id"), docs.schema["doc_id"].dataType.typeName(), F.col("k1"))
    gone = staged(removals(keyed.select(order.alias("ord"), "k1", "k2", "text"), least, seed), "line-removals")
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(gone.select("k1")))

    @F.pandas_udf("boolean")
    def may_lose(k: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, k.to_numpy().astype(np.int64)))

    marked = keyed.withColumn("may", may_lose("k1"))
    same = marked.filter(~F.col("may")).select("row", "text", F.lit(None).cast("array<struct<s:int,e:int>>").alias("gone"))
    cut = marked.filter("may").join(gone, ["k1", "k2"], "left").select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("gone"))).alias("text"), "gone")
    return same.unionByName(cut)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text shortened, in their own columns."""
    return shortened(docs, **options).select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_rest(docs: DataFrame, **options) -> DataFrame:
    """docs without their repeated chunks, in their own columns; n_chars, if there, follows. Rows of which nothing but white space is left go."""
    out = shortened(docs, **options).filter(F.col("gone").isNull() | F.col("text").rlike(r"[^\x09-\x0D\x20]"))

    def column(c):
        if c == "text":
            return F.col("text")
        own = F.col("row").getField(c)
        return (F.when(F.col("gone").isNull(), own).otherwise(F.length("text")).cast(docs.schema[c].dataType) if c == "n_chars" else own).alias(c)

    return out.select(*map(column, docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (ranges), removed (start:end in bytes of UTF-8, joined), text_sha256 (of what is left)."""
    found = shortened(docs.select("doc_id", "text"))
    shown = F.array_join(F.transform("gone", lambda g: F.concat_ws(":", g["s"].cast("string"), g["e"].cast("string"))), ",")
    return found.select("row.doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(shown, F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
