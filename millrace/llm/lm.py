"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy, and the words' counts.

The model writes a text word by word (the end is one). A word comes from the counts with some probability (c / N over
the training tokens), else it is spelt by the attention model; its probability is the sum of both, so over all words, and at every size of the
corpus, they add up to one. A word is a known one with ``known``, Good and Turing's 1 - (singletons + 1) / (N + 2), and a known one comes from
the counts with a share that is learned: of ``SHARES`` the one under which the training texts' known words are likeliest, each scored by the
counts without itself. All others, known or new, are the attention model's.

Spelling: P(subword | those before) = P(class | those before) P(subword | class). Classes hold either subwords that begin a
word (they begin with its space) or others, so the same softmax says whether a word ends. A word's probability is that of
its subwords, the first among those that begin a word, times that of a beginning after it. The common ``COMMON`` subwords
fall into classes by k-means on their left contexts, the rest by frequency bands; P(subword | class) are smoothed counts.
P(class | those before) is one attention head with learned relative positions over embeddings (an own one for each common subword,
its class's for the rest) and a skip from the last subword's class that starts at counts.

Training takes in every subword of every training text: data-parallel Adam, every partition on its own texts, parameters
averaged by their weights, ``rounds`` times. Scoring cuts a text's subwords into windows of 2 x HOP that overlap by HOP; a
window's last HOP positions are scored, each token once, by batched attention under a causal mask that also hides what is
before the text.

Counts of words above a count threshold (so chosen that at most ``hot`` words are) are broadcast, a bounded dictionary; all
other words, with the probabilities they were spelt with, are looked up by a join, for the base model (add-one unigrams of
words) and the score alike. So all counts enter, however many.

Words: A-Z lower-cased, ASCII white space parts them, then one end. Null text: the end only. Null doc_id: trained on, not
held out. No training rows: N = 0, all unknown, uniform model. Repeated rows are scored each. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import kmeans
from .common import gathered, highest, small_batches, staged
from .pieces import Kept
from .tokencount import EOD, encoding, rank_file

HOP = 16
PIECES = EOD + 1
CONTEXTS, COMMON = 256, 4096
FLUSH = 400_000
#: What the share of the counts in known words may be.
SHARES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(modulus: int = 7, remainder: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all rows; the end is the empty word."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(words_of(text))
            counts[b""] += b.num_rows
            if len(counts) > FLUSH:
                yield flush()
                counts = Counter()
        if counts:
            yield flush()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hot_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    found = highest(counts, most)
    if found is None:
        return {}
    t = found.toArrow()
    return dict(zip(t["word"].to_pylist(), t["c"].to_pylist(), strict=True))


def count_subwords(counts: DataFrame, ranks) -> np.ndarray:
    """How often each subword stands in the training texts."""

    def run(batches):
        encode = encoder(ranks.value)
        total = np.zeros(PIECES, np.int64)
        for b in gathered(batches, 1 << 16):
            size, z = flat_pieces(encode, b.column("word").to_pylist())
            total += np.bincount(z, np.repeat(b.column("c").to_numpy().astype(np.float64), size), PIECES).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "c"])

    found = counts.mapInArrow(run, "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c")).toArrow()  # at most a row for each subword
    out = np.zeros(PIECES, np.int64)
    out[found["piece"].to_numpy()] = found["c"].to_numpy()
    return out


def flat_pieces(encode, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subwords per word, and all subwords in a row."""
    pieces = [pieces_of(encode, w) for w in words]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return size, np.fromiter(chain.from_iterable(pieces), np.int64, int(size.sum()))


def pieces_of(encode, word: bytes) -> list[int]:
    """Subword ids of a word with the space before it, taken as one unit of the tokenizer; the end has its own id."""
    return encode(b" " + word) if word else [EOD]


def encoder(ranks: bytes):
    return encoding(ranks)._core_bpe.encode_single_piece


def beginners(ranks: bytes) -> np.ndarray:
    """Which subwords begin a word: those that begin with its space, and the end."""
    found = encoding(ranks)
    out = np.zeros(PIECES, bool)
    for i in range(EOD):
        out[i] = found.decode_single_token_bytes(i)[:1] == b" "
    out[EOD] = True
    return out


#: Stands before each text's subwords.
BEGIN = (1 << 16) - 1


def take_pieces(train: DataFrame, ranks) -> DataFrame:
    """Stored: pieces, BEGIN and all of a text's subwords as 16-bit ids."""

    def run(batches):
        encode = encoder(ranks.value)
        known = Kept(lambda w: array("H", pieces_of(encode, w)).tobytes(), FLUSH)
        begin, end = array("H", [BEGIN]).tobytes(), known[b""]
        for b in batches:
            out = [b"".join(chain([begin], map(known.__getitem__, words_of(text)), [end])) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["pieces"])

    return staged(train.select("text").mapInArrow(run, "pieces binary"), "lm-pieces")


def _pieces(batch) -> list[np.ndarray]:
    """The texts' subwords, each after BEGIN, a text at a time so that few are held in full width."""
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column("pieces").to_pylist()]


def count_follows(taken: DataFrame, totals: np.ndarray) -> np.ndarray:
    """(COMMON pieces by count) x (CONTEXTS commonest pieces before them, and other; a text's beginning is other)."""
    order = np.argsort(-totals, kind="stable")
    place = np.full(PIECES, COMMON, np.int64)
    place[order[:COMMON]] = np.arange(COMMON)
    shared = taken.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        place = shared.value
        total = np.zeros((COMMON + 1) * (CONTEXTS + 1), np.int64)
        for b in batches:
            seq = np.concatenate(_pieces(b) or [np.empty(0, np.int64)])
            at = np.where(seq == BEGIN, COMMON, place[np.minimum(seq, EOD)])
            live = seq[1:] != BEGIN
            total += np.bincount(at[1:][live] * (CONTEXTS + 1) + np.minimum(at[:-1][live], CONTEXTS), minlength=len(total))
        total = total.reshape(COMMON + 1, CONTEXTS + 1)
        piece, before = np.nonzero(total[:COMMON])
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(total[piece, before])], ["piece", "before", "n"])

    found = taken.mapInArrow(run, "piece int, before int, n long").groupBy("piece", "before").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((COMMON, CONTEXTS + 1))
    out[found["piece"].to_numpy(), found["before"].to_numpy()] = found["n"].to_numpy()
    return out


def classes_of(totals: np.ndarray, follows: np.ndarray, begins: np.ndarray, classes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each piece, and log P(piece | class). A class holds pieces that begin words or pieces that don't. About ``classes``,
    none without pieces."""
    order = np.argsort(-totals, kind="stable")
    bands, own = classes // 4, classes // 3
    out = np.empty(PIECES, np.int64)
    out[order[:own]] = np.arange(own)  # the commonest are their own classes
    context = np.sqrt(follows + 1e-3)
    context = (context / np.sqrt((context**2).sum(axis=1, keepdims=True))).astype(np.float32)
    n, smoothed = own, totals + 0.5
    for members, many, near in ((np.arange(own, COMMON), classes - bands - own, True), (np.arange(COMMON, PIECES), bands, False)):
        weight = np.array([smoothed[order[members[begins[order[members]] == side]]].sum() for side in (False, True)])
        first = int(np.clip(round(many * weight[0] / weight.sum()), 1, many - 1))
        for side, k in ((False, first), (True, many - first)):
            at = members[begins[order[members]] == side]
            if not len(at):
                continue
            if near:
                centers = kmeans(context[at], k, rounds=15, seed=seed)
                out[order[at]] = n + np.argmin((centers**2).sum(axis=1) / 2 - context[at] @ centers.T, axis=1)
            else:
                mass = np.cumsum(smoothed[order[at]])
                out[order[at]] = n + np.minimum((mass / mass[-1] * k).astype(np.int64), k - 1)
            n += k
    out = np.unique(out, return_inverse=True)[1]
    return out, np.log(smoothed / np.bincount(out, smoothed)[out])


def rows_of(totals: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """The embedding of each piece: an own one if it is common, else its class's. The last row is a text's beginning."""
    order = np.argsort(-totals, kind="stable")
    out = COMMON + class_of
    out[order[:COMMON]] = np.arange(COMMON)
    return out.astype(np.int32)


def count_class_pairs(taken: DataFrame, class_of: np.ndarray, classes: int) -> np.ndarray:
    """(classes + 1 for the beginning) x classes: which class follows which."""
    shared = taken.sparkSession.sparkContext.broadcast(class_of)

    def run(batches):
        class_of = shared.value
        total = np.zeros((classes + 1) * classes, np.int64)
        for b in batches:
            seq = np.concatenate(_pieces(b) or [np.empty(0, np.int64)])
            at = np.where(seq == BEGIN, classes, class_of[np.minimum(seq, EOD)])
            live = seq[1:] != BEGIN
            total += np.bincount(at[:-1][live] * classes + at[1:][live], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    found = taken.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((classes + 1) * classes)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(classes + 1, classes)


class Attention:
    """One causal head over embedding rows, with classes as its outcome. Parameters are one flat vector; row ``rows`` and class
    ``classes`` stand for a text's beginning."""

    def __init__(self, classes: int, rows: int, dim: int = 24, seed: int = 3):
        c, d = classes, dim
        self.c, self.d, self.rows = c, d, rows
        self.shapes = {"e": (rows + 1, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, c), "rel": (2 * HOP,), "skip": (c + 1, c)}
        self.ends = list(accumulate(map(math.prod, self.shapes.values())))
        rng = np.random.default_rng(seed)
        self.flat = np.concatenate([(rng.standard_normal(int(np.prod(s))) * {"rel": 0, "skip": 0, "e": 0.3}.get(n, d**-0.5)) for n, s in self.shapes.items()]).astype(np.float32)

    def begin_at(self, pairs: np.ndarray) -> None:
        """The skip starts as the log of the class pairs' smoothed shares."""
        share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * self.c)
        self.views(self.flat)["skip"][:] = np.log((pairs + 4 * share) / (pairs.sum(axis=1, keepdims=True) + 4))
        self.views(self.flat)["o"][:] *= 0.1

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {n: flat[a:z].reshape(s) for (n, s), a, z in zip(self.shapes.items(), [0, *self.ends], self.ends, strict=False)}

    def folded(self, p) -> tuple[np.ndarray, np.ndarray]:
        """What scores need of queries and keys, and logits of values and outcome: q k^T and v o. So rows stand for their own keys and
        values, which saves projecting every input, there and back."""
        return p["q"] @ p["k"].T * np.float32(self.d**-0.5), p["v"] @ p["o"]

    def tables(self):
        """Embeddings and queries of every row, and the outcome."""
        p = self.views(self.flat)
        near, out = self.folded(p)
        return p["e"], p["e"] @ near, out

    def attend(self, p, q, x, out, opens: np.ndarray, last: np.ndarray, a: np.ndarray | None = None):
        """q: (B, HOP, d); x: (B, 2 HOP, d); opens: windows at a text's beginning; last: (B, HOP) the class before each position. a: where
        the weights go. Weights before they are divided by their sums, sums, what they mix, logits."""
        a = np.matmul(q, x.transpose(0, 2, 1), out=a)
        np.minimum(a, np.float32(50), out=a)
        a += np.where(CAUSAL, np.minimum(p["rel"], np.float32(20))[DISTANCE], np.float32(-1e9))  # at most 70, so no maximum is subtracted
        a[opens, :, :HOP] = -1e9  # before the text
        np.exp(a, out=a)
        total = np.einsum("bij->bi", a)[:, :, None]
        mixed = a @ x
        mixed /= total
        logits = mixed.reshape(-1, self.d) @ out
        logits += np.take(p["skip"], last.ravel(), axis=0)
        return a, total, mixed, logits

    def log_prob(self, ids, opens, last, target, begins, tables=None) -> tuple[np.ndarray, np.ndarray]:
        """log P of each target class, and of any class that begins a word (begins: 1 for these, else 0): (B, HOP) each."""
        e, q, out = tables or self.tables()
        logits = self.attend(self.views(self.flat), np.take(q, ids[:, HOP:], axis=0), np.take(e, ids, axis=0), out, opens, last)[-1]
        at = np.take(logits, np.arange(len(logits), dtype=np.int32) * np.int32(self.c) + target.ravel())
        if not logits.max(initial=0) < 80:
            top = logits.max(axis=1)
            at, logits = at - top, logits - top[:, None]
        np.exp(logits, out=logits)
        total = np.log(logits @ np.ones(self.c, np.float32))
        return (at - total).reshape(target.shape), (np.log(np.maximum(logits @ begins, 1e-30)) - total).reshape(target.shape)

    def gradient(self, ids, opens, last, target, there) -> tuple[float, dict, np.ndarray]:
        """Mean loss over the targets that are there; gradients by name, of e for the rows named last."""
        p, c, d = self.views(self.flat), self.c, self.d
        near, out = self.folded(p)
        x = np.take(p["e"], ids, axis=0)
        own = np.ascontiguousarray(x[:, HOP:]).reshape(-1, d)
        # of each window: weights of values, then gradients of scores; gradients of what is mixed, then queries
        weights, both = np.empty((len(ids), 2 * HOP, 2 * HOP), x.dtype), np.empty((len(ids), 2 * HOP, d), x.dtype)
        a, ds, dm, q = weights[:, :HOP], weights[:, HOP:], both[:, :HOP], both[:, HOP:]
        q[:] = (own @ near).reshape(q.shape)
        _, total, mixed, logits = self.attend(p, q, x, out, opens, last, a)
        a /= total
        flat_there = there.ravel().astype(np.float32)
        n = max(1, int(flat_there.sum()))
        at = np.arange(0, logits.size, c) + target.ravel()
        if not logits.max(initial=0) < 80:
            logits -= logits.max(axis=1, keepdims=True)
        hit = np.take(logits, at)
        dl = np.exp(logits, out=logits)
        z = dl @ np.ones(c, np.float32)
        loss = -float(((hit - np.log(z)) * flat_there).sum()) / n
        weight = flat_there / np.float32(n)
        dl *= (weight / z)[:, None]
        dl.ravel()[at] -= weight
        g = {"skip": np.zeros((c + 1, c), np.float32)}
        kinds, sums = summed(last.ravel(), dl)
        g["skip"][kinds] = sums
        d_out = mixed.reshape(-1, d).T @ dl
        g["v"], g["o"] = d_out @ p["o"].T, p["v"].T @ d_out
        dm[:] = (dl @ out.T).reshape(dm.shape)
        np.matmul(dm, x.transpose(0, 2, 1), out=ds)
        ds -= np.einsum("bij,bij->bi", dm, mixed)[:, :, None]
        ds *= a
        g["rel"] = np.bincount(DISTANCE.ravel(), ds.sum(axis=0).ravel(), 2 * HOP).astype(np.float32)
        dq = (ds @ x).reshape(-1, d)
        d_near = own.T @ dq * np.float32(d**-0.5)
        g["q"], g["k"] = d_near @ p["k"], d_near.T @ p["q"]
        dx = weights.transpose(0, 2, 1) @ both
        dx[:, HOP:] += (dq @ near.T).reshape(q.shape)
        rows, g["e"] = summed(ids.ravel(), dx.reshape(-1, d))
        return loss, g, rows


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows of values under each key. Keys are classes or rows, so 16 bits hold them, which numpy sorts by digits."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(np.take(values, order, axis=0), first, axis=0)


def adam(p: np.ndarray, first: np.ndarray, second: np.ndarray, where, gradient: np.ndarray, step: int) -> None:
    """One step of some rows of p, with the moments of their gradients."""
    m, v = 0.9 * first[where], 0.98 * second[where]
    m += 0.1 * gradient
    v += 0.02 * gradient * gradient
    first[where], second[where] = m, v
    np.sqrt(v, out=v)
    v /= (1 - 0.98**step) ** 0.5
    v += 1e-8
    m *= 0.004 / (1 + step / 400) ** 0.5 / (1 - 0.9**step)
    m /= v
    p[where] -= m


_Q, _K = np.arange(HOP, 2 * HOP)[:, None], np.arange(2 * HOP)[None, :]
CAUSAL, DISTANCE = _K <= _Q, np.clip(_Q - _K, 0, 2 * HOP - 1)


class Inputs:
    """The windows of some texts' subwords, which lie in a row, ``lens`` long each: embedding rows (2 HOP), classes before each position and
    target classes (HOP), places of the targets among the subwords, which targets are there, and which windows open a text. The input at
    a position is what stands before it; at HOP of an opening window that is the text's beginning (begin: its row and class), and
    what is before counts for nothing."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray, rows: np.ndarray, kinds: np.ndarray, begin: tuple[int, int]):
        blocks = -(-lens // HOP)
        n, m = int(blocks.sum()), len(lens)
        first = np.cumsum(blocks) - blocks
        place = np.arange(len(flat)) + np.repeat(first * HOP - (np.cumsum(lens) - lens), lens)  # each text begins a block
        kind = np.take(kinds, flat)
        self.target, self.goal, self.there, self.opens = np.zeros((n, HOP), np.int32), np.zeros((n, HOP), np.int64), np.zeros((n, HOP), bool), np.zeros(n, bool)
        self.target.ravel()[place], self.goal.ravel()[place], self.there.ravel()[place] = kind, np.arange(len(flat)), True
        self.opens[first[blocks > 0]] = True
        # inputs stand one place later, and each text has one block more, before its own
        text = np.arange(m)
        place += np.repeat((text + 1) * HOP + 1, lens)
        at = np.arange(n) + np.repeat(text, blocks)
        before = []
        for values, mark in zip((np.take(rows, flat), kind), begin, strict=True):
            row = np.zeros((n + m + 1, HOP), np.int32)
            row.ravel()[place] = values
            row[first[blocks > 0] + text[blocks > 0] + 1, 0] = mark
            before.append(row)
        self.ids = np.concatenate([before[0][at], before[0][at + 1]], axis=1)
        self.last = before[1][at + 1]

    def some(self, k):
        return self.ids[k], self.opens[k], self.last[k], self.target[k], self.there[k]


def train_attention(taken: DataFrame, class_of: np.ndarray, row_of: np.ndarray, pairs: np.ndarray, rounds: int, parts: int = 8, seed: int = 3) -> np.ndarray:
    classes, rows = int(class_of.max()) + 1, int(row_of.max()) + 1
    model = Attention(classes, rows, seed=seed)
    model.begin_at(pairs)
    spark = taken.sparkSession
    size = len(model.flat)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model.flat, class_of.astype(np.int32), row_of))

        def run(batches, r=r):
            flat, class_of, row_of = shared.value  # noqa: B023
            own = Attention(classes, rows, seed=seed)
            own.flat = flat.copy()
            state = own.flat, np.zeros(size, np.float32), np.zeros(size, np.float32)
            near, rest = [own.views(x)["e"] for x in state], [x[own.ends[0] :] for x in state]  # of e only the rows at hand, all else at once
            step, seen = 0, 0
            rng = np.random.default_rng(seed + r)

            def learn(held):
                nonlocal step, seen
                x = Inputs(np.concatenate(held), np.array(list(map(len, held))), row_of, class_of, (rows, classes))
                order = rng.permutation(len(x.ids))
                for at in range(0, len(order), 64):
                    k = order[at : at + 64]
                    _, g, touched = own.gradient(*x.some(k))
                    step += 1
                    adam(*near, touched, g["e"], step)
                    adam(*rest, ..., np.concatenate([g[name].ravel() for name in own.shapes if name != "e"]), step)
                    seen += int(x.there[k].sum())

            held, n_held = [], 0
            for b in batches:
                for seq in _pieces(b):
                    held.append(seq[1:])
                    n_held += len(seq)
                    if n_held >= 1 << 17:
                        learn(held)
                        held, n_held = [], 0
            if held:
                learn(held)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(own.flat * seen).tobytes()], pa.binary())], ["n", "w"])

        def add(batches):
            n, w = 0, np.zeros(size)
            for b in batches:
                n += sum(b.column("n").to_pylist())
                for x in b.column("w").to_pylist():
                    w += np.frombuffer(x, np.float32)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "w"])

        got = taken.mapInArrow(run, "n long, w binary").repartition(parts).mapInArrow(add, "n long, w binary").collect()  # at most parts rows of 1 MB
        if got:
            model.flat = (sum(np.frombuffer(x["w"], np.float64) for x in got) / sum(x["n"] for x in got)).astype(np.float32)
    return model.flat


class Speller:
    """The trained model: what words of some subwords are spelt with. begins: which classes begin words."""

    def __init__(self, flat, class_of: np.ndarray, row_of: np.ndarray, log_piece: np.ndarray, begins: np.ndarray):
        self.net = Attention(int(class_of.max()) + 1, int(row_of.max()) + 1)
        self.net.flat = flat
        self.class_of, self.row_of, self.log_piece = class_of.astype(np.int32), row_of, log_piece.astype(np.float32)
        self.begins = np.zeros(self.net.c, np.float32)
        self.begins[class_of[begins]] = 1
        self.tables = None

    def spell(self, size: np.ndarray, z: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """log P of each word given all before it. size: subwords per word; z: all subwords; opens: the words that open texts."""
        self.tables = self.tables or self.net.tables()
        first = np.cumsum(size) - size
        lens = np.diff(np.append(first[opens], len(z)))
        x = Inputs(z, lens, self.row_of, self.class_of, (self.net.rows, self.net.c))
        lp, ends = np.empty(len(z), np.float32), np.empty(len(z), np.float32)
        for k in range(0, len(x.ids), 128):  # so few that they stay in a processor's cache
            ids, opening, last, target, there = x.some(slice(k, k + 128))
            one, two = self.net.log_prob(ids, opening, last, target, self.begins, self.tables)
            at = x.goal[k : k + 128][there]
            lp[at], ends[at] = one[there], two[there]
        lp += np.take(self.log_piece, z)
        ends = ends[first].astype(np.float64)  # that a word begins here
        after = np.append(ends[1:], 0.0)
        after[np.append(opens[1:], len(size)) - 1] = 0.0  # after the end nothing follows
        return np.add.reduceat(lp.astype(np.float64), first) - ends + after


def score_texts(docs: DataFrame, speller: Speller, hot_counts: dict[bytes, int], n_train: int, known: float, ranks, chunk: int = 16384) -> DataFrame:
    """docs: (doc_id, held_out, text). Stored: task, ord, doc_id, held_out, n_tokens, n_hot, hot_sum, hot_score, rare (words to look
    up, and the log probabilities they were spelt with). hot_score is a list for ``SHARES``, and so is hot_without, of known words, each counted
    without itself; of held-out texts that is null."""
    spark = docs.sparkSession
    common = flat_pieces(encoder(ranks.value), list(hot_counts))
    counts = np.fromiter(hot_counts.values(), np.float64, len(hot_counts))
    shared = spark.sparkContext.broadcast((speller, {w: i for i, w in enumerate(hot_counts)}, common, counts))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import uuid

        speller, hot, common, counts = shared.value
        encode = encoder(ranks.value)
        logs, shares, without = np.append(np.log10(counts + 1), 0.0), np.append(counts / max(1, n_train), 0.0), np.append((counts - 1) / max(1, n_train - 1), 0.0)
        task, n = uuid.uuid4().int >> 65, 0

        def fresh():
            size, z = common
            return dict(hot), size, np.cumsum(size) - size, z

        place, size, start, z = fresh()
        for b in batches:
            if not b.num_rows:
                continue
            split = [words_of(t) for t in b.column("text").to_pylist()]
            for x in split:
                x.append(b"")  # the end
            lens = np.fromiter(map(len, split), np.int64, len(split))
            said = list(chain.from_iterable(split))
            if len(place) > len(hot) + FLUSH:
                place, size, start, z = fresh()
            at = np.fromiter(map(place.get, said, repeat(-1)), np.int64, len(said))
            missing = np.flatnonzero(at < 0)
            if len(missing):
                unseen = [said[i] for i in missing.tolist()]
                new = list(dict.fromkeys(unseen))
                more = flat_pieces(encode, new)
                start = np.concatenate([start, len(z) + np.cumsum(more[0]) - more[0]])
                size, z = np.concatenate([size, more[0]]), np.concatenate([z, more[1]])
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                at[missing] = np.fromiter(map(place.__getitem__, unseen), np.int64, len(unseen))
            opens = np.cumsum(lens) - lens
            spelt, lo = [], 0
            while lo < len(split):  # texts of about chunk words at once
                hi = max(lo + 1, int(np.searchsorted(opens, opens[lo] + chunk)))
                these = at[opens[lo] : opens[hi] if hi < len(split) else len(at)]
                many = size[these]
                ends = np.cumsum(many)
                spelt.append(speller.spell(many, z[np.arange(ends[-1]) + np.repeat(start[these] - ends + many, many)], opens[lo:hi] - opens[lo]))
                lo = hi
            spelt = np.concatenate(spelt)
            is_rare = at >= len(hot)
            here = np.where(is_rare, len(hot), at)
            spelt_p = np.exp(np.maximum(spelt, -690.0))

            def under(table, counted):
                other = np.where(counted, spelt_p, 1.0)  # noqa: B023
                more = np.where(counted, known * (table[here] - other), 0.0)  # noqa: B023
                return np.stack([np.add.reduceat(np.log(other + k * more), opens) for k in SHARES], axis=1)  # noqa: B023

            for_all, alone = under(shares, ~is_rare), under(without, ~is_rare & (without[here] > 0))
            learns = np.where(b.column("held_out").to_numpy(zero_copy_only=False), -1, np.arange(b.num_rows))
            for_all, alone = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(SHARES)).cast(pa.list_(pa.float64())) for x in (for_all, alone))
            alone = alone.take(pa.array(learns, mask=learns < 0))
            n_rare = np.add.reduceat(is_rare, opens, dtype=np.int64)
            who = np.flatnonzero(is_rare)
            words = pa.StructArray.from_arrays([pa.array([said[i] for i in who.tolist()], pa.binary()), pa.array(spelt[who])], ["word", "spelt"])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), words)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, task)), pa.array(np.arange(n, n + m)), b.column("doc_id"), b.column("held_out"), pa.array(lens), pa.array(lens - n_rare), pa.array(np.add.reduceat(logs[here], opens)), for_all, alone, rare],
                ["task", "ord", "doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "hot_score", "hot_without", "rare"],
            )
            n += m

    return staged(docs.select("doc_id", "held_out", "text").mapInArrow(run, f"task long, ord long, doc_id {id_type}, held_out boolean, n_tokens long, n_hot long, hot_sum double, hot_score array<double>, hot_without array<double>, rare array<struct<word:binary,spelt:double>>"), "lm-scores")


def mixed(spelt, share, known: float):
    """log of the probability of words: spelt (log), and their share of the training tokens (may be null), as columns."""
    a, b = spelt + F.lit(math.log1p(-known)), F.log(share * F.lit(known)) if known > 0 else F.lit(None).cast("double")
    return F.when(b.isNull(), a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def likeliest(done: DataFrame, rare: DataFrame, n: int, known: float) -> int:
    """Under which of ``SHARES`` the training texts' known words are likeliest, each counted without itself; the whole share unless another
    gains more than half the log of N, what a parameter costs by the Bayesian information criterion (the texts are those trained on). done: as ``score_texts`` gives it;
    rare: (held_out, spelt, c)."""
    hot = done.select(*[F.sum(F.get("hot_without", F.lit(k))) for k in range(len(SHARES))]).first()
    without = (F.col("c") - 1) / F.lit(max(1, n - 1))
    other = rare.filter(~F.col("held_out") & (F.col("c") > 1)).select(*[F.sum(mixed(F.col("spelt"), without, known * k)) for k in SHARES]).first()
    found = [(x or 0.0) + (y or 0.0) for x, y in zip(hot, other, strict=True)]
    best = int(np.argmax(found))
    return best if found[best] - found[-1] > math.log(max(1, n)) / 2 else len(SHARES) - 1


def score_corpus(docs: DataFrame, is_held_out=None, classes: int = 96, rounds: int = 1, hot: int = 200_000, path: str | None = None, seed: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    is_held_out = held_out() if is_held_out is None else is_held_out
    docs = docs.select("doc_id", is_held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = docs.filter(~F.col("held_out"))
    counts = staged(count_words(train), "lm-words")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    known = 1 - (once + 1) / (n + 2) if n else 0.0
    ranks = spark.sparkContext.broadcast(rank_file(path))
    totals = count_subwords(counts, ranks)
    taken = take_pieces(train, ranks)
    begins = beginners(ranks.value)
    class_of, log_piece = classes_of(totals, count_follows(taken, totals), begins, classes, seed)
    row_of = rows_of(totals, class_of)
    flat = train_attention(taken, class_of, row_of, count_class_pairs(taken, class_of, int(class_of.max()) + 1), rounds, seed=seed)
    hot_counts = hot_words(counts, hot)
    done = score_texts(docs, Speller(flat, class_of, row_of, log_piece, begins), hot_counts, n, known, ranks)
    low = min(hot_counts.values(), default=None)
    rest = counts if low is None else counts.filter(F.col("c") < low)
    rare = done.select("task", "ord", "held_out", F.explode("rare").alias("r")).select("task", "ord", "held_out", "r.word", "r.spelt").join(rest, "word", "left").select("task", "ord", "held_out", "spelt", "c")
    rare = staged(rare, "lm-rare")
    best = likeliest(done, rare, n, known)
    known, done = known * SHARES[best], done.withColumn("hot_score", F.get("hot_score", F.lit(best))).drop("hot_without")
    looked_up = rare.groupBy("task", "ord").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"), F.count("c").alias("n_rare"), F.sum(mixed(F.col("spelt"), F.col("c") / F.lit(max(1, n)), known)).alias("rare_score"))
    out = done.drop("rare").join(looked_up, ["task", "ord"], "left")
    base = F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    score = (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))) / F.lit(math.log(10))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
