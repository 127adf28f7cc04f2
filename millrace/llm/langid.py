"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum over all
its segmentations into pieces (forward algorithm), and a text's is the product over its words: pieces never cross a word
boundary, so the sum factorises and a word is scored once however often it occurs. The distributions are learned from all
training words by expectation-maximisation: word counts per language (distributed), expected piece counts by
forward-backward over the distinct words (distributed), piece probabilities from them (vocabulary x languages numbers).

Words: the text in lower case, ASCII other than letters dropped. A character that is no piece counts as one unknown
piece. Words of up to ``SHORT`` characters are summed in batches, longer ones one by one in logarithms, over all their
segmentations alike and in time linear in their length. Texts that are null or hold no letter: ``und``, score 0; so is every text if nothing was learned. Score: posterior of the predicted language
at a likelihood tempered to ``temper`` words. Repeated rows are scored alike. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import gathered, highest, packed, small_batches, staged, tokenizer_dir, unpacked

SHORT = 40
#: Below it a batch's sums may have lost digits; such words are summed in logarithms.
TINY = 1e-280
CACHE = 500_000
#: Lower-case ASCII letters and all bytes above ASCII stay, upper case is lowered, the rest parts words.
_TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def has_letter(text: str | None, words: list[bytes]) -> bool:
    return bool(words) and (any(w.isalpha() for w in words[:3]) or any(c.isalpha() for c in text))


def vocabulary(path: str | None = None) -> dict:
    """The trie of the pieces that can occur in a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or f"{tokenizer_dir()}/piece_bpe_32k.model")
    pieces = sorted({p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (p := sp.id_to_piece(i)) and p == p.lower() and not any(c.isascii() and not c.isalpha() for c in p)})
    return trie_of(pieces)


def trie_of(pieces: list[str]) -> dict:
    """Character to (number of the piece that ends there or -1, the characters that go on)."""
    root: dict = {}
    for i, p in enumerate(pieces):
        node = root
        for k, c in enumerate(p):
            n, rest = node.get(c, (-1, {}))
            node[c] = (i if k == len(p) - 1 else n, rest)
            node = rest
    return root


def size_of(trie: dict) -> int:
    return sum((n >= 0) + size_of(rest) for n, rest in trie.values())


def spelling(word: bytes) -> str:
    return "▁" + word.decode("utf-8", "replace")


def edges_from(s: str, i: int, vocab: dict, unknown: int):
    """(end, piece) of all pieces that begin at a place; the character alone is unknown where it is no piece."""
    p, node = vocab.get(s[i], (-1, None))
    yield i + 1, p if p >= 0 else unknown
    j, n = i + 1, len(s)
    while node and j < n and (t := node.get(s[j])):
        p, node = t
        j += 1
        if p >= 0:
            yield j, p


class Long:
    """One word of any length: a forward and a backward pass over its places, in logarithms."""

    def __init__(self, word: bytes, vocab: dict, unknown: int):
        self.s, self.vocab, self.unknown = spelling(word), vocab, unknown

    def forward(self, log_prob: np.ndarray) -> np.ndarray:
        """log P up to each place, in each column of log_prob (pieces x languages)."""
        n = len(self.s)
        alpha = np.full((n + 1, log_prob.shape[1]), -np.inf)
        alpha[0] = 0
        for i in range(n):
            for j, p in edges_from(self.s, i, self.vocab, self.unknown):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_prob[p])
        return alpha

    def expect(self, log_prob: np.ndarray, lang: int, count: float, into: np.ndarray) -> None:
        n, own = len(self.s), log_prob[:, lang]
        alpha = self.forward(log_prob[:, lang : lang + 1])[:, 0]
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            for j, p in edges_from(self.s, i, self.vocab, self.unknown):
                beta[i] = np.logaddexp(beta[i], own[p] + beta[j])
                into[p, lang] += count * np.exp(alpha[i] + own[p] + beta[j] - alpha[n])


class Lattice:
    """All segmentations of a batch of words, as edges by start position; longer words are kept apart."""

    def __init__(self, words: list[bytes], vocab: dict, unknown: int):
        spelt = [spelling(w) for w in words]
        self.n_words = len(words)
        self.word = np.array([k for k, s in enumerate(spelt) if len(s) <= SHORT], np.int64)
        self.long = [k for k, s in enumerate(spelt) if len(s) > SHORT]
        self.one = lambda k: Long(words[k], vocab, unknown)
        short = [spelt[k] for k in self.word.tolist()]
        self.lens = np.array([len(s) for s in short], np.int64)
        width = int(self.lens.max()) if len(self.lens) else 0
        found: list[list[int]] = [[] for _ in range(width)]  # by start: word, end and piece in one number
        none = (-1, None)
        for k, s in enumerate(short):
            n, base = len(s), k << 32
            for i in range(n):
                add = found[i].append
                p, node = vocab.get(s[i], none)
                add(base | (i + 1) << 24 | (p if p >= 0 else unknown))
                j = i + 1
                while node and j < n and (t := node.get(s[j])):
                    p, node = t
                    j += 1
                    if p >= 0:
                        add(base | j << 24 | p)
        self.edges = []
        for codes in found:
            c = np.array(codes, np.int64)
            self.edges.append((c >> 32, c >> 24 & 255, c & 0xFFFFFF))
        self.width = width

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """log P of each word in each column of prob (pieces x languages)."""
        alpha = np.zeros((len(self.word), self.width + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for i, (w, j, p) in enumerate(self.edges):
            alpha[w, j] += alpha[w, i] * prob[p]
        out = np.zeros((self.n_words, prob.shape[1]))
        total = alpha[np.arange(len(self.lens)), self.lens]
        out[self.word] = np.log(np.maximum(total, TINY))
        apart = [*self.long, *self.word[(total < TINY).any(axis=1)].tolist()]
        logs = np.log(prob) if apart else None
        for k in apart:
            out[k] = self.one(k).forward(logs)[-1]
        return out

    def expect(self, prob: np.ndarray, language: np.ndarray, count: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected count to into (pieces x languages); language and count are per word."""
        lang, c = language[self.word], count[self.word]
        n = len(self.lens)
        alpha, beta = np.zeros((n, self.width + 1)), np.zeros((n, self.width + 1))
        alpha[:, 0] = 1
        beta[np.arange(n), self.lens] = 1
        weights = [prob[p, lang[w]] for w, _, p in self.edges]
        for i, (w, j, _) in enumerate(self.edges):
            alpha[w, j] += alpha[w, i] * weights[i]
        for i in range(self.width - 1, -1, -1):
            w, j, _ = self.edges[i]
            beta[:, i] += np.bincount(w, weights[i] * beta[w, j], n)
        total = alpha[np.arange(n), self.lens]
        share = np.where(total < TINY, 0, c / np.maximum(total, TINY))
        apart = [*self.long, *self.word[total < TINY].tolist()]
        logs = np.log(prob) if apart else None
        for k in apart:
            self.one(k).expect(logs, int(language[k]), float(count[k]), into)
        if not n:
            return
        at = np.concatenate([p * into.shape[1] + lang[w] for w, _, p in self.edges])
        found = np.concatenate([share[w] * alpha[w, i] * weights[i] * beta[w, j] for i, (w, j, _) in enumerate(self.edges)])
        into += np.bincount(at, found, into.size).reshape(into.shape)


def count_words(train: DataFrame) -> DataFrame:
    """train: (text, lang). lang, word, n over all rows."""

    def run(batches):
        counts: dict[str, Counter] = {}

        def flush():
            rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
            k, w, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > CACHE // 2:
                yield flush()
                counts = {}
        if any(counts.values()):
            yield flush()

    return train.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """languages, piece probabilities (pieces + unknown) x languages, and the scores of the commonest words."""

    def __init__(self, languages: list[str], prob: np.ndarray, vocab: dict):
        self.languages, self.prob, self.vocab = languages, prob, vocab
        self.common, self.known = [], np.empty((0, len(languages)))

    def score(self, words: list[bytes]) -> np.ndarray:
        parts = [np.empty((0, len(self.languages)))]
        for i in range(0, len(words), 4096):
            parts.append(Lattice(words[i : i + 4096], self.vocab, len(self.prob) - 1).forward(self.prob))
        return np.concatenate(parts)

    def with_common(self, words: DataFrame | None) -> "Model":
        """Scores words, a bounded number, on the executors."""
        if words is not None and self.languages:
            shared = words.sparkSession.sparkContext.broadcast(self)

            def run(batches):
                for b in gathered(batches, 8192):
                    found = shared.value.score(b.column("word").to_pylist())
                    yield pa.RecordBatch.from_arrays([b.column("word").combine_chunks(), pa.array(list(found), pa.list_(pa.float64()))], ["word", "score"])

            t = words.select("word").mapInArrow(run, "word binary, score array<double>").toArrow()
            self.common = t["word"].to_pylist()
            self.known = np.array(t["score"].combine_chunks().flatten()).reshape(-1, len(self.languages))
        return self


def fit(docs: DataFrame, iterations: int = 2, path: str | None = None, smooth: float = 0.05, common: int = 150_000) -> Model:
    """Learns from all rows of docs with text and lang."""
    spark = docs.sparkSession
    small_batches(spark)
    vocab = vocabulary(path)
    n = size_of(vocab)
    train = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = staged(count_words(train), "langid-words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    prob = np.full((n + 1, max(1, len(languages))), 1.0 / (n + 1))
    for _ in range(iterations if languages else 0):
        shared = spark.sparkContext.broadcast((vocab, prob, {k: i for i, k in enumerate(languages)}))

        def run(batches):
            vocab, prob, index = shared.value  # noqa: B023
            into = np.zeros_like(prob)
            for b in gathered(batches, 8192):
                lang = np.array([index[k] for k in b.column("lang").to_pylist()], np.int64)
                Lattice(b.column("word").to_pylist(), vocab, len(prob) - 1).expect(prob, lang, b.column("n").to_numpy(zero_copy_only=False).astype(float), into)
            piece, k = np.nonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(into[piece, k])], ["piece", "k", "n"])

        found = counts.mapInArrow(run, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        expected = np.full_like(prob, smooth)
        expected[found["piece"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
        prob = expected / expected.sum(axis=0)
    return Model(languages, prob, vocab).with_common(highest(counts.groupBy("word").agg(F.sum("n").alias("c")), common))


def identify(docs: DataFrame, model: Model, temper: float = 12.0, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score of each row, with the columns named in keep (doc_id unless given)."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])

    def run(batches):
        model = shared.value
        languages = model.languages

        def fresh():
            return {w: i for i, w in enumerate(model.common)} if languages else {}, model.known

        at, table = fresh()
        for b in batches:
            texts = b.column("__text").to_pylist()
            split = [words_of(t) if t and languages else [] for t in texts]
            new = list({w for words in split for w in words if w not in at})
            if len(at) + len(new) > CACHE:
                at, table = fresh()
                new = list({w for words in split for w in words if w not in at})
            if new:
                table = np.concatenate([table, model.score(new)])
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            pred, score = [], []
            for text, words in zip(texts, split, strict=True):
                if not has_letter(text, words):
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(np.argmax(total))
                pred.append(languages[best])
                score.append(float(1 / np.exp((total - total[best]) * min(1.0, temper / len(words))).sum()))
            yield pa.RecordBatch.from_arrays([*[b.column(f"__{i}") for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*[f"__{i}" for i in range(len(keep))], "lang_pred", "score"])

    kept = [StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = rows.mapInArrow(run, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(modulus: int = 3, remainder: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is identified with at least min_score, in their own columns, whatever their names."""
    found = identify(docs.select(packed(docs), "text"), fit(docs), keep=["row"]).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select(*unpacked(docs))
