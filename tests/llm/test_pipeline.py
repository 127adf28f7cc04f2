"""The pipeline against a plain version of its stages, and its stage contract."""

import collections
import re

import corpus_pipeline
from millrace.llm import langid
from millrace.llm.common import staged
from pyspark.sql import functions as F

from . import plain as plainly

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(docs, items, identified):
    """docs: dicts in doc_id order. What is left after stages 1 to 4."""
    docs = [d for d in docs if identified[d["doc_id"]]]
    gone = plainly.dedup([(d["doc_id"], d["text"]) for d in docs])
    kept = []
    for d in docs:
        ranges = gone[False, d["doc_id"], d["text"]]
        text = plainly.cut(d["text"], ranges)
        if not ranges or text.strip():
            kept.append(d | {"text": text})
    reps = []
    comp = {d["doc_id"]: d["doc_id"] for d in kept}
    sets = {d["doc_id"]: plainly.shingles(d["text"], 5) for d in kept}
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    reps = [d for d in kept if comp[d["doc_id"]] == d["doc_id"]]
    asked = [plainly.item_words(t) for t in items]
    windows = {tuple(w[i : i + 10]) for w in asked if w for i in range(max(1, len(w) - 9))}

    def clean(d):
        w = plainly.item_words(d["text"])
        return not any(tuple(w[i : i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))

    return [d for d in reps if clean(d)]


def test_pipeline_against_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    found = {r.doc_id: r.lang_pred != "und" and r.score >= 0.5 for r in langid.identify(docs, langid.fit(docs)).collect()}
    want = plain(rows, [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()], found)
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = staged(stage(spark, d, data), name.replace(" ", "-"))
        assert d.columns == COLUMNS
    assert sorted((r.doc_id, r.text) for r in d.collect()) == sorted((r["doc_id"], r["text"]) for r in want)
    mixed = corpus_pipeline.run(spark, data)
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in want}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(sizes) and max(copies.values()) <= 3
    taken = mixed.groupBy("source").agg(F.sum("mix_size").alias("w"), F.first("mix_target").alias("t")).collect()
    assert abs(sum(r.w for r in taken) - sum(sizes.values())) <= 0.1 * sum(sizes.values())


def test_pipeline_on_awkward_rows(spark, edge, empty):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = staged(stage(spark, d, edge), name.replace(" ", "-"))
        assert d.columns == docs.columns and dict(d.dtypes) == dict(docs.dtypes)
        named = [c for c in docs.columns if c not in COLUMNS and c not in ("score", "size", "fp", "segment", "key", "rank", "at", "held_out")]
        assert len(named) > 20 and all(r[c] == f"{c}!" for r in d.collect() for c in named)  # columns named like the stages' own keep their values
    assert corpus_pipeline.run(spark, edge).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stage_names_and_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "dedup_lines", "dedup_documents", "decontaminate_documents", "mix_sources"]
