"""The package's own queries against SQL on the smallest tables; the entry without the training-data subpackage."""

import collections
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    cur = con.execute(queries.SQL[name])
    cols = sorted(c[0] for c in cur.description)
    want = cur.df()[cols]
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == cols
    have = df.toPandas()[cols]
    a, b = (collections.Counter(tuple(norm(v) for v in r) for r in x.itertuples(index=False, name=None)) for x in (have, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "millrace")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f), encoding="utf-8").read()
                    assert "millrace.llm" not in text and "from ..llm" not in text and "from .llm" not in text


def test_entry(spark, data):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    df = e.queries()["hybrid_retrieve"](spark, data)
    assert df.columns == ["query_id", "rank", "id", "weighted_score", "score", "in_dense", "in_sparse"] and df.count() > 0


def test_dense_topk_builds_no_collection(spark, data, monkeypatch):
    monkeypatch.setattr(queries, "_STORED", {})
    for name in ("build", "index"):
        monkeypatch.setattr(queries.collection, name, lambda *a, **b: pytest.fail("a collection is built"), raising=False)
    assert queries.QUERIES["dense_topk"](spark, data).count() > 0


@pytest.mark.parametrize("name", ["multi_query_evidence", "minmax_normalise", "hybrid_retrieve"])
def test_no_text_is_copied_and_terms_are_stored_once(spark, data, tmp_path, monkeypatch, name):
    folders = (f"file://{tmp_path}/{i}" for i in range(9))
    monkeypatch.setattr(queries, "_STORED", {})
    monkeypatch.setattr(queries, "work_folder", lambda spark: next(folders))
    assert queries.QUERIES[name](spark, data).count() > 0
    found = {os.path.relpath(top, tmp_path): spark.read.parquet(f"file://{top}").columns for top, _, files in os.walk(tmp_path) if "_SUCCESS" in files}
    assert found and not [k for k, c in found.items() if "text" in c] and sum("tops" in c or "top" in c for c in found.values()) == 1
    assert {os.path.basename(k) for k, c in found.items() if {"terms", "sparse_vector"} & set(c)} <= {"slices", "queries"}


def test_texts_of_evidence_alone_are_shuffled(spark, data, monkeypatch):
    with queries.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = queries.QUERIES["rerank_boost"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
