"""Mechanisms for large tables: buckets of an upsert, hashed names, hubs, state lists."""

import collections
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, skew
from millrace.operators import graph, html
from millrace.sources import readers, sinks
from millrace.streaming import ingest

# Keyed tables.


def rows_of(spark, ids, o=1, v="a"):
    return spark.createDataFrame([(i, o, f"{v}{i}") for i in ids], "id long, o int, v string")


def test_an_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    t = sinks.KeyedTable(spark, f"{tmp_path}/t", "id", buckets=256)
    assert len(t.upsert(rows_of(spark, range(1000)), ["o"])) > 240
    touched = t.upsert(rows_of(spark, range(0, 1000, 100), 2, "b"), ["o"])
    assert 0 < len(touched) <= 10
    at = t.pointer()["at"]
    assert sorted(int(b) for b, v in at.items() if v == 1) == touched and {v for v in at.values()} == {0, 1}
    assert sorted(os.listdir(tmp_path / "t/data/v1")) == sorted(["_SUCCESS", "._SUCCESS.crc", *[f"bucket={b}" for b in touched]])
    assert {r.id: r.v for r in t.read().collect()} == {i: f"b{i}" if i % 100 == 0 else f"a{i}" for i in range(1000)}
    assert {r.v[0] for r in t.read(0).collect()} == {"a"}  # the version before is still there
    assert t.vacuum() == len(touched) and t.read().count() == 1000 and t.versions() == [1]


def test_a_failed_upsert_changes_nothing(spark, tmp_path, monkeypatch):
    t = sinks.KeyedTable(spark, f"{tmp_path}/t", "id", buckets=8)
    t.upsert(rows_of(spark, range(20)), ["o"])
    with monkeypatch.context() as m:
        m.setattr(t, "_point", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.upsert(rows_of(spark, range(30), 2, "b"), ["o"])
    assert {r.id: r.v for r in t.read().collect()} == {i: f"a{i}" for i in range(20)}
    t.upsert(rows_of(spark, range(19, 22), 3, "c"), ["o"])
    assert {r.id: r.v for r in t.read().collect()} == {i: f"a{i}" for i in range(19)} | {i: f"c{i}" for i in range(19, 22)}
    with pytest.raises(RuntimeError, match="another writer"):
        t._point(1, {})


def test_upserts_of_null_keys_new_columns_and_nothing(spark, tmp_path):
    t = sinks.KeyedTable(spark, f"{tmp_path}/t", ["a", "b"], buckets=4)
    assert t.read() is None and t.upsert(spark.createDataFrame([], "a int, b string, o int"), ["o"]) == [] and t.read().count() == 0
    t.upsert(spark.createDataFrame([(None, "x", 1), (1, None, 1), (1, None, 2)], "a int, b string, o int"), ["o"])
    t.upsert(spark.createDataFrame([(None, "x", 0, "new")], "a int, b string, o int, c string"), ["o"])
    assert sorted(map(str, map(tuple, t.read().collect()))) == ["(1, None, 2, None)", "(None, 'x', 0, 'new')"]
    t.upsert(spark.createDataFrame([(None, "x", -1, "late")], "a int, b string, o int, c string"), ["o"], over_table=True)
    assert {r.c for r in t.read().collect()} == {None, "new"}
    with pytest.raises(ValueError, match="keys"):
        sinks.KeyedTable(spark, f"{tmp_path}/t", "a").upsert(spark.createDataFrame([(1, 1)], "a int, o int"), ["o"])


def test_a_stream_goes_on_after_a_failure_between_its_batches(spark, tmp_path):
    src, t = str(tmp_path / "in"), sinks.KeyedTable(spark, f"{tmp_path}/t", "id", buckets=4)
    rows_of(spark, range(10)).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long, o int, v string").parquet(src)
    ingest.stream_upsert(stream(), t, ["o"], f"{tmp_path}/cp")
    rows_of(spark, range(5, 15), 2, "b").coalesce(1).write.mode("append").parquet(src)
    point = t._point
    t._point = lambda *_: 1 / 0
    with pytest.raises(Exception, match="ZeroDivision"):
        ingest.stream_upsert(stream(), t, ["o"], f"{tmp_path}/cp")
    t._point = point
    assert t.read().count() == 10
    ingest.stream_upsert(stream(), t, ["o"], f"{tmp_path}/cp")
    want = {i: f"a{i}" for i in range(5)} | {i: f"b{i}" for i in range(5, 15)}
    assert {r.id: r.v for r in t.read().collect()} == want
    assert t.upsert(rows_of(spark, range(99)), ["o"], batch=t.pointer()["batch"]) == []  # seen before
    assert t.read().count() == 15


# Dictionaries.


def plain_matches(texts, names):
    out = []
    for k, t in texts:
        for n in {n for n in names if n}:
            i = (t or "").find(n)
            while i >= 0:
                out.append((k, n, i + 1))
                i = t.find(n, i + 1)
    return collections.Counter(out)


def test_names_of_any_length_are_found_wherever_they_stand(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aab é日") for _ in range(n))
    names = [word(rng.randrange(1, 12)) for _ in range(150)] + [word(40), word(300), "aaaa", "aa", "日", None, ""]
    texts = [(i, word(rng.randrange(0, 120))) for i in range(60)] + [(61, None), (62, ""), (63, names[150] * 3), (64, "x" + names[151] + names[151]), (65, "aaaaaa"), (66, "ab" * 700_000 + "日" + names[150])]
    names += ["b" + "日" + names[150][:5]]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = graph.match_names(df.filter("doc_id < 66"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert collections.Counter(map(tuple, got.collect())) == plain_matches(texts[:-1], names)
    across = graph.match_names(df.filter("doc_id = 66"), spark.createDataFrame([(names[-1],), ("é" * 2000,)], "name string"))
    assert [tuple(r) for r in across.collect()] == [(66, names[-1], 1_400_000)]


def test_one_scan_for_a_large_dictionary(spark):
    names = spark.range(300_000).select(F.concat(F.lit("name-"), F.hex(F.xxhash64("id"))).alias("name"))
    some = [r.name for r in names.limit(50).collect()]
    texts = spark.createDataFrame([(i, f"text {n} and name-00 and {n}") for i, n in enumerate(some)], "doc_id long, text string")
    got = graph.match_names(texts, names)
    assert collections.Counter(r.name for r in got.collect()) == {n: 2 for n in some}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_window_hashes_and_filters():
    import numpy as np

    data = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    w = hashing.Windows(data)
    at = np.arange(400)
    by = collections.defaultdict(set)
    for i, h in zip(at.tolist(), w(at, 7).tolist(), strict=True):
        by[bytes(data[i : i + 7])].add(h)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert w(np.array([0]), 7)[0] != w(np.array([0]), 8)[0]
    bits, keys = np.zeros(1 << 17, np.uint8), w(np.arange(40), 9)
    for spot in hashing._spots(keys[::2], 1 << 20):
        np.bitwise_or.at(bits, spot >> 3, (128 >> (spot & 7)).astype(np.uint8))
    assert set(range(0, 40, 2)) <= set(hashing.held(bits, keys).tolist()) and len(hashing.held(bits, np.empty(0, np.uint64))) == 0


# Hubs.


def test_edges_of_a_hub_are_dealt_over_all_partitions(spark):
    n = 6000
    nodes = spark.range(n).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("map<string,string>").alias("props"))
    edges = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("src"), F.lit("r").alias("rel"), ((F.col("id") * 31) % n).alias("dst"))
    hot = skew.hot_keys(edges, "src")
    assert hot == [7]
    joined = skew.spread_join(edges, nodes.select(F.col("id").alias("src"), "name").hint("merge"), "src", hot)
    sizes = sorted(r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect())
    assert sum(sizes) == n and sizes[-1] < 3 * sizes[len(sizes) // 2]
    got = graph.one_hop(spark.createDataFrame([("n7",), ("n5",)], "name string"), nodes, edges)
    e = edges.collect()
    want = {(m, f"n{x.src}", "r", f"n{x.dst}") for x in e for m in ("n7", "n5") if m in (f"n{x.src}", f"n{x.dst}")}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > n // 3
    relations = graph.relation_rows(spark.createDataFrame([(1, "n7"), (2, "n7"), (2, "n7")], "k int, name string"), nodes, edges, "k")
    assert relations.count() == 2 * len([x for x in want if x[0] == "n7"])


# Conversations.


def put(spark, src, turns):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(src)


def start_chat(spark, src, cp, said, trigger, **kw):
    rows = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(src)

    def take(batch, _):
        said.update({r.conv_id: [m["content"] for m in json.loads(r.messages)] for r in batch.collect()})

    return ingest.chat_history(rows, **kw).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", cp).trigger(**trigger).start()


def run_chat(spark, src, cp, **kw):
    said = {}
    q = start_chat(spark, src, cp, said, {"availableNow": True}, **kw)
    assert q.awaitTermination(120)
    return said, q.lastProgress


def test_conversations_go_on_after_a_restart(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    put(spark, src, [(1, k, "user", f"t{k}") for k in range(300)] + [(2, 5, "user", None)])
    assert run_chat(spark, src, cp)[0] == {1: [f"t{k}" for k in range(300)], 2: [None]}
    put(spark, src, [(1, 1000, "assistant", "later"), (1, -1, "user", "before")])
    second, progress = run_chat(spark, src, cp)  # a new start with the old checkpoint
    assert second == {1: ["before", *[f"t{k}" for k in range(300)], "later"]}
    # what is written follows the batch's turns, not the conversation's
    assert sum(x.numRowsUpdated for x in progress.stateOperators) <= 4


def test_the_last_turns_of_conversations(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [(1, k, "user", f"t{k}") for k in range(10)])
    assert run_chat(spark, src, str(tmp_path / "cp"), most=3)[0] == {1: ["t7", "t8", "t9"]}


def until(what, seconds=40):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.5)
    assert what()


def test_idle_conversations_are_forgotten(spark, tmp_path):
    src, said = str(tmp_path / "in"), {}
    put(spark, src, [(1, 0, "user", "first")])
    q = start_chat(spark, src, str(tmp_path / "cp"), said, {"processingTime": "1 second"}, idle=2.0)
    try:
        until(lambda: said == {1: ["first"]})
        time.sleep(8)
        put(spark, src, [(1, 1, "user", "second")])
        until(lambda: said != {1: ["first"]})
        assert said == {1: ["second"]}
    finally:
        q.stop()


def test_a_stream_s_batches_are_logged(spark, tmp_path):
    src, log = str(tmp_path / "in"), f"file://{tmp_path}/log"
    rows_of(spark, range(10)).coalesce(1).write.parquet(src)
    t = sinks.KeyedTable(spark, f"{tmp_path}/t", "id", buckets=4)
    for k in range(2):
        ingest.stream_upsert(spark.readStream.schema("id long, o int, v string").parquet(src), t, ["o"], f"{tmp_path}/cp", log)
        rows_of(spark, range(3), 5 + k, "b").coalesce(1).write.mode("append").parquet(src)
    got = sorted(spark.read.parquet(log).collect())
    assert [(r.batch, r.n_rows) for r in got] == [(0, 10), (1, 3)] and all(r.seconds > 0 and 0 < r.n_buckets <= 4 for r in got)


# Sinks.


def lines_in_order(folder):
    return [json.loads(x) for f in sorted(os.listdir(folder)) if f.startswith("part-") for x in open(f"{folder}/{f}", encoding="utf-8")]


def test_chunks_and_books_lie_in_order_in_files_of_bounded_size(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('s', id % 3) source_id", "cast(id as int) chunk_index", "repeat('x', 200) answer_text", "'y' search_text").repartition(5)
    sinks.write_chunks(rows, str(tmp_path / "c"), file_chars=100_000)
    got = lines_in_order(tmp_path / "c")
    assert [(r["source_id"], r["chunk_index"]) for r in got] == sorted((f"s{i % 3}", i) for i in range(4000))
    sizes = [os.path.getsize(tmp_path / "c" / f) for f in os.listdir(tmp_path / "c") if f.startswith("part-")]
    assert len(sizes) > 15 and max(sizes) < 6 * sum(sizes) / len(sizes)  # one source is a third of all rows
    sinks.write_markdown(spark.range(2000).selectExpr("concat('b', lpad(id, 5, '0')) source_id", "if(id = 7, null, 'a\nb\n') text"), str(tmp_path / "m"), file_chars=20_000)
    books = lines_in_order(tmp_path / "m")
    assert [b["source_id"] for b in books] == [f"b{i:05d}" for i in range(2000)] and books[7]["text"] == "" and books[8]["text"] == "a\nb"


def test_a_catalog_of_many_documents_keeps_its_order(spark, tmp_path):
    names = spark.range(5000).selectExpr("concat('L', lpad((id * 7) % 5000, 5, '0')) species_latin", "'' species_chinese")
    cat = names.selectExpr("'t' type", "*", "species_latin species_latin_space", "'' genus_latin", "'' genus_latin_space", "'' genus_chinese", "array('a') aliases", "1L source_count")
    sinks.write_catalog(cat, str(tmp_path / "cat"), records=300)
    docs = lines_in_order(tmp_path / "cat")
    assert len(docs) >= 5000 / 300 and max(len(d["pathogens"]) for d in docs) <= 300 and {d["count"] for d in docs} == {5000}
    assert [p["species_latin"] for d in docs for p in d["pathogens"]] == [f"L{i:05d}" for i in range(5000)]
    back = readers.read_catalog(spark, str(tmp_path / "cat")).orderBy("key").collect()
    assert [r.species_latin for r in back] == [f"L{i:05d}" for i in range(5000)]
    sinks.write_catalog(cat.limit(0), str(tmp_path / "none"))
    assert readers.read_catalog(spark, str(tmp_path / "none")).count() == 0 and lines_in_order(tmp_path / "none")[0]["count"] == 0
    (tmp_path / "pretty.json").write_text(json.dumps({"version": "1", "count": 1, "pathogens": [{"species_latin": "A"}]}, indent=2))
    assert [r.species_latin for r in readers.read_catalog(spark, str(tmp_path / "pretty.json")).collect()] == ["A"]


def test_comments_of_settings_outside_quotes():
    assert readers.settings("a: 'x # y' # note\nb: \"#1\"\nc: it's # note\nd: z#1\n# whole\ne:\n  - 'q # r' # s") == {"a": "x # y", "b": "#1", "c": "it's", "d": "z#1", "e": ["q # r"]}


def test_of_pages_of_one_name_the_last_written_counts(spark):
    pages = spark.createDataFrame([("t", "<p>zz old</p>", 1), ("t", "<p>aa new</p>", 2), (None, "<p>x</p>", 3), ("e", None, 4)], "title string, html string, written long")
    assert [tuple(r) for r in html.cached_pages(pages, "written").collect()] == [("t", "aa new")]


@pytest.mark.parametrize("name", ["numbered_split", "query_expand", "case_parse", "case_parse_nested", "field_extraction"])
def test_a_small_file_with_much_work_a_row_is_spread_over_all_cores(spark, data, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_markdown_is_cleaned_in_one_pass_over_the_lines(spark, data):
    import __spark_entry__

    plan = __spark_entry__.queries()["clean_markdown"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_list_and_its_kind_in_one(spark):
    from millrace.operators import chunking

    texts = ["头 1. 位于a；2、b；3．c；d", "12. x 3.5 mm 4、y", "none", "", None, "a1.b 2. c" * 20]
    t = spark.createDataFrame([(x,) for x in texts], "text string").select(chunking.numbered_list("text").alias("n"), chunking.list_kind("text").alias("kind"), chunking.split_numbered("text").alias("items"))
    assert all(r.n.kind == r.kind and r.n["items"] == r["items"] for r in t.collect())
