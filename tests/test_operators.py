"""Operators on small rows in the language that the rules are for."""

import base64
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text, vectors
from millrace.operators import cases, catalog, chunking, cleaning, dialog, evidence, expansion, graph, headings, html, lines, retrieval, routing
from millrace.plans import tools
from millrace.sources import readers, sinks, web
from millrace.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def many(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_text_functions(spark):
    assert many(spark, ["  a \u3000\n b ", None, ""], text.squash) == ["a b", "", ""]
    assert many(spark, ["3", " 1e-2 ", "3d", "1_000", "0.05%", None, "", ".5", "5."], text.safe_double) == [3, 0.01, 0, 0, 0, 0, 0, 0.5, 5]
    assert one(spark, "x：值 一。；，  \nrest", lambda c: text.search_value(c, "x：([^\\n]+)")) == "值 一"
    assert one(spark, "{'k': 'single', \"k\": \"double\"}", lambda c: text.quoted_field(c, "k")) == "double"
    assert one(spark, "{'k': 'single', \"k\": \"double\"}", lambda c: text.dict_field(c, "k")) == "single"
    assert one(spark, "aXXbXXX", lambda c: text.occurrences(c, "XX")) == 2
    assert spark.sql("select array('b ', 'a', '', 'b', null, ' a') x").select(text.ordered_distinct(F.col("x")).alias("y")).first()["y"] == ["b", "a"]


def test_vectors(spark):
    df = spark.sql("select array(1.0f, 2.0f) a, array(2.0f, 4.0f) b, array(0.0f, 0.0f) z, map('1', 0.5, '2', 0.0, '3', -1.0) m")
    r = df.select(vectors.dot("a", "b").alias("d"), vectors.cosine("a", "b").alias("c"), vectors.cosine("a", "z").alias("n"), vectors.sparse("m").alias("s")).first()
    assert r.d == 10 and r.c == pytest.approx(1) and r.n is None and r.s == {1: 0.5}


def test_lines(spark):
    assert one(spark, "\ufeffa\x07b\u200b\ufffd c \u3000", lines.normalize_line) == "ab c"
    assert one(spark, " 甲 ，乙（ 丙 ）\u3000丁 ", lines.normalize_spaces) == "甲，乙（丙） 丁"
    assert many(spark, ["| a | b |", "a | b", "|", "||", "  |x|  "], lines.is_table_line) == [True, False, False, True, True]
    assert many(spark, ["###", "# a", " ## "], lines.is_empty_heading) == [True, False, True]
    assert many(spark, ["![x](y.png) 图", "![x](y)", "文"], lines.without_images) == ["图", "", "文"]
    assert one(spark, "a\r\nb\rc", lambda c: F.array_join(F.split(lines.one_newline(c), "\n"), "|")) == "a|b|c"


@pytest.mark.parametrize(("body", "first"), [("前言\n目录\n第一章\n绪论\n第二章\n正文", "绪论"), ("目录\n第一章\n正文", "第一章"), ("正文\n更多", "正文"), ("第一章\n第二章 \n正文", "第二章 ")])
def test_body_start(spark, body, first):
    rows = lines.body_lines(lines.explode_lines(spark.createDataFrame([("d", body)], "source_id string, text string"))).orderBy("line_no").collect()
    assert rows[0].line == first


def test_heading_levels(spark):
    titles = ["第一篇 总论", "第一篇绪论", "第2章 心脏", "绪 论", "第三节 肺", "一、概述", "（二）病因", "1. 症状", "(3)、体征", "短标题", "这是一句完整的话。", "长" * 37, "第一章"]
    assert many(spark, titles, headings.heading_level) == [1, 4, 2, 2, 3, 4, 5, 6, 6, 4, None, None, 2]


def test_heading_detection(spark):
    got = many(spark, ["## 第一章 心脏 ..... 12", "# 版权页", "正文", "### a|b  c", "# cip data"], headings.detect_heading)
    assert [g and (g.level, g.title, g.page) for g in got] == [(2, "第一章 心脏", 12), None, None, (4, "a b c", None), None]


def test_chapter_titles_merge_and_nothing_is_lost(spark):
    body = "# 第一篇 甲\n## 第一章\n正文留下\n## 心脏\n内容\n## 肺\n第二段"
    docs = spark.createDataFrame([("d", body)], "source_id string, text string")
    out = cleaning.clean_markdown(docs, keep_front_matter=True).first().text
    assert "## 第一章 心脏" in out and "正文留下" in out and "#### 肺" in out and "\n\n\n" not in out and out.endswith("第二段\n")
    recs = cleaning.heading_records(cleaning.clean_lines(docs, True)).orderBy("line_no").collect()
    assert [(r.heading_level, r.part, r.chapter, r.subsection) for r in recs] == [(1, "第一篇 甲", "", ""), (2, "第一篇 甲", "第一章 心脏", ""), (4, "第一篇 甲", "第一章 心脏", "肺")]


def test_numbered_items(spark):
    assert one(spark, "前言1.甲 2.乙 3.5丙", chunking.split_numbered) == ["前言", "1.甲", "2.乙 3.5丙"]
    assert many(spark, ["1. 甲", "前 12、乙 3. 丙", "3.5"], chunking.without_number) == ["甲", "前 乙 3. 丙", "3.5"]
    assert many(spark, ["1.a；2.b；3.c；", "1." + "长" * 50 + " 2." + "长" * 50, "1.位于 2.包括", "1.a 2.b", "无"], chunking.list_kind) == ["short_label_list", "explanatory", "explanatory", "none", "none"]
    assert many(spark, ["1." + "字" * 24, "1.位于", "1.短", "位于"], chunking.is_lone_item) == [True, True, False, False]


BOOK = """# 第一部
## 第一章
1. 位于左侧，包括心房与心室等结构，负责循环

接续的文字没有编号
| a | b |
| 1 | 2 |

普通段落一。

普通段落二。
## 第二章
1.甲；2.乙；3.丙；
"""


def test_blocks_and_chunks(spark):
    docs = spark.createDataFrame([("dir/book.md", BOOK)], "source_id string, text string")
    b = chunking.parse_blocks(docs).orderBy("block_no").collect()
    assert [(r.block_type, r.line_start, r.line_end) for r in b] == [("numbered_item", 3, 5), ("table", 6, 7), ("paragraph", 9, 9), ("paragraph", 11, 11), ("short_label_list", 13, 13)]
    assert b[0].text == "1. 位于左侧，包括心房与心室等结构，负责循环接续的文字没有编号" and b[0].section_path == "第一部 > 第一章"
    c = chunking.build_chunks(docs, doc_type="书").orderBy("chunk_index").collect()
    assert [r.metadata.block_type for r in c] == ["numbered_item", "table", "paragraph_group", "short_label_list"]
    assert c[2].answer_text == "普通段落一。\n\n普通段落二。" and c[2].search_text == "文档类型：书\n书名：book\n章节路径：第一部 > 第一章\n正文：普通段落一。\n\n普通段落二。"
    assert re.fullmatch(r"book:2:[0-9a-f]{16}", c[2].chunk_id)


def test_packing():
    assert chunking.group_numbers([100, 200, 900, 50, 260, 10], [False] * 6, [""] * 6, 1200, 250) == [0, 0, 1, 2, 2, 3]
    assert chunking.group_numbers([10, 10, 10, 10], [False, True, False, False], ["a", "a", "a", "b"], 1200, 250) == [0, 1, 2, 3]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a。 ;\n字", max_size=300), st.integers(5, 60), st.integers(0, 30))
def test_pieces_cover_the_text(t, size, overlap):
    cuts = chunking.cut_points(t, size, min(overlap, size // 2))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(0 < b - a <= size or len(t) <= size for a, b in cuts)
    assert all(c <= b and a < c for (a, b), (c, _) in zip(cuts, cuts[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.booleans(), st.sampled_from("ab")), max_size=30))
def test_groups_never_cross_a_section(rows):
    g = chunking.group_numbers(*zip(*rows, strict=True), 1200, 250) if rows else []
    for i in range(1, len(g)):
        assert g[i] in (g[i - 1], g[i - 1] + 1)
        if g[i] == g[i - 1]:
            assert rows[i][2] == rows[i - 1][2] and not rows[i][1] and not rows[i - 1][1]


def test_elements(spark):
    rows = [("f", 0, "Title", "T"), ("f", 1, "NarrativeText", "a  b"), ("f", 2, "ListItem", "x"), ("f", 3, "Text", "y"), ("f", 4, "Text", "z"), ("f", 5, "Text", "  ")]
    r = cleaning.render_elements(spark.createDataFrame(rows, "source_id string, element_no int, category string, text string")).first()
    assert r.markdown == "# f\n\n## T\n\na b\n- x\n\ny\nz\n" and r.elements == 5 and r.text_chars == 7 and r.categories == {"Title": 1, "NarrativeText": 1, "ListItem": 1, "Text": 2}


def test_html(spark):
    page = "<html><style>s</style><p>a &amp; b</p><script>x<p>y</p></script><!-- c --><svg><text>t</text></svg><div> c<br>d </div>"
    assert one(spark, page, html.html_to_text) == "a & b\nc\nd" == one(spark, page, html.parse_html)
    assert html.text_of_html("<p>&eacute;&#x4e2d;<noscript>n</noscript>") == "é中"
    assert one(spark, "http://a/b#c", html.without_fragment) == "http://a/b"
    assert one(spark, "a；b; c；", html.sub_questions) == ["a", "b", "c"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, id string, score double")


def test_fusion(spark):
    dense = hits(spark, [(1, 1, "a", 0.9), (1, 2, "b", 0.5), (1, 3, "", 0.4), (2, 1, "z", 0.1)])
    sparse = hits(spark, [(1, 1, "b", 9.0), (1, 2, "c", 1.0)])
    got = [(r.query_id, r["rank"], r.id, round(r.weighted_score, 4), r.score) for r in retrieval.weighted_fuse(dense, sparse).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "a", 0.7, 0.9), (1, 2, "b", 0.44, 0.5), (1, 3, "c", 0.0, 1.0), (2, 1, "z", 0.7, 0.1)]
    equal = retrieval.weighted_fuse(dense, sparse, dense_weight=0, sparse_weight=-1).filter("id = 'b'").first()
    assert equal.weighted_score == pytest.approx(0.5 * 0.2 + 0.5)


def test_queries_in_blocks_give_the_same(spark):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, vector array<double>")
    q = e.filter("id < 9").withColumnRenamed("id", "query_id")
    a, b = (sorted(map(tuple, retrieval.dense_topk(q, e, 4, n).collect())) for n in (2, 100))
    assert a == b and len(a) == 36


def test_postings(spark):
    m = spark.createDataFrame([(1, {5: 1.0, 6: 0.0}), (2, {5: 2.0})], "id long, vector map<int,double>")
    p = retrieval.postings_of(m)
    got = [(r.id, r.score) for r in retrieval.sparse_topk(p.withColumnRenamed("id", "query_id").filter("query_id = 1"), p).orderBy("rank").collect()]
    assert got == [(2, 2.0), (1, 1.0)]


def catalog_rows(spark):
    rows = [(1, "Aa_bb", "", "", "", "甲氏菌", "", "甲属", ""), (2, "aa_bb", "甲菌", "细菌", "", "", "Aa", "", ""), (3, None, None, None, None, None, None, None, None), (4, "", "乙病毒", "病毒", "", "", "", "", "")]
    return catalog.records(spark.createDataFrame(rows, "ord int, latin string, chinese string, type string, p_latin string, p_chinese string, p_genus_latin string, p_genus_chinese string, p_type string"))


def test_catalog(spark):
    r = catalog_rows(spark)
    got = {x.key: x for x in catalog.merge(r).collect()}
    a = got["latin:aa_bb"]
    assert set(got) == {"latin:aa_bb", "zh:乙病毒"} and a.species_latin == "Aa_bb" and a.type == "细菌" and a.species_chinese == "甲氏菌" and a.source_count == 2 and a.genus_chinese == "甲属"
    assert a.aliases[:5] == ["Aa_bb", "Aa bb", "甲氏菌", "Aa", "甲属"]
    assert "甲菌" in a.aliases and "甲氏杆菌" in a.aliases and len(a.aliases) == len(set(a.aliases))
    c = catalog.counters(r).first()
    assert (c.n_rows, c.missing, c.unique_records) == (4, 1, 2)
    case = spark.createDataFrame([(1, "", "", "甲菌", "", "", ""), (2, "No_such", "", "", "", "", "x")], "case_id int, pathogen_type string, species_latin string, species_chinese string, genus_latin string, genus_chinese string, other string")
    names = catalog.index(catalog.merge(r))
    e = {x.case_id: x for x in catalog.enrich(case, names).collect()}
    assert e[1].species_latin == "Aa_bb" and e[1].pathogen_type == "细菌" and e[2].species_latin == "" and e[1].species_chinese == "甲菌"


CASE = """单个mNGS检出病原 病原基本信息：{'类型': '细菌', '种-拉丁名': 'Aa_bb', '种-中文名': '甲菌', '属-拉丁名': 'Aa', '属-中文名': '甲属'}
患者信息为：{'年龄': '60', '性别': '男', '临床表型': '发热', '医生诊断': '肺炎'}
种-检出序列数：2。覆盖率：0.05%。种-丰度：0.1。属-检出序列数为5。mNGS检测组织为：肺泡灌洗液，患者的免疫状态为：抑制。
病原的致病信息为：可致 肺炎

输出要求：json"""


def test_cases(spark):
    escaped = '{\\"role\\": \\"user\\", \\"content\\": \\"覆盖率：0.5。\\"}'
    rows = [(1, CASE), (2, json.dumps({"messages": [{"role": "user", "content": "种-丰度：3。"}], "Latin": "Cc_dd", "Chinese": "丙", "病原类型": "真菌", "mianyi": "2", "属排名": "4"}, ensure_ascii=False)), (3, '"messages": [{"role": "user", "content": "覆盖率：0.2。"}], "Latin": "Ee_ff"'), (4, escaped), (5, "broken {json Gg_hh"), (6, None), (7, '{"role": "user", "content": "种-丰度：7。"}')]
    got = {r.case_id: r for r in cases.parse_cases(spark.createDataFrame(rows, "case_id int, text string")).collect()}
    a = got[1]
    assert (a.species_latin, a.species_chinese, a.genus_latin, a.genus_chinese, a.pathogen_type) == ("Aa_bb", "甲菌", "Aa", "甲属", "细菌")
    assert (a.age, a.sex, a.phenotype, a.diagnosis) == ("60", "男", "发热", "肺炎")
    assert (a.reads, a.coverage, a.abundance, a.genus_reads, a.sample_type, a.immune_status, a.pathogenicity_text) == ("2", "0.05%", "0.1", "5", "肺泡灌洗液", "抑制", "可致 肺炎")
    b = got[2]
    assert (b.species_latin, b.species_chinese, b.pathogen_type, b.immune_status, b.genus_rank, b.abundance, b.genus_latin) == ("Cc_dd", "丙", "真菌", "抑制", "4", "3", "Cc")
    assert got[3].species_latin == "Ee_ff" and got[3].coverage == "0.2" and got[4].coverage == "0.5" and got[5].species_latin == "Gg_hh" and got[7].abundance == "7"
    assert all(got[6][f] == "" for f in cases.FIELDS)


def test_rules(spark):
    df = spark.createDataFrame([("3", "", "1"), ("4", "0.05", "1"), ("9", "1", ""), ("9", "1", "0.05%"), ("9", "1", "1")], "r string, c string, a string")
    assert [x.y for x in df.select(cases.low_confidence("r", "c", "a").alias("y")).collect()] == [True, True, True, True, False]
    assert many(spark, ["尿液", "痰", "全血", "脑脊液", "粪便", "骨", None], cases.site_terms) == ["尿路感染 泌尿系统感染", "肺部感染 呼吸道感染 肺炎", "血流感染 菌血症 败血症", "中枢神经系统感染 脑膜炎", "肠道感染 腹泻", "感染部位", "感染部位"]
    assert many(spark, ["0", "3", "x", None], cases.immune_state) == ["未知", "低下", "x", ""]


def test_expansion_and_its_cap(spark):
    parsed = cases.parse_cases(spark.createDataFrame([(1, CASE)], "case_id int, text string")).withColumn("aliases", F.array(F.lit("Aa"), F.lit("别名"), F.lit("又名")))
    q = [r.query for r in expansion.expand(parsed).orderBy("query_no").collect()]
    assert len(q) == 18 and q[0] == "甲菌 致病性 感染 临床表现 感染部位" and q[3] == "甲菌 肺泡灌洗液 感染 肺部感染 呼吸道感染 肺炎" and q[5].startswith("Aa bb ") and not any(x.startswith("甲属") for x in q)
    q = [r.query for r in expansion.expand(parsed, most=100).orderBy("query_no").collect()]
    assert "甲属 肺泡灌洗液 感染 定植" in q and "可致 肺炎" in q and q[-1] == "甲菌 Aa bb Aa_bb 甲属 Aa 肺泡灌洗液 发热 肺炎 抑制 mNGS 有害 无害 判断"


def test_evidence(spark):
    rows = [(1, 1, 1, "甲菌 text", "f1", "s", 0.0, 0.4), (1, 1, 2, "other", "f2", "s", 0.9, 0.1), (1, 2, 1, "甲菌 text", "f1", "s", 0.8, 0.4), (1, 2, 2, "x" * 80 + "1", "f3", "s", 0.5, 0.0), (1, 2, 3, "x" * 80 + "2", "f3", "s", 0.6, 0.0)]
    docs = spark.createDataFrame(rows, "case_id int, query_no int, rank int, text string, source_file string, section_path string, weighted_score double, score double")
    kept = evidence.first_wins(docs)
    assert kept.count() == 3
    ranked = evidence.rerank(kept.withColumn("terms", F.array(F.lit("甲菌"), F.lit("F2"))).withColumn("exact", F.array(F.lit("甲菌"))))
    got = [(r.source_file, round(r.final_score, 3)) for r in ranked.orderBy("final_rank").collect()]
    assert got == [("f1", 2.4), ("f2", 1.5), ("f3", 0.5)]
    case = spark.createDataFrame([(1,), (2,)], "case_id int")
    out = {r.case_id: r.context for r in evidence.format_evidence(ranked.withColumn("page", F.lit(3)), case).collect()}
    assert out[1].startswith("[证据1]\n引用ID: 证据1\n可填入source: f1 | 未标注章节 | 页码: 3\n来源: f1\n章节: 未标注\n页码: 3\n文件: f1\n内容: 甲菌 text\n\n[证据2]") and out[2] == evidence.NOTHING


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "病", "感冒", {"名称": "感冒"}), (2, "症", "发热", {"名称": "发热"}), (3, "药", None, {}), (4, "病", "感", {}), (5, "病", "感冒", {"v": "2"})], "id long, label string, name string, props map<string,string>")
    edges = spark.createDataFrame([(5, "引起", 2), (5, "引起", 2), (4, "包括", 5)], "src long, rel string, dst long")
    texts = spark.createDataFrame([(1, "感冒与感冒发热"), (2, "无"), (3, None)], "doc_id int, text string")
    hits = graph.match_names(texts, nodes)
    assert sorted((r.doc_id, r.name, r.start) for r in hits.collect()) == [(1, "发热", 6), (1, "感", 1), (1, "感", 4), (1, "感冒", 1), (1, "感冒", 4)]
    rel = graph.relation_strings(hits.filter("name = '感冒'"), nodes, edges, "doc_id").first()
    assert rel.relations == "感 包括 感冒；感冒 v: 2；感冒 引起 发热"
    assert [r.doc_id for r in graph.present(texts, hits, "doc_id").collect()] == [1]
    assert graph.match_names(texts, nodes.limit(0)).count() == 0


def test_routing(spark):
    qs = ["当前患者是否有害", "有害 mNGS 病原", "有害 患者信息 免疫状态", "有害 患者信息", "根据知识库 搜索", "根据知识图谱", "搜索一下", "hello", ""]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i int, q string")
    got = [r.y for r in df.select("i", routing.code_of(routing.intent_label("q", F.lit(False), F.lit("文本生成"))).alias("y")).orderBy("i").collect()]
    assert got == [9, 9, 9, 0, 5, 10, 8, 0, 0]
    assert one(spark, "x", lambda c: routing.intent_label(c, F.lit(True), F.lit("图片生成"))) == "图片描述"
    assert one(spark, "x", lambda c: routing.intent_label(c, F.lit(None), F.lit("图片生成"))) == "图片生成"
    with pytest.raises(Exception, match="no tool"):
        spark.range(1).select(routing.tool_of(F.lit(6))).collect()
    assert many(spark, ["a.PNG", "b.pdf", "c.docx", "d.txt", "e.zip", None], routing.upload_kind) == ["image", "pdf", "docx", "text", "unsupported", "unsupported"]


def test_tools(spark):
    q = spark.createDataFrame([(1, "根据知识库 x", False, None), (2, "hello", False, "文本生成")], "id int, question string, has_image boolean, model_label string")
    t = tools.Tools()
    t.add("retrieval", tools.retrieval_tool(lambda d: d.select("id", F.lit(1).alias("rank"), F.lit("passage").alias("text"))))
    got = {r.id: (r.tool, r.answer) for r in t.answer(q).collect()}
    assert got[2] == ("text", None) and "passage" in got[1][1] and got[1][0] == "retrieval"
    with pytest.raises(KeyError):
        t.add("nothing", None)
    assert [r.a for r in q.select("id", tools.complete(F.col("question"), lambda: lambda p: p[:5].upper()).alias("a")).orderBy("id").collect()] == ["根据知识库", "HELLO"]
    v = q.select(tools.encode(F.col("question"), tools.lexical_encoder).alias("e")).select("e.*").collect()
    assert all(len(r.vector) == 64 and r.sparse_vector for r in v)


def test_dialog(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "system", "s")], "conv_id long, turn long, role string, text string")
    assert [(m.role, m.content) for m in dialog.messages(turns, "sys").first().messages] == [("system", "sys"), ("user", "a"), ("assistant", "b")]


def test_chunk_files_round_trip_and_blank_fields_fail(spark, tmp_path):
    docs = spark.createDataFrame([("dir/book.md", BOOK)], "source_id string, text string")
    chunks = chunking.build_chunks(docs)
    sinks.write_chunks(chunks, f"{tmp_path}/out")
    back = readers.read_chunks(spark, f"{tmp_path}/out", "*.json")
    assert sorted(r.chunk_id for r in back.collect()) == sorted(r.chunk_id for r in chunks.collect())
    (tmp_path / "bad.chunks.jsonl").write_text('\n{"chunk_id": "a", "search_text": " ", "answer_text": "x"}\n')
    with pytest.raises(Exception, match="blank required field"):
        readers.read_chunks(spark, str(tmp_path)).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# t")
    (tmp_path / "a" / "x.clean.md").write_text("# c")
    assert sorted(r.source_id for r in readers.read_markdown(spark, str(tmp_path)).collect()) == ["a/x.clean.md", "a/x.md"]
    assert [r.source_id for r in readers.read_markdown(spark, str(tmp_path), skip_clean=True).collect()] == ["a/x.md"]
    (tmp_path / "r.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert [(r.line_no, r.k) for r in readers.read_jsonl(spark, f"{tmp_path}/r.jsonl", "k int").orderBy("line_no").collect()] == [(1, 1), (3, 2)]
    (tmp_path / "r.jsonl").write_text('{"k": 1}\n{bad\n')
    with pytest.raises(Exception, match="invalid JSON at .*:2"):
        readers.read_jsonl(spark, f"{tmp_path}/r.jsonl", "k int").collect()
    assert readers.read_catalog(spark, f"{tmp_path}/none.json").count() == 0
    files = readers.read_files(spark, str(tmp_path / "a"), first=1)
    got = readers.parse_files(files, lambda c: [("Text", c.decode()), ("Text", "b")]).orderBy("element_no").collect()
    assert [(r.category, r.text) for r in got] == [("Text", "# c"), ("Text", "b")]
    bad = readers.parse_files(files, lambda c: 1 / 0).collect()
    assert len(bad) == 1 and "ZeroDivisionError" in bad[0].error
    n, e = readers.graph_tables(spark, "no_nodes", "no_edges")
    assert n.count() == e.count() == 0
    assert [readers.text_of_bytes(x) for x in ("中".encode("utf-16"), "中".encode(), "中".encode("gb18030"), None)] == ["中", "中", "中", None]
    assert spark.createDataFrame([(bytearray(b"ab"),)], "c binary").select(readers.data_uri(F.col("c")).alias("u")).first().u == "data:image/png;base64," + base64.b64encode(b"ab").decode()
    tree = readers.settings("a:\n  b: 1\n  c:\n    d: 'x'\n    e: [p, q]\nlist:\n  - u\n  - v # note\n")
    assert tree == {"a": {"b": 1, "c": {"d": "x", "e": ["p", "q"]}}, "list": ["u", "v"]} and readers.setting(tree, "a", "c", "d") == "x"


def test_catalog_file_round_trip(spark, tmp_path):
    merged = catalog.merge(catalog_rows(spark))
    sinks.write_catalog(merged, f"{tmp_path}/catalog")
    assert sorted(r.species_chinese for r in readers.read_catalog(spark, f"{tmp_path}/catalog").collect()) == sorted(r.species_chinese for r in merged.collect())


def test_keyed_table(spark, tmp_path):
    t = sinks.KeyedTable(spark, f"{tmp_path}/t", "id")
    t.upsert(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, o int, v string"), ["o"])
    t.upsert(spark.createDataFrame([(2, 5, "d"), (3, 1, "e")], "id int, o int, v string"), ["o"])
    assert sorted(map(tuple, t.read().collect())) == [(1, 2, "b"), (2, 5, "d"), (3, 1, "e")]
    with pytest.raises(ValueError, match="vector"):
        sinks.check_fields(t.read())
    t.drop()
    assert t.read() is None


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(src))
    q = ingest.chat_history(spark.readStream.schema(turns.schema).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("chat").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from chat").collect()
    assert r[-1].n_turns == 2 and json.loads(r[-1].messages)[1] == {"role": "assistant", "content": "b"}
    t = sinks.KeyedTable(spark, f"{tmp_path}/t", "conv_id")
    for _ in range(2):  # a second start finds nothing new
        ingest.stream_upsert(spark.readStream.schema(turns.schema).parquet(str(src)), t, ["turn"], f"{tmp_path}/cp2")
    assert [tuple(x) for x in t.read().collect()] == [(1, 1, "assistant", "b")]


def test_long_conversations_keep_their_beginnings(spark, tmp_path):
    src = tmp_path / "in"
    turns = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(1200)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(src))
    q = ingest.chat_history(spark.readStream.schema(turns.schema).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("long_chat").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from long_chat").collect()
    assert r[-1].n_turns == 1200 and [m["content"] for m in json.loads(r[-1].messages)] == [f"t{k}" for k in range(1200)]


def test_sessions(spark):
    e = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) ts, 1L user_id from values (0), (10), (100) t(m)")
    assert sorted(r.n for r in ingest.sessions(e).collect()) == [1, 2]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-5, 5, allow_nan=False)), min_size=1, max_size=8))
def test_fused_scores_are_shares(spark, rows):
    d = spark.createDataFrame([(q, i + 1, str(i), s) for i, (q, s) in enumerate(rows)], "query_id long, rank int, id string, score double")
    assert all(0 <= r.weighted_score <= 1 for r in retrieval.weighted_fuse(d, d).collect())


def test_web_search(spark):
    def engine():
        return lambda q: [("http://a#x", "t1", 200, "<p>a</p>"), ("http://a#y", "t1", 200, "<p>b</p>"), ("http://b", "t2", 404, ""), ("http://c", "t0", 200, "<p></p>")] if q != "bad" else 1 / 0

    q = spark.createDataFrame([(1, "x"), (2, "bad"), (3, " ")], "id int, query string")
    got = web.search_pages(q, {"e1": engine, "e2": engine}, n=1)
    assert sorted((r.id, r.engine, r.url) for r in got.collect()) == [(1, "e1", "http://a"), (1, "e2", "http://a")]
    pages = web.search_pages(q, {"e1": engine})
    assert [(r.title, r.text) for r in web.page_texts(pages, "url").collect()] == [("t1", "a")]


def test_collections(spark):
    with pytest.raises(LookupError, match="no_such"):
        retrieval.collection(spark, "no_such")
    sinks.create_collection(spark, "col1", 2, drop=True)
    sinks.check_fields(retrieval.collection(spark, "col1"))
    v = spark.sql("select array(1.0f, 2.0f) vector")
    assert sinks.checked_vectors(v, 2).count() == 1
    with pytest.raises(Exception, match="dimension 3"):
        sinks.checked_vectors(v, 3).collect()
    a, b = hits(spark, [(1, 1, "a", 0.9), (2, 1, "b", 0.5)]), hits(spark, [(1, 1, "b", 9.0)])
    assert sorted(map(tuple, retrieval.probe_counts(a, b).collect())) == [(1, 1, 1), (2, 1, 0)]
    assert retrieval.non_blank(spark.createDataFrame([(" ",), (None,), ("q",)], "query string")).count() == 1
    spark.sql("drop table col1")


def test_sparse_route_equals_a_plain_sum(spark, monkeypatch):
    import collections
    import random

    rng = random.Random(2)
    monkeypatch.setattr(retrieval, "FREQUENT", 3)
    monkeypatch.setattr(retrieval, "CHUNK", 16)
    docs = {i: collections.Counter(rng.choice("aaabbcdefghijklmnop") for _ in range(rng.randrange(0, 25))) for i in range(90)}
    asked = {(q, "x"): collections.Counter(rng.choice("aabcdefgz") for _ in range(6)) for q in range(7)}
    p = spark.createDataFrame([(i, t, float(n)) for i, c in docs.items() for t, n in c.items()] + [(500, "a", 0.0), (501, None, 1.0)], "id long, term string, weight double").repartition(3)
    q = spark.createDataFrame([(k, t, float(n)) for k, c in asked.items() for t, n in c.items()], "query_id struct<n:long,s:string>, term string, weight double")
    want = []
    for k, c in asked.items():
        scores = sorted(((-sum(n * d[t] for t, n in c.items()), i) for i, d in docs.items()))
        want += [(k, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5]) if s < 0]
    for block in (2, 100):
        got = [(tuple(r.query_id), r["rank"], r.id, r.score) for r in retrieval.sparse_topk(q, p, 5, block).collect()]
        assert sorted(got) == sorted(want)
    none = retrieval.sparse_topk(q.limit(0), p)
    assert none.columns == ["query_id", "rank", "id", "score"] and none.count() == 0


def test_blank_queries_have_no_results(spark):
    vectors = [(1, " ", [1.0, 0.0]), (2, "x", [1.0, 0.0])]
    queries = spark.createDataFrame(vectors, "query_id long, query string, vector array<double>")
    corpus = spark.createDataFrame([(7, [1.0, 0.0])], "id long, vector array<double>")
    terms = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "query_id long, term string, weight double")
    postings = spark.createDataFrame([(7, "a", 1.0)], "id long, term string, weight double")
    assert [r.query_id for r in retrieval.hybrid_retrieve(queries, corpus, terms, postings).collect()] == [2]


def test_clean_lines_equal_the_single_steps(spark):
    texts = [("a", "x  y\r\n##\n ![p](q) z ，w\n\n（ a ）​ \n"), ("b", None), ("c", ""), ("d", "# head\n   ###   \n﻿end ")]
    docs = spark.createDataFrame(texts, "source_id string, text string")
    step = lines.explode_lines(docs).withColumn("line", lines.normalize_line("line")).filter(~lines.is_empty_heading("line"))
    want = step.select("source_id", "line_no", lines.normalize_spaces(lines.without_images("line")).alias("line")).filter("line <> ''")
    assert sorted(map(tuple, lines.clean_lines(docs).collect())) == sorted(map(tuple, want.collect())) and want.count() == 5


def test_progress_of_batches(spark):
    rows = spark.range(23).withColumnRenamed("id", "k")
    got = [tuple(r) for r in sinks.progress(rows, "k", 10).orderBy("batch").collect()]
    assert got == [(1, 10, 23, 10 / 23), (2, 20, 23, 20 / 23), (3, 23, 23, 1.0)]
    assert sinks.progress(rows.limit(0), "k", 10).count() == 0


def test_records_with_nested_braces(spark):
    schema = "struct<a:string,b:string>"
    texts = ["m {'a': '1', 'n': {'x': {}, 'y': None}, 'b': '2'} {'a': '9'}", 'x m: t {"b": 3, "n": [{"q": 1}], "a": null} }', "m {'a': '1'", "m no record", None, "", "{'a': 'before'} m", "m {} {'a': '1'}", "m {'a': 'it\\'s', 'b': True}", "m }{'a': '1'}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r and (r.r.a, r.r.b) for r in df.select("i", cases.record_after("t", "m", schema).alias("r")).orderBy("i").collect()]
    assert got == [("1", "2"), (None, "3"), None, None, None, None, None, (None, None), ("it's", "true"), ("1", None)]
