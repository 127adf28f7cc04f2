"""Evidence: first-wins dedup over a case's queries, boosted re-ranking, formatting, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoders import encode
from ..functions.text import col, ordered_distinct, squash, text_or_empty
from . import retrieval
from .collection import Collection

MAX_DOCS, MAX_CHARS = 12, 1800
#: Queries of a case are numbered below this.
MAX_QUERIES = 100
#: Fixed value, as are the labels of an evidence block: the context of a case without evidence.
NOTHING = "未从知识库检索到可用证据。此时 evidence 数组必须为空，不要编造文献来源。"


def search(collection: Collection, queries: DataFrame, make_encoder, work: str, top_k: int = retrieval.TOP_K, candidates: int = retrieval.CANDIDATES) -> DataFrame:
    """queries: (case_id, a number; query_no below MAX_QUERIES; query). Every query of every case by both routes over the stored collection, encoded once
    by the collection's own encoder, fused for itself: case_id, query_no, rank, id, weighted_score, score and the collection's payload but its
    texts and vectors. Blank queries have no hits."""
    asked = retrieval.non_blank(queries).withColumn("query_id", F.col("case_id").cast("long") * MAX_QUERIES + F.col("query_no"))
    terms = retrieval.term_maps(asked, "query_id", "query").withColumnRenamed("id", "query_id")
    encoded = asked.select("query_id", "query", encode(F.col("query"), make_encoder).alias("e")).select("query_id", "query", F.when(F.exists("e.vector", lambda x: x != 0), F.col("e.vector")).alias("vector"))
    stored = f"{work}/queries"
    encoded.join(terms, "query_id", "left").write.parquet(stored)
    hits = collection.hybrid(collection.spark.read.parquet(stored), f"{work}/search", top_k, candidates)
    payload = collection.documents.drop("no", "vector", "sparse_vector", "text")
    return hits.join(payload, "id").withColumns({"case_id": F.floor(F.col("query_id") / MAX_QUERIES), "query_no": F.pmod("query_id", F.lit(MAX_QUERIES))})


def doc_key(source="source_file", text="text", chunk=None, page=None) -> Column:
    """Source, chunk, page and the first 80 characters; chunk and page are empty unless given."""
    return F.concat_ws("|", text_or_empty(source), text_or_empty(chunk) if chunk else F.lit(""), text_or_empty(page) if page else F.lit(""), F.substring(text_or_empty(text), 1, 80))


def first_wins(docs: DataFrame, case: str = "case_id", key: Column | None = None) -> DataFrame:
    """docs: (case_id, query_no, rank, ...). Of documents with one key the first by query, then rank. Adds seen, its place."""
    d = docs.withColumn("__key", doc_key() if key is None else key)
    firsts = d.withColumn("__n", F.row_number().over(Window.partitionBy(case, "__key").orderBy("query_no", "rank"))).filter("__n = 1")
    return firsts.withColumn("seen", F.row_number().over(Window.partitionBy(case).orderBy("query_no", "rank"))).drop("__n", "__key")


def boost(terms, exact, haystack) -> Column:
    """2 for each of the exact names found in the haystack, 0.6 for each other term."""
    hay = F.lower(text_or_empty(haystack))
    return F.aggregate(col(terms), F.lit(0.0), lambda s, t: s + F.when((t != "") & F.contains(hay, F.lower(t)), F.when(F.array_contains(col(exact), t), 2.0).otherwise(0.6)).otherwise(0.0))


def case_terms() -> Column:
    """Names and findings of a parsed, enriched case that evidence is searched for."""
    def spaced(c):
        return F.replace(text_or_empty(c), F.lit("_"), F.lit(" "))

    own = F.array("species_chinese", "species_latin", spaced("species_latin"), "genus_chinese", "genus_latin", spaced("genus_latin"), "sample_type", "phenotype", "diagnosis")
    return ordered_distinct(F.concat(F.coalesce(F.col("aliases"), F.array().cast("array<string>")), own))


def base_score(weighted="weighted_score", score="score") -> Column:
    """The fused score; a fused score of exactly 0 falls through to the raw one."""
    return F.coalesce(F.nullif(col(weighted), F.lit(0.0)), F.nullif(col(score), F.lit(0.0)), F.lit(0.0))


def rerank(docs: DataFrame, case: str = "case_id", terms: str = "terms", exact: str = "exact") -> DataFrame:
    """docs with terms and exact (arrays of strings). Adds final_score and final_rank; ties stay in the order seen."""
    hay = F.concat_ws(" ", text_or_empty("text"), text_or_empty("source_file"), text_or_empty("section_path"))
    scored = docs.withColumn("final_score", base_score() + boost(terms, exact, hay))
    return scored.withColumn("final_rank", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("final_score"), "seen")))


def _first(*names) -> Column:
    return F.coalesce(*[F.nullif(text_or_empty(n), F.lit("")) for n in names], F.lit(""))


def evidence_block(n, text, title, section, page, file) -> Column:
    """One numbered block; what is missing is named so."""
    t = F.when(title == "", "未知来源").otherwise(title)
    has_page = (page != "") & (page != "-1")
    cited = F.concat(t, F.lit(" | "), F.when(section == "", "未标注章节").otherwise(section), F.when(has_page, F.concat(F.lit(" | 页码: "), page)).otherwise(F.lit("")))

    def line(name, value, there):
        return F.concat(F.lit(f"{name}: "), F.when(there, value).otherwise(F.lit("未标注")))

    no = n.cast("string")
    return F.concat_ws(
        "\n", F.concat(F.lit("[证据"), no, F.lit("]")), F.concat(F.lit("引用ID: 证据"), no), F.concat(F.lit("可填入source: "), cited), F.concat(F.lit("来源: "), t),
        line("章节", section, section != ""), line("页码", page, has_page), line("文件", file, file != ""), F.concat(F.lit("内容: "), F.substring(squash(text), 1, MAX_CHARS)),
    )


def format_evidence(docs: DataFrame, cases: DataFrame, case: str = "case_id", max_docs: int = MAX_DOCS) -> DataFrame:
    """case, context: the blocks of its first max_docs documents by final_rank; a fixed sentence if it has none.
    Optional columns of docs: title, doc_name, source, source_file, section, chapter, page, page_number, doc_path."""
    have = set(docs.columns)

    def pick(*names):
        return _first(*[n for n in names if n in have]) if have & set(names) else F.lit("")

    page = F.coalesce(*[F.col(n).cast("string") for n in ("page", "page_number") if n in have], F.lit(""))
    top = docs.filter(F.col("final_rank") <= max_docs)
    block = evidence_block(F.col("final_rank"), F.col("text"), pick("title", "doc_name", "source", "source_file"), pick("section", "chapter"), page, pick("doc_path", "source", "source_file"))
    made = top.select(case, "final_rank", block.alias("block")).groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    return cases.select(case).join(made, case, "left").select(case, F.coalesce("context", F.lit(NOTHING)).alias("context"))


def judge_prompt(question, context) -> Column:
    """A prompt that asks for a verdict as JSON with cited evidence. The wording is this package's own."""
    return F.concat(
        F.lit("Judge whether the detected organism is harmful to this patient. Answer with one JSON object: label, explanation, evidence (ids from the list below only), limitations.\n\nEvidence:\n"),
        text_or_empty(context), F.lit("\n\nCase:\n"), text_or_empty(question),
    )


def answer_prompt(question, context) -> Column:
    return F.concat(F.lit("Answer from the passages only; say so if they don't hold the answer.\n\nPassages:\n"), text_or_empty(context), F.lit("\n\nQuestion:\n"), text_or_empty(question))
