"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, ann, decontaminate, hardneg, langid, linededup, lm, mixing, pii, simhash, tokencount, tokenindex, warc
from .common import read


def op1_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op2_ann(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_line_dedup(spark, sf_dir):
    return linededup.query(read(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    return lm.score_corpus(read(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op8_warc(spark, sf_dir):
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


def op9_language_id(spark, sf_dir):
    return langid.query(read(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op11_token_alignment(spark, sf_dir):
    return alignment.query(read(spark, sf_dir, "documents"))


def op12_token_index(spark, sf_dir):
    return tokenindex.query(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hardneg.query(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_ann, op3_line_dedup, op4_token_counts, op5_lm_scoring, op6_mixing, op7_simhash, op8_warc, op9_language_id, op10_decontamination,
        op11_token_alignment, op12_token_index, op13_hard_negatives,
    )
}
SQL = {"op6_mixing": mixing.SQL, "op8_warc": warc.SQL, "op10_decontamination": decontaminate.SQL, "op13_hard_negatives": hardneg.SQL}
