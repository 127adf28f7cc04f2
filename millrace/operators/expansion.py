"""Query expansion: one case becomes up to ``most`` retrieval queries, in a fixed order of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, ordered_distinct, text_or_empty
from .cases import low_confidence, site_terms

MOST = 18
#: What is asked of a name.
SPECIES = ("致病性 感染 临床表现 感染部位", "定植 背景病原 污染 mNGS", "case report infection clinical manifestation")


def _spaced(c) -> Column:
    return F.replace(text_or_empty(c), F.lit("_"), F.lit(" "))


def species_names(chinese="species_chinese", latin="species_latin", genus_latin="genus_latin", genus_chinese="genus_chinese", aliases="aliases") -> Column:
    """At most four names of the species; aliases that name its genus don't count."""
    genus = F.array(text_or_empty(genus_latin), text_or_empty(genus_chinese), _spaced(genus_latin))
    others = F.filter(F.coalesce(col(aliases), F.array().cast("array<string>")), lambda a: ~F.array_contains(genus, a))
    return F.slice(ordered_distinct(F.concat(F.array(text_or_empty(chinese), _spaced(latin), text_or_empty(latin)), others)), 1, 4)


def genus_names(genus_chinese="genus_chinese", genus_latin="genus_latin") -> Column:
    return F.slice(ordered_distinct(F.array(text_or_empty(genus_chinese), _spaced(genus_latin), text_or_empty(genus_latin))), 1, 3)


def _join(*parts) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def queries_of(most: int = MOST) -> Column:
    """array<string> over a parsed case's columns."""
    species, genus = species_names(), genus_names()
    sample, phenotype, diagnosis, immune, pathogenicity = (text_or_empty(c) for c in ("sample_type", "phenotype", "diagnosis", "immune_status", "pathogenicity_text"))
    none = F.array().cast("array<string>")

    def of_species(n):
        return F.array_compact(F.array(*[_join(n, s) for s in SPECIES], F.when(sample != "", _join(n, sample, "感染", site_terms(sample))), F.when(phenotype != "", _join(n, phenotype, "临床表型 症状"))))

    def of_genus(n):
        return F.array_compact(F.array(_join(n, "感染 临床表现 感染部位"), F.when(sample != "", _join(n, sample, "感染 定植"))))

    site = F.when((sample != "") | (phenotype != ""), F.array(_join(sample, phenotype, "常见病原 感染 鉴别诊断"), _join(sample, "mNGS 背景菌 污染 定植 低序列数 低覆盖率"))).otherwise(none)
    primary = F.when(F.size(species) > 0, species[0]).otherwise(F.lit(""))
    rest = F.array_compact(F.array(
        F.when(diagnosis != "", _join(diagnosis, sample, phenotype, "感染 常见病原")),
        F.when(pathogenicity != "", F.substring(pathogenicity, 1, 220)),
        F.when(low_confidence("reads", "coverage", "abundance"), _join(primary, "低序列数 低覆盖率 低丰度 mNGS 污染 背景")),
        F.array_join(F.concat(F.slice(species, 1, 3), F.slice(genus, 1, 2), F.array(sample, phenotype, diagnosis, immune, F.lit("mNGS 有害 无害 判断"))), " "),
    ))
    every = F.concat(F.flatten(F.transform(species, of_species)), F.flatten(F.transform(genus, of_genus)), site, rest)
    return F.slice(ordered_distinct(every), 1, most)


def expand(cases: DataFrame, key: str = "case_id", most: int = MOST) -> DataFrame:
    """key, query_no (from 1), query."""
    return cases.select(key, F.posexplode(queries_of(most)).alias("n", "query")).select(key, (F.col("n") + 1).alias("query_no"), "query")
