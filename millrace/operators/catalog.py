"""Entity catalog: records from cases, keyed merge, priority lookup, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_of, ordered_distinct, squash, strip_quotes, text_or_empty

FIELDS = ("type", "species_latin", "species_latin_space", "species_chinese", "genus_latin", "genus_latin_space", "genus_chinese")


def clean(c) -> Column:
    return strip_quotes(squash(c))


def spaced(c) -> Column:
    return F.replace(text_or_empty(c), F.lit("_"), F.lit(" "))


def genus_of(latin) -> Column:
    return F.split_part(F.replace(text_or_empty(latin), F.lit(" "), F.lit("_")), F.lit("_"), F.lit(1))


def chinese_aliases(name) -> Column:
    """Fixed rules: 氏菌 also without 氏; a name in 菌 that isn't a 杆菌 also as one."""
    n = text_or_empty(name)
    return F.array_compact(F.array(F.when(n.contains("氏菌"), F.replace(n, F.lit("氏菌"), F.lit("菌"))), F.when(n.endswith("菌") & ~n.contains("杆菌"), F.concat(n.substr(F.lit(1), F.length(n) - 1), F.lit("杆菌")))))


def aliases_of(species_latin, species_chinese, genus_latin, genus_chinese) -> Column:
    own = F.array(text_or_empty(species_latin), spaced(species_latin), text_or_empty(species_chinese), text_or_empty(genus_latin), spaced(genus_latin), text_or_empty(genus_chinese))
    return ordered_distinct(F.concat(own, chinese_aliases(species_chinese)))


def records(rows: DataFrame) -> DataFrame:
    """rows: (ord, latin, chinese, type, and of the prompt's record p_latin, p_chinese, p_genus_latin, p_genus_chinese, p_type). One record each."""
    r = rows.select("ord", first_of(clean("latin"), clean("p_latin")).alias("species_latin"), first_of(clean("chinese"), clean("p_chinese")).alias("species_chinese"), clean("p_genus_latin").alias("gl"), clean("p_genus_chinese").alias("genus_chinese"), first_of(clean("type"), clean("p_type")).alias("type"))
    r = r.withColumn("genus_latin", first_of("gl", genus_of("species_latin"))).withColumn("species_latin_space", spaced("species_latin")).withColumn("genus_latin_space", spaced("genus_latin"))
    return r.select("ord", *FIELDS, aliases_of("species_latin", "species_chinese", "genus_latin", "genus_chinese").alias("aliases"), F.lit(1).cast("long").alias("source_count"))


def stable_key(latin="species_latin", chinese="species_chinese") -> Column:
    return F.when(text_or_empty(latin) != "", F.concat(F.lit("latin:"), F.lower(text_or_empty(latin)))).otherwise(F.concat(F.lit("zh:"), F.lower(text_or_empty(chinese))))


def merge(found: DataFrame) -> DataFrame:
    """One record per key: of each field the first non-empty value by ord, aliases in order of first sight, counts added. Rows with neither name go."""
    rows = found.filter((text_or_empty("species_latin") != "") | (text_or_empty("species_chinese") != "")).withColumn("key", stable_key())
    first = [F.coalesce(F.min_by(F.col(f), F.when(text_or_empty(f) != "", F.col("ord"))), F.lit("")).alias(f) for f in FIELDS]
    # an alias is gathered once a key with the place where it was first seen, so a key of many rows gathers its distinct aliases only
    seen = rows.select("key", "ord", F.posexplode("aliases").alias("pos", "alias")).groupBy("key", "alias").agg(F.min(F.struct("ord", "pos")).alias("at"))
    names = seen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return rows.groupBy("key").agg(*first, F.sum("source_count").alias("source_count")).join(names, "key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def counters(found: DataFrame) -> DataFrame:
    named = (text_or_empty("species_latin") != "") | (text_or_empty("species_chinese") != "")
    return found.agg(F.count("*").alias("n_rows"), F.count_if(~named).alias("missing"), F.count_distinct(F.when(named, stable_key())).alias("unique_records"))


def index(catalog: DataFrame, order: str = "key") -> DataFrame:
    """(name, record): every lower-cased name of a record; of records that share one the first by order."""
    names = F.concat(F.array(*[text_or_empty(f) for f in FIELDS[1:]]), F.coalesce("aliases", F.array().cast("array<string>")))
    record = F.struct(*[c for c in catalog.columns if c != order or order == "key"])
    rows = catalog.select(F.col(order).alias("__o"), record.alias("record"), F.explode(F.transform(names, lambda x: F.lower(squash(x)))).alias("name")).filter("name <> ''")
    return rows.groupBy("name").agg(F.min_by("record", "__o").alias("record"))


def lookup_keys() -> Column:
    return ordered_distinct(F.array(text_or_empty("species_latin"), spaced("species_latin"), text_or_empty("species_chinese"), text_or_empty("genus_latin"), text_or_empty("genus_chinese")))


def lookup(cases: DataFrame, names: DataFrame, key: str = "case_id") -> DataFrame:
    """cases with the record of the first of their names that the index has (null if none)."""
    asked = cases.select(key, F.posexplode(lookup_keys()).alias("prio", "name")).withColumn("name", F.lower("name"))
    hit = asked.join(names, "name").groupBy(key).agg(F.min_by("record", "prio").alias("record"))
    return cases.join(hit, key, "left")


def enrich(cases: DataFrame, names: DataFrame, key: str = "case_id") -> DataFrame:
    """Empty fields are filled from the record; aliases are its aliases and the case's own names, in order."""
    found = lookup(cases, names, key)
    filled = {"pathogen_type": "type", "species_latin": "species_latin", "species_chinese": "species_chinese", "genus_latin": "genus_latin", "genus_chinese": "genus_chinese"}
    out = found.withColumns({c: first_of(c, F.col("record")[f]) for c, f in filled.items()})
    own = F.array("species_latin", spaced("species_latin"), "species_chinese", "genus_latin", spaced("genus_latin"), "genus_chinese")
    return out.withColumn("aliases", ordered_distinct(F.concat(F.coalesce(F.col("record")["aliases"], F.array().cast("array<string>")), own))).drop("record")
