"""Case parsing: fields of a request by a fixed order of sources; rules on the parsed fields.

Sources of a field, the first that isn't empty: the prompt's record after its marker (overrides), the request's own JSON
keys, quoted fields, dictionary-like fields, patterns of the running text. All built-in expressions; braces are balanced by
a fold over a text's braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, dict_field, first_of, quoted_field, safe_double, search_value, strip, strip_quotes, text_or_empty

MESSAGE = "struct<role:string,content:string>"
REQUEST = f"struct<messages:array<{MESSAGE}>,Latin:string,Chinese:string,`病原类型`:string,`取样部位_from_prompt`:string,`取样部位_raw_metadata`:string,mianyi:string,`属排名`:string,`种排名`:string>"
#: Codes of immune states.
IMMUNE = {"0": "未知", "1": "正常", "2": "抑制", "3": "低下"}
#: Words of a sample's site and the infections looked for there, the first that matches.
SITES = (
    (("尿", "尿液"), "尿路感染 泌尿系统感染"),
    (("肺", "痰", "支气管", "肺泡", "灌洗"), "肺部感染 呼吸道感染 肺炎"),
    (("血", "血液", "血浆"), "血流感染 菌血症 败血症"),
    (("脑脊液", "脑"), "中枢神经系统感染 脑膜炎"),
    (("粪", "便", "肠"), "肠道感染 腹泻"),
)
OTHER_SITE = "感染部位"
#: Patterns of measures in the running text.
MEASURES = {
    "reads": "种-检出序列数：([^。\\n]+)", "genus_reads": "属-检出序列数为([^。\\n]+)", "coverage": "覆盖率：([^。\\n]+)",
    "abundance": "种-丰度：([^。\\n]+)", "genus_abundance": "属-丰度为([^。\\n]+)", "genus_rank": "属的排序为：([^，。\\n]+)",
    "species_rank": "种的排序为：([^，。\\n]+)", "sample_type": "mNGS检测组织为：([^，。\\n]+)", "immune_status": "患者的免疫状态为：([^，。\\n]+)",
    "pathogenicity_text": "(?s)病原的致病信息为：(.+?)(?:\\n\\n|输出要求|$)",
}
FIELDS = (
    "species_latin", "species_chinese", "genus_latin", "genus_chinese", "pathogen_type", "sample_type", "immune_status", "age", "sex", "phenotype", "diagnosis",
    "reads", "genus_reads", "coverage", "abundance", "genus_abundance", "genus_rank", "species_rank", "pathogenicity_text",
)


def loose_json(text) -> Column:
    """The request's object, however it is wrapped: as it is, without its braces, as a list's items, or escaped once more."""
    t = strip(text)
    plain = F.replace(t, F.lit('\\"'), F.lit('"'))

    def parsed(c):
        return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, REQUEST, {"allowSingleQuotes": "true"}))

    def listed(c):
        items = F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"array<{MESSAGE}>")
        ok = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & (F.size(items) > 0)
        return F.when(ok, F.from_json(F.concat(F.lit('{"messages":['), c, F.lit("]}")), REQUEST))

    wrapped = F.when(t.rlike("^[\"']messages[\"']"), parsed(F.concat(F.lit("{"), t, F.lit("}"))))
    single = F.when(t.rlike("^\\s*\\{\\s*'"), F.from_json(t, REQUEST, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}))
    several = F.when(t.startswith("{") & t.contains('"role"') & t.contains('"content"'), listed(t))
    escaped = F.when(t.contains('\\"role\\"') & t.contains('\\"content\\"'), F.coalesce(parsed(plain), F.when(plain.startswith("{"), listed(plain))))
    return F.coalesce(parsed(t), wrapped, several, escaped, single)


def content_strings(text) -> Column:
    """The content strings of a request that doesn't parse, unescaped."""
    raw = F.regexp_extract_all(text_or_empty(text), F.lit('(?s)"content"\\s*:\\s*"((?:\\\\.|[^"\\\\])*)"'), 1)
    decoded = F.transform(raw, lambda x: F.coalesce(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0], F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))))
    return F.filter(decoded, lambda x: x != "")


def working_text(text, payload: Column) -> Column:
    messages = payload["messages"]
    given = F.transform(F.filter(messages, lambda m: m["content"].isNotNull()), lambda m: m["content"])
    t = text_or_empty(text)
    found = F.concat(content_strings(t), F.when(t.contains('\\"content\\"'), content_strings(F.replace(t, F.lit('\\"'), F.lit('"')))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(F.array(t), F.when(messages.isNotNull(), given).otherwise(found)), "\n")


def balanced(text: Column) -> Column:
    """From the opening brace that a text begins with to the one that closes it, whatever is nested between; '' if none does."""
    none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s, part):  # each part but the last ends with a brace
        depth = s["depth"] + F.when(part.endswith("{"), 1).when(part.endswith("}"), -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + F.length(part)).alias("n"), (depth == 0).alias("done")))

    n = F.aggregate(F.split(text, r"(?<=[{}])"), none, step, lambda s: F.when(s["done"], s["n"]).otherwise(0))
    return F.substring(text, F.lit(1), n)


def record_after(text, marker: str, schema: str) -> Column:
    """The first dictionary after a marker, in JSON's or Python's quotes and words, with its nested ones; null if there is none or it isn't closed."""
    t = text_or_empty(text)
    after = F.regexp_extract(t, f"(?s)\\Q{marker}\\E[^{{]*(\\{{.*)", 1)
    cut = balanced(after)
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"([:,\[]\s*)None(?=\s*[,}\]])", "$1null"), r"([:,\[]\s*)True(?=\s*[,}\]])", "$1true"), r"([:,\[]\s*)False(?=\s*[,}\]])", "$1false")
    return F.when(cut != "", F.from_json(words, schema, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}))


def immune_state(code) -> Column:
    """A code's name, other values as they are."""
    c = strip(code)
    out = c
    for k, v in IMMUNE.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def site_terms(sample) -> Column:
    out = None
    for words, terms in SITES:
        out = (F if out is None else out).when(contains_any(sample, words), terms)
    return out.otherwise(OTHER_SITE)


def low_confidence(reads, coverage, abundance) -> Column:
    """At most 3 reads, or under 0.1 coverage, or no abundance; what is missing or unreadable counts as 0."""
    r, c, a = safe_double(reads), safe_double(coverage), safe_double(abundance)
    return ((r > 0) & (r <= 3)) | ((c > 0) & (c < 0.1)) | (a == 0)


def parse_cases(cases: DataFrame, text: str = "text") -> DataFrame:
    """cases: (case_id, text, ...). Adds FIELDS, all strings, '' where missing."""
    c = cases.withColumn("__p", loose_json(text))
    c = c.withColumn("__w", working_text(text, F.col("__p")))
    c = c.withColumn("__i", record_after("__w", "病原基本信息", "struct<`类型`:string,`种-拉丁名`:string,`种-中文名`:string,`属-拉丁名`:string,`属-中文名`:string>"))
    c = c.withColumn("__u", record_after("__w", "患者信息为", "struct<`年龄`:string,`性别`:string,`临床表型`:string,`医生诊断`:string>"))
    p, i, u, w = F.col("__p"), F.col("__i"), F.col("__u"), F.col("__w")

    def loose(key):
        return F.regexp_extract(w, f"{key}['\"]?\\s*[:：]\\s*['\"]([^'\"，。}}]+)", 1)

    latin = first_of(strip_quotes(i["种-拉丁名"]), strip_quotes(p["Latin"]), strip_quotes(quoted_field(text, "Latin")), strip_quotes(dict_field(w, "种-拉丁名")), F.regexp_extract(w, "\\b([A-Z][a-z]+_[a-z][A-Za-z_]+)\\b", 1))
    found = {
        "species_latin": latin,
        "species_chinese": first_of(strip(i["种-中文名"]), strip(p["Chinese"]), quoted_field(text, "Chinese"), dict_field(w, "种-中文名"), strip(loose("种-中文名"))),
        "genus_latin": first_of(strip_quotes(i["属-拉丁名"]), strip_quotes(dict_field(w, "属-拉丁名")), F.when(latin.contains("_"), F.split_part(latin, F.lit("_"), F.lit(1)))),
        "genus_chinese": first_of(strip(i["属-中文名"]), dict_field(w, "属-中文名"), strip(loose("属-中文名"))),
        "pathogen_type": first_of(strip(i["类型"]), strip(p["病原类型"]), quoted_field(text, "病原类型"), dict_field(w, "类型")),
        "sample_type": first_of(search_value(w, MEASURES["sample_type"]), strip(p["取样部位_from_prompt"]), strip(p["取样部位_raw_metadata"]), quoted_field(text, "取样部位_from_prompt"), quoted_field(text, "取样部位_raw_metadata")),
        "immune_status": first_of(search_value(w, MEASURES["immune_status"]), immune_state(p["mianyi"])),
        "age": first_of(strip(u["年龄"]), dict_field(w, "年龄")),
        "sex": first_of(strip(u["性别"]), dict_field(w, "性别")),
        "phenotype": first_of(strip(u["临床表型"]), dict_field(w, "临床表型"), strip(loose("临床表型"))),
        "diagnosis": first_of(strip(u["医生诊断"]), dict_field(w, "医生诊断")),
        "genus_rank": first_of(search_value(w, MEASURES["genus_rank"]), strip(p["属排名"])),
        "species_rank": first_of(search_value(w, MEASURES["species_rank"]), strip(p["种排名"])),
    }
    found |= {k: search_value(w, MEASURES[k]) for k in MEASURES if k not in found}
    return c.withColumns(found).drop("__p", "__w", "__i", "__u")
