"""Intent routing by ordered rules, and what each intent leads to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any, how_many, text_or_empty

#: Markers of a judgement task.
DIRECT = ("单个mNGS检出病原", "mNGS检出病原", "mNGS结果解读", "当前患者是否有害")
JUDGEMENT = ("有害", "无害", "Label", "OriginalFlag")
DETECTION = ("mNGS", "病原", "检出", "覆盖率", "丰度", "取样部位", "检测组织")
CASE = ("病原基本信息", "患者信息", "免疫状态", "临床表型", "医生诊断")
STRUCTURED = ("messages", "Label", "OriginalFlag", "Latin", "Chinese", "UUID")
#: Label to code.
CODES = {"其他": 0, "文本生成": 0, "图片描述": 4, "图片生成": 3, "基于知识库": 5, "问候语": 6, "网络搜索": 8, "mNGS判别": 9, "基于知识图谱": 10}
#: Code to the tool that handles it; 6 has none.
TOOLS = {0: "text", 3: "image_generation", 4: "image_description", 5: "retrieval", 8: "web_search", 9: "judgement", 10: "graph"}


def is_judgement(question) -> Column:
    q = text_or_empty(question)
    detection = q.contains("mNGS") & contains_any(q, DETECTION)
    structured = q.contains("mNGS") & (how_many(q, STRUCTURED) >= 2)
    return contains_any(q, DIRECT) | (contains_any(q, JUDGEMENT) & (detection | (how_many(q, CASE) >= 2) | structured))


def intent_label(question, has_image, model_label=None) -> Column:
    """The first rule that holds; a model's label counts only for the two kinds of generation."""
    q = text_or_empty(question)
    label = F.lit("") if model_label is None else text_or_empty(model_label)
    out = F.when(is_judgement(q), "mNGS判别").when(q.contains("根据知识库"), "基于知识库").when(q.contains("根据知识图谱"), "基于知识图谱").when(q.contains("搜索"), "网络搜索")
    out = out.when(F.coalesce(has_image, F.lit(False)), "图片描述").when((label == "图片生成") & (F.length(q) > 0), "图片生成")
    return out.when(label == "文本生成", "文本生成").otherwise("其他")


def code_of(label) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return table[text_or_empty(label)]


def tool_of(code: Column) -> Column:
    """The tool's name; an error for a code without one."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in TOOLS.items():
        out = out.when(code == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("no tool handles intent "), code.cast("string"))))


def upload_kind(name) -> Column:
    """image, pdf, docx, text or unsupported, by extension."""
    e = F.lower(F.regexp_extract(text_or_empty(name), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(e.isin("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "tif", "tiff"), "image").when(e == "pdf", "pdf").when(e == "docx", "docx").when(e.isin("txt", "md", "csv", "html", "htm", "xml", "py", "log", "css", "tsv"), "text").otherwise("unsupported")
