"""Text Columns with the reference semantics of missing values: '' stands for missing, white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as a class of a pattern: much faster than a Unicode-aware \\s.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What a decimal number looks like to the parser: a plain cast takes more ("3d") and less.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def text_or_empty(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    return F.btrim(text_or_empty(c), F.lit(SPACES))


def strip_end(c) -> Column:
    return F.rtrim(text_or_empty(c), F.lit(SPACES))


def squash(c) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text_or_empty(c), f"{SPACE}+", " "))


def strip_quotes(c) -> Column:
    return F.regexp_replace(strip(c), "^['\"]+|['\"]+$", "")


def safe_double(c, default: float = 0.0) -> Column:
    s = col(c).cast("string")
    return F.coalesce(F.when(s.rlike(NUMBER), s.try_cast("double")), F.lit(default))


def first_of(*cs) -> Column:
    """The first that is neither null nor ''; else ''."""
    return F.coalesce(*[F.nullif(text_or_empty(c), F.lit("")) for c in cs], F.lit(""))


def search_value(text, pattern: str) -> Column:
    """Group 1 of the first match, squashed, without trailing or leading separators; '' if there is none."""
    return F.regexp_replace(squash(F.regexp_extract(text_or_empty(text), pattern, 1)), "^[。；;，, ]+|[。；;，, ]+$", "")


def _literal(key: str) -> str:
    return r"\Q" + key + r"\E"


def quoted_field(text, key: str) -> Column:
    """The value of a quoted key, double quotes tried before single ones."""
    t = text_or_empty(text)
    double, single = (F.regexp_extract(t, f"{q}{_literal(key)}{q}\\s*:\\s*{q}([^{q}]*){q}", 1) for q in ('"', "'"))
    has = t.rlike(f'"{_literal(key)}"\\s*:\\s*"[^"]*"')
    return strip(F.when(has, double).otherwise(single))


def dict_field(text, key: str) -> Column:
    """The same with single quotes first."""
    t = text_or_empty(text)
    double, single = (F.regexp_extract(t, f"{q}{_literal(key)}{q}\\s*:\\s*{q}([^{q}]*){q}", 1) for q in ('"', "'"))
    has = t.rlike(f"'{_literal(key)}'\\s*:\\s*'[^']*'")
    return strip(F.when(has, single).otherwise(double))


def occurrences(text, word: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    t = text_or_empty(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / len(word)).cast("int")


def contains_any(text, words) -> Column:
    t = text_or_empty(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def how_many(text, words) -> Column:
    t = text_or_empty(text)
    out = F.lit(0)
    for w in words:
        out = out + F.contains(t, F.lit(w)).cast("int")
    return out


def ordered_distinct(items: Column) -> Column:
    """Squashed, blanks dropped, the first of equals kept in place."""
    return F.array_distinct(F.filter(F.transform(items, squash), lambda x: x != ""))
