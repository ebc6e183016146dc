"""Column expressions over text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import TOKEN_PATTERN


def tokens(text: Column) -> Column:
    """Lower-case word and number tokens, decimals kept whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(F.lower(text), F.lit(TOKEN_PATTERN))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match or null (Spark yields '' for both 'no match' and 'empty')."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def replace_all(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, in order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def any_of(text: Column, words: Iterable[str]) -> Column:
    """True when any literal word occurs (one scan with an alternation)."""
    import re

    return text.rlike("|".join(re.escape(w).replace("/", "/") for w in words))


# every character Python's str.strip() treats as white space
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_ws(text: Column) -> Column:
    """Both ends without white space; looks at the ends only."""
    return F.btrim(text, F.lit(WHITE))


def strip_markers(text: Column, keep_newlines: bool = False) -> Column:
    """Remove internal table markers; white space collapses unless kept."""
    t = F.regexp_replace(text, r"%%TABLE_[0-9_]*", "")
    t = F.replace(t, F.lit("%%"), F.lit(""))
    t = F.regexp_replace(t, r"\[\s*TABLE\s+\d+\s*\]", "")
    if keep_newlines:
        return trim_ws(F.regexp_replace(t, r"[ \t]+", " "))
    return trim_ws(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_label(value: Column) -> Column:
    """Metadata label; null-like sentinels become ''."""
    from ..fixed import NULLISH

    v = trim_ws(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(v).isin(NULLISH), F.lit("")).otherwise(strip_markers(v))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
