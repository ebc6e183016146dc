"""Column expressions over figures in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import find_all


def number_tokens(text: Column) -> Column:
    """Number-like tokens with their sign, parentheses and unit, blanks removed."""
    found = find_all(F.coalesce(text, F.lit("")), fixed.NUMBER_PATTERN)
    return F.transform(found, lambda t: F.regexp_replace(t, r"\s+", ""))


def normalize_number(token: Column, strict_parens: bool = True) -> Column:
    """Drop currency, grouping, unit letters and trailing punctuation. With
    ``strict_parens`` off, a lone closing or opening parenthesis goes as well."""
    n = F.regexp_replace(token, r"[$, MBKmbk%]", "")
    if not strict_parens:
        n = F.when(n.contains("(") & n.contains(")"), n).otherwise(F.regexp_replace(n, r"[()]", ""))
    return F.regexp_replace(n, r"[.,]+$", "")


def drop_zeros(number: Column) -> Column:
    return F.regexp_replace(number, r"^0+", "")


def numeric_values(text: Column) -> Column:
    """Plain figures as doubles, grouping commas removed."""
    found = find_all(F.coalesce(text, F.lit("")), fixed.NUMERIC_TOKEN)
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")).cast("double"))


def close_to(a: Column, b: Column) -> Column:
    """Within 0.5 percent of the larger, or 0.12."""
    return F.abs(a - b) <= F.greatest(fixed.CLOSE_REL * F.greatest(F.abs(a), F.abs(b)), F.lit(fixed.CLOSE_ABS))


def normalize_evidence(text: Column) -> Column:
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), ",", "")
    t = F.regexp_replace(t, r"[$%]", " ")
    t = F.regexp_replace(t, r"\s*(million|billion|thousand)s?\b", " ")
    t = F.regexp_replace(t, r"\bm\b", " ")
    return F.regexp_replace(t, r"\s+", " ")
