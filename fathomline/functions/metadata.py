"""Filing metadata from path and content (header windows are the semantics)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import find_all, first_match



def accession(path: Column, content: Column) -> Column:
    """The single distinct accession number in path and header, else null."""
    in_path = find_all(path, r"(?:^|[/\\])" + fixed.ACCESSION_PATTERN + r"(?=[/\\]|$)", 1)
    in_head = find_all(content, r"(?i)ACCESSION\s+NUMBER\s*:\s*" + fixed.ACCESSION_PATTERN, 1)
    both = F.array_distinct(F.concat(in_path, in_head))
    return F.when(F.size(both) == 1, F.get(both, 0))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def ticker(path: Column, content: Column) -> Column:
    """Path folder, then file name, then company name in the header."""
    folder = F.upper(first_match(path, "(?i)" + fixed.PATH_TICKER_PATTERN))
    stem = F.upper(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))
    head = F.upper(F.substring(content, 1, fixed.HEADER_CHARS_COMPANY))
    pick = lambda text, pairs: reduce(lambda acc, p: F.when(F.contains(text, F.lit(p[0])), p[1]).otherwise(acc), reversed(pairs), F.lit(None).cast("string"))
    return F.coalesce(folder, pick(stem, [(t, t) for t in fixed.PATH_TICKERS]), pick(head, fixed.HEADER_NAMES), F.lit(fixed.UNKNOWN))


def fiscal_year(path: Column, content: Column) -> Column:
    """Accession number in the path, then the header, then the path folder."""
    short = first_match(path, fixed.ACCESSION_YEAR_PATTERN)
    head, p = F.substring(content, 1, fixed.HEADER_CHARS_YEAR), "(?im)" + fixed.CONTENT_YEAR_PATTERN
    stated = F.coalesce(*[first_match(head, p, i) for i in (1, 2, 3)])
    return F.coalesce((F.lit(2000) + short.cast("int")).cast("string"), stated, first_match(path, fixed.PATH_YEAR_PATTERN), F.lit(fixed.UNKNOWN))


def doc_type(path: Column, content: Column) -> Column:
    in_path = F.replace(F.upper(first_match(path, "(?i)" + fixed.DOC_TYPE_PATTERN)), F.lit(" "), F.lit("-"))
    in_head = F.upper(first_match(F.substring(content, 1, fixed.HEADER_CHARS_COMPANY), r"(?i)<TYPE>\s*" + fixed.DOC_TYPE_PATTERN))
    return F.coalesce(in_path, in_head, F.lit(fixed.UNKNOWN))


def section(text: Column) -> Column:
    """First of the known sections whose pattern occurs."""
    c = F.lit(fixed.GENERAL)
    for pattern, name in reversed(fixed.SECTION_PATTERNS):
        c = F.when(text.rlike("(?id)" + pattern), name).otherwise(c)
    return c


def has_table(text: Column) -> Column:
    return text.rlike(r"(?d)\|.*\|.*\|")
