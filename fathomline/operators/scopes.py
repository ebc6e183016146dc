"""Metadata scopes: restrict each question to the chunks its filter admits.

A filter names any of ticker / tickers / fiscal_year / section; absent parts
admit everything. Instead of a null-tolerant (non-equi) join, a chunk carries
the key of each filter shape that could admit it (ticker given or not, year
given or not, section given or not), and filters meet chunks by key equality.
Only the shapes that some filter really uses are produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("ticker", "fiscal_year", "section")
ANY = "*"


def normalize_filter(df: DataFrame) -> DataFrame:
    """Trim the filter columns, upper-case tickers, blank becomes null; a
    ``tickers`` list counts only when it has more than one entry."""
    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))

    out = df.withColumns({c: (F.upper(text(c)) if c == "ticker" else text(c)) for c in PARTS if c in df.columns})
    if "tickers" in df.columns:
        up = F.filter(F.transform("tickers", lambda t: F.upper(F.trim(t))), lambda t: t != "")
        out = out.withColumn("tickers", F.when(F.size("tickers") > 1, up))
    return out


def _key(parts: list[Column]) -> Column:
    return F.concat_ws("|", *parts)


def with_scope(plans: DataFrame) -> DataFrame:
    """Add ``scope``, one row per admitted ticker when ``tickers`` is given."""
    missing = {c: F.lit(None).cast("string") for c in PARTS if c not in plans.columns}
    p = plans.withColumns(missing) if missing else plans
    p = normalize_filter(p)
    if "tickers" in p.columns:
        p = p.withColumn("_t", F.explode(F.coalesce("tickers", F.array(F.col("ticker")))))
    else:
        p = p.withColumn("_t", F.col("ticker"))
    key = _key([F.coalesce(c, F.lit(ANY)) for c in (F.col("_t"), F.col("fiscal_year"), F.col("section"))])
    return p.withColumn("scope", key).drop("_t")


def scope_keys(ticker: Column, year: Column, section: Column) -> Column:
    """The eight filter shapes a chunk can satisfy."""
    star = F.lit(ANY)
    shapes = []
    for mask in range(8):
        parts = [p if mask >> i & 1 else star for i, p in enumerate((ticker, year, section))]
        shapes.append(_key([F.coalesce(p, F.lit("")) for p in parts]))
    return F.array(*shapes)


def cell(df: DataFrame) -> Column:
    """Key of the most specific filter a row satisfies; a scope is a union of
    such disjoint cells."""
    return _key([F.coalesce(F.col(p), F.lit("")) for p in PARTS])


def cell_scopes(cells: DataFrame, plans_with_scope: DataFrame) -> DataFrame:
    """(cell, scope) pairs in use. ``cells`` has one row per cell with PARTS;
    both sides are as small as the distinct filter values."""
    used = plans_with_scope.select("scope").distinct()
    keys = scope_keys(*[F.col(p) for p in PARTS])
    return cells.select("cell", F.explode(F.array_distinct(keys)).alias("scope")).join(used, "scope")


def candidate_counts(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """How many chunks each question's filter admits (pre-filter size). Chunks
    are counted per cell before any join."""
    p = with_scope(plans)
    cells = chunks.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell(chunks))
    per_scope = cell_scopes(cells, p).join(cells.select("cell", "n"), "cell").groupBy("scope").agg(F.sum("n").alias("n"))
    return p.join(per_scope, "scope", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidates"))
