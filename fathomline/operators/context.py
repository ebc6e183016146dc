"""Assembling contexts: at most a few dozen rows per request, so the windows
per request stay small; table selection per filing is pure aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import any_of, clean_label, strip_markers
from .ingest import PLACEHOLDER


# --- retrieved text ----------------------------------------------------------
def section_key(ticker: Column, section: Column, text: Column) -> Column:
    """Same company and section, or for generic sections the same words."""
    squash = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
    label = squash(strip_markers(F.coalesce(section, F.lit(""))))
    own = F.coalesce(F.nullif(ticker, F.lit("")), F.lit(fixed.UNKNOWN))
    return F.when(label.isin("", "general"), F.concat_ws("|", own, F.lit("content"), F.md5(squash(text)))).otherwise(F.concat_ws("|", own, F.lit("section"), label))


def section_dedupe(docs: DataFrame) -> DataFrame:
    """Best-ranked document per request and section key."""
    d = docs.withColumn("_key", section_key(F.col("ticker"), F.col("section"), F.col("raw_text")))
    first = F.row_number().over(Window.partitionBy("request_id", "_key").orderBy("rank"))
    return d.withColumn("_first", first).where("_first = 1").drop("_first", "_key")


def budget_context(docs: DataFrame, per_doc: int = fixed.MAX_CONTEXT_DOC_CHARS, total: int = fixed.MAX_TOTAL_CONTEXT_CHARS, per_ticker: int = 2) -> DataFrame:
    """Unique sections, placeholders out, each text capped, a running budget per
    request; with several companies at most two texts each."""
    several = docs.groupBy("request_id").agg((F.count_distinct("ticker") > 1).alias("_many"))
    d = section_dedupe(docs).join(several, "request_id")
    d = d.withColumn("text", F.regexp_replace("raw_text", PLACEHOLDER, "")).where(F.length("text") > 0)
    nth = F.row_number().over(Window.partitionBy("request_id", "ticker").orderBy("rank"))
    d = d.withColumn("_nth", nth).where(~F.col("_many") | (F.col("_nth") <= per_ticker))
    want = F.least(F.length("text"), F.lit(per_doc))
    prior = F.coalesce(F.sum(want).over(Window.partitionBy("request_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("kept", F.greatest(F.lit(0), F.least(want, F.lit(total) - prior)).cast("int")).where("kept > 0")
    return d.withColumn("text", F.substring("text", F.lit(1), F.col("kept"))).drop("_many", "_nth")


# --- tables ------------------------------------------------------------------
def compact_table(text: Column) -> Column:
    """Readable rows only: no alignment rows, empty or placeholder cells, nor
    repeated neighbours."""
    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))
        kept = F.filter(cells, lambda c: ~F.lower(c).isin("nan", "none", "") & ~F.lower(c).startswith("unnamed:"))
        return F.array_join(F.filter(kept, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(kept, i - 1))), " | ")

    lines = F.transform(F.split(text, r"\r?\n", -1), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.contains(":---"))
    return F.array_join(F.filter(F.transform(lines, row), lambda r: r != ""), "\n")


def income_tier(text: Column) -> Column:
    """1 to 5 by how complete an income statement reads; 6 for anything else."""
    low = F.lower(text)
    rev, inc, eps = (any_of(low, x) for x in (fixed.REVENUE_MARKERS, fixed.INCOME_MARKERS, fixed.PER_SHARE_MARKERS))
    return F.when(rev & inc & eps, 1).when(rev & inc, 2).when(low.contains("revenue") & inc, 3).when(rev, 4).when(inc, 5).otherwise(6)


def income_detail_score(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.NET_INCOME_ROW)) + F.regexp_count(text, F.lit(fixed.PER_SHARE_ROW))


def percent_score(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.DECIMAL_PERCENT))


def _within(text: Column, band: tuple[int, int] | None) -> Column:
    return F.lit(True) if band is None else F.length(text).between(*band)


def best_table(tables: DataFrame, by: list[str], order: list[Column], where: Column | None = None) -> DataFrame:
    """One table per scope, least ``order`` then lowest chunk_id; an aggregation
    that combines before the shuffle."""
    t = tables if where is None else tables.where(where)
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("chunk_id").alias("chunk_id"))
    return t.groupBy(*by).agg(F.min(key).alias("k")).select(*by, F.col("k.chunk_id").alias("chunk_id"))


def select_income_table(tables: DataFrame, by: list[str], text: str = "raw_text") -> DataFrame:
    return best_table(tables, by, [income_tier(F.col(text)), -F.length(text)])


def select_marked_table(tables: DataFrame, by: list[str], markers: list[str], band: tuple[int, int] | None = None, text: str = "raw_text") -> DataFrame:
    """Longest table with any marker, optionally inside a size band."""
    return best_table(tables, by, [-F.length(text)], any_of(F.lower(text), markers) & _within(F.col(text), band))


# Passes in selection order: name, rank in the prompt, cap, cap shared by tickers
PASSES = [
    ("income", 2, fixed.MAX_INCOME_TABLE_CHARS, True), ("detail", 1, fixed.MAX_COMPACT_INCOME_CHARS, True),
    ("product", 0, fixed.MAX_PRODUCT_TABLE_CHARS, True), ("margin", 0, fixed.MAX_METRICS_TABLE_CHARS, True),
    ("cash", 0, fixed.MAX_CASH_FLOW_TABLE_CHARS, False), ("segment", 0, fixed.MAX_SEGMENT_TABLE_CHARS, False),
]


def _criteria(text: Column) -> dict[str, tuple[Column, list[Column]]]:
    """Named candidate lists: condition and order. '+' names are fallbacks."""
    low, size = F.lower(text), -F.length(text)
    pct, det = -percent_score(text), -income_detail_score(text)
    c = {"income": (F.lit(True), [income_tier(text), size]),
         "detail": (_within(text, fixed.COMPACT_INCOME_BAND) & any_of(low, fixed.INCOME_MARKERS + fixed.PER_SHARE_MARKERS), [det, size]),
         "product": (_within(text, fixed.PRODUCT_BAND) & any_of(low, fixed.PRODUCT_MARKERS), [size]),
         "margin": (_within(text, fixed.METRICS_BAND) & low.contains("gross margin percentage"), [pct, size]),
         "margin+": (_within(text, fixed.METRICS_BAND) & low.contains("gross margin"), [pct, size]),
         "cash": (_within(text, fixed.CASH_FLOW_BAND) & any_of(low, fixed.CASH_FLOW_MARKERS), [size]), "cash+": (any_of(low, fixed.CASH_FLOW_MARKERS), [size]),
         "segment": (_within(text, fixed.SEGMENT_BAND) & any_of(low, fixed.SEGMENT_MARKERS), [size]), "segment+": (any_of(low, fixed.SEGMENT_MARKERS), [size])}
    c.update({f"product:{w}": (_within(text, fixed.PRODUCT_BAND) & low.contains(w), [size]) for w in fixed.PRODUCT_MARKERS})
    return c


def table_candidates(tables: DataFrame, by: list[str], text: str = "raw_text") -> DataFrame:
    """Per scope a map: criterion -> its best six chunk ids. At most five tables
    are chosen before any pass, so six candidates always decide it exactly."""
    rows = []
    for name, (cond, order) in _criteria(F.col(text)).items():
        key = F.array(*[o.cast("long") for o in order])
        rows.append(F.when(cond, F.struct(F.lit(name).alias("criterion"), key.alias("o"))))
    r = tables.select(*by, "chunk_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")).select(*by, "chunk_id", "r.criterion", "r.o")
    w = Window.partitionBy(*by, "criterion").orderBy("o", "chunk_id")
    top = r.withColumn("_n", F.row_number().over(w)).where("_n <= 6")
    lists = top.groupBy(*by, "criterion").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "chunk_id"))), lambda s: s["chunk_id"]).alias("ids"))
    return lists.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("criterion", "ids"))).alias("lists"))


def inject_tables(requests: DataFrame, tables: DataFrame, budget: str = "budget") -> DataFrame:
    """Statement tables per request: ordered passes per company, never the same
    table twice, one running budget.

    ``requests``: request_id, query, tickers ARRAY, fiscal_year and the budget
    left. Result: request_id, ticker, ticker_pos, pass, augment_rank, chunk_id,
    text, kept."""
    by = ["ticker", "fiscal_year"]
    low = F.lower("query")
    r = requests.select("request_id", "query", "fiscal_year", budget, F.greatest(F.size("tickers"), F.lit(1)).alias("n"), F.posexplode("tickers").alias("ticker_pos", "ticker"))
    r = r.join(table_candidates(tables, by), by)
    income_id = F.get(F.col("lists")["income"], 0)
    short = tables.select(F.col("chunk_id").alias("_id"), F.length(compact_table(F.col("raw_text"))).alias("_len"))
    r = r.withColumn("_id", income_id).join(short, "_id", "left").drop("_id")
    term = reduce(lambda acc, w: F.when(low.contains(w), w).otherwise(acc), reversed(fixed.PRODUCT_MARKERS), F.lit(None).cast("string"))
    asked = {
        "income": F.lit(True), "detail": any_of(low, fixed.DETAIL_QUERY_TERMS) & (F.col("_len") > F.floor(fixed.MAX_INCOME_TABLE_CHARS / F.col("n"))),
        "product": any_of(low, fixed.PRODUCT_QUERY_TERMS), "margin": low.contains("gross margin"),
        "cash": any_of(low, fixed.CASH_FLOW_QUERY_TERMS), "segment": any_of(low, fixed.SEGMENT_QUERY_TERMS)}
    empty = F.array().cast("array<string>")
    r = r.withColumn("_taken", empty)
    for name, *_ in PASSES:
        ids = F.coalesce(F.when(term.isNotNull(), F.col("lists")[F.concat(F.lit("product:"), term)]).otherwise(F.col("lists")["product"]), empty) if name == "product" else F.coalesce(F.col("lists")[name], empty)
        free = lambda a: F.get(F.filter(a, lambda x: ~F.array_contains("_taken", x)), 0)
        pick = F.coalesce(free(ids), free(F.coalesce(F.col("lists")[f"{name}+"], empty))) if name in ("margin", "cash", "segment") else free(ids)
        r = r.withColumn(f"_p_{name}", F.when(asked[name], pick))
        r = r.withColumn("_taken", F.when(F.col(f"_p_{name}").isNotNull(), F.concat("_taken", F.array(f"_p_{name}"))).otherwise(F.col("_taken")))
    cap = lambda c, shared: F.floor(F.lit(c) / F.col("n")).cast("int") if shared else F.lit(c)
    picks = F.array(*[F.struct(F.lit(i).alias("pass_no"), F.lit(n).alias("pass"), F.lit(k).alias("augment_rank"), cap(c, s).alias("cap"), F.col(f"_p_{n}").alias("chunk_id")) for i, (n, k, c, s) in enumerate(PASSES)])
    p = r.select("request_id", "ticker", "ticker_pos", budget, F.explode(F.filter(picks, lambda x: x["chunk_id"].isNotNull())).alias("p")).select("request_id", "ticker", "ticker_pos", budget, "p.*")
    p = p.join(tables.select("chunk_id", compact_table(F.col("raw_text")).alias("text")), "chunk_id").where(F.length("text") > 0)
    want = F.least(F.length("text"), F.col("cap"))
    prior = F.coalesce(F.sum(want).over(Window.partitionBy("request_id").orderBy("ticker_pos", "pass_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("kept", F.greatest(F.lit(0), F.least(want, F.col(budget) - prior)).cast("int")).where("kept > 0")
    return p.withColumn("text", F.substring("text", F.lit(1), F.col("kept"))).drop("cap", budget)


# --- prompt and sources ------------------------------------------------------
def context_xml(docs: DataFrame, order: str = "rank") -> DataFrame:
    """One prompt context per request: documents by company in first-seen order,
    companies wrapped when there are several."""
    s = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    doc = F.concat(
        F.lit('<DOCUMENT id="'), F.col("chunk_id"), F.lit('" ticker="'), s("ticker", fixed.UNKNOWN), F.lit('" fiscal_year="'), s("fiscal_year", fixed.UNKNOWN),
        F.lit('" section="'), s("section", fixed.GENERAL), F.lit('" page="N/A" contains_table="'), F.coalesce(F.col("contains_table").cast("string"), F.lit("false")), F.lit('">\n'),
        F.coalesce("text", F.lit("")), F.lit("\n</DOCUMENT>\n"))
    tk = s("ticker", fixed.UNKNOWN)
    per = docs.select("request_id", tk.alias("ticker"), F.col(order).alias("_o"), doc.alias("_d")).groupBy("request_id", "ticker").agg(
        F.min("_o").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_d"))), lambda x: x["_d"]), "\n").alias("body"))
    groups = per.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("first", "ticker", "body"))).alias("g"))
    many = F.size("g") > 1
    part = lambda g: F.when(many, F.concat(F.lit('<ENTITY ticker="'), g["ticker"], F.lit('">\n'), g["body"], F.lit("\n</ENTITY>\n"))).otherwise(g["body"])
    return groups.select("request_id", F.concat(F.lit("<CONTEXT>\n"), F.array_join(F.transform("g", part), "\n"), F.lit("\n</CONTEXT>")).alias("context"))


def citation_score(citation: Column) -> Column:
    """Company 3, year 2, section 1, two shared long words 2."""
    cit = F.lower(citation)
    inside = lambda c, least=0: F.coalesce((F.length(c) > least) & F.contains(cit, c), F.lit(False))
    head = F.lower(F.substring(strip_markers(F.coalesce(F.col("raw_text"), F.lit(""))), 1, 200))
    words = F.array_distinct(F.filter(F.split(F.replace(head, F.lit("$"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 4))
    shared = F.size(F.array_intersect(words, F.split(cit, r"\s+")))
    low = lambda c: F.lower(clean_label(F.col(c)))
    return (F.when(inside(low("ticker")), 3).otherwise(0) + F.when(inside(low("fiscal_year")), 2).otherwise(0)
            + F.when(inside(low("section"), 2), 1).otherwise(0) + F.when(shared >= 2, 2).otherwise(0))


def rank_citations(contexts: DataFrame, citations: DataFrame) -> DataFrame:
    """Contexts of a request, cited ones first: each citation marks its best
    context; order by (mark, score). Both sides are small per request."""
    c = citations.where(F.trim("citation") != "").select("request_id", "citation").distinct()
    m = contexts.where(F.coalesce(F.trim("chunk_id"), F.lit("")) != "")
    scored = m.join(c, "request_id").withColumn("rel", citation_score(F.col("citation"))).where("rel > 0")
    best = scored.groupBy("request_id", "citation").agg(F.max("rel").alias("rel"), F.min(F.struct((-F.col("rel")).alias("r"), "rank", "chunk_id")).alias("b"))
    mark = best.groupBy("request_id", F.col("b.chunk_id").alias("chunk_id")).agg(F.max("rel").alias("cited"))
    out = m.join(mark, ["request_id", "chunk_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    w = Window.partitionBy("request_id").orderBy(F.col("cited").desc(), F.coalesce("score", F.lit(0.0)).desc(), F.col("rank"))
    return out.withColumn("position", F.row_number().over(w))


def build_sources(ranked: DataFrame, limit: int = fixed.MAX_SOURCES, snippet: int = 300, defaults: bool = True) -> DataFrame:
    """First sources of a request, each chunk once, labels cleaned; snippets are
    a display feature. ``defaults`` off leaves missing labels empty."""
    first = F.row_number().over(Window.partitionBy("request_id", "chunk_id").orderBy("position"))
    u = ranked.withColumn("_f", first).where("_f = 1")
    u = u.withColumn("source_no", F.row_number().over(Window.partitionBy("request_id").orderBy("position"))).where(F.col("source_no") <= limit)
    lab = lambda c, d: (F.coalesce(F.nullif(clean_label(F.col(c)), F.lit("")), F.lit(d)) if defaults else clean_label(F.col(c))).alias(c)
    score = F.coalesce("score", F.lit(0.0))
    return u.select("request_id", "source_no", "chunk_id", (F.least(score, F.lit(1.0)) if defaults else score).alias("score"), lab("ticker", fixed.UNKNOWN),
                    lab("fiscal_year", fixed.UNKNOWN), lab("section", fixed.GENERAL), strip_markers(F.substring("raw_text", 1, snippet)).alias("text_snippet"))
