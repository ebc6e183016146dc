"""Context assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import any_of, strip_markers
from ..operators import context as c
from ..sources import derived as d
from .registry import query

W = d.sql_with
BY = ["ticker", "fiscal_year"]


def contexts(spark, sf):
    """Twelve consecutive chunks are one request's retrieved contexts."""
    t = d.placed_chunks(spark, sf)
    req = F.floor(F.col("doc_id") / 12).cast("long")
    return t.select(
        req.alias("request_id"), (F.col("doc_id") % 12 + 1).cast("int").alias("rank"), "chunk_id", F.when(req % 3 == 0, "AAPL").otherwise(F.col("ticker")).alias("ticker"),
        "fiscal_year", F.when(F.col("doc_id") % 5 == 0, F.concat("section", F.lit(" %%TABLE_"))).otherwise(F.col("section")).alias("section"), "contains_table",
        F.when(F.col("doc_id") % 10 == 3, "%%TABLE_1%%").otherwise(F.col("raw_text")).alias("raw_text"), ((F.col("doc_id") * 7 % 130) / 100.0).alias("score"))


CTX = """ctx AS (SELECT doc_id // 12 AS request_id, CAST(doc_id % 12 + 1 AS INTEGER) AS rank, chunk_id, CASE WHEN (doc_id // 12) % 3 = 0 THEN 'AAPL' ELSE ticker END AS ticker, fiscal_year,
  CASE WHEN doc_id % 5 = 0 THEN section || ' %%TABLE_' ELSE section END AS section, contains_table, CASE WHEN doc_id % 10 = 3 THEN '%%TABLE_1%%' ELSE raw_text END AS raw_text, (doc_id * 7 % 130) / 100.0::DOUBLE AS score FROM placed_chunks)"""
STRIP = r"regexp_replace(regexp_replace(replace(regexp_replace({}, '%%TABLE_[0-9_]*', '', 'g'), '%%', ''), '\[\s*TABLE\s+\d+\s*\]', '', 'g'), '\s+', ' ', 'g')"
SQUASH = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
DEDUP = f"""kd AS (SELECT *, CASE WHEN sl IN ('', 'general') THEN ticker || '|content|' || md5({SQUASH.format('raw_text')}) ELSE ticker || '|section|' || sl END AS key FROM (SELECT *, {SQUASH.format("trim(" + STRIP.format('section') + ")")} AS sl FROM ctx)),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, key ORDER BY rank) AS f FROM kd) WHERE f = 1)"""
BUDG = f"""{DEDUP}, tx AS (SELECT dd.*, regexp_replace(raw_text, '%%TABLE_(\\d+)%%', '', 'g') AS text, many FROM dd JOIN (SELECT request_id, count(DISTINCT ticker) > 1 AS many FROM ctx GROUP BY ALL) USING (request_id)),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, ticker ORDER BY rank) AS nth FROM tx WHERE length(text) > 0) WHERE NOT many OR nth <= 2),
bu AS (SELECT * FROM (SELECT *, greatest(0, least(least(length(text), 1500), 12000 - coalesce(sum(least(length(text), 1500)) OVER (PARTITION BY request_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept FROM cp) WHERE kept > 0)"""


@query("section_dedupe", W(["placed_chunks"], "SELECT request_id, rank, chunk_id FROM dd", CTX + ",\n" + DEDUP))
def section_dedupe(spark, sf):
    return c.section_dedupe(contexts(spark, sf)).select("request_id", "rank", "chunk_id")


@query("budget_context", W(["placed_chunks"], "SELECT request_id, rank, chunk_id, CAST(kept AS INTEGER) AS kept, md5(substr(text, 1, CAST(kept AS BIGINT))) AS text_md5 FROM bu", CTX + ",\n" + BUDG))
def budget_context(spark, sf):
    return c.budget_context(contexts(spark, sf)).select("request_id", "rank", "chunk_id", "kept", F.md5("text").alias("text_md5"))


@query("strip_markers", W(["placed_chunks"], f"SELECT chunk_id, md5(regexp_replace({STRIP.format('raw_text')}, '^ | $', '', 'g')) AS text_md5 FROM placed_chunks"))
def strip_marker(spark, sf):
    return d.placed_chunks(spark, sf).select("chunk_id", F.md5(strip_markers(F.col("raw_text"))).alias("text_md5"))


# --- tables ------------------------------------------------------------------
EXTRA = ["", "iPhone and Mac services", "Net cash provided by operating activities", "Intelligent Cloud segment", "Gross margin percentage"]


def wide_tables(spark, sf):
    """Statement tables widened to the sizes real filings have."""
    t = d.table_chunks(spark, sf)
    extra = F.element_at(F.array(*[F.lit(x) for x in EXTRA]), (F.col("table_index") + 1).cast("int"))
    n = ((F.col("entity") * 7 + F.col("fiscal_year").cast("long") + F.col("table_index") * 13) % 150).cast("int")
    line = F.concat(F.lit("\n| "), extra, F.lit(" | | Unnamed: 3 | nan | 1,2"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" | 4.5% | 4.5% |"))
    return t.withColumn("raw_text", F.concat("raw_text", F.repeat(line, n + 10)))


WIDE = f"""wide AS (SELECT * REPLACE (raw_text || repeat(chr(10) || '| ' || {d._pick(EXTRA, 'table_index')} || ' | | Unnamed: 3 | nan | 1,2' || printf('%02d', ((entity * 7 + CAST(fiscal_year AS BIGINT) + table_index * 13) % 150) % 100) || ' | 4.5% | 4.5% |',
  (entity * 7 + CAST(fiscal_year AS BIGINT) + table_index * 13) % 150 + 10) AS raw_text) FROM table_chunks)"""
COMPACT = r"""array_to_string(list_filter(list_transform(list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, ':---')), lambda x: array_to_string(
  list_filter(list_filter(list_transform(string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|'), lambda y: trim(y)), lambda y: lower(y) NOT IN ('nan', 'none', '') AND NOT starts_with(lower(y), 'unnamed:')),
    lambda y, i: i = 1 OR y <> list_extract(list_filter(list_transform(string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|'), lambda y: trim(y)), lambda y: lower(y) NOT IN ('nan', 'none', '') AND NOT starts_with(lower(y), 'unnamed:')), i - 1)), ' | ')), lambda x: x <> ''), chr(10))"""


@query("compact_table", W(["table_chunks"], f"SELECT chunk_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT chunk_id, {COMPACT.format('raw_text')} AS t FROM wide)", WIDE))
def compact_table(spark, sf):
    t = wide_tables(spark, sf).select("chunk_id", c.compact_table(F.col("raw_text")).alias("t"))
    return t.select("chunk_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


HAS = lambda words: "(" + " OR ".join(f"contains(lower(raw_text), '{w}')" for w in words) + ")"
REV, INC, EPS = HAS(fixed.REVENUE_MARKERS), HAS(fixed.INCOME_MARKERS), HAS(fixed.PER_SHARE_MARKERS)
TIER = f"CASE WHEN {REV} AND {INC} AND {EPS} THEN 1 WHEN {REV} AND {INC} THEN 2 WHEN contains(lower(raw_text), 'revenue') AND {INC} THEN 3 WHEN {REV} THEN 4 WHEN {INC} THEN 5 ELSE 6 END"


@query("select_income_table", W(["table_chunks"], f"SELECT ticker, fiscal_year, arg_min(chunk_id, {{'a': {TIER}, 'b': -length(raw_text), 'c': chunk_id}}) AS chunk_id FROM wide GROUP BY ALL", WIDE))
def select_income_table(spark, sf):
    return c.select_income_table(wide_tables(spark, sf), BY)


@query("select_marked_table", W(["table_chunks"], f"SELECT ticker, fiscal_year, arg_min(chunk_id, {{'b': -length(raw_text), 'c': chunk_id}}) AS chunk_id FROM wide WHERE {HAS(fixed.CASH_FLOW_MARKERS)} GROUP BY ALL", WIDE))
def select_marked_table(spark, sf):
    return c.select_marked_table(wide_tables(spark, sf), BY, fixed.CASH_FLOW_MARKERS)


@query("select_band_table", W(["table_chunks"], f"SELECT ticker, fiscal_year, arg_min(chunk_id, {{'b': -length(raw_text), 'c': chunk_id}}) AS chunk_id FROM wide WHERE {HAS(fixed.PRODUCT_MARKERS)} AND length(raw_text) BETWEEN 2500 AND 5500 GROUP BY ALL", WIDE))
def select_band_table(spark, sf):
    return c.select_marked_table(wide_tables(spark, sf), BY, fixed.PRODUCT_MARKERS, fixed.PRODUCT_BAND)


ASKS = ["What was net income per share?", "iPhone revenue and gross margin?", "Show cash flow and gross margin", "intelligent cloud segment revenue, services", "plain"]


def table_requests(spark, sf):
    i = F.col("item_id")
    ask = F.element_at(F.array(*[F.lit(x) for x in ASKS]), (i % len(ASKS) + 1).cast("int"))
    t = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return d.table(spark, sf, "benchmark").select(
        i.alias("request_id"), ask.alias("query"), F.when(i % 3 == 0, t("AAPL")).when(i % 3 == 1, t("MSFT", "AAPL")).otherwise(t("NVDA", "T3", "none")).alias("tickers"),
        (2020 + i % 5).cast("string").alias("fiscal_year"), F.when(i % 4 == 0, 6000).otherwise(12000).alias("budget"))


def passes_sql() -> str:
    """Brute force: each pass ranks all tables of the scope not chosen before."""
    q = lambda words: "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + ")"
    pc = lambda x: f"len(regexp_extract_all({x}, '\\d+\\.\\d+\\s*(?:\\|\\s*)?%'))"
    det = "len(regexp_extract_all(raw_text, '(?i)net income\\D{0,120}\\d[\\d,]{3,}')) + len(regexp_extract_all(raw_text, '(?i)(?:basic|diluted)?\\s*earnings per share\\D{0,80}\\d'))"
    term = "CASE " + " ".join(f"WHEN contains(lower(query), '{w}') THEN '{w}'" for w in fixed.PRODUCT_MARKERS) + " END"
    gm, band = "contains(lower(raw_text), 'gross margin')", "length(raw_text) BETWEEN {} AND {}"
    any_prod = HAS(fixed.PRODUCT_MARKERS)
    cases = [
        ("income", "TRUE", "TRUE", f"{TIER}, -length(raw_text)"),
        ("detail", f"{q(fixed.DETAIL_QUERY_TERMS)} AND inc_len > 8000 // n", f"{band.format(3000, 6000)} AND ({INC} OR {EPS})", f"-({det}), -length(raw_text)"),
        ("product", q(fixed.PRODUCT_QUERY_TERMS), f"{band.format(2500, 5500)} AND CASE WHEN {term} IS NULL THEN {any_prod} ELSE contains(lower(raw_text), {term}) END", "-length(raw_text)"),
        ("margin", "contains(lower(query), 'gross margin')", f"{band.format(1000, 3000)} AND {gm}", f"CASE WHEN contains(lower(raw_text), 'gross margin percentage') THEN 0 ELSE 1 END, -{pc('raw_text')}, -length(raw_text)"),
        ("cash", q(fixed.CASH_FLOW_QUERY_TERMS), HAS(fixed.CASH_FLOW_MARKERS), f"CASE WHEN {band.format(2000, 8000)} THEN 0 ELSE 1 END, -length(raw_text)"),
        ("segment", q(fixed.SEGMENT_QUERY_TERMS), HAS(fixed.SEGMENT_MARKERS), f"CASE WHEN {band.format(1500, 9000)} THEN 0 ELSE 1 END, -length(raw_text)")]
    out, chosen = [], []
    for i, (name, ask, cond, order) in enumerate(cases):
        ban = "".join(f" AND NOT EXISTS (SELECT 1 FROM p{j} x WHERE x.request_id = b.request_id AND x.ticker_pos = b.ticker_pos AND x.chunk_id = b.chunk_id)" for j in range(i))
        base = "base" if name == "income" else "base2"
        out.append(f"p{i} AS (SELECT request_id, ticker_pos, ticker, {i} AS pass_no, '{name}' AS pass, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id, ticker_pos ORDER BY {order}, chunk_id) AS r FROM {base} b WHERE ({ask}) AND ({cond}){ban}) WHERE r = 1)")
        if name == "income":
            out.append(f"base2 AS (SELECT base.*, inc_len FROM base JOIN (SELECT p0.request_id, p0.ticker_pos, length({COMPACT.format('raw_text')}) AS inc_len FROM p0 JOIN wide USING (chunk_id)) USING (request_id, ticker_pos))")
        chosen.append(f"SELECT * FROM p{i}")
    out.append("allp AS (" + " UNION ALL ".join(chosen) + ")")
    return ",\n".join(out)


INJECT = f"""{WIDE},
req AS (SELECT item_id AS request_id, {d._pick(ASKS, f'item_id % {len(ASKS)}')} AS query, CASE item_id % 3 WHEN 0 THEN ['AAPL'] WHEN 1 THEN ['MSFT', 'AAPL'] ELSE ['NVDA', 'T3', 'none'] END AS tickers, CAST(2020 + item_id % 5 AS VARCHAR) AS fiscal_year, CASE WHEN item_id % 4 = 0 THEN 6000 ELSE 12000 END AS budget FROM benchmark),
rt AS (SELECT request_id, query, fiscal_year, budget, len(tickers) AS n, unnest(tickers) AS ticker, generate_subscripts(tickers, 1) - 1 AS ticker_pos FROM req),
base AS (SELECT rt.request_id, rt.query, rt.n, rt.ticker, rt.ticker_pos, w.chunk_id, w.raw_text FROM rt JOIN wide w ON w.ticker = rt.ticker AND w.fiscal_year = rt.fiscal_year),
{passes_sql()},
capd AS (SELECT a.*, budget, {COMPACT.format('raw_text')} AS t, CASE pass WHEN 'income' THEN 8000 // n WHEN 'detail' THEN 5000 // n WHEN 'product' THEN 5500 // n WHEN 'margin' THEN 2000 // n WHEN 'cash' THEN 6000 ELSE 4000 END AS cap
  FROM allp a JOIN wide USING (chunk_id) JOIN (SELECT request_id, budget, len(tickers) AS n FROM req) r ON r.request_id = a.request_id),
kept AS (SELECT *, greatest(0, least(least(length(t), cap), budget - coalesce(sum(least(length(t), cap)) OVER (PARTITION BY request_id ORDER BY ticker_pos, pass_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS k FROM capd)"""


@query("inject_tables", W(["table_chunks"], "SELECT request_id, ticker, pass, CASE pass WHEN 'income' THEN 2 WHEN 'detail' THEN 1 ELSE 0 END AS augment_rank, chunk_id, CAST(k AS INTEGER) AS kept, md5(substr(t, 1, CAST(k AS BIGINT))) AS text_md5 FROM kept WHERE k > 0", INJECT))
def inject_tables(spark, sf):
    out = c.inject_tables(table_requests(spark, sf), wide_tables(spark, sf))
    return out.select("request_id", "ticker", "pass", "augment_rank", "chunk_id", "kept", F.md5("text").alias("text_md5"))


# --- prompt and sources ------------------------------------------------------
@query("context_xml", W(["placed_chunks"], """SELECT request_id, md5('<CONTEXT>' || chr(10) || string_agg(CASE WHEN many THEN '<ENTITY ticker="' || ticker || '">' || chr(10) || body || chr(10) || '</ENTITY>' || chr(10) ELSE body END, chr(10) ORDER BY f) || chr(10) || '</CONTEXT>') AS context_md5 FROM (
    SELECT *, count(*) OVER (PARTITION BY request_id) > 1 AS many FROM (SELECT request_id, ticker, min(rank) AS f, string_agg('<DOCUMENT id="' || chunk_id || '" ticker="' || ticker || '" fiscal_year="' || fiscal_year || '" section="' || section || '" page="N/A" contains_table="false">' || chr(10) || raw_text || chr(10) || '</DOCUMENT>' || chr(10), chr(10) ORDER BY rank) AS body
      FROM ctx GROUP BY request_id, ticker)) GROUP BY request_id""", CTX))
def context_xml(spark, sf):
    out = c.context_xml(contexts(spark, sf).withColumn("text", F.col("raw_text")))
    return out.select("request_id", F.md5("context").alias("context_md5"))


def citations(spark, sf):
    """Two citations per request: one of its third context, one loose."""
    x = contexts(spark, sf).where("rank in (3, 6)")
    return x.select("request_id", F.when(F.col("rank") == 3, F.concat_ws(" - ", "ticker", "fiscal_year", "section")).otherwise(F.concat(F.lit("see "), F.substring(F.regexp_replace("raw_text", r"\s+", " "), 1, 120))).alias("citation"))


CLEAN = "regexp_replace({}, '^ | $', '', 'g')"
CITE = f"""cit AS (SELECT DISTINCT request_id, CASE WHEN rank = 3 THEN ticker || ' - ' || fiscal_year || ' - ' || section ELSE 'see ' || substr(regexp_replace(raw_text, '\\s+', ' ', 'g'), 1, 120) END AS citation FROM ctx WHERE rank IN (3, 6)),
lab AS (SELECT *, {CLEAN.format(STRIP.format('section'))} AS sec, lower(substr({CLEAN.format(STRIP.format('raw_text'))}, 1, 200)) AS head FROM ctx),
rl AS (SELECT l.request_id, l.rank, l.chunk_id, citation, CASE WHEN contains(lower(citation), lower(l.ticker)) THEN 3 ELSE 0 END + CASE WHEN contains(lower(citation), l.fiscal_year) THEN 2 ELSE 0 END + CASE WHEN length(sec) > 2 AND contains(lower(citation), lower(sec)) THEN 1 ELSE 0 END
  + CASE WHEN len(list_intersect(list_distinct(list_filter(string_split_regex(replace(head, '$', ' '), '\\s+'), lambda w: length(w) > 4)), string_split_regex(lower(citation), '\\s+'))) >= 2 THEN 2 ELSE 0 END AS rel FROM lab l JOIN cit USING (request_id)),
mk AS (SELECT request_id, chunk_id, max(rel) AS cited FROM (SELECT *, row_number() OVER (PARTITION BY request_id, citation ORDER BY rel DESC, rank, chunk_id) AS r FROM rl WHERE rel > 0) WHERE r = 1 GROUP BY ALL),
rk AS (SELECT lab.*, coalesce(cited, 0) AS cited, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(cited, 0) DESC, score DESC, rank) AS position FROM lab LEFT JOIN mk USING (request_id, chunk_id))"""


@query("rank_citations", W(["placed_chunks"], "SELECT request_id, chunk_id, CAST(cited AS INTEGER) AS cited, CAST(position AS INTEGER) AS position FROM rk", CTX + ",\n" + CITE))
def rank_citations(spark, sf):
    return c.rank_citations(contexts(spark, sf), citations(spark, sf)).select("request_id", "chunk_id", "cited", "position")


@query("build_sources", W(["placed_chunks"], f"SELECT request_id, CAST(position AS INTEGER) AS source_no, chunk_id, least(score, 1.0) AS score, ticker, fiscal_year, sec AS section, md5({CLEAN.format(STRIP.format('substr(raw_text, 1, 300)'))}) AS snippet_md5 FROM rk WHERE position <= 6", CTX + ",\n" + CITE))
def build_sources(spark, sf):
    s = c.build_sources(c.rank_citations(contexts(spark, sf), citations(spark, sf)))
    return s.select("request_id", "source_no", "chunk_id", "score", "ticker", "fiscal_year", "section", F.md5("text_snippet").alias("snippet_md5"))
