"""Question preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import questions as q
from ..operators.scopes import normalize_filter
from ..sources import derived as d
from .registry import query

W = d.sql_with
TK = "CASE {} WHEN 'aapl' THEN 'AAPL' WHEN 'apple' THEN 'AAPL' WHEN 'msft' THEN 'MSFT' WHEN 'microsoft' THEN 'MSFT' ELSE 'NVDA' END"
KNOWN = r"regexp_extract_all(lower({}), '\b(?:aapl|msft|nvda|apple|microsoft|nvidia)\b')"


def ordered(text: str) -> str:
    """Distinct tickers by first appearance, as a list."""
    found = f"list_transform({KNOWN.format(text)}, lambda w: {TK.format('w')})"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def named(text: str) -> str:
    found = f"list_transform({KNOWN.format(text)}, lambda w: {TK.format('w')})"
    return f"list_filter(['AAPL', 'MSFT', 'NVDA'], lambda t: list_contains({found}, t))"


ANY = lambda pats, text: "(" + " OR ".join(f"regexp_matches({text}, '(?i){p}')" for p in pats) + ")"
UNSAFE, CHAT = ANY(fixed.INJECTION_PATTERNS, "query"), ANY(fixed.CHITCHAT_PATTERNS, "trim(query)")


@query("route_queries", W(["asked"], f"SELECT query_id, CASE WHEN {UNSAFE} THEN 'BLOCKED' WHEN {CHAT} THEN 'GENERAL' ELSE 'REWRITE' END AS action FROM asked"))
def route_queries(spark, sf):
    return d.asked(spark, sf).select("query_id", q.route(F.col("query")).alias("action"))


@query("flag_unsafe", W(["turns"], f"SELECT conv_id, turn, {UNSAFE.replace('query', 'content')} AS unsafe FROM turns"))
def flag_unsafe(spark, sf):
    return d.turns(spark, sf).select("conv_id", "turn", q.is_unsafe(F.col("content")).alias("unsafe"))


@query("extract_all_tickers", W(["asked"], f"SELECT query_id, array_to_string({ordered('query')}, ',') AS tickers FROM asked"))
def extract_all_tickers(spark, sf):
    return d.asked(spark, sf).select("query_id", F.array_join(q.all_tickers(F.col("query")), ",").alias("tickers"))


SUBJ = r"""coalesce(CASE WHEN regexp_matches(lower({0}), '\baapl\b') THEN 'AAPL' WHEN regexp_matches(lower({0}), '\bmsft\b') THEN 'MSFT' WHEN regexp_matches(lower({0}), '\bnvda\b') THEN 'NVDA'
  WHEN regexp_matches(lower({0}), '\bapple\b') THEN 'AAPL' WHEN regexp_matches(lower({0}), '\bmicrosoft\b') THEN 'MSFT' WHEN regexp_matches(lower({0}), '\bnvidia\b') THEN 'NVDA' END,
  list_extract(list_filter(regexp_extract_all({0}, '[\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,5}}') AND w NOT IN (""" + ", ".join(f"'{w}'" for w in fixed.NON_TICKER_CAPS) + ")), 1))"


@query("extract_subject", W(["asked"], f"SELECT query_id, {SUBJ.format('query')} AS subject FROM asked"))
def extract_subject(spark, sf):
    return d.asked(spark, sf).select("query_id", q.subject(F.col("query")).alias("subject"))


@query("query_fiscal_year", W(["asked"], r"SELECT query_id, CAST(list_max(list_transform(regexp_extract_all(query, '(?i)(?:FY|fiscal(?:\s+year)?)\s*[-]?\s*(\d{4})', 1), lambda y: CAST(y AS INTEGER))) AS VARCHAR) AS fiscal_year FROM asked"))
def query_fiscal_year(spark, sf):
    return d.asked(spark, sf).select("query_id", q.query_fiscal_year(F.col("query")).alias("fiscal_year"))


@query("extract_section_ref", W(["asked"], r"SELECT query_id, 'Item ' || upper(nullif(regexp_extract(regexp_extract(query, '(?i)\bItem\s*[1-9][A-Za-z]?\b'), '[1-9][A-Za-z]?'), '')) AS section FROM asked"))
def extract_section_ref(spark, sf):
    return d.asked(spark, sf).select("query_id", q.section_ref(F.col("query")).alias("section"))


CMP = r"regexp_matches(query, '(?i)\b(?:compar\w*|versus|vs\.?|across|differences?|between)\b')"
CROSS = f"regexp_matches(query, '(?i){fixed.CROSS_COMPANY_PATTERN}')"
MULTI = f"(len({named('query')}) >= 2 OR {CMP})"
DETECT = f"CASE WHEN {CROSS} THEN list_concat({named('query')}, list_filter(['AAPL', 'MSFT', 'NVDA'], lambda t: NOT list_contains({named('query')}, t))) ELSE {named('query')} END"


@query("multi_ticker_intent", W(["asked"], f"SELECT query_id, {MULTI} AS multi FROM asked"))
def multi_ticker_intent(spark, sf):
    return d.asked(spark, sf).select("query_id", q.multi_ticker_intent(F.col("query")).alias("multi"))


@query("comparison_pool", W(["asked"], f"""SELECT query_id, array_to_string(list_concat(ex, list_filter(det, lambda t: NOT list_contains(ex, t)))[1:4], ',') AS pool FROM (
    SELECT query_id, {DETECT} AS det, CASE query_id % 3 WHEN 0 THEN ['TSLA', 'NVDA'] WHEN 1 THEN ['META'] ELSE []::VARCHAR[] END AS ex FROM asked)"""))
def comparison_pool(spark, sf):
    i = F.col("query_id") % 3
    ex = F.when(i == 0, F.array(F.lit("TSLA"), F.lit("NVDA"))).when(i == 1, F.array(F.lit("META"), F.lit("")))
    return d.asked(spark, sf).select("query_id", F.array_join(q.comparison_pool(F.col("query"), ex), ",").alias("pool"))


@query("cross_ticker_bypass", W(["asked"], f"SELECT query_id, CASE WHEN NOT {MULTI} THEN 'AAPL' END AS ticker, '2024' AS fiscal_year FROM asked"))
def cross_ticker_bypass(spark, sf):
    p = d.asked(spark, sf).withColumns({"ticker": F.lit("AAPL"), "fiscal_year": F.lit("2024")})
    return q.cross_ticker_bypass(p).select("query_id", "ticker", "fiscal_year")


@query("normalize_filter", """SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'AAPL' END AS ticker, CAST(2000 + item_id AS VARCHAR) AS fiscal_year, CASE WHEN item_id % 3 = 0 THEN 'Item 7' END AS section,
    CASE WHEN item_id % 4 = 0 THEN 'MSFT,NVDA' END AS tickers FROM benchmark""")
def normalize_filters(spark, sf):
    i = F.col("item_id")
    p = d.table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.when(i % 2 == 0, " aapl ").otherwise("  ").alias("ticker"), (2000 + i).alias("fiscal_year"), F.when(i % 3 == 0, "Item 7 ").alias("section"),
        F.when(i % 4 == 0, F.array(F.lit("msft"), F.lit(" "), F.lit("nvda "))).when(i % 4 == 1, F.array(F.lit("msft"))).alias("tickers"))
    return normalize_filter(p).withColumn("tickers", F.array_join("tickers", ","))


KW = "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in fixed.FINANCE_KEYWORDS) + ")"
NEED = rf"(len(list_filter(string_split_regex(query, '\W+'), lambda w: w <> '')) < 4 OR NOT {KW})"


@query("needs_expansion", W(["asked"], f"SELECT query_id, {NEED} AS need FROM asked"))
def needs_expansion(spark, sf):
    return d.asked(spark, sf).select("query_id", q.needs_expansion(F.col("query")).alias("need"))


def variants_sql() -> str:
    out = ["query"]
    for term, syns in fixed.SYNONYMS:
        for s in syns:
            s2 = s.replace("'", "''")
            out.append(f"CASE WHEN instr(lower(query), '{term}') > 0 THEN substr(query, 1, instr(lower(query), '{term}') - 1) || '{s2}' || substr(query, instr(lower(query), '{term}') + {len(term)}) END")
    part = lambda p, i: f"regexp_extract(query, '(?s)^(.*?)({p})(.*)$', {i})"
    caps, year = r"\b[A-Z]{2,5}\b", r"\b(?:19|20)\d{2}\b"
    legal = f"CASE {part(caps, 2)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.COMPANY_LEGAL.items()) + " END"
    out.append(f"{part(caps, 1)} || {legal} || ' (' || {part(caps, 2)} || ')' || {part(caps, 3)}")
    for lead in ("fiscal year ", "FY "):
        out.append(f"CASE WHEN {part(year, 2)} <> '' THEN {part(year, 1)} || '{lead}' || {part(year, 2)} || {part(year, 3)} END")
    out.append("query || CASE WHEN contains(lower(query), '10-k') OR contains(lower(query), '10k') THEN ' as disclosed in the SEC 10-K annual report' ELSE ' as reported in the company''s annual report' END")
    return "[" + ", ".join(out) + "]"


@query("expand_queries", W(["asked"], f"""SELECT query_id, CAST(i - 1 AS INTEGER) AS variant, md5(v) AS query_md5 FROM (SELECT query_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (
    SELECT query_id, list_filter(u, lambda x, i: list_position(u, x) = i)[1:CASE WHEN {NEED} THEN 4 ELSE 1 END] AS l FROM (SELECT query_id, query, list_filter({variants_sql()}, lambda x: x IS NOT NULL) AS u FROM asked)))"""))
def expand_queries(spark, sf):
    return q.expanded(d.asked(spark, sf)).select("query_id", "variant", F.md5("retrieval_query").alias("query_md5"))


YEARS = r"regexp_extract_all(content, '(?:19|20)\d{2}')"
RANGE = "CASE WHEN CAST({0} AS INTEGER) BETWEEN 2000 AND 2035 THEN CAST({0} AS INTEGER) END"
HIST = f"""tt AS (SELECT *, role = 'user' AS u, CASE WHEN role = 'user' THEN {ordered('content')} END AS a, {SUBJ.format('content')} AS sub, {RANGE.format(f'list_extract({YEARS}, 1)')} AS y1,
  CASE WHEN role = 'user' THEN {RANGE.format(f'list_extract({YEARS}, -1)')} END AS yl, regexp_matches(lower(content), '{fixed.COREFERENCE_PATTERN.replace(chr(39), chr(39) * 2)}') AS ref FROM turns),
hh AS (SELECT *, last_value(CASE WHEN len(a) >= 1 THEN a END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN len(a) >= 2 THEN a END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN len(a) >= 3 THEN a END IGNORE NULLS) OVER w AS h3,
  last_value(CASE WHEN u THEN {{'t': coalesce(sub, a[1])}} END IGNORE NULLS) OVER w AS prev, count(*) OVER w > 0 AS hist, last_value(yl IGNORE NULLS) OVER w AS hy FROM tt
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rr AS (SELECT *, coalesce(sub, CASE WHEN contains(lower(content), 'first company') THEN h1[1] END, CASE WHEN contains(lower(content), 'second company') THEN h2[2] END, CASE WHEN contains(lower(content), 'third company') THEN h3[3] END,
  CASE WHEN hist AND ref THEN prev.t END) AS ticker, coalesce(y1, hy) AS fiscal_year FROM hh WHERE u),
r2 AS (SELECT *, CASE ticker WHEN 'AAPL' THEN 'Apple Inc.' WHEN 'MSFT' THEN 'Microsoft Corporation' WHEN 'NVDA' THEN 'NVIDIA Corporation' ELSE ticker END AS name, CASE WHEN len(a) = 0 AND ticker IS NOT NULL THEN coalesce(h1, a) ELSE a END AS tl FROM rr)"""


@query("resolve_coreference", W(["turns"], """SELECT conv_id, turn, ticker, fiscal_year, CASE WHEN len(tl) > 1 THEN array_to_string(tl, ',') END AS tickers,
    md5(CASE WHEN hist AND ref AND ticker IS NOT NULL AND NOT contains(lower(content), lower(name)) AND NOT contains(lower(content), lower(ticker)) THEN trim(name || ' (' || ticker || ') ' || content) ELSE content END) AS standalone_md5 FROM r2""", HIST))
def resolve_coreference(spark, sf):
    r = q.resolve_references(d.turns(spark, sf))
    return r.select("conv_id", "turn", "ticker", "fiscal_year", F.array_join("tickers", ",").alias("tickers"), F.md5("standalone_query").alias("standalone_md5"))


@query("extract_query_year", W(["turns"], "SELECT conv_id, turn, fiscal_year FROM rr", HIST))
def extract_query_year(spark, sf):
    return q.resolve_references(d.turns(spark, sf)).select("conv_id", "turn", "fiscal_year")


@query("memory_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations) WHERE role = 'system' OR r <= 6")
def memory_window(spark, sf):
    return q.memory_window(d.table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("redact_last_ai", """SELECT conv_id, turn, role, md5(CASE WHEN role = 'assistant' AND turn = last THEN '[redacted]' ELSE text END) AS content_md5 FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
    UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', md5('[redacted]') FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0""")
def redact_last_ai(spark, sf):
    t = d.table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return q.redact_last_ai(t, "[redacted]").select("conv_id", "turn", "role", F.md5("content").alias("content_md5"))
