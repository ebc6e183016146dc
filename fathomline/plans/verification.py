"""Answer verification and grounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.numbers import normalize_number, number_tokens
from ..operators import verify as v
from ..sources import derived as d
from .registry import query

W = d.sql_with
BY = ["ticker", "fiscal_year"]
NUM = r"regexp_replace(t, '\s+', '', 'g')"
NUMBERS = r"list_transform(regexp_extract_all(coalesce({}, ''), '\(?\s*-?\s*\d[\d,]*\.?\d*\s*[%MBKmbk]?\s*\)?'), lambda t: regexp_replace(t, '\s+', '', 'g'))"
NORM = "rtrim(regexp_replace({}, '[$, MBKmbk%]', '', 'g'), '.,')"


# --- model output ------------------------------------------------------------
def raw_outputs(spark, sf):
    """Model texts in the shapes a parser meets, one per answer."""
    a = d.answers(spark, sf)
    k = F.col("request_id") % 8
    js = lambda thought, *more: F.to_json(F.struct(F.lit(thought).alias("internal_thought"), *more))
    full = js("step 1", F.col("extracted_raw_data"), F.col("answer"), F.array(F.lit(" NVDA - 2026 "), F.lit("")).alias("sources"))
    bare = js("no digits", F.col("answer"))
    raw = (F.when(k == 0, full).when(k == 1, F.concat(F.lit("Here:\n```json\n"), full, F.lit("\n```"))).when(k == 2, F.concat(F.lit("<think>so {x}\n</think> "), full))
           .when(k == 3, F.to_json(F.struct(full.alias("content")))).when(k == 4, F.concat(F.lit("noise "), full, F.lit(" tail")))
           .when(k == 5, F.concat(F.lit('broken {"answer": "'), "answer", F.lit(' \\"quoted\\"", "x'))).when(k == 6, F.col("answer")).otherwise(bare))
    return a.withColumn("raw_output", raw)


@query("parse_answers", W(["answers"], """SELECT request_id, request_id % 8 < 5 AS parsed, md5(CASE WHEN request_id % 8 = 5 THEN answer || ' "quoted"' ELSE answer END) AS answer_md5,
    CASE WHEN request_id % 8 < 5 THEN coalesce(extracted_raw_data, answer) ELSE 'No structured data was extracted from the LLM response.' END AS extracted_raw_data,
    CASE WHEN request_id % 8 < 5 THEN 'NVDA - 2026' ELSE 'unknown' END AS sources FROM answers"""))
def parse_answers(spark, sf):
    out = v.parse_answers(raw_outputs(spark, sf).drop("answer", "extracted_raw_data"))
    return out.select("request_id", "parsed", F.md5("answer").alias("answer_md5"), "extracted_raw_data", F.array_join("sources", ";").alias("sources"))


MARK = " OR ".join(f"contains(lower(answer), '{m.replace(chr(39), chr(39) * 2)}')" for m in fixed.REFUSAL_MARKERS)


@query("classify_outputs", W(["answers"], f"SELECT request_id, CASE WHEN request_id % 8 IN (2, 5, 6) THEN CASE WHEN {MARK} THEN 'refusal' ELSE 'malformed' END ELSE 'structured' END AS kind FROM answers"))
def classify_outputs(spark, sf):
    return raw_outputs(spark, sf).select("request_id", v.classify_outputs(F.col("raw_output")).alias("kind"))


# --- numbers and claims ------------------------------------------------------
@query("extract_numbers", W(["corpus"], f"SELECT chunk_id, count(*) AS n, min(tok) AS least, max({NORM.format('tok')}) AS most, sum(length(tok))::BIGINT AS chars FROM (SELECT chunk_id, unnest({NUMBERS.format('raw_text')}) AS tok FROM corpus) GROUP BY chunk_id"))
def extract_numbers(spark, sf):
    rows = d.corpus(spark, sf).select("chunk_id", F.explode(number_tokens(F.col("raw_text"))).alias("tok"))
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("tok").alias("least"), F.max(normalize_number(F.col("tok"))).alias("most"), F.sum(F.length("tok")).alias("chars"))


VERIFIED = f"""nums AS (SELECT *, {NUMBERS.format('answer')} AS n, list_transform({NUMBERS.format('extracted_raw_data')}, lambda t: {NORM.format('t')}) AS e FROM answers),
ver AS (SELECT *, list_filter(n, lambda t: NOT (list_contains(e, {NORM.format('t')}) OR list_contains(list_transform(e, lambda z: ltrim(z, '0')), ltrim({NORM.format('t')}, '0')))) AS failed FROM nums)"""


@query("verify_claims", W(["answers"], "SELECT request_id, len(failed) = 0 AS passed, CAST(len(n) - len(failed) AS INTEGER) AS verified, array_to_string(failed, ';') AS failed FROM ver", VERIFIED))
def verify_claims(spark, sf):
    out = v.verify_claims(d.answers(spark, sf))
    return out.select("request_id", "passed", F.size("verified_claims").alias("verified"), F.array_join("failed_claims", ";").alias("failed"))


def verdicts(spark, sf):
    return v.verdict_status(v.verify_claims(d.answers(spark, sf)), F.col("request_id") % 20 != 0)


STATUS = f"""{VERIFIED},
sta AS (SELECT *, CASE WHEN request_id % 20 = 0 THEN 'not_run' WHEN extracted_raw_data IS NULL THEN 'error' WHEN len(failed) = 0 THEN 'passed' ELSE 'failed' END AS status FROM ver)"""


@query("verdict_status", W(["answers"], f"SELECT request_id, status, md5(CASE WHEN status = 'failed' THEN '{fixed.SAFE_FALLBACK}' ELSE answer END) AS final_md5, status = 'passed' AND NOT contains(lower(answer), 'not available') AS cacheable FROM sta", STATUS))
def verdict_status(spark, sf):
    return verdicts(spark, sf).select("request_id", "status", F.md5("final_output").alias("final_md5"), "cacheable")


WITHHELD = fixed.WITHHELD_MESSAGE.replace("'", "''")


@query("enforce_delivery", W(["answers"], f"SELECT request_id, md5(CASE status WHEN 'failed' THEN '{fixed.SAFE_FALLBACK}' WHEN 'error' THEN '{WITHHELD}' ELSE answer END) AS delivered_md5, CASE WHEN status IN ('failed', 'error') THEN 0 ELSE 1 END AS sources, status IN ('failed', 'error') AS enforced FROM sta", STATUS))
def enforce_delivery(spark, sf):
    out = v.enforce_delivery(verdicts(spark, sf).withColumn("sources", F.array(F.lit("s"))))
    return out.select("request_id", F.md5("delivered").alias("delivered_md5"), F.size("delivered_sources").alias("sources"), "enforced")


def asked_answers(spark, sf):
    """Answers with the company and question they belong to."""
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), d.ticker_of(F.col("c_nationkey").cast("long")).alias("ticker"))
    k = F.col("request_id")
    return d.answers(spark, sf).join(c, "custkey").select(
        "request_id", F.when(k % 30 == 4, "ALL").otherwise(F.col("ticker")).alias("ticker"), F.when(k % 25 == 0, "2031").otherwise(F.col("fiscal_year")).alias("fiscal_year"),
        F.when(k % 40 == 10, "").when(k % 9 == 0, F.col("answer")).otherwise(F.concat("ticker", F.lit(" results. "), "answer", F.lit(" Growth of 3%."))).alias("answer"),
        F.when(k % 4 == 0, "What is the operating margin?").otherwise("How much?").alias("query"))


ASKED = f"""asked0 AS (SELECT request_id, {d._ticker('CAST(c_nationkey AS BIGINT)')} AS tk, fiscal_year AS fy, answer AS ans FROM answers JOIN customer ON custkey = c_custkey),
aa AS (SELECT request_id, CASE WHEN request_id % 30 = 4 THEN 'ALL' ELSE tk END AS ticker, CASE WHEN request_id % 25 = 0 THEN '2031' ELSE fy END AS fiscal_year,
  CASE WHEN request_id % 40 = 10 THEN '' WHEN request_id % 9 = 0 THEN ans ELSE tk || ' results. ' || ans || ' Growth of 3%.' END AS answer, CASE WHEN request_id % 4 = 0 THEN 'What is the operating margin?' ELSE 'How much?' END AS query FROM asked0)"""
CLAIM = "list_distinct_ordered"
RAWCLAIMS = " || ".join(f"list_transform(regexp_extract_all(answer, '(?i){p}'), lambda c: trim(c))" for p in fixed.CLAIM_PATTERNS)
CLAIMS = f"""{ASKED},
cl0 AS (SELECT request_id, ticker, fiscal_year, query, unnest(l) AS claim, generate_subscripts(l, 1) AS i FROM (SELECT *, {RAWCLAIMS} AS l FROM aa)),
cl AS (SELECT request_id, ticker, fiscal_year, query, claim, row_number() OVER (PARTITION BY request_id ORDER BY min(i)) - 1 AS claim_no,
  TRY_CAST(replace(regexp_extract(claim, '\\d[\\d,]*(?:\\.\\d+)?'), ',', '') AS DOUBLE) AS value FROM cl0 GROUP BY request_id, ticker, fiscal_year, query, claim)"""


@query("extract_financial_claims", W(["answers"], "SELECT request_id, CAST(claim_no AS INTEGER) AS claim_no, claim, value FROM cl", CLAIMS))
def extract_financial_claims(spark, sf):
    return v.claim_rows(asked_answers(spark, sf), ["request_id"]).select("request_id", "claim_no", "claim", "value")


EVID = r"""ev AS (SELECT DISTINCT ticker, fiscal_year, TRY_CAST(replace(t, ',', '') AS DOUBLE) AS val FROM (SELECT ticker, fiscal_year, unnest(regexp_extract_all(raw_text, '\d[\d,]*(?:\.\d+)?')) AS t FROM corpus)),
mt AS (SELECT *, value IS NOT NULL AND EXISTS (SELECT 1 FROM ev WHERE ev.ticker = cl.ticker AND ev.fiscal_year = cl.fiscal_year AND abs(cl.value - ev.val) <= greatest(0.005 * greatest(abs(cl.value), abs(ev.val)), 0.12)) AS matched FROM cl)"""


@query("claims_vs_evidence", W(["answers", "corpus"], "SELECT request_id, CAST(claim_no AS INTEGER) AS claim_no, matched FROM mt", CLAIMS + ",\n" + EVID))
def claims_vs_evidence(spark, sf):
    claims = v.claim_rows(asked_answers(spark, sf), ["request_id", *BY])
    out = v.claims_vs_evidence(claims, v.evidence_numbers(d.corpus(spark, sf), BY), BY)
    return out.select("request_id", "claim_no", "matched")


def statements(spark, sf):
    """Corpus with statement tables in prose form ('Label: figure')."""
    return d.corpus(spark, sf).withColumn("raw_text", F.replace("raw_text", F.lit(" | "), F.lit(": ")))


def first_sql(name: str, pattern: str, group: int = 1) -> str:
    x = f"nullif(regexp_extract(raw_text, '(?i){pattern}', {group}), '')"
    return f"arg_min({x}, chunk_id) FILTER ({x} IS NOT NULL) AS {name}"


STMT = "st AS (SELECT * REPLACE (replace(raw_text, ' | ', ': ') AS raw_text) FROM corpus)"
MARGIN = f"""{STMT},
m0 AS (SELECT ticker, fiscal_year, {first_sql('r', fixed.REVENUE_FIGURE)}, {first_sql('o', fixed.OPERATING_FIGURE)}, {first_sql('g', fixed.GROSS_FIGURE)} FROM st GROUP BY ALL),
mg AS (SELECT ticker, fiscal_year, nullif(CAST(replace(o, ',', '') AS DOUBLE), 0) / nullif(CAST(replace(r, ',', '') AS DOUBLE), 0) * 100 AS operating_margin, nullif(CAST(replace(g, ',', '') AS DOUBLE), 0) / nullif(CAST(replace(r, ',', '') AS DOUBLE), 0) * 100 AS gross_margin FROM m0)"""


@query("derived_margin", W(["corpus"], "SELECT ticker, fiscal_year, round(operating_margin, 6) AS operating_margin, round(gross_margin, 6) AS gross_margin FROM mg", MARGIN))
def derived_margin(spark, sf):
    return v.derived_margin(statements(spark, sf), BY).select(*BY, F.round("operating_margin", 6).alias("operating_margin"), F.round("gross_margin", 6).alias("gross_margin"))


GM = f"coalesce(nullif(regexp_extract(raw_text, '(?i){fixed.METRIC_PATTERNS['gross_margin']}', 1), ''), nullif(regexp_extract(raw_text, '(?i){fixed.METRIC_PATTERNS['gross_margin']}', 2), ''))"


@query("extract_key_metrics", W(["corpus"], "SELECT ticker, fiscal_year, " + ", ".join(
    f"arg_min({GM}, chunk_id) FILTER ({GM} IS NOT NULL) AS {n}" if n == "gross_margin" else first_sql(n, p) for n, p in fixed.METRIC_PATTERNS.items()) + " FROM st GROUP BY ALL", STMT))
def extract_key_metrics(spark, sf):
    return v.key_metrics(statements(spark, sf), BY)


def segment_notes(spark, sf):
    """Statement tables as segment notes."""
    t = d.table_chunks(spark, sf)
    return t.withColumn("raw_text", F.concat(F.lit("The "), F.lower("segment"), F.lit(" segment\nhad revenue: $"), F.regexp_extract("raw_text", r"([\d,]{5,})", 1), F.lit(" " + "-" * 110 + " and the other business sales: 5.")))


@query("segment_revenue", W(["table_chunks"], r"""SELECT ticker, fiscal_year, 'The ' || lower(segment) || ' segment' AS segment, arg_max(n, chunk_id) AS value FROM (SELECT *, regexp_extract(raw_text, '([\d,]{5,})', 1) AS n FROM table_chunks) WHERE n <> '' GROUP BY ALL
   UNION ALL SELECT ticker, fiscal_year, 'and the other business', '5' FROM (SELECT *, regexp_extract(raw_text, '([\d,]{5,})', 1) AS n FROM table_chunks) WHERE n <> '' GROUP BY ALL"""))
def segment_revenue(spark, sf):
    return v.segment_revenue(segment_notes(spark, sf).where(F.regexp_extract("raw_text", r"revenue: \$([\d,]{5,})", 1) != ""), BY)


COMPANIES = ", ".join(f"'{t}'" for t in fixed.SUPPORTED_TICKERS)
# scope ALL: claims meet the evidence of every supported company, and ALL has what any of them has
FLAGS = f"""pr0 AS (SELECT ticker, fiscal_year, bool_or(x) AS in_a, bool_or(y) AS in_b FROM (SELECT ticker, fiscal_year, TRUE AS x, FALSE AS y FROM {{}} UNION ALL SELECT ticker, fiscal_year, FALSE, TRUE FROM vector_store) GROUP BY ALL),
pres AS (SELECT * FROM pr0 WHERE ticker <> 'ALL' UNION ALL SELECT 'ALL', fiscal_year, bool_or(in_a), bool_or(in_b) FROM pr0 WHERE ticker IN ({COMPANIES}) GROUP BY fiscal_year)"""
EACH = f"ce AS (SELECT request_id, unnest(CASE WHEN ticker = 'ALL' THEN [{COMPANIES}] ELSE [ticker] END) AS ticker, fiscal_year, query, claim, claim_no, value FROM cl)"
REFUSED = "(" + " OR ".join(f"contains(lower(answer), '{m}')" for m in fixed.AUDIT_REFUSALS) + " OR trim(answer) = '')"
NAMED = "(contains(upper(answer), ticker) OR contains(upper(answer), CASE ticker WHEN 'AAPL' THEN 'APPLE' WHEN 'MSFT' THEN 'MICROSOFT' WHEN 'NVDA' THEN 'NVIDIA' END) IS TRUE)"


@query("grounding_status", W(["answers", "corpus", "vector_store"], f"""SELECT request_id, split_part(c, '|', 1) AS status, split_part(c, '|', 2) AS layer, claims, supported FROM (SELECT *, CASE
    WHEN ref AND NOT ia AND NOT ib THEN 'PASS|' WHEN ref AND ia AND NOT ib THEN 'FAIL|Vector Retrieval' WHEN ref AND NOT ia THEN 'FAIL|Context Assembly' WHEN ref THEN 'FAIL|Generation'
    WHEN ticker <> 'ALL' AND NOT {NAMED} THEN 'FAIL|Generation' WHEN claims = 0 THEN 'PARTIAL|Generation'
    WHEN supported / claims >= CASE WHEN ticker = 'ALL' THEN 0.5 ELSE 0.8 END THEN 'PASS|' WHEN supported / claims >= CASE WHEN ticker = 'ALL' THEN 0.3 ELSE 0.5 END THEN 'PARTIAL|Retrieval' ELSE 'FAIL|Retrieval' END AS c
    FROM (SELECT aa.*, {REFUSED} AS ref, coalesce(in_a, FALSE) AS ia, coalesce(in_b, FALSE) AS ib, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported FROM aa LEFT JOIN pres USING (ticker, fiscal_year)
      LEFT JOIN (SELECT request_id, count(*) AS claims, count(*) FILTER (ok) AS supported FROM (SELECT request_id, claim_no, bool_or(coalesce(matched OR abs(value - dm) <= greatest(0.005 * greatest(abs(value), abs(dm)), 0.12), FALSE)) AS ok FROM (
        SELECT mt.*, CASE WHEN contains(lower(claim || ' ' || query), 'operating margin') THEN operating_margin WHEN contains(lower(claim || ' ' || query), 'gross margin') THEN gross_margin END AS dm FROM mt LEFT JOIN mg USING (ticker, fiscal_year)) GROUP BY ALL) GROUP BY request_id) USING (request_id)))""",
    CLAIMS + ",\n" + EACH + ",\n" + MARGIN + ",\n" + EVID.replace("FROM corpus", "FROM st").replace("cl.", "ce.").replace("FROM cl)", "FROM ce)") + ",\n" + FLAGS.format("st")))
def grounding_status(spark, sf):
    return v.grounding_status(asked_answers(spark, sf), statements(spark, sf), d.vector_store(spark, sf), BY)


@query("grounding_class", W(["answers", "corpus", "vector_store"], """SELECT request_id, CASE WHEN ref AND NOT ia AND NOT ib THEN 'CORRECT_REFUSAL' WHEN ref AND NOT ia THEN 'CONTEXT_ASSEMBLY_FAILURE' WHEN ref THEN 'RETRIEVAL_FAILURE'
    WHEN claims = 0 THEN 'PARTIALLY_GROUNDED' WHEN supported / claims >= 0.8 THEN 'FULLY_GROUNDED' WHEN supported > 0 THEN 'PARTIALLY_GROUNDED' ELSE 'UNGROUNDED' END AS label
    FROM (SELECT aa.*, contains(lower(answer), 'not available') OR answer = '' AS ref, coalesce(in_a, FALSE) AS ia, coalesce(in_b, FALSE) AS ib, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported FROM aa LEFT JOIN pres USING (ticker, fiscal_year)
      LEFT JOIN (SELECT request_id, count(*) AS claims, count(*) FILTER (ok) AS supported FROM (SELECT request_id, claim_no, bool_or(coalesce(f, FALSE)) AS ok FROM ct LEFT JOIN tf USING (ticker, fiscal_year, term) GROUP BY ALL) GROUP BY request_id) USING (request_id))""",
    CLAIMS + ",\n" + EACH + r""",
ct AS (SELECT request_id, ticker, fiscal_year, claim_no, unnest(list_filter(string_split_regex(replace(replace(lower(claim), '$', ''), ',', ''), '\s+'), lambda x: x <> '')[1:3]) AS term FROM ce),
dt AS (SELECT DISTINCT ticker, fiscal_year, term FROM ct),
vo AS (SELECT DISTINCT ticker, fiscal_year, unnest(string_split_regex(lower(raw_text), '\s+')) AS word FROM corpus),
tf AS (SELECT ticker, fiscal_year, term, EXISTS (SELECT 1 FROM vo WHERE vo.ticker = dt.ticker AND vo.fiscal_year = dt.fiscal_year AND contains(vo.word, dt.term)) AS f FROM dt),
""" + FLAGS.format("corpus")))
def grounding_class(spark, sf):
    return v.grounding_class(asked_answers(spark, sf), d.corpus(spark, sf), d.vector_store(spark, sf), BY)


@query("number_to_chunks", W(["answers", "table_chunks"], r"""SELECT number, chunk_id, min(place) AS "offset" FROM (SELECT chunk_id, replace(t, ',', '') AS number, instr(raw_text, t) - 1 AS place FROM (SELECT chunk_id, raw_text, unnest(regexp_extract_all(raw_text, '\d[\d,]*(?:\.\d+)?')) AS t FROM table_chunks))
    WHERE number IN (SELECT CAST(cents // 100 AS VARCHAR) FROM answers) GROUP BY ALL"""))
def number_to_chunks(spark, sf):
    targets = d.answers(spark, sf).select(F.floor(F.col("cents") / 100).cast("string").alias("number"))
    return v.number_to_chunks(targets, d.table_chunks(spark, sf)).select("number", "chunk_id", F.col("offset").cast("long").alias("offset"))
