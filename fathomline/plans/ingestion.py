"""Ingestion queries: filing files to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as g
from ..sources import derived as d
from ..functions import markup
from ..functions.text import estimate_tokens
from .registry import query

W = d.sql_with

INNER = ('<table class="t"><tr><th>Line Item</th><th>2024</th><th></th></tr>\n<tr><td>Revenue &amp; other</td><td>$<ix:nonFraction name="r">', '</ix:nonFraction></td><td></td></tr>'
         '<tr><td></td><td> </td><td></td></tr><TR><TD>Net <b>income</b></TD><td>(12)</td><td>5%</td></tr></table>')
EMPTY, NEST = '<table><tr><td>only</td></tr></table>', ('<table><tr><td>outer note', '</td></tr></table>')
PATHS = ["data/AAPL/10-K/0000320193-24-000123/filing.html", "up/10-K/2023/msft_report.html", "misc/0000000001-22-000009/x.txt", "up/annual.sgml"]


def raw_filings(spark, sf):
    return filing_columns(d.table(spark, sf, "pages"))


def filing_columns(p):
    """Pages as SGML-wrapped filings with tables added."""
    i = F.col("page_id")
    acc = lambda n: F.format_string(f"%010d-%02d-{n:06d}", i, 20 + i % 5)
    head = F.concat(
        F.lit("<SEC-HEADER> ACCESSION NUMBER: "), acc(7), F.lit("\n"), F.when(i % 6 == 0, F.concat(F.lit("accession number : "), acc(8), F.lit("\n"))).otherwise(""),
        F.when(i % 3 == 0, "NAME: Apple Inc.\n").when(i % 3 == 1, "NAME: Microsoft Corp\n").otherwise(""),
        F.when(i % 4 == 1, "For the fiscal year ended September 28, 2021\n").otherwise(""))
    table = lambda k: F.concat(F.lit(INNER[0]), (i * 1000 + k).cast("string"), F.lit(INNER[1]))
    tables = F.concat(
        F.when(i % 4 == 0, EMPTY).otherwise(""), F.when(i % 3 >= 1, table(1)).otherwise(""), F.lit("\nbetween\n"), F.when(i % 3 >= 2, table(2)).otherwise(""),
        F.when(i % 7 == 0, F.concat(F.lit(NEST[0]), table(9), F.lit(NEST[1]))).otherwise(""))
    body = F.concat(F.when(i % 5 < 3, "<DOCUMENT>\n<TYPE>10-K\n<TEXT>").otherwise("<DOCUMENT>\n<TYPE>8-K\n"), F.col("html"), tables, F.when(i % 5 < 2, "\n</DOCUMENT>").otherwise(""))
    tail = F.when(i % 5 != 2, "\n<DOCUMENT>\n<TYPE>EX-21\nexhibit\n</DOCUMENT>").otherwise("")
    path = F.element_at(F.array(*[F.lit(x) for x in PATHS]), (i % len(PATHS) + 1).cast("int"))
    return p.select("page_id", path.alias("path"), F.concat(head, body, tail).alias("content"))


def _t(k):
    return f"'{INNER[0]}' || (page_id * 1000 + {k}) || '{INNER[1]}'"


RAW = f"""raw AS (SELECT page_id, {d._pick(PATHS, f'page_id % {len(PATHS)}')} AS path, '<SEC-HEADER> ACCESSION NUMBER: ' || printf('%010d-%02d-000007', page_id, 20 + page_id % 5) || chr(10)
  || CASE WHEN page_id % 6 = 0 THEN 'accession number : ' || printf('%010d-%02d-000008', page_id, 20 + page_id % 5) || chr(10) ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN 'NAME: Apple Inc.' || chr(10) WHEN 1 THEN 'NAME: Microsoft Corp' || chr(10) ELSE '' END || CASE WHEN page_id % 4 = 1 THEN 'For the fiscal year ended September 28, 2021' || chr(10) ELSE '' END
  || CASE WHEN page_id % 5 < 3 THEN '<DOCUMENT>' || chr(10) || '<TYPE>10-K' || chr(10) || '<TEXT>' ELSE '<DOCUMENT>' || chr(10) || '<TYPE>8-K' || chr(10) END || html
  || CASE WHEN page_id % 4 = 0 THEN '{EMPTY}' ELSE '' END || CASE WHEN page_id % 3 >= 1 THEN {_t(1)} ELSE '' END || chr(10) || 'between' || chr(10) || CASE WHEN page_id % 3 >= 2 THEN {_t(2)} ELSE '' END
  || CASE WHEN page_id % 7 = 0 THEN '{NEST[0]}' || {_t(9)} || '{NEST[1]}' ELSE '' END || CASE WHEN page_id % 5 < 2 THEN chr(10) || '</DOCUMENT>' ELSE '' END
  || CASE WHEN page_id % 5 <> 2 THEN chr(10) || '<DOCUMENT>' || chr(10) || '<TYPE>EX-21' || chr(10) || 'exhibit' || chr(10) || '</DOCUMENT>' ELSE '' END AS content FROM pages)"""
MAIN = r"""CASE WHEN regexp_extract(content, '(?is)<DOCUMENT>\s*\n<TYPE>10-K\b.*?</DOCUMENT>') <> '' THEN regexp_extract(content, '(?is)<DOCUMENT>\s*\n<TYPE>10-K\b.*?</DOCUMENT>')
  WHEN regexp_extract(content, '(?is)<DOCUMENT>\s*\n<TYPE>10-K\b.*') <> '' THEN regexp_extract(content, '(?is)<DOCUMENT>\s*\n<TYPE>10-K\b.*') ELSE content END"""


@query("extract_main_document", W([], f"SELECT page_id, length(m) AS chars, md5(m) AS text_md5 FROM (SELECT page_id, {MAIN} AS m FROM raw)", RAW))
def extract_main_document(spark, sf):
    m = raw_filings(spark, sf).select("page_id", markup.main_document(F.col("content")).alias("m"))
    return m.select("page_id", F.length("m").cast("long").alias("chars"), F.md5("m").alias("text_md5"))


def decoded(x: str) -> str:
    from .. import fixed

    for old, new in fixed.HTML_ENTITIES + fixed.CLEAN_ENTITIES[:6]:
        x = f"replace({x}, '{old}', {'chr(39)' if new == chr(39) else chr(39) + new + chr(39)})"
    return x


VISIBLE = MAIN
for _tag in ("script", "style", "head"):
    VISIBLE = f"regexp_replace({VISIBLE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', chr(1), 'g')"
VISIBLE = f"regexp_replace({VISIBLE}, '(?s)<!--.*?-->', chr(1), 'g')"
TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
TEXTED = f"""{RAW}, vis AS (SELECT page_id, {VISIBLE} AS h FROM raw),
seg AS (SELECT page_id, string_split_regex(h, '(?is)<table\\b.*?</table\\s*>') AS s, regexp_extract_all(h, '(?is)<table\\b.*?</table\\s*>') AS t FROM vis),
fl AS (SELECT *, list_transform(t, lambda x: contains(x, '<th>')) AS f FROM seg),
jo AS (SELECT page_id, len(list_filter(f, lambda x: x)) AS n, array_to_string(list_transform(s, lambda x, i: x || CASE WHEN i > len(t) THEN '' WHEN f[i] THEN CASE WHEN contains(t[i], 'outer note') THEN '<table><tr><td>outer note' ELSE '' END
  || chr(1) || '%%TABLE_' || len(list_filter(f[1:i - 1], lambda z: z)) || '%%' || chr(1) ELSE t[i] END), '') AS j FROM fl),
nd AS (SELECT page_id, n, list_filter(list_transform(string_split(regexp_replace(j, '<[^>]+>', chr(1), 'g'), chr(1)), lambda x: {TRIMMED.format(decoded('x'))}), lambda x: x <> '') AS l FROM jo)"""


@query("extract_html_text", W([], "SELECT page_id, CAST(n AS INTEGER) AS table_count, md5(regexp_replace(regexp_replace(array_to_string(l, ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS text_md5 FROM nd", TEXTED))
def extract_html_text(spark, sf):
    p = g.parse_filings(raw_filings(spark, sf))
    return p.select("page_id", "table_count", F.md5("text_content").alias("text_md5"))


@query("extract_html_tables", """WITH t AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS ti FROM (SELECT page_id, unnest(CASE WHEN page_id % 7 = 0 THEN [1, 2, 9] ELSE [1, 2] END) AS k FROM pages)
    WHERE k = 9 OR page_id % 3 >= k)
  SELECT page_id, CAST(ti AS INTEGER) AS table_index, CAST(r AS INTEGER) AS row_index, CASE r WHEN 0 THEN 'Line Item;2024;' WHEN 1 THEN 'Revenue & other;$ ' || (page_id * 1000 + k) || ';' ELSE 'Net income;(12);5%' END AS cells FROM t, (SELECT unnest([0, 1, 2]) AS r)""")
def extract_html_tables(spark, sf):
    return g.table_rows(raw_filings(spark, sf), "page_id").select("page_id", "table_index", "row_index", F.array_join("cells", ";").alias("cells"))


@query("html_tables_markdown", """WITH t AS (SELECT page_id, k FROM (SELECT page_id, unnest(CASE WHEN page_id % 7 = 0 THEN [1, 2, 9] ELSE [1, 2] END) AS k FROM pages) WHERE k = 9 OR page_id % 3 >= k)
  SELECT page_id, count(*) AS tables, md5(string_agg('| Line Item | 2024 | Unnamed: 2 |' || chr(10) || '|:---|:---|:---|' || chr(10) || '| Revenue & other | $ ' || (page_id * 1000 + k) || ' | nan |' || chr(10) || '| Net income | (12) | 5% |', chr(10) ORDER BY k)) AS text_md5 FROM t GROUP BY page_id""")
def html_tables_markdown(spark, sf):
    p = g.parse_filings(raw_filings(spark, sf)).where("table_count > 0")
    return p.select("page_id", F.col("table_count").cast("long").alias("tables"), F.md5(F.array_join("tables", "\n")).alias("text_md5"))


SPANNED = (
    "<table><tr><th rowspan=2>Segment</th><th colspan='2'>2024 &amp; 2023</th></tr><tr><th>Q&#49;</th><th>Q&#x32;</th></tr>"
    "<tr><td rowspan=\"3\">page ", "</td><td>&#36;391,035</td><td rowspan=2>&#8226; both</td></tr><tr><td colspan=2>wide</td></tr><tr><td>1</td><td>2</td></tr></table>")


@query("html_table_grid", """WITH p AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS r, 'page ' || page_id AS name FROM pages)
  SELECT page_id, CAST(r AS INTEGER) AS row_index, CASE r WHEN 0 THEN 'Segment;2024 & 2023;2024 & 2023' WHEN 1 THEN 'Segment;Q1;Q2' WHEN 2 THEN name || ';$391,035;• both'
    WHEN 3 THEN name || ';wide;wide;• both' ELSE name || ';1;2' END AS cells FROM p""")
def html_table_grid(spark, sf):
    """A table on each page whose cells span rows and columns, some across each other."""
    i = F.col("page_id").cast("string")
    pages = d.table(spark, sf, "pages").select("page_id", F.concat(F.lit(SPANNED[0]), i, F.lit(SPANNED[1])).alias("content"))
    return g.table_rows(pages, "page_id").select("page_id", "row_index", F.array_join("cells", ";").alias("cells"))


# --- text with pipe tables ---------------------------------------------------
def mixed_text(spark, sf):
    """Documents with pipe tables, footnotes, headers and placeholders."""
    t = F.col("text")
    body = F.concat(
        F.lit("Intro\n"), t, F.lit("\nItem 7. Discussion of results  \n| a   | 1 |\n| b | (2) |\n(1) restated\n[2] more\nplain line "), F.col("source"),
        F.lit("\n| lone | row |\nnot a note\nPart II\n%%TABLE_1%% x\nItem 1A. Risk Factors  text %%TABLE_0%%\n"), t, F.lit("\n| c | 3 |"))
    return d.table(spark, sf, "documents").select("doc_id", "source", body.alias("body"), t)


MIXED = """mix AS (SELECT doc_id, source, text, 'Intro' || chr(10) || text || chr(10) || 'Item 7. Discussion of results  ' || chr(10) || '| a   | 1 |' || chr(10) || '| b | (2) |' || chr(10) || '(1) restated' || chr(10) || '[2] more' || chr(10) || 'plain line ' || source
  || chr(10) || '| lone | row |' || chr(10) || 'not a note' || chr(10) || 'Part II' || chr(10) || '%%TABLE_1%% x' || chr(10) || 'Item 1A. Risk Factors  text %%TABLE_0%%' || chr(10) || text || chr(10) || '| c | 3 |' AS body FROM documents)"""
LINES = """ln AS (SELECT doc_id, i, l, starts_with(trim(l, ' ' || chr(9) || chr(13)), '|') AND ends_with(trim(l, ' ' || chr(9) || chr(13)), '|') AND length(trim(l, ' ' || chr(9) || chr(13))) > 2 AS t FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM mix)),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS grp FROM ln)"""


@query("split_markdown_tables", W([], """SELECT doc_id, count(*) AS tables, md5(string_agg(txt, '#' ORDER BY at_)) AS tables_md5, any_value(rest) AS rest_md5 FROM (SELECT doc_id, grp, min(i) AS at_, string_agg(l, chr(10) ORDER BY i) AS txt FROM run WHERE t GROUP BY doc_id, grp)
    JOIN (SELECT doc_id, md5(string_agg(l, chr(10) ORDER BY i)) AS rest FROM ln WHERE NOT t GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""", MIXED + ",\n" + LINES))
def split_markdown_tables(spark, sf):
    s = g.split_markdown_tables(mixed_text(spark, sf), "body")
    return s.select("doc_id", F.size("md_tables").cast("long").alias("tables"), F.md5(F.array_join("md_tables", "#")).alias("tables_md5"), F.md5("rest").alias("rest_md5"))


def dirty_text(spark, sf):
    """Documents with markup, boilerplate, spaced figures and a table."""
    body = F.concat(
        F.lit('<p style="color:red">Filed on: 2024 by agent</p> Revenue was $ 1,234  M  and (5,000)\tor 12.5 %\n'), F.col("text"),
        F.lit("\n| a   | 1  |\n| b <i> | (2)   |\n\n\n\nEDGAR Filing by xyz\nend &amp; done   now  "))
    return d.table(spark, sf, "documents").select("doc_id", body.alias("body"))


@query("clean_financial_text")
def clean_financial_text(spark, sf):
    c = g.clean_financial_text(dirty_text(spark, sf), "body")
    return c.select("doc_id", F.length("clean_text").alias("chars"), F.md5("clean_text").alias("text_md5"))


# --- metadata ----------------------------------------------------------------
@query("extract_metadata", W([], r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'MSFT' ELSE CASE page_id % 3 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'MSFT' ELSE 'UNKNOWN' END END AS ticker,
    CASE page_id % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2021' WHEN 2 THEN '2022' ELSE 'UNKNOWN' END AS fiscal_year,
    CASE WHEN page_id % 4 < 2 THEN '10-K' ELSE coalesce(nullif(upper(regexp_extract(substr(content, 1, 5000), '(?i)<TYPE>\s*(10-K/A|10-Q/A|8-K/A|10-K|10-Q|8-K|S-1|DEF\s*14A)', 1)), ''), 'UNKNOWN') END AS doc_type,
    regexp_extract(path, '([^/]*)$', 1) AS source_file, CASE WHEN len(list_distinct(list_concat(regexp_extract_all(path, '(?:^|/)(\d{10}-\d{2}-\d{6})(?:/|$)', 1), regexp_extract_all(content, '(?i)ACCESSION\s+NUMBER\s*:\s*(\d{10}-\d{2}-\d{6})', 1)))) = 1
      THEN list_concat(regexp_extract_all(path, '(?:^|/)(\d{10}-\d{2}-\d{6})(?:/|$)', 1), regexp_extract_all(content, '(?i)ACCESSION\s+NUMBER\s*:\s*(\d{10}-\d{2}-\d{6})', 1))[1] END AS source_id FROM raw""", RAW))
def extract_metadata(spark, sf):
    return g.extract_metadata(raw_filings(spark, sf)).select("page_id", "ticker", "fiscal_year", "doc_type", "source_file", "source_id")


def section_sql(text: str) -> str:
    from .. import fixed

    cases = " ".join("WHEN regexp_matches({}, '(?i){}') THEN '{}'".format(text, p.replace("'", "''"), n.replace("'", "''")) for p, n in fixed.SECTION_PATTERNS)
    return f"CASE {cases} ELSE 'General' END"


HEADS = ["Item 1A. Risk Factors", "Item 7: Management's Discussion", "part iv", "Item 5. x Market y", "plain |a|b| text", "item 9A: Controls"]


@query("identify_section", W([], f"SELECT doc_id, {section_sql('t')} AS section, regexp_matches(t, '\\|.*\\|.*\\|') AS contains_table FROM (SELECT doc_id, {d._pick(HEADS, f'doc_id % {len(HEADS)}')} || chr(10) || text AS t FROM documents)"))
def identify_section(spark, sf):
    h = F.element_at(F.array(*[F.lit(x) for x in HEADS]), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    docs = d.table(spark, sf, "documents").select("doc_id", F.lit("").alias("path"), F.lit("").alias("content"), F.concat(h, F.lit("\n"), "text").alias("chunk"))
    return g.extract_metadata(docs, chunk_text="chunk").select("doc_id", "section", "contains_table")


# --- sections and chunks -----------------------------------------------------
@query("split_sections", W([], r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_no, coalesce(nullif(substr(regexp_replace(coalesce(nullif(regexp_extract(h, '(?is)^Part\s+(?:I{1,3}V?|IV)\b'), ''), regexp_extract(h, '(?i)(Item\s+\d+[A-Z]?[:.]\s+[^\n]+?)(?:\s{2,}|\n?$)', 1)), '^\s+|\s+$', '', 'g'), 1, 80), ''), 'General') AS section,
    length(p) AS chars FROM (SELECT doc_id, i, p, substr(p, 1, 300) AS h FROM (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS p FROM (
      SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(body, '(?i)(Item\s+\d+[A-Z]?[\:\.]\s|Part\s+(?:I{1,3}V?|IV)\b)', chr(1) || '\1', 'g'), chr(1)) AS l FROM mix))) WHERE p <> '')""", MIXED))
def split_sections(spark, sf):
    s = mixed_text(spark, sf).select("doc_id", F.posexplode(g.split_sections(F.col("body"))).alias("section_no", "s"))
    return s.select("doc_id", "section_no", F.col("s.section").alias("section"), F.length("s.text").cast("long").alias("chars"))


@query("assign_table_section", "SELECT doc_id, n AS table_index, CASE n WHEN 1 THEN 'Part II' ELSE 'Item 1A. Risk Factors' END AS section FROM documents, (SELECT unnest([0, 1]) AS n)")
def assign_table_section(spark, sf):
    p = g.placeholder_sections(mixed_text(spark, sf), "body").select("doc_id", F.explode("placeholders").alias("p"))
    return p.select("doc_id", "p.table_index", "p.section")


@query("extract_table_chunks", """SELECT doc_id, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN 'Item 7. Discussion of results' WHEN 1 THEN 'Item 7. Discussion of results' ELSE 'Item 1A. Risk Factors' END AS section,
    CASE n WHEN 0 THEN '| a   | 1 |;| b | (2) |;(1) restated;[2] more' WHEN 1 THEN '| lone | row |' ELSE '| c | 3 |' END AS chunk FROM documents, (SELECT unnest([0, 1, 2]) AS n)""")
def extract_table_chunks(spark, sf):
    p = g.table_chunks_in_text(mixed_text(spark, sf), "body").select("doc_id", F.posexplode(F.filter("pieces", lambda x: x["table"].isNotNull())).alias("n", "p"))
    return p.select("doc_id", "n", F.col("p.section").alias("section"), F.replace("p.table", F.lit("\n"), F.lit(";")).alias("chunk"))


@query("chunk_text_bounded")
def chunk_text_bounded(spark, sf):
    c = g.chunk_text_bounded(d.table(spark, sf, "documents"), "text")
    return c.select("doc_id", F.posexplode("chunks").alias("n", "chunk")).select("doc_id", "n", estimate_tokens(F.col("chunk")).alias("tokens"), F.md5("chunk").alias("chunk_md5"))


@query("count_tokens", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def count_tokens(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("make_chunk_id", W(["text_chunks"], "SELECT doc_id, chunk_id FROM text_chunks"))
def make_chunk_id(spark, sf):
    return d.text_chunks(spark, sf).select("doc_id", "chunk_id")


@query("chunk_corpus")
def chunk_corpus(spark, sf):
    """Files to chunks in one pass: parse, metadata, clean, chunk."""
    p = g.parse_filings(raw_filings(spark, sf))
    p = g.clean_financial_text(g.extract_metadata(p), "text_content")
    docs = p.select("page_id", "ticker", "fiscal_year", "doc_type", F.concat(F.col("page_id").cast("string"), F.lit("-"), "source_file").alias("source_file"), F.col("clean_text").alias("text_content"), "tables")
    return g.chunk_corpus(docs).select("page_id", "chunk_id", "chunk_type", "section", "token_count")


# --- placeholders ------------------------------------------------------------
CUT = "greatest(0, least(coalesce(length(substr(t{0}.raw_text, 1, 200)), 0), {1}))"
NEWTEXT = "CASE WHEN {k} > 0 THEN chr(10) || '[TABLE ' || {n} || ']' || chr(10) || substr(t{i}.raw_text, 1, CAST({k} AS BIGINT)) ELSE '%%TABLE_' || {n} || '%%' END"
K1 = CUT.format(1, 300)
K2 = CUT.format(2, "300 - coalesce(length(substr(t1.raw_text, 1, 200)), 0)")


@query("resolve_table_placeholders", W(["text_chunks", "table_chunks"], f"""SELECT c.chunk_id, md5(c.raw_text || ' ' || {NEWTEXT.format(k=K1, n='(doc_id % 7)', i=1)} || ' and ' || {NEWTEXT.format(k=K2, n='(doc_id % 3)', i=2)} || ' end') AS text_md5
    FROM text_chunks c LEFT JOIN table_chunks t1 ON t1.source_file = c.source_file AND t1.ticker = c.ticker AND t1.fiscal_year = c.fiscal_year AND t1.table_index = doc_id % 7
    LEFT JOIN table_chunks t2 ON t2.source_file = c.source_file AND t2.ticker = c.ticker AND t2.fiscal_year = c.fiscal_year AND t2.table_index = doc_id % 3"""))
def resolve_table_placeholders(spark, sf):
    out = g.resolve_table_placeholders(d.placed_chunks(spark, sf), d.table_chunks(spark, sf), 200, 300)
    return out.select("chunk_id", F.md5("raw_text").alias("text_md5"))


REFS = "refs AS (SELECT ticker, fiscal_year, source_file, unnest([doc_id % 7, doc_id % 3]) AS n FROM text_chunks)"


@query("placeholder_alignment", W(["text_chunks", "table_chunks"], """SELECT r.ticker, r.fiscal_year, r.source_file, count(*) AS refs, count(t.chunk_id) AS resolved, count(*) - count(t.chunk_id) AS unresolved FROM refs r
    LEFT JOIN table_chunks t ON t.ticker = r.ticker AND t.fiscal_year = r.fiscal_year AND t.source_file = r.source_file AND t.table_index = r.n GROUP BY ALL""", REFS))
def placeholder_alignment(spark, sf):
    return g.placeholder_alignment(d.placed_chunks(spark, sf), d.table_chunks(spark, sf))


@query("orphan_tables", W(["text_chunks", "tables_with_spares"], """SELECT chunk_id, ticker, fiscal_year, source_file FROM tables_with_spares t WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE t.ticker = r.ticker AND t.fiscal_year = r.fiscal_year AND t.source_file = r.source_file AND t.table_index = r.n)""", REFS))
def orphan_tables(spark, sf):
    return g.orphan_tables(d.placed_chunks(spark, sf), d.tables_with_spares(spark, sf))


@query("table_size_stats", W(["table_chunks"], "SELECT count(*) AS tables, min(length(raw_text)) AS min_chars, max(length(raw_text)) AS max_chars, count(*) FILTER (length(raw_text) > 250) AS over_cap, median(length(raw_text))::DOUBLE AS median_chars FROM table_chunks"))
def table_size_stats(spark, sf):
    t = g.table_size_stats(d.table_chunks(spark, sf), 250)
    return t.select("tables", F.col("min_chars").cast("long").alias("min_chars"), F.col("max_chars").cast("long").alias("max_chars"), "over_cap", "median_chars")
