"""Store and consistency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as c
from ..operators import dense, stores
from ..session import shared_folder
from ..sources import derived as d
from ..sources import filings
from ..sources.snapshots import SnapshotStore
from .registry import query

W = d.sql_with


# --- scans -------------------------------------------------------------------
@query("scan_filings", """SELECT page_id, 'AAPL' AS ticker, length(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) AS chars FROM pages WHERE length(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) >= 200""")
def scan_filings(spark, sf):
    """Pages written as filing files, then read back with path metadata."""
    root = shared_folder(spark, "filings")
    pages = d.table(spark, sf, "pages").select(
        F.concat(F.lit("AAPL/10-K/2024/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    filings.write_filings(pages, root)
    docs = filings.scan_filings(spark, root)
    return docs.select(F.regexp_extract("source_file", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "ticker", F.length("content").cast("long").alias("chars"))


@query("scan_chunks_filtered", W(["corpus"], "SELECT chunk_id, section FROM corpus WHERE ticker = 'MSFT' AND fiscal_year = '2022' AND section = 'Item 7: MD&A'"))
def scan_chunks_filtered(spark, sf):
    return stores.scan_chunks_filtered(d.corpus(spark, sf), " msft", None, 2022, "Item 7: MD&A").select("chunk_id", "section")


@query("lookup_chunks_by_id", W(["chunk_store", "vector_store"], "SELECT chunk_id, source_id FROM chunk_store WHERE chunk_id IN (SELECT chunk_id FROM vector_store)"))
def lookup_chunks_by_id(spark, sf):
    return stores.lookup_by_id(d.chunk_store(spark, sf), d.vector_store(spark, sf)).select("chunk_id", "source_id")


@query("scan_by_source_id", W(["text_chunks", "vector_store"], "SELECT chunk_id, source_id FROM text_chunks WHERE source_id <> 'UNKNOWN' AND source_id IN (SELECT source_id FROM vector_store)"))
def scan_by_source_id(spark, sf):
    return stores.scan_by_source_id(d.text_chunks(spark, sf), d.vector_store(spark, sf)).select("chunk_id", "source_id")


@query("full_scan", W(["chunk_store"], "SELECT chunk_id, source_id, ticker FROM chunk_store"))
def full_scan(spark, sf):
    store = SnapshotStore(spark, shared_folder(spark, "store"), ["seq"])
    store.replace(d.chunk_store(spark, sf))
    return store.read().select("chunk_id", "source_id", "ticker")


INCOMING = """inc AS (SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'en' END AS section, 'new' AS source_file FROM text_chunks WHERE lang = 'en'
  UNION ALL SELECT 'bench-' || item_id, NULL, 'bench' FROM benchmark)"""


def incoming_rows(spark, sf):
    t = d.text_chunks(spark, sf)
    new = t.where("lang = 'en'").select("chunk_id", F.when(F.col("doc_id") % 2 == 0, "en").alias("section"), F.lit("new").alias("source_file"))
    extra = d.table(spark, sf, "benchmark").select(
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("chunk_id"), F.lit(None).cast("string").alias("section"), F.lit("bench").alias("source_file"))
    return new.unionByName(extra)


@query("upsert_chunks", W(["text_chunks"], "SELECT chunk_id, coalesce(i.section, t.section) AS section, coalesce(i.source_file, t.source_file) AS source_file, t.ticker FROM text_chunks t FULL JOIN inc i USING (chunk_id)", INCOMING))
def upsert_chunks(spark, sf):
    """Merge into a versioned store and read the new version."""
    store = SnapshotStore(spark, shared_folder(spark, "chunks"), ["chunk_id"])
    store.replace(d.text_chunks(spark, sf).select("chunk_id", "section", "source_file", "ticker"))
    store.upsert(incoming_rows(spark, sf))
    return store.read().select("chunk_id", "section", "source_file", "ticker")


@query("upsert_vectors", """SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'L' || label ELSE 'UNKNOWN' END AS ticker, CASE WHEN label % 3 = 0 THEN 'S' ELSE 'General' END AS section, label >= 5 AS contains_table, 64 AS dims FROM embeddings""")
def upsert_vectors(spark, sf):
    v = d.table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") % 2 == 0, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("ticker"),
        F.when(F.col("label") % 3 == 0, "S").alias("section"), F.when(F.col("label") >= 5, True).alias("contains_table"), "embedding")
    half = v.withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    merged = stores.upsert(dense.upsert_defaults(half), dense.upsert_defaults(v), ["vec_id"])
    return merged.select("vec_id", "ticker", "section", "contains_table", F.size("embedding").alias("dims"))


@query("delete_stale", W(["text_chunks", "vector_store"], "SELECT chunk_id FROM text_chunks t WHERE NOT EXISTS (SELECT 1 FROM vector_store v WHERE v.chunk_id = t.chunk_id AND v.source_id = t.source_id)"))
def delete_stale(spark, sf):
    return stores.delete_stale(d.text_chunks(spark, sf), d.vector_store(spark, sf)).select("chunk_id")


@query("ingestion_metrics", W(["corpus"], "SELECT count(*) AS total_chunks, count(*) FILTER (chunk_type = 'text') AS text_chunks, count(*) FILTER (chunk_type = 'table') AS table_chunks FROM corpus"))
def ingestion_metrics(spark, sf):
    return stores.ingestion_metrics(d.corpus(spark, sf))


@query("store_stats", W(["text_chunks", "vector_store"], """SELECT coalesce(ticker, 'TOTAL') AS ticker, CAST(sum(a) AS BIGINT) AS chunks, CAST(sum(b) AS BIGINT) AS vectors FROM (SELECT ticker, 1 AS a, 0 AS b FROM text_chunks UNION ALL SELECT ticker, 0, 1 FROM vector_store) GROUP BY ROLLUP (ticker)"""))
def store_stats(spark, sf):
    return stores.store_stats(d.text_chunks(spark, sf), d.vector_store(spark, sf))


# --- consistency -------------------------------------------------------------
IDX = """ia AS (SELECT chunk_id, arg_max({'ticker': ticker, 'fiscal_year': fiscal_year, 'doc_type': doc_type, 'source_id': source_id}, seq) AS a FROM chunk_store WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
ib AS (SELECT chunk_id, arg_max({'ticker': ticker, 'fiscal_year': fiscal_year, 'doc_type': doc_type, 'source_id': source_id}, seq) AS b FROM vector_store WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
pair AS (SELECT chunk_id, a, b FROM ia FULL JOIN ib USING (chunk_id)),
confl AS (SELECT a.source_id AS source_id, count(DISTINCT a.ticker || '|' || a.fiscal_year || '|' || a.doc_type) AS variants, array_to_string(list_sort(list(DISTINCT a.ticker || '|' || a.fiscal_year || '|' || a.doc_type)), ';') AS keys FROM ia WHERE a.source_id IS NOT NULL AND a.source_id <> 'UNKNOWN' GROUP BY a.source_id HAVING variants > 1),
mis AS (SELECT chunk_id, a.source_id AS a_source_id, b.source_id AS b_source_id FROM pair WHERE a IS NOT NULL AND b IS NOT NULL AND a.source_id <> b.source_id),
prov AS (SELECT upper(trim(ticker)) AS pt, trim(fiscal_year) AS py, upper(doc_type) AS pd, count(DISTINCT source_id) AS cand, min(source_id) AS sid FROM provenance GROUP BY ALL),
leg AS (SELECT chunk_id, 'a' AS store, a AS own, b.source_id AS other FROM pair WHERE a IS NOT NULL AND (a.source_id IS NULL OR a.source_id = 'UNKNOWN')
  UNION ALL SELECT chunk_id, 'b', b, a.source_id FROM pair WHERE b IS NOT NULL AND (b.source_id IS NULL OR b.source_id = 'UNKNOWN')),
back AS (SELECT chunk_id, store, CASE WHEN okey THEN 'confirmed' WHEN cand IS NULL THEN 'uncertain' WHEN cand = 1 THEN 'confirmed' ELSE 'ambiguous' END AS status,
  CASE WHEN okey THEN 'other_store_keyed' WHEN cand IS NULL THEN 'no_provenance' WHEN cand = 1 THEN 'provenance_map' ELSE 'ambiguous_provenance' END AS reason,
  CASE WHEN okey THEN other WHEN cand = 1 THEN sid END AS source_id FROM (SELECT *, other IS NOT NULL AND other <> 'UNKNOWN' AS okey FROM leg LEFT JOIN prov ON pt = upper(own.ticker) AND py = own.fiscal_year AND pd = own.doc_type))"""
S = ["chunk_store", "vector_store", "provenance"]


def a(spark, sf):
    return d.chunk_store(spark, sf)


def b(spark, sf):
    return d.vector_store(spark, sf)


@query("reconcile_presence", W(S, """SELECT CASE WHEN a IS NULL THEN 'b_only' WHEN b IS NULL THEN 'a_only' ELSE 'paired' END AS category, count(*) AS n FROM pair GROUP BY ALL
  UNION ALL SELECT 'a_missing_key', count(*) FILTER (chunk_id IS NULL) FROM chunk_store UNION ALL SELECT 'a_duplicate_key', count(chunk_id) - count(DISTINCT chunk_id) FROM chunk_store
  UNION ALL SELECT 'b_missing_key', count(*) FILTER (chunk_id IS NULL) FROM vector_store UNION ALL SELECT 'b_duplicate_key', count(chunk_id) - count(DISTINCT chunk_id) FROM vector_store""", IDX))
def reconcile_presence(spark, sf):
    return c.reconcile_presence(a(spark, sf), b(spark, sf))


@query("reconcile_identity", W(S, """SELECT 'a' AS store, count(*) FILTER (a.source_id IS NOT NULL AND a.source_id <> 'UNKNOWN') AS keyed, count(*) FILTER (a.source_id IS NULL OR a.source_id = 'UNKNOWN') AS legacy FROM ia
  UNION ALL SELECT 'b', count(*) FILTER (b.source_id IS NOT NULL AND b.source_id <> 'UNKNOWN'), count(*) FILTER (b.source_id IS NULL OR b.source_id = 'UNKNOWN') FROM ib""", IDX))
def reconcile_identity(spark, sf):
    return c.reconcile_identity(a(spark, sf), b(spark, sf))


def conflicted(spark, sf):
    """Store A with a second fiscal year planted into some filings."""
    return a(spark, sf).withColumn("fiscal_year", F.when(F.col("seq") % 45 == 1, "1999").otherwise(F.col("fiscal_year")))


CONFL = "chunk_store2 AS (SELECT * REPLACE (CASE WHEN seq % 45 = 1 THEN '1999' ELSE fiscal_year END AS fiscal_year) FROM chunk_store),\n" + IDX.replace("FROM chunk_store ", "FROM chunk_store2 ")


@query("source_metadata_conflicts", W(S, "SELECT source_id, variants, keys FROM confl", CONFL))
def source_metadata_conflicts(spark, sf):
    return c.source_metadata_conflicts(conflicted(spark, sf)).select("source_id", "variants", F.array_join("keys", ";").alias("keys"))


@query("source_id_mismatch", W(S, "SELECT * FROM mis", IDX))
def source_id_mismatch(spark, sf):
    return c.source_id_mismatch(a(spark, sf), b(spark, sf))


@query("normalize_provenance", W(S, "SELECT pt AS p_ticker, py AS p_year, pd AS p_type, cand AS candidates, sid AS source_id FROM prov", IDX))
def normalize_provenance(spark, sf):
    return c.normalize_provenance(d.provenance(spark, sf))


@query("backfill_assessment", W(S, "SELECT * FROM back", IDX))
def backfill_assessment(spark, sf):
    return c.backfill_assessment(a(spark, sf), b(spark, sf), d.provenance(spark, sf))


@query("proposed_actions", W(S, """SELECT CASE WHEN category = 'confirmed' THEN 'REVIEW' WHEN category IN ('uncertain', 'ambiguous') THEN 'ESCALATE' ELSE 'INVESTIGATE' END AS action, category, n FROM (
  SELECT status AS category, count(*) AS n FROM back GROUP BY ALL UNION ALL SELECT 'a_only', count(*) FROM pair WHERE b IS NULL UNION ALL SELECT 'b_only', count(*) FROM pair WHERE a IS NULL
  UNION ALL SELECT 'metadata_conflict', count(*) FROM confl UNION ALL SELECT 'source_id_mismatch', count(*) FROM mis) WHERE n > 0""", CONFL))
def proposed_actions(spark, sf):
    return c.proposed_actions(conflicted(spark, sf), b(spark, sf), d.provenance(spark, sf))


@query("store_parity", W(S, "SELECT a_rows, b_rows, CASE WHEN a_rows = b_rows THEN 'ok(' || a_rows || ')' ELSE 'drift(' || (a_rows - b_rows) || ')' END AS parity FROM (SELECT (SELECT count(*) FROM chunk_store) AS a_rows, (SELECT count(*) FROM vector_store) AS b_rows)"))
def store_parity(spark, sf):
    return c.store_parity(a(spark, sf), b(spark, sf))


def incoming_filings(spark, sf):
    """New versions of filings: every third chunk gone, new ones added, some
    metadata changed, some vectors missing, one identity repeated."""
    t = d.text_chunks(spark, sf)
    kept = t.where("doc_id % 3 <> 0").select(
        "chunk_id", "source_id", "ticker", F.when(F.col("entity") == 4, "1998").otherwise(F.col("fiscal_year")).alias("fiscal_year"), "doc_type",
        F.when((F.col("entity") != 6) | (F.col("doc_id") % 2 == 0), F.array(F.lit(1.0))).alias("embedding"))
    again = kept.where("source_id like '0000000008-%'")
    new = t.where("doc_id % 10 = 3").select(F.concat(F.lit("new-"), "chunk_id").alias("chunk_id"), "source_id", "ticker",
                                            F.when(F.col("entity") == 4, "1998").otherwise(F.col("fiscal_year")).alias("fiscal_year"), "doc_type", F.array(F.lit(1.0)).alias("embedding"))
    return kept.unionByName(again).unionByName(new)


INC2 = """inc0 AS (SELECT chunk_id, source_id, ticker, CASE WHEN entity = 4 THEN '1998' ELSE fiscal_year END AS fiscal_year, doc_type, entity <> 6 OR doc_id % 2 = 0 AS vec FROM text_chunks WHERE doc_id % 3 <> 0),
inc AS (SELECT * FROM inc0 UNION ALL SELECT * FROM inc0 WHERE source_id LIKE '0000000008-%' UNION ALL SELECT 'new-' || chunk_id, source_id, ticker, CASE WHEN entity = 4 THEN '1998' ELSE fiscal_year END, doc_type, TRUE FROM text_chunks WHERE doc_id % 10 = 3),
gate AS (SELECT i.source_id, bool_or(t.source_id IS NOT NULL AND t.fiscal_year <> i.fy) AS conflict FROM (SELECT source_id, min(fiscal_year) AS fy FROM inc GROUP BY source_id) i
  LEFT JOIN text_chunks t ON t.source_id = i.source_id AND i.source_id <> 'UNKNOWN' WHERE i.source_id IS NOT NULL GROUP BY i.source_id),
chk AS (SELECT i.source_id, chunks, CASE WHEN i.source_id IS NULL OR i.source_id = 'UNKNOWN' THEN 'bad_identity' WHEN vecs <> chunks THEN 'vector_count' WHEN ids <> chunks THEN 'duplicate_ids' WHEN conflict THEN 'metadata_conflict' ELSE 'accept' END AS verdict
  FROM (SELECT source_id, count(*) AS chunks, count(DISTINCT chunk_id) AS ids, count(*) FILTER (vec) AS vecs FROM inc GROUP BY source_id) i LEFT JOIN gate g ON g.source_id = i.source_id),
acc AS (SELECT DISTINCT source_id, chunk_id FROM inc WHERE source_id IN (SELECT source_id FROM chk WHERE verdict = 'accept'))"""


@query("metadata_conflict_gate", W(["text_chunks"], "SELECT source_id, conflict FROM gate", INC2))
def metadata_conflict_gate(spark, sf):
    return c.metadata_conflict_gate(d.text_chunks(spark, sf), incoming_filings(spark, sf).where("source_id is not null"))


@query("stale_ids", W(["text_chunks"], """SELECT source_id, count(w) AS expected, count(*) FILTER (w IS NULL) AS stale, count(*) FILTER (h IS NULL) AS missing, count(*) FILTER (w IS NULL OR h IS NULL) = 0 AS converged FROM (
  SELECT source_id, chunk_id, 1 AS w FROM (SELECT DISTINCT source_id, chunk_id FROM inc WHERE source_id IS NOT NULL)) FULL JOIN (SELECT DISTINCT source_id, chunk_id, 1 AS h FROM text_chunks WHERE source_id <> 'UNKNOWN' AND source_id IN (SELECT source_id FROM inc)) USING (source_id, chunk_id) GROUP BY source_id""", INC2))
def stale_ids(spark, sf):
    return c.stale_ids(d.text_chunks(spark, sf), incoming_filings(spark, sf).where("source_id is not null"))


@query("replace_source", W(["text_chunks"], """SELECT source_id, verdict, chunks, coalesce(ra, 0) AS removed_a, coalesce(rb, 0) AS removed_b, verdict = 'accept' AS converged FROM chk
  LEFT JOIN (SELECT source_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM acc WHERE acc.chunk_id = t.chunk_id AND acc.source_id = t.source_id)) AS ra, count(*) FILTER (doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM acc WHERE acc.chunk_id = t.chunk_id AND acc.source_id = t.source_id)) AS rb
    FROM text_chunks t WHERE source_id IN (SELECT source_id FROM acc) GROUP BY source_id) USING (source_id)""", INC2))
def replace_source(spark, sf):
    t = d.text_chunks(spark, sf).select("chunk_id", "source_id", "ticker", "fiscal_year", "doc_type", "doc_id")
    store_a, store_b = t.drop("doc_id"), t.where("doc_id % 2 = 0").drop("doc_id").withColumn("embedding", F.array(F.lit(0.0)))
    return c.replace_sources(store_a, store_b, incoming_filings(spark, sf))[2]


@query("replace_source_store", W(["text_chunks"], """SELECT coalesce(source_id, '-') AS source_id, count(*) AS chunks FROM (SELECT source_id, chunk_id FROM acc
  UNION ALL SELECT source_id, chunk_id FROM text_chunks WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM acc)) GROUP BY ALL""", INC2))
def replace_source_store(spark, sf):
    t = d.text_chunks(spark, sf).select("chunk_id", "source_id", "ticker", "fiscal_year", "doc_type")
    new_a = c.replace_sources(t, t.withColumn("embedding", F.array(F.lit(0.0))), incoming_filings(spark, sf))[0]
    return new_a.groupBy(F.coalesce("source_id", F.lit("-")).alias("source_id")).agg(F.count(F.lit(1)).alias("chunks"))
