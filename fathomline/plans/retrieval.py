"""Retrieval queries: tokenising, BM25, vectors, fusion, reranking order."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import tokens
from ..operators import dense, hybrid, postings, rerank, scopes, sparse
from ..session import shared_folder
from ..sources import derived as d
from ..sources.snapshots import SnapshotStore
from ..sources.termstats import IndexedChunks, TermStatistics
from .registry import query



def plans(spark, sf):
    return d.questions(spark, sf)


def embedded_plans(spark, sf):
    return hybrid.embedded(plans(spark, sf), "query_id", "query", ["query", "ticker", "fiscal_year", "section"])


# --- SQL building blocks -----------------------------------------------------
TOK = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)?')"
ADMIT = "(s.ticker IS NULL OR s.ticker = d.ticker) AND (s.fiscal_year IS NULL OR s.fiscal_year = d.fiscal_year) AND (s.section IS NULL OR s.section = d.section)"


def bm25_cte(p: str, corpus: str, q: str) -> str:
    return f"""{p}q AS (SELECT query_id, query, ticker, fiscal_year, section, coalesce(ticker,'*')||'|'||coalesce(fiscal_year,'*')||'|'||coalesce(section,'*') AS scope FROM {q}),
{p}s AS (SELECT DISTINCT scope, ticker, fiscal_year, section FROM {p}q),
{p}sd AS (SELECT scope, chunk_id, tok, len(tok) AS dl FROM {p}s s JOIN (SELECT chunk_id, ticker, fiscal_year, section, {TOK.format('raw_text')} AS tok FROM {corpus}) d ON {ADMIT}),
{p}tot AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM {p}sd GROUP BY scope),
{p}tf AS (SELECT scope, chunk_id, dl, term, count(*) AS tf FROM (SELECT scope, chunk_id, dl, unnest(tok) AS term FROM {p}sd) GROUP BY ALL),
{p}df AS (SELECT scope, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT scope, term, count(*) AS df FROM {p}tf GROUP BY ALL) JOIN {p}tot USING (scope)),
{p}idf AS (SELECT scope, term, df, CASE WHEN raw < 0 THEN 0.25 * avg_raw ELSE raw END AS idf FROM {p}df JOIN (SELECT scope, avg(raw) AS avg_raw FROM {p}df GROUP BY scope) USING (scope)),
{p}qt AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest({TOK.format('query')}) AS term FROM {p}q) GROUP BY ALL),
{p}score AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {p}qt JOIN {p}tf USING (scope, term) JOIN {p}idf USING (scope, term) JOIN {p}tot USING (scope) GROUP BY ALL),
{p}rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {p}score)"""


def vec_cte(p: str, rel: str, key: str, text: str) -> str:
    return f"""{p}b AS (SELECT {key}, b, count(*) AS n FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS b
    FROM (SELECT {key}, unnest({TOK.format(text)}) AS term FROM {rel})) GROUP BY ALL),
{p}v AS (SELECT {key}, b, n / norm AS x FROM {p}b JOIN (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {p}b GROUP BY ALL) USING ({key}))"""


def knn_cte(p: str, q: str) -> str:
    """Dense ranks of question relation ``q`` over ``corpus`` (hashed vectors)."""
    return f"""{vec_cte(p + 'c', 'corpus', 'chunk_id', 'raw_text')},
{vec_cte(p + 'q', q, 'query_id', 'query')},
{p}adm AS (SELECT query_id, chunk_id FROM {q} s JOIN corpus d ON {ADMIT}),
{p}dot AS (SELECT query_id, chunk_id, sum(qv.x * cv.x) AS score FROM {p}adm JOIN {p}qv qv USING (query_id) JOIN {p}cv cv USING (chunk_id, b) GROUP BY ALL),
{p}score AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM {p}adm JOIN (SELECT DISTINCT chunk_id FROM {p}cv) USING (chunk_id)
    JOIN (SELECT DISTINCT query_id FROM {p}qv) USING (query_id) LEFT JOIN {p}dot USING (query_id, chunk_id)),
{p}rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {p}score)"""


SEGMENT_ASK = "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in fixed.SEGMENT_KEYWORDS) + ")"


def hybrid_cte(p: str, q: str, k: int, cand: int = 40) -> str:
    """Relation {p}hits(query_id, chunk_id, rrf_score, dense_score, sparse_score, rank, rescued_table)."""
    return f"""{bm25_cte(p + 'b', 'corpus', q)},
{knn_cte(p + 'k', q)},
{p}seg AS (SELECT * FROM {q} WHERE {SEGMENT_ASK}),
{p}tabs AS (SELECT * FROM corpus WHERE contains_table),
{bm25_cte(p + 't', p + 'tabs', p + 'seg')},
{p}resc AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM {p}tscore WHERE score > 0) WHERE r = 1),
{p}lists AS (SELECT query_id, chunk_id, score, rank, 'dense' AS family FROM {p}krank WHERE rank <= {cand}
  UNION ALL SELECT query_id, chunk_id, score, rank, 'sparse' FROM {p}brank WHERE rank <= {cand}),
{p}rrf AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf, max(CASE WHEN family = 'dense' THEN score END) AS dense_score,
  max(CASE WHEN family = 'sparse' THEN score END) AS sparse_score FROM {p}lists GROUP BY ALL),
{p}boost AS (SELECT query_id, chunk_id, greatest(coalesce(rrf, 0.0), CASE WHEN r.chunk_id IS NOT NULL THEN 0.5 ELSE 0.0 END) AS rrf_score, dense_score, sparse_score
  FROM {p}rrf FULL JOIN (SELECT *, TRUE AS hit FROM {p}resc) r USING (query_id, chunk_id)),
{p}hits AS (SELECT * FROM (SELECT *, rrf_score >= 0.5 AS rescued_table, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, chunk_id) AS rank FROM {p}boost) WHERE rank <= {k})"""


def with_q(body: str, extra: str = "", names: list[str] | None = None) -> str:
    return d.sql_with(names or ["corpus", "questions"], body, extra)


# --- text and sparse ---------------------------------------------------------
@query("tokenize", f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL""")
def tokenize(spark, sf):
    return sparse.tokenize(d.table(spark, sf, "documents"), "doc_id", "text")


@query("bm25_index", d.sql_with([], """SELECT term, df, cf, round(idf, 6) AS idf FROM (SELECT term, df, cf,
    CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM v)""", f"""
n AS (SELECT count(*) AS n FROM documents), t AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents),
v AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, ln(any_value(n) - count(DISTINCT doc_id) + 0.5) - ln(count(DISTINCT doc_id) + 0.5) AS raw FROM t, n GROUP BY term)"""))
def bm25_index(spark, sf):
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("raw_text"))
    return sparse.bm25_index(docs).withColumn("idf", F.round("idf", 6))


CELL = "coalesce(source, '') AS source, coalesce(lang, '') AS lang"


@query("term_statistics_upkeep", f"""SELECT {CELL}, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, source, lang, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL
    UNION ALL SELECT {CELL}, NULL, count(*), coalesce(sum(len({TOK.format('text')})), 0)::BIGINT FROM documents GROUP BY ALL""")
def term_statistics_upkeep(spark, sf):
    """Documents arrive under another source and with their text twice, then as they are and once
    more under a second id; the second ids are deleted. No batch counts more than it changes."""
    root = shared_folder(spark, "statistics")
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("ticker"), F.coalesce("lang", F.lit("")).alias("fiscal_year"), F.lit("").alias("section"), F.col("text").alias("raw_text"))
    early = docs.withColumns({"ticker": F.lit("draft"), "raw_text": F.concat_ws(" ", "raw_text", "raw_text")})
    twice = docs.withColumn("chunk_id", F.explode(F.array("chunk_id", F.concat("chunk_id", F.lit("#copy")))))
    x = IndexedChunks(SnapshotStore(spark, f"{root}/chunks", ["chunk_id"]), TermStatistics(spark, f"{root}/terms"))
    x.upsert(0, early)
    x.upsert(1, twice)
    x.delete(2, twice.where(F.col("chunk_id").endswith("#copy")), ["chunk_id"])
    names = [F.col("ticker").alias("source"), F.col("fiscal_year").alias("lang")]
    terms = x.statistics.terms().select(*names, "term", "df", "cf")
    return terms.unionByName(x.statistics.cells().select(*names, F.lit(None).cast("string").alias("term"), F.col("n").alias("df"), F.col("len").alias("cf")))


@query("bm25_search", with_q("SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM brank WHERE rank <= 40", bm25_cte("b", "corpus", "questions")))
def bm25_search(spark, sf):
    return sparse.bm25_search(d.corpus(spark, sf), plans(spark, sf)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_search_stored", with_q("SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM brank WHERE rank <= 40", bm25_cte("b", "corpus", "questions")))
def bm25_search_stored(spark, sf):
    """The same hits from an index written before."""
    path = shared_folder(spark, "bm25-index")
    postings.build(d.corpus(spark, sf), path)
    return postings.search(spark, path, plans(spark, sf)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("metadata_prefilter", with_q(f"""SELECT query_id, count(d.chunk_id) AS candidates FROM questions s LEFT JOIN corpus d ON {ADMIT} GROUP BY query_id"""))
def metadata_prefilter(spark, sf):
    return scopes.candidate_counts(d.corpus(spark, sf), plans(spark, sf))


@query("scan_chunks_in_tickers", with_q("""SELECT query_id, count(d.chunk_id) AS candidates FROM questions s LEFT JOIN corpus d
    ON d.ticker IN ('AAPL', 'NVDA') AND (s.fiscal_year IS NULL OR s.fiscal_year = d.fiscal_year) AND (s.section IS NULL OR s.section = d.section) GROUP BY query_id"""))
def scan_chunks_in_tickers(spark, sf):
    p = plans(spark, sf).withColumn("tickers", F.array(F.lit("aapl "), F.lit("NVDA")))
    return scopes.candidate_counts(d.corpus(spark, sf), p)


# --- dense -------------------------------------------------------------------
CENTROID = """e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label AS query_id, i, avg(x) AS y FROM e GROUP BY ALL),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id), m AS (SELECT query_id, sqrt(sum(y * y)) AS m FROM c GROUP BY query_id),
s AS (SELECT query_id, e.vec_id, any_value(label) AS label, sum(x * y) / any_value(n.n) / any_value(m.m) AS score
  FROM e JOIN c USING (i) JOIN n USING (vec_id) JOIN m USING (query_id) GROUP BY ALL)"""


def centroids(spark, sf):
    """One question per label: the mean of its vectors."""
    e = d.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("y"))
    packed = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("p"))
    return packed.select(F.col("label").cast("long").alias("query_id"), F.transform("p", lambda s: s["y"]).alias("embedding"))


def label_vectors(spark, sf):
    return d.table(spark, sf, "embeddings").select(
        F.format_string("%08d", "vec_id").alias("chunk_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("ticker"), "embedding")


KNN_OUT = "query_id, printf('%08d', vec_id) AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank, round(score, 6) AS score"


@query("knn_cosine", f"WITH {CENTROID} SELECT * FROM (SELECT {KNN_OUT} FROM s) WHERE rank <= 40")
def knn_cosine(spark, sf):
    hits = dense.knn_hits(label_vectors(spark, sf), centroids(spark, sf), 40)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("knn_cosine_filtered", f"WITH {CENTROID} SELECT * FROM (SELECT {KNN_OUT} FROM s WHERE label = (query_id + 1) % 10) WHERE rank <= 5")
def knn_cosine_filtered(spark, sf):
    q = centroids(spark, sf).withColumn("ticker", F.concat(F.lit(" l"), ((F.col("query_id") + 1) % 10).cast("string")))
    return dense.knn_hits(label_vectors(spark, sf), q, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("knn_enriched", with_q("""SELECT query_id, chunk_id, rank, round(score, 6) AS score, length(raw_text) AS chars FROM krank JOIN text_chunks USING (chunk_id) WHERE rank <= 10""", knn_cte("k", "questions")))
def knn_enriched(spark, sf):
    c = d.corpus(spark, sf)
    hits = dense.knn_hits(hybrid.corpus_vectors(c), embedded_plans(spark, sf), 10)
    text = d.text_chunks(spark, sf).select("chunk_id", "raw_text")
    return hits.join(text, "chunk_id").select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.length("raw_text").cast("long").alias("chars"))


@query("knn_multi_query", with_q("""SELECT * FROM (SELECT plan_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY plan_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM (SELECT query_id // 4 AS plan_id, chunk_id, max(score) AS score FROM krank WHERE rank <= 10 GROUP BY ALL)) WHERE rank <= 10""", knn_cte("k", "questions")))
def knn_multi_query(spark, sf):
    hits = dense.knn_hits(hybrid.corpus_vectors(d.corpus(spark, sf)), embedded_plans(spark, sf), 10)
    hits = hits.withColumn("plan_id", F.floor(F.col("query_id") / 4).cast("long"))
    return dense.max_per_chunk(hits, "plan_id", 10).select("plan_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("embed_batch", d.sql_with([], "SELECT doc_id, count(*) AS buckets, round(max(x), 6) AS top, round(sum(x), 6) AS total FROM ev GROUP BY doc_id", vec_cte("e", "documents", "doc_id", "text")))
def embed_batch(spark, sf):
    e = dense.hashed_tf(d.table(spark, sf, "documents"), "doc_id", "text")
    return e.select(
        "doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), F.round(F.array_max("embedding"), 6).alias("top"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("embed_batch_plugin", """SELECT doc_id, 2 AS dims, round(n / sqrt(n * n + w * w), 4) AS first FROM (SELECT doc_id, CAST(length(text) AS DOUBLE) AS n,
    CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS w FROM documents)""")
def embed_batch_plugin(spark, sf):
    """A user model as plug-in: (characters, blanks + 1) per text."""
    docs = d.table(spark, sf, "documents")
    out = dense.embed_batch(docs, "text", lambda texts: [[float(len(t)), t.count(" ") + 1.0] for t in texts])
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"))


# --- fusion ------------------------------------------------------------------
def lists(spark, sf):
    c = d.corpus(spark, sf)
    q = embedded_plans(spark, sf)
    return hybrid.ranked_lists(dense.knn_hits(hybrid.corpus_vectors(c), q.drop("query"), 40), sparse.bm25_search(c, q.drop("embedding"), 40))


@query("rrf_fuse", with_q("SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score FROM hrrf", hybrid_cte("h", "questions", 40)))
def rrf_fuse(spark, sf):
    return hybrid.rrf_fuse(lists(spark, sf)).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"))


@query("best_family_scores", with_q("SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score FROM hrrf", hybrid_cte("h", "questions", 40)))
def best_family_scores(spark, sf):
    return hybrid.rrf_fuse(lists(spark, sf)).select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"))


@query("rescue_tables", with_q("SELECT query_id, chunk_id FROM hresc", hybrid_cte("h", "questions", 40)))
def rescue_tables(spark, sf):
    return hybrid.rescue_tables(d.corpus(spark, sf), plans(spark, sf)).select("query_id", "chunk_id")


def hybrid_hits(spark, sf):
    c = d.corpus(spark, sf)
    return hybrid.hybrid_search(c, hybrid.corpus_vectors(c), embedded_plans(spark, sf))


HYBRID_OUT = "query_id, chunk_id, rank, round(rrf_score, 6) AS rrf_score, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, rescued_table"


@query("hybrid_search", with_q(f"SELECT {HYBRID_OUT}, length(raw_text) AS chars FROM hhits JOIN corpus USING (chunk_id)", hybrid_cte("h", "questions", 40)))
def hybrid_search(spark, sf):
    return hybrid_hits(spark, sf).select(
        "query_id", "chunk_id", "rank", *[F.round(c, 6).alias(c) for c in ("rrf_score", "dense_score", "sparse_score")], "rescued_table",
        F.length("raw_text").cast("long").alias("chars"))


def comparing_plans(spark, sf):
    return hybrid.embedded(d.comparing(spark, sf), "query_id", "query", ["query", "tickers", "ticker", "fiscal_year", "section"])


# one plan for each distinct company of a question, one of its own scope where it names none
ENTITY_PLANS = f"""cmp AS (SELECT *, CASE WHEN len(tickers) = 0 THEN [ticker] ELSE list_filter(tickers, lambda t, i: list_position(tickers, t) = i) END AS companies FROM comparing),
ent AS (SELECT query_id * {hybrid.STRIDE} + pos AS query_id, query, companies[pos + 1] AS ticker, fiscal_year, section FROM (SELECT *, unnest(range(len(companies))) AS pos FROM cmp))"""


@query("hybrid_search_per_entity", d.sql_with(["corpus", "comparing"], f"""SELECT query_id, chunk_id, rank, rrf_score, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, rescued_table FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM (
      SELECT h.query_id // {hybrid.STRIDE} AS query_id, chunk_id, max(round(rrf_score, 6)) AS rrf_score, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score, bool_or(rescued_table) AS rescued_table
      FROM hhits h JOIN cmp ON cmp.query_id = h.query_id // {hybrid.STRIDE} WHERE h.rank <= greatest(2, 40 // len(companies)) GROUP BY ALL)) WHERE rank <= 40""", ENTITY_PLANS + ",\n" + hybrid_cte("h", "ent", 40)))
def hybrid_search_per_entity(spark, sf):
    c = d.corpus(spark, sf)
    hits = hybrid.hybrid_per_entity(c, hybrid.corpus_vectors(c), comparing_plans(spark, sf), "tickers")
    return hits.select("query_id", "chunk_id", "rank", "rrf_score", F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"), "rescued_table")


def entity_hits(spark, sf, top_k=13):
    c = d.corpus(spark, sf)
    per = hybrid.expand_entities(comparing_plans(spark, sf), "tickers").drop("pos", "entity", "question", "tickers")
    return hybrid.hybrid_search(c, hybrid.corpus_vectors(c), per, top_k=top_k)


@query("balanced_retrieval", d.sql_with(["corpus", "comparing"], f"""SELECT question, chunk_id, ticker_pos, row_number() OVER (PARTITION BY question ORDER BY ticker_pos, rank) AS position FROM (
    SELECT query_id // {hybrid.STRIDE} AS question, chunk_id, CAST(query_id % {hybrid.STRIDE} AS INTEGER) AS ticker_pos, rank, row_number() OVER (PARTITION BY query_id // {hybrid.STRIDE}, chunk_id ORDER BY query_id % {hybrid.STRIDE}, rank) AS r
    FROM hhits WHERE rank <= 3) WHERE r = 1""", ENTITY_PLANS + ",\n" + hybrid_cte("h", "ent", 13)))
def balanced_retrieval(spark, sf):
    return hybrid.balanced_retrieval(entity_hits(spark, sf), hybrid.STRIDE, 3)


# --- reranking and order -----------------------------------------------------
def ranked_cte(p: str, n: int = 8) -> str:
    """Token-overlap rerank of {p}hits: {p}rr(query_id, chunk_id, rerank_score, pos)."""
    return f"""{p}pair AS (SELECT h.query_id, h.chunk_id, h.rank, h.rescued_table, c.raw_text, c.contains_table, c.ticker, c.fiscal_year, c.section,
  list_distinct({TOK.format('q.query')}) AS qt, list_distinct({TOK.format('c.raw_text')}) AS ct FROM {p}hits h JOIN corpus c USING (chunk_id) JOIN questions q USING (query_id)),
{p}sc AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, ct)) / len(qt) END AS rerank_score FROM {p}pair),
{p}rr0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank) AS rrank FROM {p}sc),
{p}rr AS (SELECT * FROM {p}rr0 WHERE rrank <= {n}),
{p}pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rrank <= {n} THEN 1 ELSE 0 END, CASE WHEN rrank <= {n} THEN rrank ELSE rank END) AS pos FROM {p}rr0 WHERE rrank <= {n} OR rescued_table),
{p}cy AS (SELECT *, CASE WHEN (pos - 1) % 2 = 0 THEN (pos - 1) // 2 ELSE n - 1 - (pos - 2) // 2 END AS place FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM {p}pr))"""


def scored(spark, sf):
    return rerank.score_overlap(hybrid_hits(spark, sf).join(plans(spark, sf).select("query_id", "query"), "query_id"))


HY = hybrid_cte("h", "questions", 40) + ",\n" + ranked_cte("h")


@query("rerank_topn", with_q("SELECT query_id, chunk_id, rrank AS position, round(rerank_score, 6) AS rerank_score FROM hrr", HY))
def rerank_topn(spark, sf):
    return rerank.rerank_topn(scored(spark, sf)).select("query_id", "chunk_id", "position", F.round("rerank_score", 6).alias("rerank_score"))


@query("rerank_pair_plugin", with_q("""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS position FROM (
    SELECT *, -abs(length(raw_text) - length(query)) AS s FROM hpair JOIN questions USING (query_id)) QUALIFY position <= 8""", HY))
def rerank_pair_plugin(spark, sf):
    """A user pair scorer as plug-in: closeness in length."""
    pairs = hybrid_hits(spark, sf).join(plans(spark, sf).select("query_id", "query"), "query_id")
    out = rerank.score_pairs(pairs, "query", "raw_text", lambda q, t: [-abs(len(b) - len(a)) for a, b in zip(q, t)])
    return rerank.rerank_topn(out).select("query_id", "chunk_id", "position")


@query("promote_rescued", with_q("SELECT query_id, chunk_id, pos AS position, rescued_table FROM hpr", HY))
def promote_rescued(spark, sf):
    return rerank.promote_rescued(scored(spark, sf)).select("query_id", "chunk_id", "position", "rescued_table")


@query("cylinder_order", with_q("SELECT query_id, chunk_id, pos AS position, CAST(place AS INTEGER) AS place FROM hcy", HY))
def cylinder_order(spark, sf):
    out = rerank.cylinder_order(rerank.promote_rescued(scored(spark, sf)))
    return out.select("query_id", "chunk_id", "position", F.col("place").cast("int").alias("place"))


@query("post_retrieval", with_q("""SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place, contains_table, length(raw_text) AS chars FROM hcy""", HY))
def post_retrieval(spark, sf):
    out = rerank.post_retrieval(scored(spark, sf))
    return out.select("query_id", "chunk_id", F.col("place").cast("int").alias("place"), "contains_table", F.length("raw_text").cast("long").alias("chars"))


# cleaning of non-table chunks: filler phrases and links go, figures must stay
CLEANED = r"""trim(regexp_replace(regexp_replace(regexp_replace(raw_text, 'https?://[^\s]+|[\w.+-]+@[\w-]+\.[\w.]+', ' ', 'g'),
  '\b(in order to|it should be noted that|please note|as mentioned above|furthermore|additionally|moreover)\b,?', ' ', 'gi'), '\s+', ' ', 'g'))"""


@query("shield_tables", d.sql_with(["corpus"], f"""SELECT chunk_id, contains_table, md5(CASE WHEN contains_table THEN raw_text WHEN len(list_filter(toks, lambda t: NOT contains(c, t))) = 0 THEN c ELSE raw_text END) AS text_md5
    FROM (SELECT *, {CLEANED} AS c, list_distinct(regexp_extract_all(raw_text, '[\\$\\%\\(\\)]|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+\\d{{1,2}},?\\s+\\d{{4}}|\\d{{4}}|\\b\\d+\\.\\d+\\b')) AS toks FROM corpus)"""))
def shield_tables(spark, sf):
    out = rerank.shield_tables(d.corpus(spark, sf))
    return out.select("chunk_id", "contains_table", F.md5("cleaned_text").alias("text_md5"))
