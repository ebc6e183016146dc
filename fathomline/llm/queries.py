"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, bytepairs, chat, clusters, divergence, embeddings, jaccard, licenses, packing, quality, sharding, substrings
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and packed into sequences of 2 048 tokens."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    return packing.packed(packing.pieces(coded, 2048), 2048)


_CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), coded AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '␛', '␛0'), '<(/?s>|\||/?<SYS>>|/?SYS>>)', '␛l\1', 'g'), '\[(/?INST\])', '␛b\1', 'g') AS body FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 17) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""


@query("op2_chat_fingerprint", _CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in three layouts, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    records = chat.gathered(turns.unionByName(planted))
    known = chat.canonical_turns(records, ["system", "prompt", "response", "messages"])
    d = chat.read_back(chat.formatted(known))
    whole = F.array_join(F.transform("turns_read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_WARC_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32 AS INT), 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN l USING (h)
"""


@query("op3_zip_archives", _WARC_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back from these."""
    packages = archives.write_packages(table(spark, sf_dir, "pages"))
    return archives.pages_of(archives.read_records(packages))


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_REPEATS_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS v FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
o AS (SELECT v, min(doc_id) AS first FROM g GROUP BY v),
hit AS (SELECT doc_id, list(i) AS starts FROM g JOIN o USING (v) WHERE first < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten([range(i, i + 13) for i in starts])) AS places FROM hit),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
lost AS (SELECT doc_id, unnest(places) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_CLASSES_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c
           FROM e x JOIN e y ON x.v = y.v AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (m + n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, edge.b FROM reach r JOIN edge ON edge.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id
FROM s LEFT JOIN least USING (doc_id)
"""


@query("op4_fm_index_repeats", _REPEATS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that an earlier document holds."""
    left = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return left.select(F.col("c_doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_bpe_tree")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())


@query("op6_feistel_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose counts differ by one at most."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=24, seed=20)


@query("op7_projection_forest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at cosine 0.9 and their components."""
    return embeddings.near(table(spark, sf_dir, "embeddings"))


@query("op8_grouped_prefix_join", _CLASSES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by five-word shingles, similarity 0.8."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


@query("op9_license_diagonals")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license notices in all documents."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query("op10_decision_list")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with base counts and the verdict of the learned list."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__n_symbols").alias("n_symbols"), F.col("__n_dup_lines").alias("n_dup_lines"),
        F.col("__n_repeat_words").alias("n_repeat_words"), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


_CENTROIDS_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM kept QUALIFY cluster < 40
), """ + ", ".join(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, k.v, min(struct_pack(d := CAST(list_sum([power(CAST(k.v[j] - c.v[j] AS BIGINT), 2) for j in range(1, 65)]) AS BIGINT), n := cluster)) AS best
  FROM kept k CROSS JOIN c{i} c GROUP BY vec_id, k.v
)""" + (f""", s{i} AS (
  SELECT best.n AS cluster, j, sum(v[j]) AS total, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) t(j) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY cluster) m USING (cluster)
)""" if i < 5 else "") for i in range(6)) + """
SELECT vec_id, CAST(best.n AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.n) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 c ON best.n = c.cluster
"""


@query("op11_equal_average_search", _CENTROIDS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters after five rounds."""
    return clusters.reported(*clusters.clusters(table(spark, sf_dir, "embeddings")))


_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), one AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM one GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS size, sum(whole) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM one GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT * FROM counts SEMI JOIN kept USING (lang, term)) USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (g.total + l.size) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (whole + 1)) // (l.total + l.size) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS v FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), listed AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM listed QUALIFY part = 'pair' OR rank <= 200
"""


@query("op12_pattern_tree_audit", _DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages against each other and against their language."""
    return divergence.audited(table(spark, sf_dir, "documents"))


@query("op13_segment_tree_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the multilingual byte-level ranks."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytepairs.digests(bytepairs.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
