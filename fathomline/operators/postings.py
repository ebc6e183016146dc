"""A stored BM25 index: impact-ordered posting blocks with score bounds.

``build`` reads every text once, at ingest, and writes its tables below one folder:

* ``chunks``: shard, place, chunk_id, length and the filter columns of each chunk. A
  shard holds a bounded number of chunks, dealt by the hash of their id;
* ``postings``: blocks of a term's entries in one shard, (place, tf), those with the
  largest gain first. A block carries its largest tf and least length, which bound the
  gain of its entries in any scope;
* ``vocabulary``: document frequency of each term in each cell, ``cells`` the number of chunks
  and tokens of each, and ``scopes`` their totals and the idf floor of each scope.

``search`` takes idf and mean length per scope from the small tables, then reads the postings
of the asked terms once, shard by shard. In a shard each question goes through its blocks in the
order of their bounds. Once the bounds of all next blocks together stay below the k-th score,
no further chunk can enter: the blocks left are only looked up for the candidates that can
still reach it. A shard returns k rows for each question; scored pairs are never shuffled.

Questions are sent to tasks in groups whose terms are counted before (``ASKED``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import BM25_B, BM25_EPSILON, BM25_K1, CANDIDATE_K
from ..functions.text import tokens
from .scopes import ANY, PARTS, cell, cell_scopes, scope_keys
from .sparse import query_terms, rank_top

SHARD, BLOCK = 4_096, 512
#: partitions that shards are dealt to, at most
TASKS = 20_000
#: terms of questions, each with its scope, that go to tasks at once
ASKED = 200_000
#: what rounding may hide between a bound and a score
MARGIN = 1e-6

POSTINGS = "shard int, term string, block int, n int, max_tf int, min_len int, place array<int>, tf array<int>, cells array<string>, cell_df array<int>"


def _blocks(key: tuple, t: pa.Table) -> pa.Table:
    """Posting blocks of one shard; the first of a term also counts its chunks by cell."""
    t = t.sort_by("place")
    lists = t.column("tokens").combine_chunks()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    cells = t.column("cell").combine_chunks().dictionary_encode()
    words = lists.flatten().dictionary_encode()
    term, place = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(length)), length)
    pair, tf = np.unique(term * len(length) + place, return_counts=True)
    term, place = pair // max(1, len(length)), pair % max(1, len(length))
    order = np.lexsort((place, length[place], -tf, term))
    term, place, tf = term[order], place[order], tf[order]
    begin = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(begin[:-1], begin[1:])]) if len(term) else np.zeros(0, np.int64)
    of = term[starts]
    block = (starts - begin[of]) // BLOCK
    ends = np.append(starts[1:], len(term))
    # chunks by cell, listed with a term's first block
    cell_of = cells.indices.to_numpy()[place] if len(place) else place
    key_cell, df = np.unique(term * max(1, len(cells.dictionary)) + cell_of, return_counts=True)
    at = np.searchsorted(key_cell // max(1, len(cells.dictionary)), of[block == 0])
    size = np.zeros(len(starts), np.int64)
    size[block == 0] = np.diff(np.append(at, len(key_cell)))
    split = pa.array(np.append(starts, len(term)).astype(np.int32))
    by_cell = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    lowest = np.minimum.reduceat(length[place], starts) if len(starts) else starts
    names = cells.dictionary.take(pa.array(key_cell % max(1, len(cells.dictionary)))).cast(pa.string())
    return pa.table({
        "shard": pa.array(np.full(len(starts), key[0].as_py()), pa.int32()), "term": words.dictionary.take(pa.array(of)), "block": pa.array(block, pa.int32()), "n": pa.array(ends - starts, pa.int32()),
        "max_tf": pa.array(tf[starts], pa.int32()), "min_len": pa.array(lowest, pa.int32()), "place": pa.ListArray.from_arrays(split, pa.array(place, pa.int32())),
        "tf": pa.ListArray.from_arrays(split, pa.array(tf, pa.int32())), "cells": pa.ListArray.from_arrays(by_cell, names), "cell_df": pa.ListArray.from_arrays(by_cell, pa.array(df, pa.int32()))})


def build(chunks: DataFrame, path: str, shard: int = SHARD) -> None:
    """Write the index of ``chunks`` (chunk_id, raw_text and PARTS) to ``path``."""
    shards = max(1, -(-chunks.count() // shard))
    number = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard")
    own = Window.partitionBy("shard").orderBy("chunk_id")
    parts = [F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in PARTS]
    # so many partitions as shards: merged ones would put several shards in one task
    spark, deal = chunks.sparkSession, min(shards, TASKS)
    dealt = chunks.select(number, "chunk_id", *parts, cell(chunks).alias("cell"), F.col("raw_text")).repartition(deal, "shard").withColumn("place", F.row_number().over(own) - 1)
    rows = dealt.select("shard", "place", "cell", tokens(F.col("raw_text")).alias("tokens"))
    rows.groupBy("shard").applyInArrow(_blocks, POSTINGS).write.parquet(f"{path}/postings")
    sizes = chunks.select(number, "chunk_id", *parts, cell(chunks).alias("cell"), F.size(tokens(F.col("raw_text"))).alias("len"))
    sizes.withColumn("place", F.row_number().over(own) - 1).write.parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/postings").where("block = 0").select("term", F.explode(F.arrays_zip("cells", "cell_df")).alias("x"))
    stored.groupBy(F.col("x.cells").alias("cell"), "term").agg(F.sum("x.cell_df").alias("df")).write.parquet(f"{path}/vocabulary")
    spark.read.parquet(f"{path}/chunks").groupBy("cell", *PARTS).agg(F.count("*").alias("n"), F.sum("len").cast("long").alias("len")).write.parquet(f"{path}/cells")
    scope_statistics(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/vocabulary")).write.parquet(f"{path}/scopes")


def scope_statistics(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """scope, n_docs, avg_len and floor_idf of every filter that some chunk satisfies."""
    member = cells.select("cell", "n", "len", F.explode(F.array_distinct(scope_keys(*[F.col(p) for p in PARTS]))).alias("scope"))
    totals = member.groupBy("scope").agg(F.sum("n").alias("n_docs"), (F.sum("len") / F.sum("n")).alias("avg_len"))
    df = vocabulary.join(member.select("cell", "scope"), "cell").groupBy("scope", "term").agg(F.sum("df").alias("df"))
    floor = df.join(totals, "scope").groupBy("scope").agg((F.avg(_idf()) * BM25_EPSILON).alias("floor_idf"))
    return totals.join(floor, "scope", "left")


def _idf() -> Column:
    return F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def weights(spark: SparkSession, path: str, plans: DataFrame) -> DataFrame:
    """query_id, scope, term, weight and the scope's mean length for what is asked. Only
    the statistics of asked terms are read; a negative idf becomes the scope's floor."""
    terms = query_terms(plans)
    asked = spark.read.parquet(f"{path}/vocabulary").join(terms.select("term").distinct(), "term", "left_semi")
    df = asked.join(cell_scopes(spark.read.parquet(f"{path}/cells"), terms), "cell").groupBy("scope", "term").agg(F.sum("df").alias("df"))
    found = terms.join(df, ["scope", "term"]).join(spark.read.parquet(f"{path}/scopes"), "scope")
    idf = F.when(_idf() < 0, F.col("floor_idf")).otherwise(_idf())
    return found.select("query_id", "scope", "term", "avg_len", (F.col("qtf") * idf).alias("w"))


class Shard:
    """Chunks and asked posting blocks of one shard."""

    def __init__(self, postings: pa.Table, chunks: pa.Table):
        chunks = chunks.sort_by("place")
        self.ids = np.array(chunks.column("chunk_id").to_pylist(), dtype=object)
        self.length = chunks.column("len").to_numpy().astype(float)
        self.parts = [np.array(chunks.column(p).to_pylist(), dtype=object) for p in PARTS]
        postings = postings.sort_by([("term", "ascending"), ("block", "ascending")])
        place, tf = (postings.column(c).combine_chunks() for c in ("place", "tf"))
        edge = place.offsets.to_numpy() if len(place) else np.zeros(1, np.int64)
        place, tf = place.flatten().to_numpy(), tf.flatten().to_numpy()
        edge = edge - edge[0]
        self.blocks = defaultdict(list)
        for i, (term, most, least) in enumerate(zip(*(postings.column(c).to_pylist() for c in ("term", "max_tf", "min_len")))):
            self.blocks[term].append((most, least, place[edge[i]:edge[i + 1]], tf[edge[i]:edge[i + 1]]))
        self.scored = 0  # entries whose gain was computed

    def admitted(self, scope: str) -> np.ndarray:
        mask = np.ones(len(self.ids), dtype=bool)
        for part, want in zip(self.parts, scope.split("|", len(PARTS) - 1)):
            if want != ANY:
                mask &= part == want
        return mask

    def top(self, terms: list[tuple[str, float]], avg_len: float, admitted: np.ndarray, k: int) -> list[tuple[str, float]]:
        """The k best chunks of a question in a scope, by score at nine decimals, then id."""
        norm = BM25_K1 * (1 - BM25_B + BM25_B * self.length / avg_len)
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), dtype=bool)
        lists = [(w, self.blocks[t]) for t, w in terms if t in self.blocks]
        # terms that lower scores have no bound to skip by: all their blocks come first
        bound = [[w * m * (BM25_K1 + 1) / (m + BM25_K1 * (1 - BM25_B + BM25_B * least / avg_len)) if w > 0 else np.inf for m, least, _, _ in blocks] + [0.0] for w, blocks in lists]
        following = [0] * len(lists)
        kth = -np.inf

        def add(w: float, block: tuple, mask: np.ndarray) -> np.ndarray:
            _, _, place, tf = block
            on = mask[place]
            at, n = place[on], tf[on]
            score[at] += w * n * (BM25_K1 + 1) / (n + norm[at])
            self.scored += len(at)
            return at

        while lists:
            heads = [b[i] for b, i in zip(bound, following)]
            if sum(heads) == 0 or sum(heads) + MARGIN < kth:
                break
            t = max(range(len(heads)), key=heads.__getitem__)
            seen[add(lists[t][0], lists[t][1][following[t]], admitted)] = True
            following[t] += 1
            # with terms of negative weight behind it, the k-th score can only rise
            if np.isfinite(max(b[i] for b, i in zip(bound, following))) and (some := score[seen]).size >= k:
                kth = np.partition(some, -k)[-k]
        heads = sum(b[i] for b, i in zip(bound, following)) if lists else 0
        able = seen & (score + heads + MARGIN >= kth)
        for (w, blocks), i in zip(lists, following):
            for block in blocks[i:]:
                add(w, block, able)
        found = np.flatnonzero(able)
        best = sorted((-round(float(score[i]), 9), self.ids[i], float(score[i])) for i in found)[:k]
        return [(name, value) for _, name, value in best]


def _best(asked: dict[tuple[str, float], dict[int, list[tuple[str, float]]]], k: int, kind: pa.DataType):
    def run(key: tuple, postings: pa.Table, chunks: pa.Table) -> pa.Table:
        shard, out = Shard(postings, chunks), []
        for (scope, avg_len), questions in asked.items():
            admitted = shard.admitted(scope)
            if admitted.any():
                for q, terms in questions.items():
                    out += [(q, *hit) for hit in shard.top(terms, avg_len, admitted, k)]
        columns = list(zip(*out)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(columns[0], kind), "chunk_id": pa.array(columns[1], pa.string()), "score": pa.array(columns[2], pa.float64())})

    return run


def _groups(weights: DataFrame) -> Iterator[dict]:
    """Questions by scope, at most ASKED terms at a time."""
    sizes = sum(r["count"] for r in weights.groupBy().count().collect())
    parts = max(1, -(-sizes // ASKED))
    for i in range(parts):
        asked: dict = defaultdict(lambda: defaultdict(list))
        mine = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else weights
        for r in mine.collect():
            asked[r.scope, r.avg_len][r.query_id].append((r.term, r.w))
        yield {k: dict(v) for k, v in asked.items()}


def search(spark: SparkSession, path: str, plans: DataFrame, k: int = CANDIDATE_K) -> DataFrame:
    """query_id, chunk_id, score and rank of the k best chunks of each question."""
    known = weights(spark, path, plans)
    kind = dict(known.dtypes)["query_id"]
    hits = None
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "place", "chunk_id", "len", *PARTS)
    last = chunks.agg(F.max("shard").alias("last")).collect()[0]["last"]
    deal = min((last or 0) + 1, TASKS)
    for asked in _groups(known):
        terms = spark.createDataFrame([(t,) for t in sorted({t for q in asked.values() for ts in q.values() for t, _ in ts})], "term string")
        postings = spark.read.parquet(f"{path}/postings").join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "block", "max_tf", "min_len", "place", "tf")
        best = postings.repartition(deal, "shard").groupBy("shard").cogroup(chunks.repartition(deal, "shard").groupBy("shard")).applyInArrow(_best(asked, k, pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()), f"query_id {kind}, chunk_id string, score double")
        hits = best if hits is None else hits.unionByName(best)
    return rank_top(hits, k, ["query_id"])
