"""From raw documents to packed sequences: each stage is written as Parquet and read again.

Quality rules drop documents, the n-gram Jaccard join keeps one of each group, the
substring dedup drops repeated passages from the texts that are left, and best-fit
packing cuts and places what remains. All but the last return the columns of
``documents``, further ones included, whatever their names.

Null and empty texts fail the base rule and go. Null ids count as larger than all others; rows
that repeat an id are kept or dropped together by the near-duplicate stage and never remove
each other's passages. Of equal documents the least id stays. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import bpe, jaccard, packing, quality, substrings
from fathomline.llm.arrow import written
from fathomline.llm.queries import table, vocabulary

CAPACITY = 2048


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that earlier ones hold. Texts that lose words
    become the words left, joined by blanks; others stay as they are."""
    whole = "whole"
    while whole in docs.columns:
        whole += "_"
    left = substrings.without_repeats(docs.withColumn(whole, F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"`c_{whole}`"))
    values = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return left.select(*[values.get(c, F.col(f"`c_{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    return packing.packed(packing.pieces(bpe.encode(docs, vocabulary()), CAPACITY), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]

#: learned rules and a tokenizer have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
