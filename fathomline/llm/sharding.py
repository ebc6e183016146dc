"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a gapless number in an order that only the rows decide; a
permutation of 0 .. n-1 turns the number into a place, and the place into shard
and slot. Nothing is sorted globally: rows are numbered inside hash buckets,
whose first numbers come from the bucket counts.

Null ids and texts are rows like others (a null text has 8 bytes of size and the
check sum of no bytes); repeated rows are numbered each; an empty table gives an
empty result; other columns are not looked at unless ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6  # even, so that both halves end in their own range
WALKS = 64
BUCKETS = 4096


def _halves(total: Column) -> tuple[Column, Column]:
    """Both moduli: a * b is at least ``total`` and exceeds it by less than a."""
    a = F.greatest(F.ceil(F.sqrt(total.cast("double"))), F.lit(1)).cast("long")
    return a, F.greatest(F.ceil(total / a), F.lit(1)).cast("long")


def _pass(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of all rounds over 0 .. a*b-1."""
    def step(state: Column, j: Column) -> Column:
        left, right = state["left"], state["right"]
        m = F.when(j % 2 == 0, a).otherwise(b)
        mixed = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), j, right), m), m)
        return F.struct(right.alias("left"), mixed.alias("right"))

    begun = F.struct(F.floor(x / b).cast("long").alias("left"), F.pmod(x, b).alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begun, step, lambda s: s["left"] * b + s["right"])


def permuted(number: Column, total: Column, seed: int = 0) -> Column:
    """Place of row ``number`` among ``total``: a bijection of 0 .. total-1.

    Values that fall outside are passed on until they fall inside (cycle
    walking). Fewer than sqrt(total) values lie outside, so that a walk of
    ``WALKS`` steps is certain to end up to 4 096 rows and fails beyond with a
    chance under 64**-64; a walk that did not end raises an error."""
    a, b = _halves(total)
    first = _pass(number, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda y, _: F.when(y < total, y).otherwise(_pass(y, a, b, seed)))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def shard_slot(place: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place; shard sizes differ by one at most."""
    return F.pmod(place, F.lit(shards)).cast("int"), F.floor(place / shards).cast("long")


def numbered(rows: DataFrame, bucket: Column, order: Iterable[Column], counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``__number`` (gapless from 0) and ``__total``.

    The number is the count of rows in earlier buckets plus the place inside the
    bucket. ``counted`` may be a narrower frame with the same rows to count. The
    bucket counts are at most BUCKETS rows, which is why they are broadcast."""
    sizes = (counted if counted is not None else rows).groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n"))
    everything, earlier = Window.partitionBy(), Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(everything).alias("__total"))
    inside = Window.partitionBy("__bucket").orderBy(*order)
    placed = rows.withColumn("__bucket", bucket).withColumn("__place", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(starts), "__bucket").withColumn("__number", F.col("__before") + F.col("__place")).drop("__bucket", "__before", "__place")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 0, key: str = "doc_id", text: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """Each row's shard and slot: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: counts of shards differ by one at most. One more shard deals all
    rows anew, so that ``grown_shard`` is null. Same rows, seed and number of
    shards give the same layout in any partitioning."""
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    narrow = docs.select(F.col(key).alias("__key"), (F.length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *[F.col(c).alias(f"__carry_{c}") for c in carry])
    bucket = F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)).cast("int")
    ids = docs.select(F.col(key).alias("__key"))
    rows = numbered(narrow, bucket, [F.col("__key"), F.col("text_crc32"), F.col("size")], ids)
    shard, slot = shard_slot(F.col("__at"), shards)
    return rows.withColumn("__at", permuted(F.col("__number"), F.col("__total"), seed)).select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__carry_{c}").alias(c) for c in carry])
