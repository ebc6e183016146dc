"""Centroid clustering by equal-average equal-variance search.

Components become integers, so that every distance and every new centroid is exact. A
vector ``x`` and a centroid ``c`` of ``k`` components with means m and deviations
``v = sqrt(sum (x - m)^2)`` are never nearer than

    |x - c|^2 >= k (m_x - m_c)^2 + (v_x - v_c)^2

Centroids are sorted by their mean. A vector starts at its own mean and goes outward, to
the side whose next centroid is nearer in mean; it stops as soon as the first term
alone exceeds the best distance so far, since all further ones are farther in mean, and
passes over a centroid that both terms together exclude. What is left is compared in
64-bit integers; the bounds are doubles with a margin, so that they never exclude a tie.
Equal distances go to the smaller number.

Each round reads the vectors once: tasks assign their rows and return a sum and a count
for each centroid they met, and the driver gets k times ``dim`` sums. Centroids are the
only thing sent to tasks.

Vectors that are null, of another length, or hold a null or non-finite component are left
out. With fewer vectors than centroids wanted, each is one. A null id counts as an empty
text where ids are hashed; rows that repeat an id start in the order of their vectors.
Components beyond 2^27 in size after scaling raise an error, since squared distances
would not fit 64 bits. Empty tables give empty results; only id and vector are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import written

CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
LARGEST = 1 << 27
#: margin of the bounds, relative to the sizes compared
MARGIN = 1e-9
#: vectors compared at once
ROWS = 8_192


class Centroids:
    """Centroids in the order of their means."""

    def __init__(self, rows: np.ndarray):
        rows = np.asarray(rows, dtype=np.int64)
        total = rows.sum(axis=1)
        self.number = np.lexsort((np.arange(len(rows)), total))
        self.rows, self.total = rows[self.number], total[self.number]
        self.deviation = deviation(self.rows, self.total)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many distances it took."""
        n, dim, k = len(x), x.shape[1], len(self.rows)
        total = x.sum(axis=1)
        spread = deviation(x, total)
        right = np.searchsorted(self.total, total)
        left = right - 1
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        live, compared = np.arange(n), 0
        while len(live):
            l, r = left[live], right[live]
            down = np.where(l >= 0, total[live] - self.total[l], np.inf)
            up = np.where(r < k, self.total[np.minimum(r, k - 1)] - total[live], np.inf)
            by_mean = np.minimum(down, up) ** 2 / dim
            limit = best[live] * (1 + MARGIN)
            on = by_mean <= limit
            live, by_mean, limit, lower = live[on], by_mean[on], limit[on], (down <= up)[on]
            c = np.where(lower, l[on], r[on])
            left[live] -= lower
            right[live] += ~lower
            apart = np.abs(spread[live] - self.deviation[c]) - MARGIN * (spread[live] + self.deviation[c])
            near = by_mean + np.maximum(apart, 0) ** 2 <= limit
            rows, c = live[near], c[near]
            d = ((x[rows] - self.rows[c]) ** 2).sum(axis=1)
            compared += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (self.number[c] < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], self.number[c[better]]
        return who, best, compared


def deviation(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - (total / max(1, x.shape[1]))[:, None]) ** 2).sum(axis=1))


def integers(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``id`` and integer components ``v`` of the usable vectors."""
    x = F.col("x")
    usable = (F.size("x") == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    d = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where("x IS NOT NULL").where(usable)

    def whole(e: Column) -> Column:
        fits = F.abs(e * scale) <= LARGEST
        return F.when(fits, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint")).cast("int")

    return d.select("id", F.transform(x, whole).alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            b = batch.slice(first, ROWS)
            yield b, b.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray, dim: int):
    """Per task: count and component sums of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Centroids(centroids)
        sums, count = np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for _, x in _matrices(batches, dim):
            who, _, _ = index.nearest(x)
            order = np.argsort(who, kind="stable")
            met, first = np.unique(who[order], return_index=True)
            sums[met] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(who, minlength=len(count))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Centroids(centroids)
        for b, x in _matrices(batches, dim):
            who, best, _ = index.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(who.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``key``, cluster and distance of every usable vector, and the final centroids."""
    kept = written(integers(vectors, key, vector, dim, scale), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(drawn.alias("drawn"), "v").orderBy("drawn", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(first) else 0):
        found = kept.select("v").mapInArrow(_sums(centroids, dim), "cluster long, n long, sums array<long>")
        each = found.select("cluster", "n", F.posexplode("sums").alias("component", "part")).groupBy("cluster", "component")
        # sums over all rows may pass 64 bits, counts do not
        for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
            centroids[r.cluster, r.component] = int(r.total) // r.n
    kind = dict(kept.dtypes)["id"]
    done = kept.mapInArrow(_assigned(centroids, dim), f"id {kind}, cluster int, distance long")
    return written(done, "assigned").withColumnRenamed("id", key), centroids


def reported(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of each cluster and of all, and a digest of the centroid."""
    spark = assigned.sparkSession
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, total, sum(inertia.values()), digest[c]) for c, total in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster")  # one row for each centroid
