"""Clustering against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from fathomline.llm import clusters


def plain(rows, k, rounds, dim):
    """(vec_id, cluster, distance) by brute force, and the final centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        sums = {}
        for _, v in kept:
            sums.setdefault(nearest(v)[1], []).append(v)
        for n, vs in sums.items():
            centroids[n] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_search_equals_brute_force_with_ties(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (500, 6)) if seed else (rng.normal(0, 1, (500, 6)) * 10 ** rng.uniform(0, 7, (500, 1))).astype(np.int64)
    rows = np.concatenate([x[:30], x[:10], -x[:5]])
    d = ((x[:, None, :] - rows[None]) ** 2).sum(axis=2)
    who, best, compared = clusters.Centroids(rows).nearest(x)
    assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert compared < d.size


def test_far_centroids_are_passed_over():
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (40, 64)) + rng.integers(-3000, 3000, (40, 1))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-50, 50, (4000, 64))
    who, best, compared = clusters.Centroids(centres).nearest(x)
    assert (who == ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert compared < 0.2 * len(x) * 40


@pytest.mark.parametrize("k", [5, 500])
def test_rounds_equal_brute_force(spark, k):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 4).round(2).tolist()) for i in range(200)] + [(900 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(80)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (7, [0.0] * 4), (7, [9.0] * 4), (1000, None), (1001, [1.0, None, 2.0, 3.0]), (1002, [float("nan")] * 4), (1003, [float("inf"), 0.0, 0.0, 0.0]), (1004, []), (1005, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, -1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, distance double")
    want, centroids = plain(rows, k, 3, 4)
    assigned, final = clusters.clusters(df, k=k, rounds=3, dim=4)
    assert final.tolist() == centroids
    out = clusters.reported(assigned, final).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out) == want
    assert all(r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) for r in out)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in out)


def test_empty_tables_and_large_components(spark):
    df = spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>")
    assert clusters.reported(*clusters.clusters(df.where("false"), dim=4)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters.clusters(df, dim=4)
