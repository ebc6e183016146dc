"""Embedding near-dedup where a third of the vectors are all alike, against brute force."""

import numpy as np
import pytest

from fathomline.llm import embeddings


def a_third_alike(n: int, cosine: float, dim: int = 64) -> np.ndarray:
    rng = np.random.default_rng(n)
    x = embeddings.unit(rng.standard_normal((n, dim)))
    centre = x[-1]
    off = rng.standard_normal((n // 3, dim))
    off = embeddings.unit(off - np.outer(off @ centre, centre))
    x[:n // 3] = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * off
    return x[rng.permutation(n)]


@pytest.mark.parametrize("n, cosine", [(10_000, 0.95), (30_000, 0.95), (30_000, 0.9)])
def test_recall_with_a_third_alike(spark, n, cosine):
    x = a_third_alike(n, cosine)
    want = np.concatenate([(x[i:i + 1_000] @ x.T >= embeddings.THRESHOLD).sum(axis=1) - 1 for i in range(0, n, 1_000)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = np.zeros(n, dtype=np.int64)
    for r in embeddings.near(df).select("vec_id", "n_links").collect():
        got[r.vec_id] = r.n_links
    recall = got.sum() / want.sum()
    print(f"recall {n} vectors, cosine {cosine}: {got.sum()} of {want.sum()} links, {recall:.5f}")
    assert (got <= want).all()
    assert recall >= 0.98


def test_pairs_of_blocks_count_each_pair_once():
    x = a_third_alike(900, 0.95, 16)
    ident, one, none = np.arange(900), np.ones(900, dtype=np.int64), np.zeros((900, 0), dtype=np.float32)
    total, block = np.zeros(900, dtype=np.int64), embeddings._block(ident, 3)
    for i in range(3):
        for j in range(i, 3):
            p = np.flatnonzero((block == i) | (block == j))
            total[p] += embeddings.leaf_links(ident[p], x[p], one[p], none[p], 0.9, block[p] == j if i < j else None)[0]
    assert (total == (x @ x.T >= 0.9).sum(axis=1) - 1).all()
