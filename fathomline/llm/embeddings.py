"""Embedding near-dedup by a forest of random-projection trees.

Each tree halves a bounded sample again and again by random directions; a vector
near a cut goes to both sides (spill), so that neighbours are seldom parted, and
many trees part different ones. Every vector is sent to its leaves in all trees and
compared with the others there in double precision. Pairs are counted in the first
leaf that they share and never written out: a leaf returns a count for each vector
and a spanning forest of its links.

A node is cut where few near pairs of its sample are parted. Where a good part of a
node's pairs are near and every cut would part them, it is not split any further:
such a dense leaf is compared in full. Leaves larger than LEAF_MOST, dense or not,
are cut into blocks by id and compared as pairs of blocks, each in a task of its own;
pairs that an earlier leaf has compared are not compared again.

Equal vectors collapse to one that carries their number, so a vector of very many
rows is one row in its leaves.

Null vectors, zero vectors and vectors with null or non-finite components link with
nothing. Vectors of different lengths are not compared. Null ids count as larger
than all others. Repeated rows are vectors of their own and link with each other.
Only id and vector are read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import written
from .components import components

THRESHOLD = 0.9
TREES = 8
#: vectors wanted in a leaf, and in a block of a larger one
LEAF, LEAF_MOST = 512, 4_096
#: vectors fetched to place the cuts, for each vector length
SAMPLE = 8_192
#: share of a node's vectors on either side of the cut that go to both children
SPILL = 0.06
#: quantiles and number of directions tried for a cut, rows whose pairs judge it
CUTS, DIRECTIONS, JUDGES = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8), 8, 256
#: a node is dense if this share of its pairs is near, and any cut parts that share of them
DENSE, PARTED = 0.1, 0.05
BLOCK = 1_024
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Tree:
    """A full binary tree: direction and the two bounds of each inner node, and the
    blocks of each leaf. Below a dense node all rows go left."""

    depth: int
    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row of ``x`` goes to."""
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[rows], self.directions[node])
            left, right = p < self.high[node], p >= self.low[node]
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return rows, node - (2 ** self.depth - 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cut(x: np.ndarray, rng: np.random.Generator, spill: float, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Direction, and (low, cut, high) along it, that part the fewest near pairs; None if ``x`` is dense."""
    directions = rng.standard_normal((DIRECTIONS, x.shape[1]))
    some = x if len(x) <= JUDGES else x[rng.choice(len(x), JUDGES, replace=False)]
    a, b = np.nonzero(np.triu(some @ some.T >= threshold, 1))
    at = np.quantile(x @ directions.T, np.add.outer((-spill, 0, spill), CUTS), axis=0)
    p = some @ directions.T
    left, right = p[:, None, :] < at[0], p[:, None, :] >= at[2]
    parted = ((left[a] & right[b]) | (right[a] & left[b])).mean(axis=0) if len(a) else np.zeros(at.shape[1:])
    q, best = np.unravel_index(np.argmin(parted + 0.1 * np.abs(np.array(CUTS) - 0.5)[:, None]), parted.shape)
    if parted[q, best] > PARTED and len(a) >= DENSE * len(some) * (len(some) - 1) / 2:
        return None
    return directions[best], at[:, q, best]


def grow(sample: np.ndarray, depth: int, seed: int, spill: float = SPILL, total: int = 0, threshold: float = THRESHOLD) -> Tree:
    rng = np.random.default_rng(seed)
    inner = 2 ** depth - 1
    directions, low, high = np.zeros((inner, sample.shape[1])), np.full(inner, np.inf), np.full(inner, np.inf)
    inside = {0: np.arange(len(sample))}
    for node in range(inner):
        own = inside.pop(node, None)
        found = cut(sample[own], rng, spill, threshold) if own is not None and len(own) else None
        if found:
            directions[node], (low[node], at, high[node]) = found
            p = sample[own] @ directions[node]
            inside[2 * node + 1], inside[2 * node + 2] = own[p < at], own[p >= at]
    tree = Tree(depth, directions, low, high, np.ones(2 ** depth, dtype=np.int64))
    share = np.bincount(tree.leaves(sample)[1], minlength=2 ** depth) / len(sample) if len(sample) else np.ones(2 ** depth)
    tree.blocks[:] = np.maximum(1, np.ceil(share * total / LEAF_MOST))
    return tree


def forest(sample: np.ndarray, total: int, trees: int, seed: int, threshold: float = THRESHOLD) -> list[Tree]:
    depth = int(np.ceil(np.log2(max(1.0, total / LEAF))))
    depth = max(0, min(depth, int(np.log2(max(1, len(sample) // 16)))))
    return [grow(sample, depth, seed * 1000 + t, SPILL, total, threshold) for t in range(trees)]


def _tiles(x: np.ndarray, known: np.ndarray, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, other rows and which of them are near; every pair once, without those inside ``known``, across sides only if given."""
    new, old = np.flatnonzero(~known), np.flatnonzero(known)
    sides = [(new, np.concatenate([new, old]))] if side is None else [(new[~side[new]], np.flatnonzero(side)), (new[side[new]], old[~side[old]])]
    for mine, others in sides:
        for i in range(0, len(mine), BLOCK):
            rows, cols = mine[i:i + BLOCK], others[i:] if side is None else others
            near = x[rows] @ x[cols].T >= threshold
            if side is None:
                near[:, :len(rows)] &= np.triu(np.ones((len(rows), len(rows)), dtype=bool), 1)
            yield rows, cols, near


def leaf_links(ident: np.ndarray, x: np.ndarray, weight: np.ndarray, earlier: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that no earlier leaf counts, and the least id that its links reach here.

    ``earlier`` has a row's memberships in earlier leaves, a column each; rows that share
    the commonest of them were compared there. ``side``: links between True and False only."""
    count, label = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    order = np.argsort(ident, kind="stable")
    ident, x, weight, earlier, side = ident[order], x[order], weight[order], earlier[order], side[order] if side is not None else None
    known = earlier[:, earlier.sum(axis=0).argmax()] > 0 if earlier.shape[1] else np.zeros(len(x), dtype=bool)
    first, before = True, None
    while first or (label != before).any():  # rows are in order of ids, so the least row is the least id
        before = label.copy()
        for rows, cols, near in _tiles(x, known, side, threshold):
            if first:
                new = near & (earlier[rows] @ earlier[cols].T == 0) if earlier.shape[1] else near
                count[rows] += new @ weight[cols]
                count[cols] += weight[rows] @ new
            if near.any():
                label[rows] = np.minimum(label[rows], np.where(near, label[cols], len(x)).min(axis=1))
                label[cols] = np.minimum(label[cols], np.where(near, label[rows][:, None], len(x)).min(axis=0))
        label, first = label[label], False
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return count[back], ident[label][back]


def _block(ident: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    return ((ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)) % blocks


def _sent(forests: dict[int, list[Tree]]):
    """A row for each leaf of a vector and each pair of blocks there that its block is in, with the codes of all its leaves."""
    most = max((int(t.blocks.max()) for trees in forests.values() for t in trees), default=1)
    step = max(16, 4_096 // most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                b = batch.slice(begin, step)
                size = np.diff(b.column("vector").offsets.to_numpy())
                for dim in np.unique(size):
                    rows = np.flatnonzero(size == dim)
                    part = b.take(pa.array(rows))
                    x = unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim))
                    row, code, blocks = [], [], []
                    for t, tree in enumerate(forests[int(dim)]):
                        r, leaf = tree.leaves(x)
                        row.append(r)
                        code.append(((int(dim) << 16) + t << 32) + leaf)
                        blocks.append(tree.blocks[leaf])
                    row, code, blocks = np.concatenate(row), np.concatenate(code), np.concatenate(blocks)
                    order = np.lexsort((code, row))
                    row, code, blocks = row[order], code[order], blocks[order]
                    begins = np.searchsorted(row, np.arange(len(rows) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(code))
                    own = _block(part.column("id").to_numpy()[row], blocks)
                    at = np.repeat(np.arange(len(row)), blocks)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    for k in range(0, len(at), 32_768):
                        a, o = at[k:k + 32_768], other[k:k + 32_768]
                        take = pa.array(row[a])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(code[a]), pa.array(np.minimum(own[a], o)), pa.array(np.maximum(own[a], o)), pa.array(own[a]), *[part.column(c).take(take) for c in ("id", "n", "vector")], lists.take(take)],
                            ["leaf", "i", "j", "own", "id", "n", "vector", "leaves"])

    return run


def _leaf(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        here = t.column("leaf")[0].as_py()
        ident, weight = t.column("id").to_numpy(), t.column("n").to_numpy()
        vectors, lists = t.column("vector").combine_chunks(), t.column("leaves").combine_chunks()
        x = unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ident), -1))
        owner = np.repeat(np.arange(len(ident)), np.diff(lists.offsets.to_numpy()))
        codes = lists.flatten().to_numpy()
        own = codes < here
        _, column = np.unique(codes[own], return_inverse=True)
        earlier = np.zeros((len(ident), int(column.max()) + 1 if len(column) else 0), dtype=np.float32)
        earlier[owner[own], column] = 1
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        count, least = leaf_links(ident, x, weight, earlier, threshold, t.column("own").to_numpy() == j if i < j else None)
        linked = (count > 0) | (least != ident)
        return pa.table({"id": ident[linked], "links": count[linked], "least": least[linked]})

    return run


def near(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, seed: int = 7) -> DataFrame:
    """``key``, n_links, component_id and kept of every row of ``vectors``."""
    v = F.col("vector")
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    known = rows.select("id", F.when(F.col("usable"), F.xxhash64(v)).alias("h"), F.when(F.col("usable"), F.xxhash64(F.lit(1), v)).alias("h2"), F.when(F.col("usable"), v).alias("vector"))
    distinct = written(known.where("h IS NOT NULL").groupBy("h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("vector").alias("vector")), "vectors")
    forests = {}
    for dim, total in distinct.groupBy(F.size("vector")).count().collect():
        step = max(1, total // SAMPLE)
        some = distinct.where((F.size("vector") == dim) & (F.pmod(F.col("h"), F.lit(step)) == 0)).select("h", "vector").limit(2 * SAMPLE).collect()
        sample = np.array([r.vector for r in sorted(some, key=lambda r: r.h)], dtype=np.float64).reshape(-1, dim)
        forests[dim] = forest(unit(sample) if len(sample) else np.zeros((0, dim)), total, trees, seed, threshold)
    sent = distinct.select("id", "n", "vector").mapInArrow(_sent(forests), "leaf long, i long, j long, own long, id long, n long, vector array<double>, leaves array<long>")
    found = written(sent.groupBy("leaf", "i", "j").applyInArrow(_leaf(threshold), "id long, links long, least long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    classes = distinct.select("h", "h2", F.col("id").alias("rep"), "n").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = known.select("id", "h", "h2").join(classes, ["h", "h2"], "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep"))
    null = lambda c: F.when(c != LAST, c)
    return out.select(null(F.col("id")).alias(key), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
                      null(component).alias("component_id"), (F.col("id") == component).alias("kept"))
