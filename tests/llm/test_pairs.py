"""Near duplicates of texts and vectors against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from fathomline.llm import embeddings, jaccard
from fathomline.llm.components import components
from tests.conftest import SF

LAST = jaccard.LAST


def plain_classes(rows):
    nodes, sets = {}, []
    for i, t in rows:
        i = LAST if i is None else i
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", lower)
        s = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append((i, s))
        nodes.setdefault(i, i)

    def root(i):
        while nodes[i] != i:
            i = nodes[i]
        return i

    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    seen = set()
    for ks in where.values():
        for p in range(len(ks)):
            for q in range(p):
                seen.add((ks[q], ks[p]))
    for p, q in seen:
        (i, x), (j, y) = sets[p], sets[q]
        if 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((root(i), root(j)))
            nodes[b] = a
    back = lambda i: None if i == LAST else i
    return sorted(((back(i), len(s), back(root(i) if s else i)) for i, s in sets), key=str)


def got_classes(df):
    return sorted((tuple(r) for r in jaccard.classes(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 12, 40, 90]))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        if rng.random() < 0.3:
            w += passage[: rng.choice([20, 60])]
        rows.append((rng.choice([i] * 9 + [i - 1, None]), (" " if rng.random() < 0.5 else "\n").join(w)))
    near = [rng.choice(vocabulary) for _ in range(70)]
    for i in range(60):
        w = list(near)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(w)))
    rows += rows[:5] + [(900, None), (901, ""), (902, "  \n"), (900, None), (903, "w1"), (904, "W1"), (905, "ä Ä"), (906, "a " * 5000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, key string").repartition(4)
    assert got_classes(df) == plain_classes(rows)


def test_classes_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = plain_classes(rows)
    assert got_classes(df) == want and any(a != c for a, _, c in want)
    assert jaccard.classes(df.where("false")).count() == 0
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    assert kept == {c for _, _, c in want}


def test_copies_just_too_far_apart_meet_once_not_at_each_shingle(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(1500)]
    rows = []
    for i in range(24):
        w = list(base)
        for _ in range(27):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "frequent", lambda docs: np.zeros(0, np.uint64))  # as among many documents
    met, plain = [], jaccard.meetings
    monkeypatch.setattr(jaccard, "meetings", lambda spread: met.append(plain(spread)) or met[0])
    assert got_classes(spark.createDataFrame(rows, "doc_id long, text string")) == plain_classes(rows)
    pairs = met[0].distinct().count()
    assert pairs >= 200 and met[0].count() <= 2 * pairs


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 250: 200, 300: 200}


# --- vectors

def plain_near(rows):
    """n_links and links of usable vectors, by id order of rows."""
    import numpy as np

    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for _, v in rows]
    links = [set() for _ in rows]
    for dim in {len(v) for (_, v), u in zip(rows, usable) if u}:
        at = [k for k, ((_, v), u) in enumerate(zip(rows, usable)) if u and len(v) == dim]
        x = embeddings.unit(np.array([rows[k][1] for k in at], dtype=np.float64))
        for i, j in zip(*np.nonzero(x @ x.T >= 0.9)):
            if i != j:
                links[at[i]].add(at[j])
    return links


def plain_components(rows, links):
    comp = [LAST if i is None else i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for k, ls in enumerate(links):
            low = min([comp[k], *[comp[j] for j in ls]])
            for j in (k, *ls):
                if comp[j] > low:
                    comp[j], moved = low, True
    return comp


def test_vectors_of_the_table(spark):
    import numpy as np

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF.replace('0.001', '0.1')}/embeddings.parquet' ORDER BY vec_id").fetchall()
    rng = np.random.default_rng(8)  # the table has no neighbours of its own: near copies of every third vector, up to cosine 0.9 and a little below
    rows += [(100_000 + 10 * i + k, (np.array(v) + rng.uniform(0.02, 0.06) * np.linalg.norm(v) * rng.standard_normal(len(v))).tolist()) for i, v in rows[::3] for k in range(1 + i % 4)]
    links = plain_near(rows)
    got = {r.vec_id: r for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_links <= len(ls) for (i, _), ls in zip(rows, links))
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, links)) > 0
    for (i, _), c in zip(rows, plain_components(rows, links)):
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id >= c
    assert sum(got[i].component_id == c for (i, _), c in zip(rows, plain_components(rows, links))) >= 0.95 * len(rows)


@pytest.mark.parametrize("most", [embeddings.LEAF_MOST, 40])
def test_vector_edges(spark, monkeypatch, most):
    import numpy as np

    monkeypatch.setattr(embeddings, "LEAF", 60)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(k, (centres[rng.integers(30)] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(300)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1e300] * 16, [1e-300] * 16, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(None, rows[0][1]), (5, rows[5][1]), (2000, rows[7][1]), (2001, rows[7][1]), (1000, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, leaf string, n int").repartition(3)
    links = plain_near(rows)
    comp = plain_components(rows, links)
    want = sorted((LAST if i is None else i, len(ls), c, i == c) for (i, _), ls, c in zip(rows, links, comp))
    got = sorted((LAST if r.vec_id is None else r.vec_id, r.n_links, LAST if r.component_id is None else r.component_id, r.kept) for r in embeddings.near(df).collect())
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert [g for g in got if 1000 <= g[0] < LAST] == [w for w in want if 1000 <= w[0] < LAST]
    assert embeddings.near(df.where("false")).count() == 0


def test_leaf_counts_each_pair_once():
    import numpy as np

    rng = np.random.default_rng(1)
    x = embeddings.unit(np.repeat(rng.standard_normal((5, 8)), 30, axis=0) + 0.02 * rng.standard_normal((150, 8)))
    ident = rng.permutation(150).astype(np.int64)
    parts = [np.arange(0, 100), np.arange(60, 150)]
    total, earlier = np.zeros(150, np.int64), np.zeros((150, 1), np.float32)
    for k, p in enumerate(parts):
        count, least = embeddings.leaf_links(ident[p], x[p], np.ones(len(p), np.int64), earlier[p] if k else earlier[p][:, :0], 0.9)
        total[p] += count
        earlier[p, 0] = 1
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    near[:60, 100:] = near[100:, :60] = False
    assert (total == near.sum(1)).all()
