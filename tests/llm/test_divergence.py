"""Divergence of sources against plain Python over all pairs and terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from fathomline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, ranks=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        share = {(s, t): 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for s in sources for t in kept}
        of_lang = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(sum(f(share[s, t], share[o, t]) for t in kept), o) for o in sources if o != s]
            own = [(f(share[s, t], of_lang[t]), t) for t in kept if counts[lang, s][t] and share[s, t] > of_lang[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", own, ranks)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(items[:most])]
    return sorted(out)


def rows_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{c}" + "é" * (i % 3) + "Q" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 3)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "-x", "1y2", "\n"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(n)]
    hot = [("the same text " * 5, "en", "hot")] * (n // 3)
    return rows + hot + [(None, "en", "only"), ("", "xx", "p"), ("Solo", "xx", "q"), ("...", "yy", None)]


def test_audit_equals_plain_python(spark):
    for seed, n in ((1, 400), (2, 60)):
        rows = rows_of(seed, n)
        df = spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], "text string, lang string, source string, term string, n int, share long").repartition(5)
        got = sorted(tuple(r) for r in divergence.audited(df, ranks=12).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == plain(rows, ranks=12)
    assert divergence.audited(df.where("false")).count() == 0


def test_tree_shares_paths_and_counts_each_pair_once():
    rng = np.random.default_rng(4)
    rows = sorted({tuple((s, int(rng.integers(2, 5))) for s in range(5) if rng.random() < 0.6) for _ in range(60)} - {()})
    times = rng.integers(1, 9, len(rows))
    length = np.array([len(r) for r in rows])
    flat = [x for r in rows for x in r]
    source, share = np.array([s for s, _ in flat]), np.array([p for _, p in flat])
    base = source + 1
    tree = divergence.Tree(length, source, share, base, times)
    assert len(tree.source) == len({r[:k] for r in rows for k in range(1, len(r) + 1)})
    got, want = Counter(), Counter()
    for x, y, one, other in tree.corrections():
        for a, b, v, w in zip(x.tolist(), y.tolist(), one.tolist(), other.tolist()):
            got[a, b] += v
            got[b, a] += w
    f = lambda p, q: (p - q) ** 2 // q
    for r, m in zip(rows, times.tolist()):
        for a, p in r:
            for b, q in r:
                if a != b:
                    want[a, b] += m * (f(p, q) - f(p, b + 1) - f(a + 1, q) + f(a + 1, b + 1))
    assert got == want


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = (" " + "x" * 40 + " aB1c" * 30 + "é" * 50) * 20
    whole = Counter(t.encode() for t in TERM.findall(text.replace("B", "b")))
    for size in (7, 16, 100, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert sum((Counter(x) for x in divergence.terms(text.encode())), Counter()) == whole


def test_tasks_flush_and_grow_small_trees(spark, monkeypatch):
    rows = rows_of(3, 200)
    batches = lambda: iter([__import__("pyarrow").RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), (x or "" for x in r))) for r in rows])])
    total = lambda out: Counter({k: v for b in out for k, v in [((r["lang"], r["source"], r["term"]), r["n"]) for r in b.to_pylist()] if v})
    big = sum((total([b]) for b in divergence._counted(batches())), Counter())
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr("fathomline.llm.divergence.blocks", lambda batches, column: (b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)))
    assert sum((total([b]) for b in divergence._counted(batches())), Counter()) == big
