"""Source divergence audit by a frequent-pattern tree of term rows.

For every language the sources are compared by their term shares: ``p`` is a term's
share in a source, smoothed by one, in parts of SHARE; two sources diverge by
``sum over terms of floor((p - q)^2 / q)``.

A term's row is its share in each source that has it, in source order. Most terms are
missing in most sources, and many rows begin alike, so the sum over terms is split:

* as if no source had any term: the number of terms times one value for each pair;
* for each source, corrections of the terms that it has and the other has not, by
  distinct share;
* for each pair, a correction of the terms that both have. Rows with their
  multiplicities go into a tree of (source, share) nodes; a node and each of its
  ancestors are such a pair of sources, whose correction counts once for all rows that
  share the node's path.

Equal rows are counted before. Distinct ones are dealt by ranges of their paths, so that
rows that begin alike meet, whatever the number of rows of a language; each task builds
trees of bounded size, and a path that two trees hold is merely counted in both.
Everything is exact: floors are taken for each term's value, sums are integers.

Null text, language and source are empty; so is a document without terms, whose group
still counts. Terms are runs of ASCII letters and characters beyond ASCII, with A-Z
lowered. Rows are documents: repeated rows and null ids count each. Equal values are
ranked by name. Empty tables give empty results; only text, language and source are
read, so other columns may have any name. What is held for one term or one group grows
with the number of sources of its language, never with documents; the result itself has
a row for each pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import blocks, written

SHARE = 1_000_000_000
DOCUMENTS = 3
TERMS = 200
#: counts from which on the product with SHARE needs more than 64 bits
LARGE = 9_000_000_000
#: bytes of a text counted at once, distinct terms of all groups that a task holds, nodes of a tree
SLICE, HELD, NODES = 1 << 20, 500_000, 1 << 19
#: two counts in one integer: a task holds fewer documents and occurrences than this at once
BOTH = 1 << 31
#: bytes of terms keep their value, A-Z lowered; all others become blanks
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in slices, cut between terms."""
    first = 0
    while first < len(text):
        part = text[first:first + SLICE].translate(_TERM)
        first += len(part)
        if first < len(text) and (last := part.rfind(b" ")) > 0:
            first -= len(part) - last
            part = part[:last]
        elif first < len(text):  # one term longer than a slice
            end = first
            while end < len(text) and _TERM[text[end]] != 32:
                end += 1
            part += text[first:end].translate(_TERM)
            first = end
        yield part.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of terms by language and source; a null term stands for the group itself."""
    names = ["lang", "source", "term", "n", "docs"]
    groups: dict[tuple, dict[bytes, int]] = {}  # occurrences times BOTH plus documents

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in groups.items():
            n, docs = np.divmod(np.array([0, *counts.values()], dtype=np.int64), BOTH)
            same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([x])).cast(pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, pa.array([None, *counts], pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], names)

    for b in blocks(batches, "text"):
        for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source"))):
            counts = groups.setdefault((lang, source), {})
            own: Counter = Counter()
            for some in terms(text.encode()):
                own.update(some)
            for w, n in own.items():
                counts[w] = counts.get(w, 0) + n * BOTH + 1
        if sum(map(len, groups.values())) > HELD:
            yield from emit()
            groups = {}
    yield from emit()


def _value(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two share columns, at most SHARE^2 and so within 64 bits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _share(n: Column, total: Column, size: Column) -> Column:
    """Share of ``n`` among ``total`` occurrences and ``size`` terms; wide where a product would leave 64 bits."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(SHARE).cast("decimal(10,0)")
    near = F.call_function("div", (n + 1) * SHARE, total + size)
    return 1 + F.when(n < LARGE, near).otherwise(F.call_function("div", wide, (total + size).cast("decimal(20,0)")))


class Tree:
    """A frequent-pattern tree of rows that arrive in order: ``source``, ``share`` and
    ``base`` (the share of a missing term) of each node, its ``parent`` and ``count``."""

    def __init__(self, length: np.ndarray, source: np.ndarray, share: np.ndarray, base: np.ndarray, times: np.ndarray):
        begin = np.concatenate([[0], np.cumsum(length)])
        depth = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
        row = np.repeat(np.arange(len(length)), length)
        # an item equals the one above it in the row before where all before it do too
        above = np.maximum(begin[row - 1] + depth, 0)
        there = (row > 0) & (depth < length[row - 1])
        same = there & (source == source[np.where(there, above, 0)]) & (share == share[np.where(there, above, 0)])
        alike = np.cumsum(np.concatenate([[0], ~same]))
        same &= alike[1:] == alike[begin[row]]
        # each item's node: its own, or that of the item above it
        own = np.flatnonzero(~same)
        node = np.full(len(source), -1)
        node[own] = np.arange(len(own))
        for d in range(int(length.max()) if len(length) else 0):
            at = np.flatnonzero((depth == d) & same)
            head = np.flatnonzero((depth == d) & ~same)
            node[at] = node[head[np.searchsorted(head, at) - 1]]
        self.source, self.share, self.base = source[own], share[own], base[own]
        self.parent = np.where(depth[own] > 0, node[np.maximum(own - 1, 0)], -1)
        self.count = np.zeros(len(own), np.int64)
        np.add.at(self.count, node, times[row])

    def corrections(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For all nodes and their ancestors, one generation after the other: source of the
        node and of the ancestor, and the corrections of that pair and of its reverse."""
        node, up = np.arange(len(self.parent)), self.parent
        while True:
            on = up >= 0
            node, up = node[on], up[on]
            if not len(node):
                return
            p, p0, q, q0, m = self.share[node], self.base[node], self.share[up], self.base[up], self.count[node]
            yield self.source[node], self.source[up], m * _both(p, p0, q, q0), m * _both(q, q0, p, p0)
            up = self.parent[up]


def _both(p: np.ndarray, p0: np.ndarray, q: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """What a term that both sources have adds to the base and the corrections of either."""
    f = lambda a, b: (a - b) * (a - b) // b
    return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of language and path: the corrections of each pair of sources."""
    total: dict[tuple, int] = {}

    def grow(lang: str, b: pa.RecordBatch) -> None:
        path = b.column("path")
        items = path.flatten()
        name, source = np.unique(np.array(items.field("source").to_pylist(), dtype=object), return_inverse=True)
        tree = Tree(np.diff(path.offsets.to_numpy()).astype(np.int64), source.reshape(-1), *(items.field(c).to_numpy() for c in ("share", "base")), b.column("times").to_numpy())
        sums: dict[int, int] = {}
        for x, y, one, other in tree.corrections():
            for key, value in ((x * len(name) + y, one), (y * len(name) + x, other)):
                order = np.argsort(key, kind="stable")
                met, first = np.unique(key[order], return_index=True)
                # a source's shares add up to SHARE and one for each term, which bounds all sums by some SHARE^2
                for k, v in zip(met.tolist(), np.add.reduceat(value[order], first).tolist() if len(met) else []):
                    sums[k] = sums.get(k, 0) + v
        for k, v in sums.items():
            pair = (lang, name[k // len(name)], name[k % len(name)])
            total[pair] = total.get(pair, 0) + v

    for batch in batches:
        lang = batch.column("lang").to_pylist()
        size = np.cumsum(np.diff(batch.column("path").offsets.to_numpy()))
        first = 0
        for i in range(1, len(lang) + 1):
            if i == len(lang) or lang[i] != lang[first] or size[i] - (size[first - 1] if first else 0) > NODES:
                grow(lang[first], batch.slice(first, i - first))
                first = i
        if len(total) > HELD:
            yield _pairs(total)
            total = {}
    yield _pairs(total)


def _pairs(total: dict[tuple, int]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in total], pa.string()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(total.values(), pa.int64())], ["lang", "source", "item", "value"])


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents: int = DOCUMENTS, ranks: int = TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources by divergence (``pair``),
    and the ``ranks`` terms that part a source most from its language (``term``)."""
    d = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    found = d.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # one deal by term serves both sums; the row without a term lists a language's groups. Terms come first in
    # the keys, since a sort by them can tell most by their leading bytes; only rows that stay are put in order
    by_term = found.repartition("lang", "term").groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).groupBy("term", "lang")
    rows = by_term.agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("row"))
    rows = rows.where((F.col("docs") >= documents) | F.col("term").isNull())
    rows = written(rows.select("lang", "term", "all", F.sort_array("row").alias("row")), "rows")
    kept = rows.where("term IS NOT NULL")
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("all").alias("whole"))
    totals = kept.select("lang", F.inline("row")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seen = rows.where("term IS NULL").select("lang", F.inline("row")).select("lang", "source")
    groups = seen.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups.withColumn("base", F.when(F.col("size") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("size")))), "groups")

    # a term's row becomes its path: the shares of the sources that have it
    known = groups.groupBy("lang", "size", "whole").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "base")))).alias("of"))
    met = lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), F.col("of")[x["source"]].alias("group"))
    item = lambda x: F.struct(x["source"].alias("source"), _share(x["n"], x["group"]["total"], F.col("size")).alias("share"), x["group"]["base"].alias("base"))
    shares = kept.join(known, "lang").select("lang", "term", _share(F.col("all"), F.col("whole"), F.col("size")).alias("of_lang"), F.transform(F.transform("row", met), item).alias("path"))
    shares = written(shares, "shares")
    cells = shares.select("lang", "term", "of_lang", F.inline("path"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = cells.where("share > of_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _value("share", "of_lang").alias("value"))
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= ranks)

    a = groups.select("lang", "source", "size", F.col("base").alias("p"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("q"))
    wide = lambda c: c.cast("decimal(38,0)")
    pairs = a.join(b, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(wide(F.col("size")) * wide(_value("p", "q")), wide(F.lit(0))).cast("decimal(38,0)").alias("value"))
    singles = cells.groupBy("lang", "source", "share", "base").agg(F.count("*").alias("m"))
    against = singles.join(b.withColumnRenamed("q", "other"), "lang").where("source <> item")
    of_own = against.select("lang", "source", "item", (wide(F.col("m")) * wide(_value("share", "other") - _value("base", "other"))).cast("decimal(38,0)").alias("value"))
    of_other = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (wide(F.col("m")) * wide(_value("other", "share") - _value("other", "base"))).cast("decimal(38,0)").alias("value"))

    paths = shares.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times"))
    dealt = written(paths, "paths").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    tree = dealt.mapInArrow(_corrected, "lang string, source string, item string, value long").withColumn("value", F.col("value").cast("decimal(38,0)"))

    summed = base.unionByName(of_own).unionByName(of_other).unionByName(tree).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pair = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pair.unionByName(own)
