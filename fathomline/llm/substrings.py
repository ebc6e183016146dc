"""Substring dedup: compressed FM-indexes over shards of the corpus.

A word goes when a window of ``window`` consecutive words that covers it also
starts in a document with a smaller id. Shards are cut by content: the anchor of a
window is the least-valued run of three words in it, and consecutive windows with
one anchor form a segment. Equal windows have equal anchors, so that a shard that
holds an anchor's segments holds every place of their windows, and each window is
searched in one shard only.

1. Anchors that stand in one document only are dropped.
2. Equal segments of different documents are collapsed to one with the least id. Where
   an anchor has no other segment, that id owns its windows.
3. Of the other anchors the words are fetched, once for each segment. A shard's
   segments are sorted to a Burrows-Wheeler transform in a wavelet matrix; segments
   are streamed against it by backward search, window by window, until a match is
   unique or as long as the threshold. The least id in a window's range is its owner.
4. Owners go back to the documents that hold the segments, which drop the words
   covered by windows with a smaller owner.

Words are told apart by 64-bit hashes within windows that share all other words.

Null texts have no words. A null id counts as larger than all others. Rows that
repeat an id never remove each other's words. Other columns are carried along
under their own names, whatever these are; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, written
from .words import Words, mix, run_min

WINDOW = 13
ANCHOR = 3
#: words shorter than this (bytes) make poor anchors: in all languages the frequent words are short
SHORT = 5
#: words of the segments that a shard's index holds at once, unless one anchor has more
INDEX_WORDS = 400_000
LAST = (1 << 63) - 1
_U = np.uint64


class Segments:
    """Runs of windows with one anchor in a column of texts."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = w = Words(texts)
        self.window = window
        ok = w.starts(window)
        at = np.flatnonzero(ok)
        if not len(at):
            self.first = self.count = self.doc = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.int64)
            return
        short = (w.last - w.first < SHORT).astype(np.uint64)
        n = len(w.hash) - ANCHOR + 1
        poor = sum(short[i:i + n] for i in range(ANCHOR))
        value = (poor << _U(62)) | (w.grams(ANCHOR) >> _U(2))
        least = run_min(value, window - ANCHOR + 1)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first = at[begin]  # word in the column
        self.count = np.diff(np.append(begin, len(at)))  # windows
        self.doc = w.doc[self.first]
        self.anchor = mix(least[begin]).view(np.int64)
        # hash of a segment: its windows' words, each by its place
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * _powers(len(w.hash)))])
        end = self.first + self.count + window - 1
        lead = _powers(len(w.hash) + 1, inverse=True)[self.first]
        self.hash = mix((cum[end] - cum[self.first]) * lead + self.count.astype(np.uint64)).view(np.int64)


_POWER = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(max(n, 1), _INVERSE if inverse else _POWER, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


class Wavelet:
    """Wavelet matrix over small integers: a bit vector with counts for each level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        v = values.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = (v >> b) & 1
            packed = np.zeros((len(v) // 64 + 1) * 64, dtype=np.uint8)
            packed[:len(v)] = bit
            word = np.packbits(packed, bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(word).astype(np.int64))])
            zeros = len(v) - int(bit.sum())
            self.levels.append((b, word, ones, zeros))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of each ``symbol`` before position ``at``."""
        i, base = at, np.zeros(len(at), dtype=np.int64)
        for b, word, ones, zeros in self.levels:
            hit = ((symbol >> b) & 1).astype(bool)
            r, q = self._ones(word, ones, i), self._ones(word, ones, base)
            i, base = np.where(hit, zeros + r, i - r), np.where(hit, zeros + q, base - q)
        return i - base

    @staticmethod
    def _ones(word: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (_U(1) << (i & 63).astype(np.uint64)) - _U(1)
        return ones[w] + np.bitwise_count(word[w] & mask).astype(np.int64)


class Index:
    """FM-index of sequences of symbols, exact for patterns up to ``depth``.

    ``symbols`` holds the sequences, each ended by 0. Suffixes are sorted by their
    first ``depth`` symbols, by doubling."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, have = symbols.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            step = min(have, depth - have)
            ahead = np.concatenate([rank[step:] + 1, np.zeros(step, np.int64)])
            both = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(both, kind="stable")
            s = both[order]
            new = np.zeros(n, dtype=np.int64)
            new[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            rank, have = new, have + step
        self.order = order
        top = int(symbols.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        self.tree = Wavelet(symbols[order - 1], max(1, int(top - 1).bit_length()))
        self.size = n

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns that ``symbol`` makes in front of those of the given ranges."""
        both = self.tree.occurrences(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + both[:len(low)], self.before[symbol] + both[len(low):]


def owners(texts: pa.Array, least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments given as texts with the ``least`` id that holds each: the owner
    of every window, and the first window of each segment."""
    w = Words(texts)
    _, ids = np.unique(w.hash, return_inverse=True)
    where = np.arange(len(ids)) + w.doc  # a 0 after each segment
    symbols = np.zeros(len(ids) + len(texts), dtype=np.int64)
    symbols[where] = ids + 1
    of = np.zeros(len(symbols), dtype=np.int64)
    of[where] = w.doc
    index = Index(symbols, window)
    begin = w.begin[:-1] + np.arange(len(texts))
    windows = w.count - window + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    segment = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(first[-1]) - np.repeat(first[:-1], windows) + np.repeat(begin, windows)
    owner = least[segment].copy()
    active = np.arange(len(start))
    low, high = np.zeros(len(start), np.int64), np.full(len(start), index.size, np.int64)
    for step in range(window - 1, -1, -1):
        low, high = index.extend(symbols[start[active] + step], low, high)
        more = high - low > 1  # a single place is the window itself
        active, low, high = active[more], low[more], high[more]
        if not len(active):
            return owner, first
    spans, which = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
    edges = spans.T.reshape(-1)
    by_rank = np.append(least[of[index.order]], LAST)
    owner[active] = np.minimum.reduceat(by_rank, edges)[::2][which.reshape(-1)]
    return owner, first


def _places(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            s = Segments(b.column("text"), window)
            ids = b.column("id").to_numpy(zero_copy_only=False)[s.doc]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s.anchor), pa.array(s.hash)], ["id", "anchor", "hash"])

    return run


def _segments(window: int):
    """Words of the segments whose hash is in the row's ``hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            s = Segments(b.column("text"), window)
            lists = b.column("hashes")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            wanted = _pair(owner, lists.flatten().to_numpy(zero_copy_only=False))
            at = np.flatnonzero(np.isin(_pair(s.doc, s.hash), wanted))
            ids = b.column("id").to_numpy(zero_copy_only=False)[s.doc[at]]
            data, w = s.words.data.tobytes(), s.words
            begin, end = w.first[s.first[at]], w.last[s.first[at] + s.count[at] + window - 2]
            words = [b" ".join(data[i:j].split()) for i, j in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor[at]), pa.array(s.hash[at]), pa.array(ids), pa.array(words, pa.binary())], ["anchor", "hash", "least", "words"])

    return run


def _pair(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One value for a row of a batch and a hash; one too many found costs nothing but its words."""
    return mix(value.view(np.uint64) + doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _owned(window: int):
    """Owners of the windows of a shard's segments, which arrive in order of their
    anchors; segments that own all of theirs are left out."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        least = t.column("least").to_numpy()
        owner, first = owners(t.column("words").combine_chunks().cast(pa.string()), least, window)
        smaller = np.flatnonzero(np.minimum.reduceat(owner, first[:-1]) < least)
        raw = owner.astype("<i8").tobytes()
        cut = [raw[8 * i:8 * j] for i, j in zip(first[smaller].tolist(), first[smaller + 1].tolist())]
        own = t.select(["anchor", "hash"]).take(pa.array(smaller)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(own.column(0).to_numpy()), pa.array(own.column(1).to_numpy()), pa.array(cut, pa.binary())], ["anchor", "hash", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column("anchor").to_numpy()
            edges = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            if held and held[-1].column("anchor")[-1].as_py() != anchor[0] and size > INDEX_WORDS:
                yield emit(held)
                held, size = [], 0
            sizes = np.add.reduceat(b.column("words").nbytes / b.num_rows / 6 * np.ones(b.num_rows), edges)
            begin = 0
            for e, n in zip(edges.tolist(), sizes.tolist()):
                if size > INDEX_WORDS and e > begin:
                    yield emit([*held, b.slice(begin, e - begin)])
                    held, size, begin = [], 0, e
                size += n
            held.append(b.slice(begin))
        if held:
            yield emit(held)

    return run


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the windows that a smaller id owns, for each place of a segment.

    Without owners given, the segment's least id owns all its windows."""
    for b in batches:
        ids, least = b.column("id").to_numpy(), b.column("least").to_numpy()
        marks = []
        for i, m, raw in zip(ids.tolist(), least.tolist(), b.column("owners")):
            if not raw.is_valid:
                marks.append(b"" if m < i else None)
            else:
                smaller = np.frombuffer(raw.as_buffer(), dtype="<i8") < i
                marks.append((b"" if smaller.all() else smaller.tobytes()) if smaller.any() else None)
        keep = pa.array([m is not None for m in marks])
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), pa.array(marks, pa.binary())], ["id", "hash", "marks"]).filter(keep)


def _lost(b: pa.RecordBatch, window: int) -> dict[int, np.ndarray]:
    """Which words go, for each row that has hits."""
    hit = np.flatnonzero(b.column("hits").is_valid().to_numpy(zero_copy_only=False))
    if not len(hit):
        return {}
    b = b.take(pa.array(hit))
    s = Segments(b.column("text"), window)
    bounds = np.searchsorted(s.doc, np.arange(b.num_rows + 1))
    out = {}
    for d, hits in enumerate(b.column("hits").to_pylist()):
        marks = {h["hash"]: h["marks"] for h in hits}
        delta = np.zeros(int(s.words.count[d]) + 1, dtype=np.int64)
        for k in range(bounds[d], bounds[d + 1]):
            m = marks.get(int(s.hash[k]))
            if m is not None:
                at, n = int(s.first[k] - s.words.begin[d]), int(s.count[k])
                on = at + (np.arange(n) if m == b"" else np.flatnonzero(np.frombuffer(m, dtype=bool)))
                np.add.at(delta, on, 1)
                np.add.at(delta, on + window, -1)
        out[int(hit[d])] = np.cumsum(delta)[:-1] > 0
    return out


def _kept(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            lost = _lost(b, window)
            total, gone, kept, spans = [], [], [], []
            for d, text in enumerate(b.column("text").to_pylist()):
                words = (text or "").encode().split()
                total.append(len(words))
                if d not in lost:
                    gone.append(0), kept.append(b" ".join(words).decode()), spans.append([])
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost[d].astype(np.int8), [0]])))
                spans.append([{"first": int(x), "last": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                gone.append(int(lost[d].sum()))
                kept.append(b" ".join(compress(words, ~lost[d])).decode())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                [*names, "n_words", "n_removed", "kept", "removed"])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` under ``c_`` names, n_words, n_removed, kept (the words
    left, joined by blanks) and removed (word spans)."""
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns if c != text])
    everywhere = rows.select("id", "text").mapInArrow(_places(window), "id long, anchor long, hash long")
    shared = everywhere.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    places = written(everywhere.join(shared, "anchor").select("id", "anchor", "hash"), "places")
    least = places.groupBy("anchor", "hash").agg(F.min("id").alias("least"))
    several = least.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = least.join(several, "anchor").groupBy(F.col("least").alias("id")).agg(F.collect_list("hash").alias("hashes"))
    # one deal by id, with all columns each time, serves the segments and, at the end, the documents
    dealt = rows.repartition("id")
    segments = dealt.join(wanted, "id").mapInArrow(_segments(window), "anchor long, hash long, least long, words binary")
    shards = segments.repartition("anchor").sortWithinPartitions("anchor")
    found = shards.mapInArrow(_owned(window), "anchor long, hash long, owners binary").groupBy("anchor", "hash").agg(F.max("owners").alias("owners"))
    told = least.join(found, ["anchor", "hash"], "left")
    hits = places.join(told, ["anchor", "hash"]).where("least < id OR owners IS NOT NULL").select("id", "hash", "least", "owners").mapInArrow(_flags, "id long, hash long, marks binary")
    by_id = hits.groupBy("id").agg(F.collect_list(F.struct("hash", "marks")).alias("hits"))
    names = [f"c_{c}" for c in docs.columns if c != text]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "n_words long, n_removed long, kept string, removed array<struct<first:int,last:int>>"])
    return dealt.join(by_id, "id", "left").select("text", "hits", *[F.col(f"`{c}`") for c in names]).mapInArrow(_kept(window, names), schema)
