"""Byte-level BPE with a segment tree of pair ranks.

A text is split by the vocabulary's pattern, and each match is encoded alone: a match
that is a token itself is that token. Otherwise its bytes are the leaves of a segment
tree. The leaf at a token's first byte holds the rank of the pair that this token
makes with the next one; inner nodes hold the least rank below them with the leftmost
place that has it. A merge takes the root's pair and sets three leaves anew: the
token's own, that of its former partner, and that of the live neighbour before it. So a
merge costs the logarithm of the length, and a match of n bytes n log n.

Short matches are merged many at a time, one row of a matrix for each tree; a long one
has a tree of its own.

Texts up to ``LEAF_CHARS`` are encoded where they stand, longer ones are cut where a match
ends for certain: before white space that follows other characters, and after a letter or
number that one of another kind follows. The parts are encoded by many tasks, and a
task puts a text's ids together in their order. Only a run of characters of one kind is
never cut, since its merges may reach from one end to the other.

Null texts are empty and have no ids. Rows are encoded one by one, so repeated rows and
null ids keep theirs; empty tables give empty results; only key and text are read, so
other columns may have any name. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks

LEAF_CHARS = 65_536
#: matches remembered by a task, twice that at most, and the longest that is remembered
REMEMBERED, LONGEST = 150_000, 64
#: bytes of a match from which on it has a tree of its own
ALONE = 256
#: trees whose nodes are held at once
NODES = 1 << 20
NONE = (1 << 62) - 1

# Letters and numbers of Unicode 16 that an older character database lacks.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: what \s is in the vocabulary's pattern
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=1)
def kinds() -> tuple[str, str]:
    """All letters and all numbers, as the inside of a character class."""
    out = []
    for kind, more in (("L", LETTERS_16), ("N", NUMBERS_16)):
        codes = {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind}
        for a, b in more:
            codes.update(range(a, b + 1))
        ranges: list[list[int]] = []
        for c in sorted(codes):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges))
    return out[0], out[1]


class Splitter:
    """The vocabulary's ``pattern`` with its classes \\p{L}, \\p{N} and \\s written out.

    Texts without characters beyond U+FFFF use a pattern without these, which is faster."""

    def __init__(self, pattern: str):
        letters, numbers = kinds()
        low = [re.sub(r"\\U000[1-9a-f][0-9a-f]{4}-\\U[0-9a-f]{8}|\\U0010[0-9a-f]{4}-\\U[0-9a-f]{8}", "", x) for x in (letters, numbers)]
        self.all, self.low = (re.compile(self._written_out(pattern, *x)) for x in ((letters, numbers), low))
        cut = rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{letters}])(?=[^{letters}])|(?<=[{numbers}])(?=[^{numbers}])"
        self.cut = re.compile(cut)

    @staticmethod
    def _written_out(pattern: str, letters: str, numbers: str) -> str:
        """Inside a class the members stand alone, outside they make one."""
        out, inside, i = [], False, 0
        for part in re.split(r"(\\p\{L\}|\\p\{N\}|\\s|\\S|\[|\])", pattern):
            if part in ("[", "]"):
                inside = part == "["
                out.append(part)
            elif part in (r"\p{L}", r"\p{N}", r"\s"):
                members = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": SPACE}[part]
                out.append(members if inside else f"[{members}]")
            elif part == r"\S":
                out.append(f"[^{SPACE}]")
            else:
                out.append(part)
        return "".join(out)

    def split(self, text: str) -> list[str]:
        plain = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return (self.low if plain else self.all).findall(text)

    def parts(self, text: str, size: int) -> list[str]:
        """``text`` cut where matches end, at the first such place after each ``size`` characters."""
        out, first = [], 0
        while first < len(text):
            m = self.cut.search(text, first + size)
            last = m.start() if m else len(text)
            out.append(text[first:last])
            first = last
        return out


class Vocabulary:
    """Token bytes and their ranks, and the rank of each pair of tokens that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.longest = max(map(len, self.ranks))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {(left * self.size + right): rank for t, rank in self.ranks.items() for k in range(1, len(t))
                 if (left := self.ranks.get(t[:k])) is not None and (right := self.ranks.get(t[k:])) is not None}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.keys, self.made = np.append(self.keys, NONE), np.append(self.made, NONE)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token or a side is missing (below 0)."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], NONE)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one match, by a segment tree of its own."""
        n, ranks, longest = len(piece), self.ranks, self.longest
        size = 1 << max(1, (n - 1).bit_length())
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            """Rank and place of the pair that begins at byte ``i``."""
            middle = after[i]
            if middle >= n or (last := after[middle]) - i > longest or (rank := ranks.get(piece[i:last])) is None:
                return NONE
            return rank * size + i

        tree = [NONE] * size + [leaf(i) for i in range(n)] + [NONE] * (size - n)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] != NONE:
            i = tree[1] % size
            gone = after[i]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, NONE)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def merged_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of matches of up to ALONE bytes, all trees one step at a time."""
        count = len(pieces)
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        size = 1 << max(1, int(length.max() - 1).bit_length())
        rows = np.arange(count)
        ids = np.full((count, size + 1), -1, dtype=np.int64)  # a column of none behind the last
        ids[:, :size][np.arange(size) < length[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        place = np.arange(size)
        after = np.tile(np.minimum(place + 1, size), (count, 1))
        before = np.tile(place - 1, (count, 1))
        tree = np.full((count, 2 * size), NONE, dtype=np.int64)
        pair = self.pair_ranks(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(count, size)
        tree[:, size:] = np.where(pair == NONE, NONE, pair * size + place)
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            i = i + size
            tree[r, i] = value
            while i[0] > 1:
                value = np.minimum(value, tree[r, i ^ 1])
                i = i >> 1
                tree[r, i] = value

        live = rows
        while True:
            least = tree[live, 1]
            live, least = live[least != NONE], least[least != NONE]
            if not len(live):
                break
            i = least % size
            gone = after[live, i]
            behind = after[live, gone]
            ids[live, i] = least // size
            ids[live, gone] = -1
            after[live, i] = behind
            near = behind < size
            before[live[near], behind[near]] = i[near]
            put(live, gone, np.full(len(live), NONE))
            rank = self.pair_ranks(ids[live, i], ids[live, behind])
            put(live, i, np.where(rank == NONE, NONE, rank * size + i))
            led = np.flatnonzero(before[live, i] >= 0)
            if len(led):
                r, p = live[led], before[live[led], i[led]]
                rank = self.pair_ranks(ids[r, p], ids[r, i[led]])
                put(r, p, np.where(rank == NONE, NONE, rank * size + p))
        held = ids >= 0
        raw, ends = ids[held].astype("<u4").tobytes(), np.cumsum(held.sum(axis=1)) * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


class Encoder:
    """Ids of texts, with a bounded memory of the matches seen lately."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.split = vocabulary(path), splitter(pattern).split
        self.remembered, self.known, self.older = remembered, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.split(t) for t in texts]
        known, older = self.known, self.older
        missing = [m for m in set().union(*split) if m not in known]
        rest = []
        for m in missing:
            if (old := older.get(m)) is not None:
                known[m] = old
            else:
                rest.append(m)
        once = self._learn(rest)
        if once:
            look = lambda m: known[m] if m in known else once[m]
            out = [b"".join(map(look, s)) for s in split]
        else:
            out = [b"".join(map(known.__getitem__, s)) for s in split]
        if len(known) > self.remembered:
            self.older, self.known = known, {}
            if len(known) > 2 * self.remembered:
                self.older = {}
        return out

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        """Ids of ``matches``: short ones are remembered, long ones returned."""
        v, known, once, by_size = self.vocabulary, self.known, {}, {}
        for m in matches:
            raw = m.encode()
            into = known if len(raw) <= LONGEST else once
            if (rank := v.ranks.get(raw)) is not None:
                into[m] = rank.to_bytes(4, "little")
            elif len(raw) > ALONE:
                into[m] = np.array(v.merged(raw), dtype="<u4").tobytes()
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((m, raw, into))
        for bits, rows in by_size.items():
            step = max(1, NODES >> (bits + 1))
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                for (m, _, into), ids in zip(part, v.merged_rows([raw for _, raw, _ in part])):
                    into[m] = ids
        return once


def _coded(path: str, pattern: str, names: list[str]):
    """The text column becomes ids; the columns ``names`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for b in blocks(batches, "text", 1 << 20):
            ids = encoder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(ids, pa.binary())], [*names, "ids"])

    return run


def _parts(pattern: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            for i, text in enumerate(b.column("text").to_pylist()):
                cuts = splitter(pattern).parts(text, size)
                take = pa.array([i] * len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("key").take(take), pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.string())], ["row", "key", "part", "text"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts that arrive text by text, in order, as one row for each text."""
    row, key, held = None, None, []
    for b in batches:
        for i, (r, ids) in enumerate(zip(b.column("row").to_pylist(), b.column("ids").to_pylist())):
            if r != row:
                if held:
                    yield pa.RecordBatch.from_arrays([key, pa.array([b"".join(held)], pa.binary())], ["key", "ids"])
                row, key, held = r, b.column("key").slice(i, 1), []
            held.append(ids)
    if held:
        yield pa.RecordBatch.from_arrays([key, pa.array([b"".join(held)], pa.binary())], ["key", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``key`` and ``ids`` (binary, little-endian 32-bit) of every row of ``docs``."""
    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    short = d.where(F.length("text") <= leaf_chars).mapInArrow(_coded(path, pattern, ["key"]), f"key {kind}, ids binary")
    long = d.where(F.length("text") > leaf_chars).withColumn("row", F.monotonically_increasing_id())
    parts = long.mapInArrow(_parts(pattern, leaf_chars), f"row long, key {kind}, part int, text string").repartition("row", "part")
    coded = parts.mapInArrow(_coded(path, pattern, ["row", "key", "part"]), f"row long, key {kind}, part int, ids binary")
    whole = coded.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_together, f"key {kind}, ids binary")
    return short.unionByName(whole).select(F.col("key").alias(key), "ids")


def decode(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """Bytes of little-endian 32-bit ids."""
    return b"".join(map(vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def digests(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (ids as little-endian 32-bit integers) and decoded_sha256 of encoded rows."""
    kind = dict(coded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in blocks(batches, "ids", 1 << 20):
            raw = b.column("ids").to_pylist()
            ids_sha = [hashlib.sha256(x).hexdigest() for x in raw]
            text_sha = [hashlib.sha256(decode(v, x)).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.select(F.col(f"`{key}`").alias("key"), "ids").mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
