"""BPE encoding by tree concatenation.

A long text is cut in halves, again and again, the leaves are encoded in parallel
and their encodings joined pair by pair. A cut may go through a word, a character
sequence that normalises as one, or a special token; so each join encodes a window
around the cut anew and grows it until, on both sides, it agrees with the halves
over several tokens. From there on the halves' tokens stand.

Between tasks the tree has leaves of ``LEAF_CHARS`` characters. White space always
ends a token, so that a leaf is final between its first and last blank; the rims
around a cut are the window there, and grow over whole leaves that hold no blank.
Inside a task a rim or word without blanks that is longer than ``UNSPLIT_CHARS`` is
encoded as a tree of its own with windows of tokens.

Null texts are empty and have no ids. Rows are encoded one by one, so repeated rows
and null ids keep theirs; empty tables give empty results; only key and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks

LEAF_CHARS = 16_384
UNSPLIT_CHARS = 4_096
WINDOW_CHARS = 64
#: consecutive tokens that must agree on either side of a join
AGREE = 3
#: bytes of text whose words are looked up together
ENCODED_BYTES = 4 << 20
#: words remembered by a task, twice that at most
REMEMBERED = 120_000
#: blanks that end tokens for certain; other white space goes to the tokenizer
BLANKS = re.compile("[ \n]")
#: a word of Latin letters, then marks that cannot begin a contraction
SIMPLE = re.compile(r"(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)")

#: how the tokenizer's byte level writes the two UTF-8 bytes of those letters
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(0x100) if b not in _PRINTED]
BYTE_SIGNS = {c: "".join(chr(b if b in _PRINTED else 0x100 + _HIDDEN.index(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}

#: how a tokenizer prepares texts whose words can be encoded one by one: normaliser and pre-tokenizer
PREPARED = (
    'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
    """Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""")

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, starts, ends


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokens(tok, text: str, at: int = 0) -> Tokens:
    e = tok.encode(text, add_special_tokens=False)
    spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
    return np.array(e.ids, dtype=np.uint32), spans[:, 0], spans[:, 1]


def _runs(t: Tokens, first: int, last: int) -> tuple[list, dict]:
    """The tokens from position ``first`` to ``last`` as triples, and where runs of AGREE of them begin."""
    lo, hi = int(np.searchsorted(t[1], first, "left")), int(np.searchsorted(t[2], last, "right"))
    triples = list(zip(t[0][lo:hi].tolist(), t[1][lo:hi].tolist(), t[2][lo:hi].tolist()))
    return triples, {tuple(triples[i:i + AGREE]): lo + i for i in range(len(triples) - AGREE + 1)}


def joined(tok, text: str, cut: int, left: Tokens, right: Tokens) -> Tokens:
    """Tokens of ``text`` from those of both sides of ``cut``."""
    n, width = len(text), WINDOW_CHARS
    while True:
        a, b = max(0, cut - width), min(n, cut + width)
        win = tokens(tok, text[a:b], a)
        triples = list(zip(*(x.tolist() for x in win)))
        begin, kept = (0, 0) if a == 0 else (None, 0)
        end, rest = (len(triples), len(right[0])) if b == n else (None, 0)
        if begin is None:
            _, there = _runs(left, a + 1, cut)
            for k in range(len(triples) - AGREE + 1):
                if (p := there.get(tuple(triples[k:k + AGREE]))) is not None:
                    begin, kept = k + AGREE, p + AGREE
                    break
        if end is None:
            _, there = _runs(right, cut, b - 1)
            for k in range(len(triples) - AGREE, -1, -1):
                if (p := there.get(tuple(triples[k:k + AGREE]))) is not None:
                    end, rest = k, p
                    break
        if begin is not None and end is not None and begin <= end:
            return tuple(np.concatenate([x[:kept], w[begin:end], y[rest:]]) for x, w, y in zip(left, win, right))
        if a == 0 and b == n:
            return win
        width *= 2


def tree(tok, text: str, leaf: int = UNSPLIT_CHARS, at: int = 0) -> Tokens:
    """Tokens of ``text``: halves first, then their join."""
    if len(text) <= leaf:
        return tokens(tok, text, at)
    cut = len(text) // 2
    left, right = tree(tok, text[:cut], leaf), tree(tok, text[cut:], leaf)
    right = (right[0], right[1] + cut, right[2] + cut)
    ids, starts, ends = joined(tok, text, cut, left, right)
    return ids, starts + at, ends + at


class Memory(dict):
    """Values by key; of those used since the last ``trim``, the latest ``most`` outlast it, in ``older``."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Keys without a value; those known from earlier are taken over."""
        older, out = self.older, []
        for k in keys:
            if k not in self:
                if (value := older.get(k)) is not None:
                    self[k] = value
                else:
                    out.append(k)
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(islice(self.items(), len(self) - self.most, None))
            self.clear()


class Encoder:
    """Ids of texts, with a bounded memory of words seen lately.

    A simple word is its letters, in lower case, and its marks; letters go to the
    library's BPE model as they are, everything else through the whole tokenizer. That
    holds for tokenizers that prepare texts like the word vocabulary; others get whole texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tok = tokenizer(path)
        self.model = self.tok.model
        self.by_words = (str(self.tok.normalizer), str(self.tok.pre_tokenizer)) == PREPARED
        self.words, self.letters, self.marks = Memory(remembered), Memory(2 * remembered), Memory(remembered)

    def _letters(self, text: str) -> bytes:
        signs = text if text.isascii() else text.translate(BYTE_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _whole(self, text: str) -> bytes:
        if len(text) > UNSPLIT_CHARS:
            return tree(self.tok, text)[0].astype("<u4").tobytes()
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _known(self, memory: Memory, distinct: pa.Array, make: Callable[[str], bytes]) -> list[bytes]:
        keys = distinct.to_numpy(zero_copy_only=False).tolist()
        for k in memory.missing(keys):
            memory[k] = make(k)
        return [memory[k] for k in keys]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return self.column(pa.array(texts, pa.string())).to_pylist()

    def column(self, texts: pa.Array) -> pa.Array:
        """Ids of a column of texts without nulls. Words are looked up once each, and
        then a text's ids gathered from those of its words' letters and marks."""
        if not self.by_words:
            return pa.array([self._whole(t) for t in texts.to_pylist()], pa.binary())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        parts = pc.extract_regex(words, pattern=f"^{SIMPLE.pattern}$")
        simple = pc.and_(parts.is_valid(), pc.less_equal(pc.utf8_length(words), UNSPLIT_CHARS))
        letters = pc.utf8_lower(parts.field("letters").filter(simple)).dictionary_encode()
        marks = parts.field("marks").filter(simple).dictionary_encode()
        known = [self._known(self.letters, letters.dictionary, self._letters), self._known(self.marks, marks.dictionary, self._whole), self._known(self.words, words.filter(pc.invert(simple)), self._whole)]
        pieces = [b"", *known[0], *known[1], *known[2]]
        blob, size = np.frombuffer(b"".join(pieces), np.uint32), np.array([len(x) // 4 for x in pieces])
        start = np.cumsum(size) - size
        # the two pieces of each word
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        first[is_simple] = 1 + letters.indices.to_numpy()
        second[is_simple] = 1 + len(known[0]) + marks.indices.to_numpy()
        first[~is_simple] = 1 + len(known[0]) + len(known[1]) + np.arange(len(known[2]))
        row = np.stack([first[which], second[which]], axis=1).reshape(-1)
        n = size[row]
        ends = np.append(0, np.cumsum(n))
        ids = blob[np.repeat(start[row] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = (ends[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())] * 4).astype(np.int32)
        for memory in (self.words, self.letters, self.marks):
            memory.trim()
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", ENCODED_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("key"), encoder(path).column(b.column("text"))], ["key", "ids"])

    return run


def _leaves(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            keys, rows, no, out = b.column("key"), [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                cuts = [text[p:p + size] for p in range(0, len(text), size)]
                rows += [i] * len(cuts)
                no += range(len(cuts))
                out += cuts
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(take), keys.take(take), pa.array(no, pa.int32()), pa.array(out, pa.string())], ["row", "key", "leaf", "text"])

    return run


def _encoded_leaves(path: str):
    """A leaf's first rim, the final ids inside, and its last rim; a leaf without blanks is all rim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", ENCODED_BYTES):
            heads, inner, tails = [], [], []
            for text in b.column("text").to_pylist():
                m = BLANKS.search(text) if encoder(path).by_words else None
                if m is None:
                    heads.append(text), inner.append(None), tails.append("")
                    continue
                last = max(text.rfind(" "), text.rfind("\n"))
                heads.append(text[:m.start()]), inner.append(text[m.start():last]), tails.append(text[last + 1:])
            ids = encoder(path).column(pa.array([x or "" for x in inner], pa.string()))
            inside = pc.if_else(pc.is_null(pa.array(inner, pa.string())), None, ids)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("leaf"), pa.array(heads, pa.string()), inside, pa.array(tails, pa.string())], ["row", "key", "leaf", "head", "inside", "tail"])

    return run


def _concatenated(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf")
        rims, inner, rim = [], [], []
        for head, inside, tail in zip(pdf["head"], pdf["inside"], pdf["tail"]):
            rim.append(head)
            if inside is not None:
                rims.append("".join(rim))
                inner.append(bytes(inside))
                rim = [tail]
        coded = encoder(path).encode([*rims, "".join(rim)])
        whole = b"".join(x for pair in zip(coded, inner) for x in pair) + coded[-1]
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "ids": [whole]})

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``key`` and ``ids`` (binary, little-endian 32-bit) of every row of ``docs``.

    Texts up to ``leaf_chars`` are encoded where they stand. Longer ones are dealt
    out leaf by leaf, so that no task has to encode a very long text alone."""
    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = d.where(F.length("text") <= leaf_chars).mapInArrow(_whole(path), f"key {kind}, ids binary")
    long = d.where(F.length("text") > leaf_chars).withColumn("row", F.monotonically_increasing_id())
    leaves = long.mapInArrow(_leaves(leaf_chars), f"row long, key {kind}, leaf int, text string").repartition("row", "leaf")
    coded = leaves.mapInArrow(_encoded_leaves(path), f"row long, key {kind}, leaf int, head string, inside binary, tail string")
    whole = coded.groupBy("row").applyInPandas(_concatenated(path), f"key {kind}, ids binary")
    return short.unionByName(whole).select(F.col("key").alias(key), "ids")


def digests(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (decimal ids) and decoded_sha256 of encoded rows."""
    kind = dict(coded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(True))]
        decimals = [str(i) for i in range(len(names))]
        for b in blocks(batches, "ids"):
            count, ids_sha, text_sha = [], [], []
            for raw in b.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u4").tolist()
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([decimals[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded(tok, names, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = coded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return d.withColumnRenamed("key", key)


def decoded(tok, names: list[str], ids: list[int]) -> str:
    """Text of ids: with a decoder its own, without one the tokens, joined by blanks."""
    return tok.decode(ids, skip_special_tokens=False) if tok.decoder is not None else " ".join([names[i] for i in ids])
