"""Terms of Arrow texts counted by group, without a Python loop over tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that a task looks at together, and counts that it passes on together
BLOCK_BYTES, PASSED_ROWS = 8 << 20, 1 << 16

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_WORD = _DIGIT.copy()
_WORD[ord("a"):ord("z") + 1] = True


def token_strings(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Matches of ``TOKEN_PATTERN`` in lower-cased texts, in order, and the row of each. Nulls
    have none; other texts have to end with a blank, so that no run goes on in the next one.

    A run of letters and digits takes a dot and the digits behind it. Digits taken so are no
    longer free: in 1.2.3 the run 2 belongs to 1.2, and 3 stands alone."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset:]
    start, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[start:end] if end > start else np.zeros(0, np.uint8)
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[0] = False
    np.take(_WORD, data, out=inside[1:], mode="clip")
    first, last = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    inside = inside[1:]
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(first, offsets - start)))

    # links: runs before a dot and a digit
    link = np.flatnonzero(first[1:] == last[:-1] + 1)
    link = link[(data[last[link]] == ord(".")) & _DIGIT[data[first[link + 1]]]]
    if len(link):
        first, last = first.copy(), last.copy()
        stop = _past_digits(data, first[link + 1])
        # a run that the link before takes as a whole has no link of its own: such links hold in turn
        bound = np.concatenate([[False], (link[1:] == link[:-1] + 1) & (stop[:-1] == last[link[:-1] + 1])])
        turn = np.arange(len(link))
        holds = (turn - np.maximum.accumulate(np.where(bound, 0, turn))) % 2 == 0
        link, stop = link[holds], stop[holds]
        inside[last[link]] = True
        last[link] = stop
        first[link + 1] = stop
        some = last > first
        first, last, row = first[some], last[some], row[some]
    ends = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(last - first, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside])), row


def _past_digits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the digits that begin at each place end; the last byte is none."""
    stop, going = at + 1, np.arange(len(at))
    for _ in range(32):
        going = going[_DIGIT[data[stop[going]]]]
        stop[going] += 1
    if len(going):
        other = np.flatnonzero(~_DIGIT[data])
        stop[going] = other[np.searchsorted(other, stop[going])]
    return stop


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _block_counts(group: np.ndarray, sign: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """group, term, df and cf of some rows; the null term counts rows and tokens."""
    strings, row = token_strings(texts)
    coded = strings.dictionary_encode()
    bits = np.int64(len(coded.dictionary).bit_length())
    mask = (np.int64(1) << bits) - 1
    pair = np.sort(row << bits | coded.indices.to_numpy())
    begin = _runs(pair)
    often = np.diff(np.append(begin, len(pair)))
    pair = pair[begin]
    at = pair >> bits
    key = group[at] << bits | pair & mask
    order = np.argsort(key)
    key, df = key[order], sign[at][order]
    cf = df * often[order]
    begin = _runs(key)
    if len(begin):
        df, cf = np.add.reduceat(df, begin), np.add.reduceat(cf, begin)
    of, term = key[begin] >> bits, key[begin] & mask
    terms = pa.concat_arrays([coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.nulls(len(group), pa.string())])
    whole = sign * np.bincount(row, minlength=len(group))
    return np.concatenate([of, group]), terms, np.concatenate([df, sign]), np.concatenate([cf, whole])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (string columns that name a group, sign, text as for ``token_strings``) -> the group's columns,
    term, df, cf. Equal ones are added up within a block of texts; the caller adds up the blocks."""
    for batch in batches:
        *parts, sign, texts = batch.columns
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault(k, len(groups)) for k in zip(*[p.to_pylist() for p in parts])], dtype=np.int64)
        signs = sign.to_numpy(zero_copy_only=False).astype(np.int64)
        values = [pa.array(c, pa.string()) for c in zip(*groups)]
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_BYTES, "right")))
            of, term, df, cf = _block_counts(group[first:last], signs[first:last], texts.slice(first, last - first))
            out = pa.RecordBatch.from_arrays([*[v.take(pa.array(of)) for v in values], term, pa.array(df), pa.array(cf)], names=[*batch.schema.names[:-2], "term", "df", "cf"])
            for at in range(0, out.num_rows, PASSED_ROWS):
                yield out.slice(at, PASSED_ROWS)
            first = last
