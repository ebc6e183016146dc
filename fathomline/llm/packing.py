"""Best-fit-decreasing packing of encoded documents into sequences.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are
packed longest first, each into the open sequence it fills best; a segment tree
over remaining capacities finds that one in logarithmic time.

Which sequence a piece goes to depends on its length only, so the choice is made
over the counts of lengths (at most ``capacity`` rows, all that reaches the driver):
pieces of equal length and sequences of equal rest move together. Every task then
looks up where the k-th piece of a length belongs.

A null or empty text is one piece that holds the end id alone. Repeated rows are
packed each; null ids are ids like others; an empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import written

BUCKETS = 64


class OpenSequences:
    """Numbers of open sequences by remaining capacity, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, rest: int, first: int, n: int) -> None:
        """``n`` sequences numbered from ``first`` have ``rest`` places left."""
        self.runs.setdefault(rest, []).append((first, n))
        self._change(rest, n)

    def _change(self, rest: int, n: int) -> None:
        i = self.size + rest
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that some open sequence has."""
        i = self.size + need
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def take(self, rest: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of capacity ``rest``: first number and count."""
        first, n = self.runs[rest].pop()
        if n > most:
            self.runs[rest].append((first + most, n - most))
            n = most
        self._change(rest, -n)
        return first, n


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The packing of ``counts`` pieces by length, and the number of sequences.

    Rows: length, rank of the first piece, pieces a sequence, first sequence, place
    in it of the first piece. Later pieces of a row follow in place and sequence."""
    tree, rows, opened = OpenSequences(capacity), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, each = capacity, capacity // length
                first, n = opened, max(1, left // each)
                opened += n
            else:
                each = rest // length
                first, n = tree.take(rest, max(1, left // each))
            put = min(left, each * n)
            rows.append((length, rank, each, first, capacity - rest))
            full, over = divmod(put, each)
            if full and rest > each * length:
                tree.add(rest - each * length, first, full)
            if over:
                tree.add(rest - over * length, first + full, 1)
            left, rank = left - put, rank + put
    return np.array(rows, dtype=np.int64).reshape(-1, 5), opened


def pieces(coded: DataFrame, capacity: int, key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Rows ``key``, piece, start, length, ids_crc32 of documents given as ``ids``.

    Columns only: a task that encodes texts needs no second Python worker to cut them."""
    width = 4 * capacity
    data = F.concat(F.coalesce(F.col("ids"), F.lit(b"")), F.lit(end_id.to_bytes(4, "little")))
    d = coded.select(F.col(key).alias("key"), data.alias("ids"))
    d = d.select("key", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.length("ids") - 1) / width).cast("int"))).alias("piece"))
    part = F.substring(F.col("ids"), F.col("piece") * width + 1, F.lit(width))
    return d.select(F.col("key").alias(key), "piece", (F.col("piece").cast("long") * capacity).alias("start"), (F.length(part) / 4).cast("long").alias("length"), F.crc32(part).alias("ids_crc32"))


def packed(cut: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: best fit over all of them.

    Full pieces need no partner and get numbers of their own. The others are
    ranked inside hash buckets of each length; the bucket counts (at most capacity x
    BUCKETS rows, hence broadcast) say where a bucket's ranks begin."""
    cut = written(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.where(F.col("length") < capacity).groupBy("length").count().collect()}
    table, opened = best_fit(counts, capacity)
    bucket = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    rest = cut.where(F.col("length") < capacity).withColumn("__bucket", bucket)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rest.groupBy("length", "__bucket").count().select("length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__bucket").orderBy(key, "piece", "ids_crc32")
    ranked = rest.withColumn("__place", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__place")).drop("__bucket", "__before", "__place")
    kind = dict(cut.dtypes)[key]
    names = [key, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the table are sorted by falling length and rising rank."""
        order = np.lexsort((table[:, 1], table[:, 0]))
        t = table[order]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(t[:, 0], [n, n + 1])
                of = length == n
                at[of] = lo + np.searchsorted(t[lo:hi, 1], rank[of], "right") - 1
            r = t[at]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(r[:, 3] + nth // r[:, 2]), pa.array(r[:, 4] + nth % r[:, 2] * length)], [*names, "sequence_id", "offset"])

    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    shared = ranked.select(*names, "__rank").mapInArrow(place, schema)
    alone = cut.where(F.col("length") == capacity).select(*names, (F.lit(opened) + F.monotonically_increasing_id()).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)
