"""Term statistics that follow a chunk store by signed changes.

A changed chunk gives -1 for each count it had and +1 for each it has now, so an upsert
or a delete reads the chunks it touches and never the corpus; a cell left without chunks
loses the counts it has, and the texts it held are not counted again. The sums of a batch form one
change folder; the statistics are the sums over all folders. Folders are merged so that each
holds at least ``GROWTH`` times the rows of the next: their number grows with the logarithm of
the vocabulary, and a count is rewritten as seldom.

``IndexedChunks`` changes the statistics first and the store second. A batch stopped between
the two is pending: repeated, it finishes the store alone; any other batch is refused until
then. A batch that is done changes nothing when it comes again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import BM25_EPSILON
from ..functions.termcounts import count_terms
from ..operators.postings import scope_statistics
from ..operators.scopes import PARTS, cell
from .snapshots import Manifested, SnapshotStore

GROWTH = 2
KEYS = [*PARTS, "term"]
FIELDS = (*PARTS, "raw_text")
COLUMNS = "ticker string, fiscal_year string, section string, term string, df long, cf long"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 OR cf <> 0")


def _parts() -> list[Column]:
    return [F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in PARTS]


def _counted(rows: DataFrame) -> DataFrame:
    """Counts that still have to be added up."""
    return rows.select(*_parts(), "sign", F.concat(F.lower("raw_text"), F.lit(" ")).alias("t")).mapInArrow(count_terms, COLUMNS)


def signed_counts(rows: DataFrame) -> DataFrame:
    """Rows (PARTS, raw_text, sign) -> PARTS, term, df, cf. The row without a term counts
    the chunks (df) and tokens (cf) of its cell. Null parts are '', null texts empty."""
    return _summed(_counted(rows))


class TermStatistics(Manifested):
    """Document and token counts by cell and term below one folder."""

    def __init__(self, spark: SparkSession, root: str, growth: int = GROWTH):
        super().__init__(spark, root)
        self.growth = growth

    def manifest(self) -> dict:
        """``folders`` (name, rows), the last batch ``done`` and the one ``pending``."""
        return super().manifest() or {"folders": [], "done": -1, "pending": None}

    def _read(self, folders: list) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], COLUMNS + ", kind string")
        reader = self.spark.read.schema(COLUMNS + ", kind string").option("basePath", f"{self.root}/data")
        return reader.parquet(*[f"{self.root}/data/change={name}" for name, _ in folders]).drop("change")

    def _write(self, rows: DataFrame) -> list:
        name = f"c{uuid.uuid4().hex}"
        path = f"{self.root}/data/change={name}"
        rows.withColumn("kind", F.when(F.col("term").isNull(), "cells").otherwise("terms")).write.partitionBy("kind").parquet(path)
        kinds = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("kind=")]
        n = self._read([(name, 0)]).count() if kinds else 0  # from the footers
        return [[name, n]] if n else []

    def add(self, batch: int, change: DataFrame) -> bool:
        """Make a batch's signed counts part of the statistics and the batch pending.
        False if it already is done; a pending one is not counted again."""
        now = self.manifest()
        if now["pending"] is not None and now["pending"] != batch:
            raise ValueError(f"batch {now['pending']} has not reached the store: repeat it first")
        if batch <= now["done"]:
            return False
        if now["pending"] is None:
            number = self._number()
            folders = now["folders"] + self._write(change)
            at, rows = len(folders) - 1, folders[-1][1] if folders else 0
            while at > 0 and folders[at - 1][1] < self.growth * rows:
                at -= 1
                rows += folders[at][1]
            if 0 <= at < len(folders) - 1:
                folders = folders[:at] + self._write(_summed(self._read(folders[at:])))
            self._commit(number, {"folders": folders, "done": now["done"], "pending": batch})
        return True

    def finish(self, batch: int) -> None:
        self._commit(self._number(), {"folders": self.manifest()["folders"], "done": batch, "pending": None})

    def _kind(self, kind: str) -> DataFrame:
        folders = self.manifest()["folders"]
        rows = self._read(folders).where(F.col("kind") == kind).drop("kind")
        return _summed(rows) if len(folders) > 1 else rows

    def emptied(self, moves: DataFrame) -> DataFrame | None:
        """Cells (PARTS) without a chunk after rows (PARTS, sign) came and went; None if there are none."""
        if not self.manifest()["folders"]:
            return None
        n = self.cells().select(*PARTS, "n").unionByName(moves.select(*_parts(), F.col("sign").cast("long").alias("n")))
        found, path = n.groupBy(*PARTS).agg(F.sum("n").alias("n")).where("n = 0").select(*PARTS), f"{self.root}/emptied/e{uuid.uuid4().hex}"
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        return None if found.isEmpty() else found

    def change(self, rows: DataFrame, emptied: DataFrame | None) -> DataFrame:
        """Signed counts of rows (PARTS, raw_text, sign). What ``emptied`` cells lose are the counts
        they have, so their texts are not read for it."""
        if emptied is None:
            return signed_counts(rows)
        kept = rows.select(*_parts(), "raw_text", "sign").join(emptied, list(PARTS), "left_anti")
        lost = self._read(self.manifest()["folders"]).join(emptied, list(PARTS), "left_semi")
        return _summed(_counted(kept).unionByName(lost.select(*KEYS, (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))))

    def cells(self) -> DataFrame:
        """cell, PARTS, n (chunks) and len (tokens)."""
        rows = self._kind("cells")
        return rows.select(cell(rows).alias("cell"), *PARTS, F.col("df").alias("n"), F.col("cf").alias("len"))

    def terms(self) -> DataFrame:
        """cell, PARTS, term, df and cf."""
        rows = self._kind("terms")
        return rows.select(cell(rows).alias("cell"), *KEYS, "df", "cf")

    def scopes(self) -> DataFrame:
        """Totals and idf floor of each scope, as ``postings.build`` writes them."""
        return scope_statistics(self.cells(), self.terms())

    def vocabulary(self) -> DataFrame:
        """term, df, cf and idf over all cells, as ``sparse.bm25_index`` counts them from the texts."""
        n = self.cells().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        v = self.terms().groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        raw = v.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        floor = raw.agg((F.avg("raw_idf") * BM25_EPSILON).alias("floor"))
        return raw.crossJoin(F.broadcast(floor)).select(
            "term", "df", "cf", F.when(F.col("raw_idf") < 0, F.col("floor")).otherwise(F.col("raw_idf")).alias("idf"))


class IndexedChunks:
    """A chunk store with its statistics. Batches of one writer carry rising numbers; a
    repeated batch must bring the rows it brought before, as streams do."""

    def __init__(self, store: SnapshotStore, statistics: TermStatistics):
        self.store, self.statistics = store, statistics

    def _rows(self, df: DataFrame, fields: tuple) -> Column:
        return F.struct(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in fields])

    def _signed(self, incoming: DataFrame, now: DataFrame | None, fields: tuple) -> DataFrame:
        """Old rows with -1 and new ones with +1 where an upsert changes one of the fields.
        As in the store, fields that come empty keep their value."""
        keys = self.store.keys
        new = incoming.select(*keys, self._rows(incoming, fields).alias("new"))
        if now is None:
            return new.select("new.*", F.lit(1).alias("sign"))
        both = new.join(now.select(*keys, self._rows(now, fields).alias("old")), keys, "left")
        after = F.struct(*[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in fields])
        both = both.select("old", after.alias("after")).where(~F.col("old").eqNullSafe(F.col("after")))
        pairs = F.array(F.struct(F.col("old").alias("r"), F.lit(-1).alias("sign")), F.struct(F.col("after").alias("r"), F.lit(1).alias("sign")))
        return both.select(F.explode(pairs).alias("p")).where("p.r IS NOT NULL").select("p.r.*", "p.sign")

    def _replaced(self, incoming: DataFrame) -> DataFrame:
        now = self.store.lookup(incoming)
        emptied = None if now is None else self.statistics.emptied(self._signed(incoming, now, PARTS))
        return self.statistics.change(self._signed(incoming, now, FIELDS), emptied)

    def _removed(self, now: DataFrame | None) -> DataFrame:
        if now is None:
            return self.store.spark.createDataFrame([], COLUMNS)
        rows = now.select(self._rows(now, FIELDS).alias("r"), F.lit(-1).alias("sign")).select("r.*", "sign")
        return self.statistics.change(rows, self.statistics.emptied(rows.select(*PARTS, "sign")))

    def upsert(self, batch: int, incoming: DataFrame) -> bool:
        """Merge by key; keys are unique in a batch and not null."""
        keys = self.store.keys
        bad = incoming.groupBy(*keys).count().where("count > 1 OR " + " OR ".join(f"`{k}` IS NULL" for k in keys))
        if not bad.isEmpty():
            raise ValueError(f"batch {batch} refused: repeated or null keys")
        if not self.statistics.add(batch, self._replaced(incoming)):
            return False
        self.store.upsert(incoming)
        self.statistics.finish(batch)
        return True

    def delete(self, batch: int, gone: DataFrame, on: list[str]) -> bool:
        """Remove the rows that match ``gone`` on the given columns."""
        if not self.statistics.add(batch, self._removed(self.store.lookup(gone, on))):
            return False
        self.store.delete(gone, on)
        self.statistics.finish(batch)
        return True
