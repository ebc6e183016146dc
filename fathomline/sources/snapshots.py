"""A keyed store as versioned, bucketed Parquet with a small numbered manifest.

Rows live in hash buckets of ``bucket_by``. A change reads and rewrites only the
buckets it touches, into a new version folder; after a check, the next manifest
(bucket -> version) makes it current. Creating a manifest fails when another
writer took the number, readers always see one whole manifest, and a lost job
leaves the previous one current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import upsert


class Manifested:
    """A folder whose current state is named by its newest numbered manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _number(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder)), default=0)

    def manifest(self) -> dict:
        """The current state; empty before the first commit."""
        n = self._number()
        return {} if n == 0 else json.loads(self.spark.read.text(f"{self.root}/manifest/{n}.json", wholetext=True).first()[0])

    def _commit(self, number: int, manifest: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/manifest/{number + 1}.json"), False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()


class SnapshotStore(Manifested):
    """The manifest maps a bucket to its version folder, so its size is bounded."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 32):
        super().__init__(spark, root)
        self.keys, self.buckets = keys, buckets
        self.bucket_by = bucket_by or keys

    # --- rows ------------------------------------------------------------------
    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int"))

    def _paths(self, manifest: dict[str, str], only: set[str] | None = None) -> list[str]:
        return [f"{self.root}/data/{v}/_bucket={b}" for b, v in manifest.items() if only is None or b in only]

    def _load(self, manifest: dict[str, str], only: set[str] | None = None) -> DataFrame | None:
        paths = self._paths(manifest, only)
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        return self._load(self.manifest())

    def lookup(self, wanted: DataFrame, on: list[str] | None = None) -> DataFrame | None:
        """Rows that match on the given columns (the keys); only the buckets
        they can lie in are read."""
        base, on = self.manifest(), on or self.keys
        only = self._touched(wanted) if set(self.bucket_by) <= set(on) else None
        now = self._load(base, only)
        return None if now is None else now.join(wanted.select(*on).distinct(), on, "left_semi")

    def _publish(self, df: DataFrame, number: int, base: dict[str, str], touched: set[str] | None) -> int:
        version = f"v{uuid.uuid4().hex}"
        path = f"{self.root}/data/{version}"
        self._bucketed(df).write.partitionBy("_bucket").parquet(path)
        kept = {} if touched is None else {b: v for b, v in base.items() if b not in touched}
        here = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("_bucket=")}
        n = 0
        if here:
            written = self.spark.read.parquet(path)
            seen = written.groupBy(*self.keys).count().agg(F.sum("count"), F.max("count")).first()
            n = seen[0]
            if seen[1] > 1:
                raise ValueError(f"version {version} refused: repeated keys")
        self._commit(number, {**kept, **{b: version for b in here}})
        return n

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` the whole content; returns its row count."""
        return self._publish(df, self._number(), {}, None)

    def _touched(self, df: DataFrame) -> set[str]:
        """Buckets of the rows: at most ``buckets`` numbers."""
        return {str(r[0]) for r in self._bucketed(df).select("_bucket").distinct().collect()}

    def upsert(self, incoming: DataFrame) -> int:
        """Merge by key; returns the rows of the rewritten buckets."""
        number, base = self._number(), self.manifest()
        touched = self._touched(incoming)
        if not touched:
            return 0
        now = self._load(base, touched)
        merged = incoming if now is None else upsert(now, incoming, self.keys).drop("_inserted", "_written")
        return self._publish(merged, number, base, touched)

    def delete(self, gone: DataFrame, on: list[str]) -> None:
        """Remove rows that match on the given columns."""
        number, base = self._number(), self.manifest()
        known = set(self.bucket_by) <= set(gone.columns)
        touched = (self._touched(gone) & set(base)) if known else set(base)
        now = self._load(base, touched)
        if now is not None:
            self._publish(now.join(gone.select(*on).distinct(), on, "left_anti"), number, base, touched)
