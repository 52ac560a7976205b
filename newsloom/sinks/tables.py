"""Stored tables with committed versions, on any file system Spark can write.

A version counts once Spark has put its ``_SUCCESS`` marker there, so a job that dies half-way
leaves the previous state in force; writing a version again replaces it, which makes retried
stream batches harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators.ranking import keep_first
from newsloom.operators.snapshots import is_success, upsert_snapshots
from newsloom.sources.tables import RESPONSES, SNAPSHOTS, column_names


def committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the committed directories ``<prefix><number>`` below ``path``, ascending."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(prefix) and name[len(prefix) :].isdigit() and fs.exists(marker):
            found.append(int(name[len(prefix) :]))
    return sorted(found)


def drop_below(spark: SparkSession, path: str, prefix: str, version: int) -> None:
    """Delete the directories ``<prefix><number>`` with numbers below ``version``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(prefix) and name[len(prefix) :].isdigit() and int(name[len(prefix) :]) < version:
            fs.delete(status.getPath(), True)


class KeyedTable:
    """The latest row per key: a base plus one delta per version, merged when read.

    A version only writes the rows it brings, never the whole table. Every ``compact_every`` versions a new
    base is written; what the base before it had made superfluous goes then (not what this one does, for
    readers that are still at it and for batches that are repeated).
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], compact_every: int = 20
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.keys = keys
        self.order = order
        self.compact_every = compact_every

    def _directory(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}{version:012d}"

    def versions(self) -> list[int]:
        return sorted({v for kind in ("base", "delta") for v in committed(self.spark, self.path, kind)})

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row per key, the last in order; map tasks send one row per key."""
        names = column_names(self.schema)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), F.struct(*self.order)).alias("_last"))
        return last.select("_last.*")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The merged table, or as it was before a version; None if it was empty."""

        def usable(kind: str) -> list[int]:
            return [v for v in committed(self.spark, self.path, kind) if before is None or v < before]

        base = (usable("base") or [None])[-1]
        paths = [self._directory("delta", v) for v in usable("delta") if base is None or v > base]
        paths += [] if base is None else [self._directory("base", base)]
        if not paths:
            return None
        return self._latest(self.spark.read.schema(self.schema).parquet(*paths))

    def write(self, rows: DataFrame, version: int) -> None:
        """Store the rows of a version; any of its keys' earlier rows no longer count."""
        rows.select(*column_names(self.schema)).write.mode("overwrite").parquet(self._directory("delta", version))
        if version % self.compact_every == 0:
            self.compact(version)

    def compact(self, version: int) -> None:
        """Write the table after ``version`` as a new base."""
        merged = self.read(version + 1)
        if merged is None or version in committed(self.spark, self.path, "base"):
            return
        before = [v for v in committed(self.spark, self.path, "base") if v < version]
        merged.write.mode("overwrite").parquet(self._directory("base", version))
        if before:
            drop_below(self.spark, self.path, "base", before[-1])
            drop_below(self.spark, self.path, "delta", before[-1] + 1)


class ChangeTable:
    """Changes of items, one directory per version, and the last version of each item."""

    LAST = "feed_url string, id string, at_us bigint, tie bigint, content_hash string"
    CHANGES = "feed_url string, id string, fetched_at timestamp, change string, content_hash string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.last = KeyedTable(spark, f"{self.path}/last", self.LAST, ["feed_url", "id"], ["at_us", "tie", "content_hash"])

    def directory(self, version: int) -> str:
        return f"{self.path}/changes/v{version:012d}"

    def changes(self) -> DataFrame:
        """All changes of committed versions."""
        versions = committed(self.spark, f"{self.path}/changes", "v")
        if not versions:
            return self.spark.createDataFrame([], self.CHANGES)
        return self.spark.read.schema(self.CHANGES).parquet(*[self.directory(v) for v in versions])


class SnapshotTable:
    """The latest body per feed: a base plus one delta per batch, merged when read.

    A batch only writes what it brought (at most two rows per feed), never the whole table;
    ``compact`` folds everything into a new base when there are many deltas, and deletes what the base
    before it had made superfluous (not what this one does, for readers that are still at it).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _directory(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}{version:012d}"

    def append(self, responses: DataFrame, version: int) -> None:
        """Store a batch: the newest write and the newest confirmation of each feed."""
        code = F.col("http_status")
        kept = responses.where(is_success(code) | (code == 304)).withColumn("_w", is_success(code))
        newest = keep_first(kept, ["feed_url", "_w"], [F.col("fetched_at").desc_nulls_last()])
        newest.select(*column_names(RESPONSES)).write.mode("overwrite").parquet(
            self._directory("delta", version)
        )

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The merged table after version ``upto`` (all versions by default)."""

        def usable(kind: str) -> list[int]:
            return [v for v in committed(self.spark, self.path, kind) if upto is None or v <= upto]

        base = (usable("base") or [None])[-1]
        deltas = [v for v in usable("delta") if base is None or v > base]
        stored = None
        if base is not None:
            stored = self.spark.read.schema(SNAPSHOTS).parquet(self._directory("base", base))
        if not deltas:
            return stored
        paths = [self._directory("delta", v) for v in deltas]
        return upsert_snapshots(stored, self.spark.read.schema(RESPONSES).parquet(*paths))

    def compact(self, version: int) -> None:
        """Write the merged table up to ``version`` as a new base."""
        bases = committed(self.spark, self.path, "base")
        merged = None if version in bases else self.read(version)
        if merged is None:
            return
        before = [v for v in bases if v < version]
        merged.write.mode("overwrite").parquet(self._directory("base", version))
        if before:
            drop_below(self.spark, self.path, "base", before[-1])
            drop_below(self.spark, self.path, "delta", before[-1] + 1)
