"""A snapshot of rows by key, dealt to buckets, of which a change rewrites only those that it touches; and loads by a cursor over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions.scalars import _c

_MANIFEST = "version bigint, batch string, bucket int, folder string, mark timestamp_ntz"


@dataclass(frozen=True)
class KeyedTable:
    """Rows (``schema``) by ``key`` under ``path``, in ``buckets`` by the hash of the key.

    Each change writes new folders for the buckets that it touches and then appends one small file to the
    manifest, which says which folder counts for each bucket: the append is what makes a change count, so a job
    that is lost before it changes nothing, and one with a batch name that the manifest knows does nothing. One
    writer at a time. Folders that no longer count stay for readers that have begun.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "id"
    buckets: int = 64

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], _MANIFEST)

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows; at most ``buckets`` of them."""
        last = self._manifest().where("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "version").alias("folder"))
        return {r.bucket: r.folder for r in last.collect()}

    def mark(self):
        """The highest mark that a change has left, None before the first."""
        return self._manifest().agg(F.max("mark")).first()[0]

    def bucket_of(self, c: Column | str) -> Column:
        return F.pmod(F.xxhash64(_c(c)), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def rows(self) -> DataFrame:
        return self._read([f for _, f in sorted(self.folders().items())])

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], batch: str, mark: Column | None = None) -> list[int]:
        """Puts ``apply(rows, changes)`` in place of the rows of the buckets that ``changes`` touch, and returns these buckets.

        ``changes`` are read twice and should be a stored table; ``mark`` is an aggregate over them. A batch
        that is in the manifest already changes nothing. Rows that ``apply`` gives keep to the touched buckets.
        """
        manifest = self._manifest()
        if not manifest.where(F.col("batch") == batch).isEmpty():
            return []
        touched = sorted(r[0] for r in changes.select(self.bucket_of(self.key)).distinct().collect())
        if not touched:
            return []
        now, version = self.folders(), (manifest.agg(F.max("version")).first()[0] or 0) + 1
        new = apply(self._read([now[b] for b in touched if b in now]), changes).select(*self.schema.names)
        folder = f"data-{version}-{uuid.uuid4().hex}"
        new.withColumn("_bucket", self.bucket_of(self.key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        # A bucket whose rows have all gone has no folder of its own; it points to an empty one.
        self.spark.createDataFrame([], self.schema).write.parquet(f"{self.path}/{folder}-none")
        held = {r[0] for r in self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()}
        said = [(version, batch, b, f"{folder}/_bucket={b}" if b in held else f"{folder}-none") for b in touched]
        entry = self.spark.createDataFrame(said, "version bigint, batch string, bucket int, folder string")
        high = changes.agg(mark).first()[0] if mark is not None else None
        entry.withColumn("mark", F.lit(high).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched


def latest(rows: DataFrame, changes: DataFrame, key: str, modified: str) -> DataFrame:
    """Of the rows of each key, old and new, the one that was modified last; of equal times that of ``changes``."""
    both = rows.withColumn("_new", F.lit(False)).unionByName(changes.select(*rows.columns).withColumn("_new", F.lit(True)))
    return both.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(modified, "_new")).alias("_row")).select("_row.*")


def load_changes(source: DataFrame, table: KeyedTable, modified: str, batch: str, overlap: str = "INTERVAL 5 MINUTES", store: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Merges the rows that were modified since the last load into ``table``, and returns how many buckets that touched.

    The cursor is the latest ``modified`` (timestamp_ntz) of all loads. Rows up to ``overlap`` before it are read
    again, since a source may show changes late; as rows are merged by key, that doubles nothing. The condition
    reaches the source's scan. ``store`` writes the rows that were read, so that the source is read once.
    """
    since = table.mark()
    fresh = source if since is None else source.where(F.col(modified) > F.lit(since) - F.expr(overlap))
    return len(table.change(store(fresh), lambda rows, changes: latest(rows, changes, table.key, modified), batch, F.max(modified)))
