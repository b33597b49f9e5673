"""Keyed writes without a merge statement: the new version is a table of its own, the switch is one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.common import first_by


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key; among new rows of a key the first by ``order``."""
    fresh = first_by(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``gone``."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_from(old: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` with some columns taken from ``values`` where it has the key (once), null ones too."""
    named = values.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    return old.join(named, keys, "left").select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def changed(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that differ from the stored row of equal key in any common column (null equals null)."""
    common = [c for c in incoming.columns if c in stored.columns and c not in keys]
    differ = F.lit(False)
    for c in common:
        differ = differ | ~F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}"))
    return incoming.alias("i").join(stored.alias("s"), keys).where(differ).select(*keys, *[F.col(f"i.{c}").alias(c) for c in incoming.columns if c not in keys])


def newer(latest: DataFrame, history: DataFrame, new: DataFrame, keys: list[str], as_of: str = "as_of") -> DataFrame:
    """The rows of ``new`` that may stand in ``latest``: those whose date is not before any that ``history`` has of their key."""
    last = history.groupBy(*keys).agg(F.max(as_of).alias("_last"))
    return new.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(as_of) >= F.col("_last"))).drop("_last")


class VersionedTable:
    """Versions of a table under one folder; the file ``CURRENT`` names the one in force."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self):
        return self._path(f"{self.root}/CURRENT")

    def read(self) -> DataFrame:
        name = self.spark.read.text(f"{self.root}/CURRENT").first()[0]
        return self.spark.read.parquet(f"{self.root}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._pointer())

    def stage(self, df: DataFrame) -> str:
        """Writes a version that isn't yet in force; its name."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def switch(self, name: str) -> None:
        """Puts a written version in force by one rename; readers see the old one or the new one whole."""
        staged = self._path(f"{self.root}/.{name}")
        out = self._fs.create(staged)
        out.write(bytearray(name.encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(staged, self._pointer(), options)

    def write(self, df: DataFrame) -> str:
        """Writes a version, then makes it the one in force."""
        name = self.stage(df)
        self.switch(name)
        return name


def publish_snapshot(snapshots: DataFrame, version: str, date: str, source: str) -> DataFrame:
    """The snapshot table with a new CURRENT one; those in force before are superseded."""
    new_id = F.sha2(F.lit(f"{version}:{date}:{source}"), 256)
    old = snapshots.where(F.col("snapshot_id") != new_id).withColumn("status", F.when(F.col("status").isin("CURRENT", "REBUILDING"), "SUPERSEDED").otherwise(F.col("status")))
    new = snapshots.sparkSession.range(1).select(new_id.alias("snapshot_id"), F.lit(version).alias("version"), F.lit(date).cast("date").alias("snapshot_date"), F.lit(source).alias("source"), F.lit("CURRENT").alias("status"))
    return old.unionByName(new)
