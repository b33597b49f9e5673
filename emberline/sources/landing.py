"""Readers of landed files: area CSVs, evidence CSVs, Parquet, replay JSON; batch or stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Columns of an area CSV; all are read as text.
AREA_COLUMNS = "latitude longitude bright_ti4 bright_ti5 frp scan track acq_date acq_time satellite instrument confidence version daynight".split()
AREA_SCHEMA = StructType([StructField(c, StringType()) for c in AREA_COLUMNS])


def landing_path(root: str, source: str, bbox: str, start: str) -> str:
    """Where a request's answer lies; Spark finds source, bbox and start as partition columns."""
    return f"{root.rstrip('/')}/source={source}/bbox={bbox.replace(',', '_')}/start={start}"


def read_area_csv(spark: SparkSession, path: str) -> DataFrame:
    """All records as text, with the file's columns by name."""
    return spark.read.option("enforceSchema", "false").csv(path, header=True, schema=AREA_SCHEMA)


def stream_area_csv(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New files of a landing folder as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).csv(path, header=True, schema=AREA_SCHEMA)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or an error that names what is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] = (), limit: int | None = None) -> DataFrame:
    """A Parquet table with a check of its columns; ``limit`` takes so many rows."""
    df = require_columns(spark.read.parquet(path), columns)
    return df.limit(limit) if limit is not None else df


def first_present(df: DataFrame, *names: str, default: str | None = None) -> F.Column:
    """The first of the columns that exist, row by row the first that isn't null."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


#: Files in which a line may end either way.
TEXT_SUFFIXES = ("csv", "json", "md", "py", "txt", "yaml", "yml")


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files with their SHA-256 beside the manifest's (name, sha256, and optional where there): name, found, expected, status.

    A text file is right with either kind of line end; a file that is optional may be absent (ABSENT), another not (MISSING).
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    text = F.decode("content", "ISO-8859-1")  # a byte for a character
    lf = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    ends = [F.sha2(F.encode(t, "ISO-8859-1"), 256) for t in (lf, F.replace(lf, F.lit("\n"), F.lit("\r\n")))]
    plain = F.lower(F.element_at(F.split("name", "[.]"), -1)).isin(*TEXT_SUFFIXES)
    hashed = files.select("name", F.sha2("content", 256).alias("found"), F.when(plain, F.array(*ends)).otherwise(F.array().cast("array<string>")).alias("_ends"))
    wanted = manifest.select("name", F.lower("sha256").alias("expected"), (F.col("optional") if "optional" in manifest.columns else F.lit(False)).alias("_optional"))
    both = wanted.join(hashed, "name", "left")
    right = (F.col("found") == F.col("expected")) | F.array_contains("_ends", F.col("expected"))
    return both.withColumn("status", F.when(F.col("found").isNull(), F.when(F.col("_optional"), "ABSENT").otherwise("MISSING")).when(right, "OK").otherwise("INVALID")).drop("_ends", "_optional")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Replay snapshots (one JSON object for each file), a row for each feature."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select("as_of_date", "active_sites_count", "returned_sites_count", "truncated", F.explode_outer("features").alias("f")).select("as_of_date", "active_sites_count", "returned_sites_count", "truncated", "f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))
