"""Helpers that every operator of the subpackage shares, some of them the engine's own."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.common import components, cut, salted_left, shared_folder, unite

__all__ = ["components", "cut", "salted_left", "shared_folder", "unite", "table", "free_name", "with_rows", "text_of", "map_rows", "range_buckets", "bucket_of", "bucket_index", "partitions"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it, so that ``df`` has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def with_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written, with a number that no other row has, and the name of its column."""
    name = free_name(df, "_row")
    return cut(df.withColumn(name, F.monotonically_increasing_id())), name


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_rows(df: DataFrame, schema: str, rows: Callable[[dict], dict], done: Callable[[], None] | None = None) -> DataFrame:
    """Applies ``rows`` (column name to list, batch by batch) on the executors through Arrow; ``done`` is called at a task's end, so that a worker keeps no more than it needs between tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # bounds what Python holds at once
                part = batch.slice(start, 512)
                if part.num_rows:
                    out = rows(part.to_pydict())
                    yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)
        if done:
            done()

    return df.mapInArrow(run, schema)


def range_buckets(df: DataFrame, column: str, count: int) -> list:
    """Upper bounds that cut ``column`` into about ``count`` even ranges (at most ``count`` numbers come to the driver)."""
    if count < 2:
        return []
    shares = [i / count for i in range(1, count)]
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", shares, 0.25 / count)
    return sorted(set(found))


def bucket_of(column: str, bounds: list) -> Column:
    """The number of the range that a value lies in; null lies in range 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(float(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < F.col(column).cast("double"), at + step).otherwise(at))  # by halving
    return F.when(F.col(column).isNull(), 0).otherwise(below)


def bucket_index(value, bounds: list) -> int:
    """The same rule as ``bucket_of`` in Python."""
    return 0 if value is None else bisect_left(bounds, float(value))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
