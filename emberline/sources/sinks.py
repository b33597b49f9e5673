"""Writers: GeoJSON, export by suffix, backup, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def geojson_features(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """A GeoJSON feature for each row, as JSON text; the other columns are its properties."""
    rest = [c for c in df.columns if c not in (longitude, latitude)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(longitude, 5), F.round(latitude, 5)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def feature_collection(page: DataFrame, total: int, limit: int) -> str:
    """A page of at most ``limit`` rows as a FeatureCollection with total_count, returned_count and truncated (the page, not the table, comes to the driver)."""
    features = [r["feature"] for r in geojson_features(page.limit(limit)).collect()]
    head = f'{{"type":"FeatureCollection","total_count":{total},"returned_count":{len(features)},"truncated":{str(total > len(features)).lower()}'
    return f'{head},"features":[{",".join(features)}]}}'


def export(df: DataFrame, path: str) -> None:
    """Writes Parquet, CSV or JSON as the path's suffix says; another suffix is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "csv", "json"):
        raise ValueError("a path ends in .parquet, .csv or .json")
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if suffix == "csv" else getattr(writer, suffix)(path)


def backup(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Copies every table and returns table and n_rows of the copies."""
    counts = None
    for name, df in sorted(tables.items()):
        place = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(place)
        part = spark.read.parquet(place).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts


def run_record(spark: SparkSession, run: str, counts: dict[str, int], status: str) -> DataFrame:
    """One row of the ingestion ledger."""
    return spark.createDataFrame([(run, counts.get("read", 0), counts.get("inserted", 0), counts.get("updated", 0), counts.get("failed", 0), status)], "run_id string, n_read long, n_inserted long, n_updated long, n_failed long, status string")
