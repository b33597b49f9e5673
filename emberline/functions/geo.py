"""Distances, grid cells and tiles."""

from __future__ import annotations

from math import degrees, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.config import EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _columns(row: Column, height: float, radius: float) -> Column:
    """How many cells go round the globe in a row, each at least as wide as the radius anywhere in this row and its neighbours; one at the poles."""
    top = F.greatest(F.abs(row - 1), F.abs(row + 2)) * height
    reach = F.sin(F.lit(radius)) / F.cos(F.radians(F.least(top, F.lit(90.0))))
    return F.when((top >= 90 - height) | (reach >= 1), 1).otherwise(F.floor(F.lit(360.0) / (F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.000001))).cast("long")


def _place(lat: Column, lon: Column, radius_m: float) -> tuple[Column, float, float, Column]:
    radius = radius_m / EARTH_RADIUS_M
    height = degrees(radius) * 1.000001
    return F.floor(lat / height).cast("long"), height, radius, (lon + 180) / 360


def with_cell(df: DataFrame, radius_m: float) -> DataFrame:
    """``df`` with the grid cell of each point: a row of latitude as high as the radius (cy), and a column whose width is that row's own (cx); columns close at 180 degrees."""
    row, height, radius, share = _place(F.col("latitude"), F.col("longitude"), radius_m)
    out = df.withColumn("cy", row).withColumn("_n", _columns(F.col("cy"), height, radius))
    return out.withColumn("cx", F.pmod(F.floor(share * F.col("_n")).cast("long"), F.col("_n"))).drop("_n")


def dealt_around(df: DataFrame, radius_m: float) -> DataFrame:
    """``df`` with a row for every cell (cy, cx) that holds points within the radius of a point, each once.

    What a row of latitude needs is worked out once for that row, not for each of its cells.
    """
    row, height, radius, share = _place(F.col("latitude"), F.col("longitude"), radius_m)
    rows = df.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("cy", row + F.col("_i"))
    rows = rows.withColumn("_n", _columns(F.col("cy"), height, radius)).withColumn("_at", F.floor(share * F.col("_n")).cast("long"))
    beside = F.array_distinct(F.array(*[F.pmod(F.col("_at") + j, F.col("_n")) for j in (-1, 0, 1)]))
    return rows.withColumn("cx", F.explode(beside)).drop("_i", "_n", "_at")


def dealt_blocks(df: DataFrame, side_m: float, reach_m: float) -> DataFrame:
    """``df`` with a row for every block (cy, cx) that holds points within the reach of a point, each once; ``own``: the point's own block.

    Blocks are the cells of a grid of wider side: few points are near to another block.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    row, height, radius, share = _place(lat, lon, side_m)
    reach = reach_m / EARTH_RADIUS_M
    up = degrees(reach) * 1.000001
    wide = F.degrees(F.asin(F.least(F.lit(sin(reach)) / F.cos(F.radians(lat)), F.lit(1.0)))) * (1.000001 / 360)
    rows = df.withColumn("_wide", wide).withColumn("_row", row).withColumn("cy", F.explode(F.array_distinct(F.array(F.col("_row"), *[F.floor((lat + d) / height).cast("long") for d in (-up, up)]))))
    rows = rows.withColumn("_n", _columns(F.col("cy"), height, radius))
    at = [F.pmod(F.floor((share + d) * F.col("_n")).cast("long"), F.col("_n")) for d in (F.lit(0.0), -F.col("_wide"), F.col("_wide"))]
    out = rows.withColumn("_at", at[0]).withColumn("cx", F.explode(F.array_distinct(F.array(F.col("_at"), *at[1:]))))
    return out.withColumn("own", (F.col("cy") == F.col("_row")) & (F.col("cx") == F.col("_at"))).drop("_wide", "_row", "_n", "_at")


def tile_id(lat: Column, lon: Column, step: int = 3) -> Column:
    """The name of the tile by its south-west corner; null from 89 degrees on."""
    south, west = (F.floor(c / step) * step for c in (lat, lon))
    name = F.concat(F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0"))
    return F.when(F.abs(lat) < 89, name)


def window_bounds(lat: Column, lon: Column) -> dict[str, Column]:
    """The box of 2 km around a point."""
    dlat, dlon = F.lit(1000 / 111_320), F.lit(1000.0) / (F.lit(111_320.0) * F.cos(F.radians(lat)))
    return {"south": lat - dlat, "north": lat + dlat, "west": lon - dlon, "east": lon + dlon}
