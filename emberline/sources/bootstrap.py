"""Files that a store is begun with: sites, states, labels, and four tables of evidence, each by its own columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.config import LAND_COVER, STATES
from emberline.functions.normalize import event_time, no_nan, number
from emberline.sources.landing import first_present, require_columns


def numbered(df: DataFrame, column: str = "n") -> DataFrame:
    """Rows with their place in the files, from 0: places within a partition and a start for each (a number a partition comes from a count)."""
    held = df.withColumn("_i", F.monotonically_increasing_id())
    within, part = F.col("_i").bitwiseAND((1 << 33) - 1), F.shiftright("_i", 33)
    counts = held.groupBy(part.alias("_p")).agg(F.count("*").alias("_c")).collect()  # a row for each partition
    starts, at = {}, 0
    for row in sorted(counts, key=lambda r: r["_p"]):
        starts[row["_p"]], at = at, at + row["_c"]
    start = F.element_at(F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]), part) if starts else F.lit(0)
    return held.withColumn(column, within + start).drop("_i")


@dataclass(frozen=True)
class Evidence:
    """Fixed values of one table of evidence: how its ids and names begin, and what it is taken to be where it doesn't say."""

    source: str
    prefix: str
    digits: int
    kind: str
    quality: str
    name: str = ""


FACILITIES = {
    "gfmr": Evidence("WORLDBANK_GFMR", "GFMR", 5, "gas_flare", "HIGH", "Flare"),
    "gem": Evidence("GEM_GIPT", "GEM", 5, "power_plant", "EXACT", "PowerPlant"),
}
EVENTS = {
    "icar": Evidence("ICAR_IARI_CREAMS", "ICAR", 6, "crop_residue_burn", "SATELLITE_DERIVED"),
    "fsi": Evidence("FSI_FOREST_FIRE", "FSI", 6, "forest_fire", "SATELLITE_DERIVED"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with its header's columns, all as text; quoted fields may hold line breaks."""
    return spark.read.option("multiLine", "true").option("escape", '"').csv(path, header=True, inferSchema=False)


def _text(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first column that exists and isn't empty."""
    found = F.nullif(F.trim(first_present(df, *names).cast("string")), F.lit(""))
    return found if default is None else F.coalesce(found, default)


def _identity(spec: Evidence) -> Column:
    return F.format_string(f"{spec.prefix}_%0{spec.digits}d", "n")


def facility_evidence(raw: DataFrame, spec: Evidence) -> DataFrame:
    """Facilities: what is lasting. Without a readable place a row is an error of the file and stays out."""
    rows = numbered(require_columns(raw, ["latitude", "longitude"]))
    named = rows.select(
        _identity(spec).alias("evidence_id"), F.lit(spec.source).alias("source_name"),
        _text(rows, "facility_name", default=F.concat(F.lit(f"{spec.name}_"), F.col("n").cast("string"))).alias("facility_name"), _text(rows, "subclass", default=F.lit(spec.kind)).alias("facility_type"),
        number(F.col("latitude")).alias("latitude"), number(F.col("longitude")).alias("longitude"), _text(rows, "coordinate_quality", default=F.lit(spec.quality)).alias("coordinate_quality"),
        _text(rows, "source_url").alias("source_url"), F.to_json(F.struct(*[c for c in raw.columns])).alias("attributes"),
    )
    return named.where("latitude is not null and longitude is not null")


def event_evidence(raw: DataFrame, spec: Evidence) -> DataFrame:
    """Events: what has a date, and a time of day where the file has one that can be read."""
    rows = numbered(require_columns(raw, ["latitude", "longitude", "event_date"]))
    day, end = F.try_to_timestamp(_text(rows, "event_date")), F.try_to_timestamp(_text(rows, "event_end_date"))
    at = F.coalesce(event_time(day.cast("date"), _text(rows, "acq_time", default=F.lit("00:00:00"))), day)
    named = rows.select(
        _identity(spec).alias("evidence_id"), F.lit(spec.source).alias("source_name"), _text(rows, "subclass", default=F.lit(spec.kind)).alias("evidence_type"), _text(rows, "reference_id").alias("reference_id"),
        number(F.col("latitude")).alias("latitude"), number(F.col("longitude")).alias("longitude"), day.cast("date").alias("event_start"), end.cast("date").alias("event_end"), at.alias("observed_at"),
        F.lit(spec.quality).alias("coordinate_quality"), _text(rows, "source_url").alias("source_url"), F.to_json(F.struct(*[c for c in raw.columns])).alias("attributes"),
    )
    return named.where("latitude is not null and longitude is not null")


def sites(raw: DataFrame) -> DataFrame:
    """Sites with the land cover and spread that the file has, as JSON without what is missing (null if all is)."""
    rows = require_columns(raw, ["site_id", "latitude", "longitude"])

    def group(names: list[str]) -> Column:
        held = [no_nan(number(F.col(n))).alias(n) for n in names if n in rows.columns]
        return F.nullif(F.to_json(F.struct(*held)), F.lit("{}")) if held else F.lit(None).cast("string")

    return rows.select(
        "site_id", number(F.col("latitude")).alias("latitude"), number(F.col("longitude")).alias("longitude"), F.lit("ACTIVE").alias("status"),
        group([f"{n}_fraction" for n in LAND_COVER.values()]).alias("land_cover"), group(["spatial_median_m", "spatial_p90_m", "spatial_std_m"]).alias("spatial_stats"),
    )


def states(raw: DataFrame) -> DataFrame:
    """Temporal states; a file may call the confidence by either of two names, HIGH without both. A state that isn't one is an error."""
    rows = require_columns(raw, ["site_id", "state"])
    state = F.upper(F.trim("state"))
    checked = F.when(state.isin(*STATES), state).otherwise(F.raise_error(F.concat(F.lit("no state: "), F.coalesce("state", F.lit("null")))).cast("string"))
    return rows.select("site_id", checked.alias("state"), F.upper(first_present(rows, "state_confidence", "confidence", default="HIGH")).alias("confidence"), number(first_present(rows, "days_since_last")).cast("int").alias("days_since_last"))


def labels(raw: DataFrame) -> DataFrame:
    """Reference labels: one of a site, 0 or 1, and where it is from."""
    rows = require_columns(raw, ["site_id", "label"])
    return rows.select("site_id", number(F.col("label")).cast("int").alias("label"), _text(rows, "source", "label_source", default=F.lit("REFERENCE")).alias("source")).where("label in (0, 1)").dropDuplicates(["site_id"])
