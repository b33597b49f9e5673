"""Per-site features: radiative power, recurrence, dispersion, land cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import FEATURE_EARTH_RADIUS_M, FEATURES, LAND_COVER


def thermal(detections: DataFrame) -> DataFrame:
    """Mean, spread and exact quantiles of FRP, and the share of night detections; spread of one detection is null."""
    frp = F.coalesce("frp", F.lit(0.0))
    q = F.percentile(frp, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    grouped = detections.groupBy("site_id").agg(
        F.count("*").alias("detections"), F.avg(frp).alias("frp_mean"), F.max(frp).alias("frp_max"), F.stddev_samp(frp).alias("frp_std"), q.alias("q"), F.avg(F.when(F.col("daynight") == "N", 1.0).otherwise(0.0)).alias("night_ratio")
    )
    names = ["frp_p10", "frp_p25", "frp_median", "frp_p75", "frp_p90"]
    out = grouped.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]).drop("q")
    return out.withColumn("frp_iqr", F.col("frp_p75") - F.col("frp_p25")).withColumn("frp_cv", F.col("frp_std") / F.greatest("frp_mean", F.lit(1e-6)))


def recurrence(detections: DataFrame) -> DataFrame:
    """Days, lifetime, rate, activity before the site's own last day, and gaps between days (null for one day)."""
    counted = detections.groupBy("site_id", "acq_date").agg(F.count("*").alias("n"))
    order = Window.partitionBy("site_id").orderBy("acq_date")
    whole = Window.partitionBy("site_id")
    step = counted.withColumn("gap", F.datediff("acq_date", F.lag("acq_date").over(order))).withColumn("last", F.max("acq_date").over(whole))
    ago = F.datediff("last", "acq_date")
    out = step.groupBy("site_id").agg(
        F.sum("n").alias("detections"), F.count("*").alias("active_days"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"),
        *[F.count_if(ago < n).alias(f"active_days_{n}d") for n in (7, 30, 90, 365)],
        F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.5).alias("median_gap"),
    )
    return out.withColumn("lifetime_days", F.greatest(F.lit(1), F.datediff("last_date", "first_date") + 1)).withColumn("detections_per_day", F.col("detections") / F.col("active_days"))


def dispersion(detections: DataFrame, sites: DataFrame) -> DataFrame:
    """Distances on the tangent plane from the site's place (its detections' median place where it has none)."""
    middle = detections.groupBy("site_id").agg(F.percentile("latitude", 0.5).alias("_lat"), F.percentile("longitude", 0.5).alias("_lon"))
    places = middle.join(sites.select("site_id", "latitude", "longitude"), "site_id", "left").select("site_id", F.coalesce("latitude", "_lat").alias("c_lat"), F.coalesce("longitude", "_lon").alias("c_lon"))
    x = F.radians(F.col("longitude") - F.col("c_lon")) * F.cos(F.radians("c_lat")) * FEATURE_EARTH_RADIUS_M
    y = F.radians(F.col("latitude") - F.col("c_lat")) * FEATURE_EARTH_RADIUS_M
    measured = detections.join(places, "site_id").select("site_id", F.sqrt(x * x + y * y).alias("d"))
    return measured.groupBy("site_id").agg(F.percentile("d", 0.5).alias("distance_median_m"), F.percentile("d", 0.9).alias("distance_p90_m"), F.stddev_pop("d").alias("distance_std_m"))


def land_cover(pixels: DataFrame) -> DataFrame:
    """Shares of nine classes among valid pixels (code above 0; other classes count below the line); all null without any."""
    valid = F.count_if(F.col("code") > 0)
    return pixels.groupBy("site_id").agg(valid.alias("valid_pixels"), *[F.try_divide(F.count_if(F.col("code") == c), valid).alias(f"cover_{n}") for c, n in LAND_COVER.items()])


def cloud_fraction(pixels: DataFrame) -> DataFrame:
    """The share of pixels that the mask calls cloudy (any of the low five bits, or the fill value)."""
    cloudy = (F.col("fmask").bitwiseAND(31) != 0) | (F.col("fmask") == 255)
    return pixels.groupBy("site_id").agg(F.avg(F.when(cloudy, 1.0).otherwise(0.0)).alias("cloud_fraction"))


def vector(detections: DataFrame, sites: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """All features of each site; the parts are joined on the site they are grouped by already."""
    out = thermal(detections).drop("detections").join(recurrence(detections), "site_id").join(dispersion(detections, sites), "site_id")
    return out.join(land_cover(pixels).drop("valid_pixels"), "site_id", "left") if pixels is not None else out


#: Features whose name in the model differs from the one they have here.
_NAMES = {
    "mean_frp": "frp_mean", "median_frp": "frp_median", "max_frp": "frp_max", "std_frp": "frp_std", "source_lifetime_days": "lifetime_days", "mean_recurrence_gap_days": "mean_gap", "median_recurrence_gap_days": "median_gap",
    "detections_per_active_day": "detections_per_day", "spatial_median_m": "distance_median_m", "spatial_p90_m": "distance_p90_m", "spatial_std_m": "distance_std_m",
    **{f"active_days_{n}": f"active_days_{n}d" for n in (7, 30, 90, 365)}, **{f"{n}_fraction": f"cover_{n}" for n in LAND_COVER.values()},
}


def identity_vector(detections: DataFrame, sites: DataFrame, pixels: DataFrame) -> DataFrame:
    """site_id and the identity model's features under its names and in its order, as doubles, NaN as null."""
    wide = vector(detections, sites, pixels)
    return wide.select("site_id", *[F.nanvl(F.col(_NAMES.get(n, n)).cast("double"), F.lit(None).cast("double")).alias(n) for n in FEATURES])


def golden(found: DataFrame, expected: DataFrame, names: list[str], sites: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """Features that differ on the first ``sites`` sites by the SHA-256 of their id: site_id, feature, found, expected."""
    chosen = expected.join(found.select("site_id"), "site_id", "left_semi").orderBy(F.sha2("site_id", 256)).limit(sites)
    both = chosen.alias("e").join(found.alias("f"), "site_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f.{n}").cast("double").alias("found"), F.col(f"e.{n}").cast("double").alias("expected")) for n in names]))
    rows = both.select("site_id", pairs.alias("p")).select("site_id", "p.*")
    equal = F.col("found").eqNullSafe(F.col("expected")) | (F.isnan("found") & F.isnan("expected")) | (F.abs(F.col("found") - F.col("expected")) <= tolerance + tolerance * F.abs("expected"))
    return rows.where(~F.coalesce(equal, F.lit(False)))


def normalised_patch(bands: Column, mean: list[float], std: list[float]) -> Column:
    """Reflectances (band by pixel) as the visual scorer reads them: pixels that are 0 in all bands stay 0."""
    empty = F.transform(bands[0], lambda _, p: F.forall(bands, lambda b: F.element_at(b, p + 1) == 0))
    m, s = (F.array(*[F.lit(float(x)) for x in v]) for v in (mean, std))
    return F.transform(bands, lambda band, b: F.transform(band, lambda v, p: F.when(F.element_at(empty, p + 1), 0.0).otherwise((v * 10_000 - F.element_at(m, b + 1)) / F.element_at(s, b + 1))))


