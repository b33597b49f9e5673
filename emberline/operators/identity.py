"""Identity of a site: guarded decision on two probabilities, and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.config import CORE, LOW, RESCUE, STRONG

#: A scorer adds ``p_core`` to a table of features.
Scorer = Callable[[DataFrame], DataFrame]


def logistic_stand_in(features: DataFrame) -> DataFrame:
    """A documented stand-in (the trained model isn't published): a logistic of night share, detections and spread."""
    z = 1.5 * F.coalesce("night_ratio", F.lit(0.0)) + 0.8 * F.log1p(F.col("detections").cast("double")) - 0.6 * F.coalesce("frp_cv", F.lit(0.0)) - 2.0
    return features.withColumn("p_core", 1 / (1 + F.exp(-z)))


def score(features: DataFrame, names: list[str], scorer: Scorer = logistic_stand_in) -> DataFrame:
    """Runs a scorer on the features; their names and order must be the model's."""
    have = [c for c in features.columns if c in names]
    if have != list(names):
        raise ValueError("feature names or order differ from the model's")
    return scorer(features)


def decision(p_core: Column, p_visual: Column) -> Column:
    """The guarded decision; a visual probability can lift the uncertain band only, never veto."""
    return (
        F.when(p_core >= STRONG, "INDUSTRIAL_CORE_STRONG").when(p_core >= CORE, "INDUSTRIAL_CORE_POSITIVE")
        .when(p_core >= LOW, F.when(F.coalesce(p_visual >= RESCUE, F.lit(False)), "INDUSTRIAL_PRITHVI_RESCUE").otherwise("UNKNOWN")).otherwise("NONINDUSTRIAL")
    )


def identity_class(name: Column) -> Column:
    """INDUSTRIAL, UNKNOWN or NONINDUSTRIAL."""
    return F.when(name.startswith("INDUSTRIAL_"), "INDUSTRIAL").otherwise(name)


def visual_status(p_core: Column, p_visual: Column, enabled: Column) -> Column:
    """Whether a visual probability is there, awaited, not to be had, or not called for."""
    band = (p_core >= LOW) & (p_core < CORE)
    return F.when(p_visual.isNotNull(), "AVAILABLE").when(band, F.when(enabled, "PENDING").otherwise("UNAVAILABLE")).otherwise("NOT_TRIGGERED")


def guard(scored: DataFrame, enabled: bool = True) -> DataFrame:
    """Decision, class, visual status and whether to queue the site for the visual scorer."""
    status = visual_status(F.col("p_core"), F.col("p_visual"), F.lit(enabled))
    out = scored.withColumn("decision", decision(F.col("p_core"), F.col("p_visual")))
    return out.withColumn("class", identity_class(F.col("decision"))).withColumn("visual_status", status).withColumn("should_queue", status == "PENDING")


def inference_id(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
