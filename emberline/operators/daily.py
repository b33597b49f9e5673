"""Site-days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_activity(detections: DataFrame, rounded: bool = False) -> DataFrame:
    """Count, mean and maximum of FRP for each site and day (null FRP counts as 0)."""
    frp = F.coalesce("frp", F.lit(0.0))
    mean, top = F.avg(frp), F.max(frp)
    if rounded:
        mean, top = F.bround(mean, 2), F.bround(top, 2)
    return detections.groupBy("site_id", "acq_date").agg(F.count("*").alias("detections"), mean.alias("mean_frp"), top.alias("max_frp"))


def merge_daily(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two sets of site-days as one: counts add up, means by their counts, the larger maximum."""
    both = old.alias("o").join(new.alias("n"), ["site_id", "acq_date"], "full")
    count = lambda a: F.coalesce(F.col(f"{a}.detections"), F.lit(0))
    weighted = lambda a: F.coalesce(F.col(f"{a}.mean_frp") * F.col(f"{a}.detections"), F.lit(0.0))
    total = count("o") + count("n")
    return both.select("site_id", "acq_date", total.alias("detections"), ((weighted("o") + weighted("n")) / total).alias("mean_frp"), F.greatest("o.max_frp", "n.max_frp").alias("max_frp"))


def refresh_days(daily: DataFrame, detections: DataFrame, touched: DataFrame) -> DataFrame:
    """``daily`` with the days of ``touched`` (site_id, acq_date) made anew from all their detections; days left empty go."""
    keys = touched.select("site_id", "acq_date").distinct()
    fresh = daily_activity(detections.join(keys, ["site_id", "acq_date"], "left_semi"))
    return daily.join(keys, ["site_id", "acq_date"], "left_anti").unionByName(fresh)


def latest_seen(detections: DataFrame) -> DataFrame:
    """The last day of each site."""
    return detections.groupBy("site_id").agg(F.max("acq_date").alias("latest_seen"))


def candidate_stats(members: DataFrame) -> DataFrame:
    """Size, mean place and first and last observation of each candidate."""
    return members.groupBy("candidate_id").agg(F.count("*").alias("members"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
