"""Audits and repairs: burden, claims, completeness, deliveries, promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.common import first_by
from emberline.operators.identity import decision, identity_class


def burden_by_day(alerts: DataFrame) -> DataFrame:
    """Alerts of each day that has any."""
    high = F.col("alert_level").isin("HIGH", "CRITICAL")
    return alerts.groupBy("site_day").agg(F.count("*").alias("alerts"), F.count_distinct("site_id").alias("sites"), F.count_if(high).alias("high_or_critical"), F.count_if("evidence_required").alias("evidence_required"))


def burden_by_type(alerts: DataFrame) -> DataFrame:
    """Alerts of each type and level."""
    return alerts.groupBy("alert_type", "alert_level").agg(F.count("*").alias("alerts"), F.count_distinct("site_id").alias("sites"))


def burden_summary(alerts: DataFrame) -> DataFrame:
    """Mean, median and maximum of the daily counts."""
    return burden_by_day(alerts).agg(F.count("*").alias("days"), F.avg("alerts").alias("mean_daily"), F.percentile("alerts", 0.5).alias("median_daily"), F.max("alerts").alias("max_daily"))


def claims_as_of(alerts: DataFrame, history: DataFrame, claim: str = "INDUSTRIAL") -> DataFrame:
    """Alerts that claimed a class which the site's identity as of the alert's day (the last one up to it) doesn't bear out.

    Alerts and history stand in one line for each site, by day, history before the alerts of its day; an alert takes
    the last entry before it, so nothing is joined and no alert meets more than its own row.
    """
    entry = F.struct("as_of", identity_class(decision(F.col("p_core"), F.col("p_visual"))).alias("class"))
    known = history.where("as_of is not null").select("site_id", F.col("as_of").alias("_day"), F.col("inference_id").alias("_n"), entry.alias("h"), F.lit(None).cast("string").alias("alert_id"))
    asked = alerts.select("site_id", F.col("site_day").alias("_day"), F.lit(None).cast("long").alias("_n"), F.lit(None).cast(known.schema["h"].dataType).alias("h"), "alert_id")
    line = Window.partitionBy("site_id").orderBy("_day", F.col("alert_id").isNotNull(), "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = known.unionByName(asked).withColumn("last", F.last("h", ignorenulls=True).over(line)).where("alert_id is not null")
    return last.where(~F.col("last.class").eqNullSafe(claim)).select("alert_id", "site_id", "last.as_of", "last.class")


def missing(sites: DataFrame, **tables: DataFrame) -> DataFrame:
    """Sites that a table lacks, a row for each table: result, sites."""
    out = None
    for name, table in sorted(tables.items()):
        part = sites.join(table.select("site_id"), "site_id", "left_anti").agg(F.count("*").alias("sites")).select(F.lit(name).alias("result"), "sites")
        out = part if out is None else out.unionByName(part)
    return out


def delivery_duplicates(detections: DataFrame, archive: str = "VIIRS_NOAA20_SP", live: str = "VIIRS_NOAA20_NRT") -> DataFrame:
    """Archive rows that re-deliver a live one: same satellite, place to four decimals, day and time; the live row ingested first."""
    place = [F.round(F.col(c).cast("decimal(18,8)"), 4) for c in ("latitude", "longitude")]
    keyed = detections.select("detection_id", "site_id", "source_sensor", "ingested_at", "satellite", "acq_date", "acq_time", place[0].alias("lat4"), place[1].alias("lon4"))
    keys = ["satellite", "acq_date", "acq_time", "lat4", "lon4"]
    sp = keyed.where(F.col("source_sensor") == archive).select("detection_id", "site_id", *keys)
    nrt = keyed.where(F.col("source_sensor") == live).select(F.col("detection_id").alias("kept_id"), "ingested_at", *keys)
    return first_by(sp.join(nrt, keys), ["detection_id"], [F.col("ingested_at"), F.col("kept_id")]).select("detection_id", "site_id", "kept_id")


def without_redeliveries(detections: DataFrame, **labels: str) -> DataFrame:
    """Detections less those that a live row covers already."""
    return detections.join(delivery_duplicates(detections, **labels).select("detection_id"), "detection_id", "left_anti")


def invalid_promotions(members: DataFrame, least: int = 3) -> DataFrame:
    """Promoted candidates that keep fewer members than a promotion needs."""
    return members.where("promoted_site_id is not null").groupBy("candidate_id").agg(F.count_if("retained").alias("kept")).where(F.col("kept") < least)


def affected_sites(duplicates: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """Sites that lose a duplicate, or whose promotion is invalid."""
    bad = members.join(invalid_promotions(members, least).select("candidate_id"), "candidate_id", "left_semi").where("promoted_site_id is not null").select(F.col("promoted_site_id").alias("site_id"))
    return duplicates.select("site_id").union(bad).distinct()


def orphans(inference: DataFrame, daily: DataFrame) -> DataFrame:
    """Inference rows whose site-day is gone."""
    return inference.join(daily.select("site_id", "acq_date"), ["site_id", "acq_date"], "left_anti")


def first_members(members: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` members of each candidate by date, time, observation and id."""
    return first_by(members, ["candidate_id"], [F.col("acq_date"), F.col("acq_time"), F.col("observed_at"), F.col("detection_id")], n).select("candidate_id", "detection_id")


def touched_sites(detections: DataFrame, since: str, promoted: DataFrame | None = None) -> DataFrame:
    """Sites with a detection after a date, and those promoted."""
    out = detections.where(F.col("acq_date") > F.lit(since).cast("date")).select("site_id")
    return (out if promoted is None else out.union(promoted.select("site_id"))).distinct()


def preflight(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first check that fails (has rows), in order; READY if none does."""
    spark = checks[0][1].sparkSession
    failing = next((name for name, rows in checks if not rows.isEmpty()), None)
    return spark.createDataFrame([(failing or "READY", failing is None)], "status string, ready boolean")


def broken_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't unique."""
    return df.groupBy(*keys).count().where("count > 1")


def broken_references(df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Rows whose key no parent has."""
    names = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(names, key, "left_anti")


def repair_deliveries(detections: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections without re-deliveries, and site-days made anew where one was dropped (days left empty go)."""
    from emberline.operators.daily import refresh_days

    kept = without_redeliveries(detections)
    touched = detections.join(kept.select("detection_id"), "detection_id", "left_anti").select("site_id", "acq_date").distinct()
    return kept, refresh_days(daily, kept, touched)


def repair_promotions(members: DataFrame, sites: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members and sites after promotions that keep too few members are taken back: those members belong to no site, and a site goes that no valid promotion made."""
    bad = invalid_promotions(members, least).select("candidate_id", F.lit(True).alias("_bad"))
    marked = members.join(bad, "candidate_id", "left")
    demoted = marked.withColumn("promoted_site_id", F.when(F.col("_bad").isNull(), F.col("promoted_site_id"))).drop("_bad")
    made = marked.where("promoted_site_id is not null").groupBy(F.col("promoted_site_id").alias("site_id")).agg(F.min(F.col("_bad").isNotNull()).alias("_gone"))
    gone = made.where("_gone").select("site_id")
    return demoted, sites.join(gone, "site_id", "left_anti")


def repair_audit(detections: DataFrame, members: DataFrame, reviews: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """How much a repair of re-deliveries would change, and what people have decided that it would touch: name, n.

    Duplicates, the sites and candidates that hold them, promotions of such candidates, those among them that keep
    too few detections, and reviews and reference labels of those promotions' sites.
    """
    double = delivery_duplicates(detections)
    touched = members.join(double.select("detection_id"), "detection_id", "left_semi").select("candidate_id").distinct()
    promoted = members.where("promoted_site_id is not null").join(touched, "candidate_id", "left_semi").select("candidate_id", F.col("promoted_site_id").alias("site_id")).distinct()
    kept = detections.join(double.select("detection_id"), "detection_id", "left_anti").groupBy("site_id").agg(F.count("*").alias("_kept"))
    invalid = promoted.join(kept, "site_id", "left").where(F.coalesce("_kept", F.lit(0)) < least).drop("_kept")
    sets = {
        "duplicate_rows": double, "affected_sites": double.where("site_id is not null").select("site_id").union(invalid.select("site_id")).distinct(), "affected_candidates": touched,
        "affected_promotions": promoted, "invalid_promotions": invalid,
        "protected_reviews": reviews.join(invalid.select("site_id").distinct(), "site_id", "left_semi"), "protected_labels": labels.join(invalid.select("site_id").distinct(), "site_id", "left_semi"),
    }
    out = None
    for name, rows in sets.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def require_unprotected(audit_rows: DataFrame) -> None:
    """An error if a repair would take what people have decided."""
    held = audit_rows.where("name like 'protected%' and n > 0").collect()  # at most two rows
    if held:
        raise ValueError("protected rows: " + ", ".join(f"{r['name']} {r['n']}" for r in held))


def repair_cascade(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the sites that are gone."""
    names = gone.select("site_id").distinct()
    return {name: table.join(names, "site_id", "left_anti") for name, table in tables.items()}
