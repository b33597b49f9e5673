"""Read queries: viewport, detail, timeline, feeds, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import RECENT_DAYS
from emberline.operators import anomaly, decide, identity, temporal
from emberline.operators.common import as_of, box, first_by, matching


def latest_identity(history: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Each site's last identity row (by date, then id), with decision and class."""
    rows = history if cutoff is None else as_of(history, cutoff, "as_of")
    last = first_by(rows, ["site_id"], [F.desc("as_of"), F.desc("inference_id")])
    return identity.guard(last)


def latest_active_alert(alerts: DataFrame, by: str = "updated_at") -> DataFrame:
    """Each site's last active alert."""
    return first_by(alerts.where("status = 'ACTIVE'"), ["site_id"], [F.desc(by), F.desc("alert_id")])


def viewport(sites: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, alerts: DataFrame, bounds: tuple[float, float, float, float], a_class: str | None = None, b_state: str | None = None, c_status: str | None = None, severity: str | None = None) -> DataFrame:
    """Sites in a box with their latest results and active alert; missing results are UNAVAILABLE."""
    top = latest_active_alert(alerts).select("site_id", "alert_id", "alert_level", F.col("updated_at").alias("alert_at"))
    out = box(sites, *bounds).join(a.select("site_id", F.col("class").alias("a_class"), "p_core"), "site_id", "left").join(b.select("site_id", F.col("state").alias("b_state"), F.col("last_date").alias("latest_seen")), "site_id", "left")
    out = out.join(c.select("site_id", "c_status", "c_score"), "site_id", "left").join(top, "site_id", "left")
    out = matching(out, a_class=a_class, b_state=b_state, c_status=c_status, alert_level=severity)
    named = [F.coalesce(x, F.lit("UNAVAILABLE")).alias(x) for x in ("a_class", "b_state", "c_status")]
    return out.select("site_id", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"), *named, F.round("p_core", 4).alias("p_core"), F.round("c_score", 4).alias("c_score"), "latest_seen", "alert_id", "alert_level", "alert_at")


def page(found: DataFrame, limit: int) -> DataFrame:
    """The first rows of a viewport: last alert, highest score, last seen, id. (Count the whole separately.)"""
    return found.orderBy(F.desc_nulls_last("alert_at"), F.desc_nulls_last("c_score"), F.desc_nulls_last("latest_seen"), "site_id").limit(limit)


def feature_collection(found: DataFrame, limit: int) -> DataFrame:
    """One GeoJSON text: at most ``limit`` features, the counts, whether rows were left out."""
    total = found.count()
    shown = page(found, limit)
    properties = [c for c in shown.columns if c not in ("latitude", "longitude")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    one = shown.select(feature.alias("f")).agg(F.collect_list("f").alias("features"), F.count("*").alias("returned_count"))
    return one.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features", F.lit(total).alias("total_count"), "returned_count", (F.col("returned_count") < total).alias("truncated"))).alias("json"))


def timeline(daily: DataFrame, scored: DataFrame, cutoff: str) -> DataFrame:
    """Each site-day with its anomaly result, the site's number of days, first and last day up to the cutoff."""
    days = as_of(daily, cutoff)
    whole = days.groupBy("site_id").agg(F.count("*").alias("total_active_days"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"))
    return days.join(scored.select("site_id", "acq_date", "level", "c_score"), ["site_id", "acq_date"], "left").join(whole, "site_id")


def alert_feed(alerts: DataFrame, sites: DataFrame, a: DataFrame, status: str | None = "ACTIVE", severity: str | None = None, limit: int = 1000) -> DataFrame:
    """Alerts of known sites, newest first."""
    out = matching(alerts, status=status, alert_level=severity).join(sites.select("site_id", "latitude", "longitude"), "site_id").join(a.select("site_id", F.col("class").alias("a_class")), "site_id", "left")
    return out.select("alert_id", "site_id", "site_day", "alert_level", "status", "updated_at", "latitude", "longitude", "a_class").orderBy(F.desc("updated_at"), F.desc("alert_id")).limit(limit)


def hot_spots(detections: DataFrame, bounds: tuple[float, float, float, float], limit: int = 5000) -> DataFrame:
    """Detections in a box, newest and strongest first."""
    return box(detections, *bounds).orderBy(F.desc("acq_date"), F.desc("frp"), "site_id", "acq_time", "latitude", "longitude").limit(limit)


def recent_detections(detections: DataFrame, site: str, cutoff: str, limit: int = 1000) -> DataFrame:
    """A site's last detections up to a date."""
    return as_of(detections.where(F.col("site_id") == site), cutoff).orderBy(F.desc("acq_date"), F.desc("acq_time"), "latitude", "longitude").limit(limit)


def detail(sites: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, alerts: DataFrame, site: str) -> DataFrame:
    """One site with all its results; its active alert is the one created last."""
    one = sites.where(F.col("site_id") == site)
    top = latest_active_alert(alerts.where(F.col("site_id") == site), "created_at" if "created_at" in alerts.columns else "updated_at")
    return one.join(a.drop("latitude", "longitude"), "site_id", "left").join(b, "site_id", "left").join(c, "site_id", "left").join(top.drop("status"), "site_id", "left")


def acknowledge(alerts: DataFrame, ids: DataFrame, by: str, at: str) -> DataFrame:
    """``alerts`` with the active ones among ``ids`` acknowledged: by whom and when; all others as they are."""
    named = ids.select("alert_id").distinct().withColumn("_a", F.lit(True))
    hit = F.coalesce(F.col("_a") & (F.col("status") == "ACTIVE"), F.lit(False))
    held = F.col("acknowledged_by") if "acknowledged_by" in alerts.columns else F.lit(None).cast("string")
    marked = alerts.join(named, "alert_id", "left").withColumn("_hit", hit)
    return marked.withColumns({"status": F.when(F.col("_hit"), "ACKNOWLEDGED").otherwise(F.col("status")), "acknowledged_by": F.when(F.col("_hit"), by).otherwise(held), "updated_at": F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))}).drop("_a", "_hit")


def selected(column: F.Column, wanted: list[str]) -> F.Column:
    """Whether a value is among those chosen; with none chosen all are."""
    return column.isin(wanted) if wanted else F.lit(True)


def raised_or_reactivated(a: DataFrame, b: DataFrame, c: DataFrame, levels: tuple[str, ...] = ("ELEVATED", "ANOMALOUS", "CRITICAL")) -> DataFrame:
    """Sites with all three results whose anomaly is raised or whose state is REACTIVATED."""
    return c.join(a, "site_id").join(b, "site_id").where(F.col("c_status").isin(*levels) | (F.col("state") == "REACTIVATED"))


#: The categories that counts name even where there is none of them.
CATEGORIES = {
    "a": ("INDUSTRIAL", "UNKNOWN", "NONINDUSTRIAL"), "b": ("REACTIVATED", "NEW", "PERSISTENT", "DORMANT", "INTERMITTENT"),
    "c": ("INSUFFICIENT_HISTORY", "NORMAL", "ELEVATED", "ANOMALOUS", "CRITICAL", "NO_RECENT_EVENT"), "alert": ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"),
}


def model_counts(a: DataFrame, b: DataFrame, c: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sites of each identity class, state and anomaly status, and active alerts of each level: model, category, n (0 where none)."""
    columns = {"a": (a, "class"), "b": (b, "state"), "c": (c, "c_status"), "alert": (alerts.where("status = 'ACTIVE'"), "alert_level")}
    counted = None
    for name, (df, column) in columns.items():
        part = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n")).select(F.lit(name).alias("model"), "category", "n")
        counted = part if counted is None else counted.unionByName(part)
    known = a.sparkSession.createDataFrame([(m, x) for m, xs in CATEGORIES.items() for x in xs], "model string, category string")
    return known.join(counted, ["model", "category"], "left").select("model", "category", F.coalesce("n", F.lit(0)).alias("n"))


def replay_page(found: DataFrame, limit: int) -> DataFrame:
    """The first rows of a replay, seen last first, with the number of all rows and whether some are left out."""
    total = found.agg(F.count("*").alias("total_count"))
    shown = found.orderBy(F.desc("latest_seen"), "site_id").limit(limit)
    return shown.join(F.broadcast(total)).withColumn("truncated", F.col("total_count") > limit)  # one row of counts


def replay(sites: DataFrame, detections: DataFrame, a_history: DataFrame, scored: DataFrame, cutoff: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """What was known on a date: sites seen by then, their identity, state and anomaly as of it, and the alert that follows.

    One plan; nothing later than the date is read into it. Sites without identity have no decision.
    """
    b = temporal.temporal_state(detections, cutoff).select("site_id", "state", "confidence", F.col("last_date").alias("latest_seen"))
    a = latest_identity(a_history, cutoff).select("site_id", "decision", F.col("class").alias("a_class"), "p_core")
    c = anomaly.latest_status(scored, cutoff)
    places = sites if bounds is None else box(sites, *bounds)
    out = places.select("site_id", "latitude", "longitude").join(b, "site_id").join(a, "site_id", "left").join(c, "site_id", "left").withColumn("c_status", F.coalesce("c_status", F.lit("UNAVAILABLE")))
    able = F.col("decision").isNotNull() & ~F.col("c_status").isin("NO_RECENT_EVENT", "UNAVAILABLE")
    found = out.withColumn("level", F.col("c_status")).withColumns(decide.rules())
    shown = able & ~F.col("alert_level").isin("NONE", "INFO")
    return found.select("site_id", "a_class", F.round("p_core", 4).alias("p_core"), F.col("state").alias("b_state"), "confidence", "c_status", F.round("c_score", 4).alias("c_score"), "latest_seen", F.when(shown, F.col("alert_type")).alias("alert_type"), F.when(shown, F.col("alert_level")).alias("alert_level"))


def _spells(rows: DataFrame, day: str, order: list, cutoffs: list[str]) -> DataFrame:
    """Each site's rows with the dates (``cutoff``) for which they are the last: those from their own day to the next row's."""
    dates = F.array(*[F.lit(x).cast("date") for x in sorted(set(cutoffs))])
    line = Window.partitionBy("site_id").orderBy(F.col(day), *order)
    spell = rows.where(F.col(day).isNotNull()).withColumn("_to", F.lead(day).over(line))
    return spell.withColumn("cutoff", F.explode(F.filter(dates, lambda x: (x >= F.col(day)) & (F.col("_to").isNull() | (x < F.col("_to")))))).drop("_to")


def replay_days(sites: DataFrame, detections: DataFrame, a_history: DataFrame, scored: DataFrame, cutoffs: list[str], bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``replay`` for many dates in one plan: the same rows for each, with their ``cutoff``.

    Identity and anomaly results hold from their day to the next one's, so each is dealt to the dates of its spell
    without a join; states are counted for all dates in one pass.
    """
    name, sure = temporal.state()
    b = temporal.timelines(detections, cutoffs).withColumn("state", name).withColumn("confidence", sure).select("site_id", "cutoff", "state", "confidence", F.col("last_date").alias("latest_seen"))
    a = identity.guard(_spells(a_history, "as_of", [F.col("inference_id")], cutoffs)).select("site_id", "cutoff", "decision", F.col("class").alias("a_class"), "p_core")
    c = _spells(scored.select("site_id", "acq_date", "level", "c_score"), "acq_date", [], cutoffs)
    old = F.datediff("cutoff", "acq_date") > RECENT_DAYS
    c = c.select("site_id", "cutoff", F.when(old, "NO_RECENT_EVENT").otherwise(F.col("level")).alias("c_status"), F.when(~old, F.col("c_score")).alias("c_score"))
    places = sites if bounds is None else box(sites, *bounds)
    out = places.select("site_id").join(b, "site_id").join(a, ["site_id", "cutoff"], "left").join(c, ["site_id", "cutoff"], "left").withColumn("c_status", F.coalesce("c_status", F.lit("UNAVAILABLE")))
    able = F.col("decision").isNotNull() & ~F.col("c_status").isin("NO_RECENT_EVENT", "UNAVAILABLE")
    found = out.withColumn("level", F.col("c_status")).withColumns(decide.rules())
    shown = able & ~F.col("alert_level").isin("NONE", "INFO")
    return found.select("site_id", "cutoff", "a_class", F.round("p_core", 4).alias("p_core"), F.col("state").alias("b_state"), "confidence", "c_status", F.round("c_score", 4).alias("c_score"), "latest_seen", F.when(shown, F.col("alert_type")).alias("alert_type"), F.when(shown, F.col("alert_level")).alias("alert_level"))


def imagery_as_of(imagery: DataFrame, cutoff: str) -> DataFrame:
    """Imagery that was there on a date; without a date it always was."""
    return imagery.where(F.col("acq_date").isNull() | (F.col("acq_date") <= F.lit(cutoff).cast("date")))


def imagery_list(imagery: DataFrame, most: int = 50) -> DataFrame:
    """Each site's imagery, newest first, numbered; without a date it stands last."""
    order = [F.desc_nulls_last("acq_date"), F.col("granule")]
    numbered = imagery.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(*order)))
    return numbered.where(F.col("place") <= most)


def best_granules(granules: DataFrame, site: str | None, day: str, lookback: int = 30) -> DataFrame:
    """Granules in a window around a day, nearest first, then clearest; a missing date stands last, a missing cloud share counts as 101."""
    ref = F.lit(day).cast("date")
    near = granules.where(F.col("acq_date").isNull() | F.abs(F.datediff("acq_date", ref)).between(0, lookback))
    near = near if site is None else near.where(F.col("site_id") == site)
    ranked = near.withColumn("days_off", F.coalesce(F.abs(F.datediff("acq_date", ref)), F.lit(10_000))).withColumn("cloud_rank", F.coalesce("cloud", F.lit(101.0)))
    return first_by(ranked, ["site_id"], [F.col("days_off"), F.col("cloud_rank"), F.col("granule")])


def retry_due(status: F.Column, age_minutes: F.Column, wait: int = 60) -> F.Column:
    """Whether imagery is to be looked for again: never tried, or not to be had a while ago."""
    return F.when(status.isNull(), True).when(status == "UNAVAILABLE", age_minutes >= wait).otherwise(False)
