"""Decision rules on identity, state and anomaly; fingerprints; escalation within a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import HEADLINES, SEVERITIES, STACK_VERSION
from emberline.operators.common import first_by


def rank(level: Column) -> Column:
    """A severity's place; unknown ones stand lowest."""
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(level == s, i).otherwise(out)
    return out


def rules() -> dict[str, Column]:
    """Alert type, level and need of evidence from ``decision``, ``state`` and ``level``; the first rule that holds wins."""
    a, b, c = F.upper("decision"), F.col("state"), F.col("level")
    industrial, unknown, raised = a.startswith("INDUSTRIAL_"), a == "UNKNOWN", c.isin("ELEVATED", "ANOMALOUS")
    table = [
        (industrial & (c == "CRITICAL"), "CRITICAL_INDUSTRIAL_ANOMALY", "CRITICAL", True),
        (industrial & (b == "REACTIVATED") & raised, "INDUSTRIAL_REACTIVATION_ANOMALY", "HIGH", True),
        (industrial & (c == "ANOMALOUS"), "HIGH_INDUSTRIAL_ANOMALY", "HIGH", True),
        (unknown & (c == "CRITICAL"), "UNKNOWN_CRITICAL_REVIEW", "HIGH", True),
        (unknown & raised, "UNKNOWN_ANOMALY_REVIEW", "MEDIUM", True),
        (industrial & (c == "ELEVATED"), "INDUSTRIAL_ELEVATION", "MEDIUM", False),
        ((b == "NEW") & (unknown | industrial) & (c == "INSUFFICIENT_HISTORY"), "NEW_SOURCE_REVIEW", "MEDIUM", True),
        (industrial & (c == "NORMAL"), "NORMAL_INDUSTRIAL_OPERATION", "INFO", False),
        (a == "NONINDUSTRIAL", "NONINDUSTRIAL_ACTIVITY", "LOW", False),
    ]
    kind, level, evidence = F.lit("NO_ALERT"), F.lit("NONE"), F.lit(False)
    for test, k, v, e in reversed(table):
        kind, level, evidence = F.when(test, k).otherwise(kind), F.when(test, v).otherwise(level), F.when(test, F.lit(e)).otherwise(evidence)
    return {"alert_type": kind, "alert_level": level, "evidence_required": evidence}


def fingerprint(site: Column, day: Column, kind: Column, version: str = STACK_VERSION) -> Column:
    """What makes an alert the same alert."""
    return F.sha2(F.concat_ws("_", site, day.cast("string"), kind, F.lit(version)), 256)


def decide(joined: DataFrame, version: str = STACK_VERSION) -> DataFrame:
    """Alerts for rows of site_id, site_day, decision, state, level."""
    out = joined.withColumns(rules())
    reasons = F.concat_ws(",", F.concat(F.lit("A="), "decision"), F.concat(F.lit("B="), "state"), F.concat(F.lit("C="), "level"))
    return out.withColumn("reason_codes", reasons).withColumn("fingerprint", fingerprint(F.col("site_id"), F.col("site_day"), F.col("alert_type"), version))


def headline(kind: Column) -> Column:
    """What an alert of a type says."""
    out = F.lit(None).cast("string")
    for name, text in HEADLINES.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def merge_alerts(stored: DataFrame, decided: DataFrame, at: str) -> DataFrame:
    """The rows that a decision writes to the alerts, keyed by fingerprint: alerts that are new, and those that escalate.

    ``decided`` has one row for each site and day. Where an active alert of the site and day is there (the one
    created last counts), only a higher level writes: it names the level that it comes from in headline and reasons.
    NONE and INFO are never written. A fingerprint that is stored keeps its id, status and time of creation.
    """
    now = F.lit(at).cast("timestamp")
    held = first_by(stored.where("status = 'ACTIVE'"), ["site_id", "site_day"], [F.desc("created_at"), F.desc("alert_id")])
    held = held.select("site_id", "site_day", F.col("alert_level").alias("_level"), F.col("alert_type").alias("_type"))
    both = decided.join(held, ["site_id", "site_day"], "left")
    escalates = F.col("_level").isNotNull()
    kept = both.where(~F.col("alert_level").isin("NONE", "INFO") & (~escalates | (rank(F.col("alert_level")) > rank(F.col("_level")))))
    text = headline(F.col("alert_type"))
    rows = kept.select(
        "fingerprint", "site_id", "site_day", "alert_type", "alert_level", "evidence_required",
        F.when(escalates, F.concat(text, F.lit(" (Escalated from "), "_level", F.lit(")"))).otherwise(text).alias("headline"),
        F.when(escalates, F.concat("reason_codes", F.lit(",ESCALATED_FROM_"), "_level")).otherwise(F.col("reason_codes")).alias("reason_codes"),
        escalates.alias("is_escalation"), F.col("_level").alias("previous_level"), F.col("_type").alias("previous_type"),
    )
    old = stored.select("fingerprint", F.col("alert_id").alias("_id"), F.col("status").alias("_status"), F.col("created_at").alias("_created"))
    known = rows.dropDuplicates(["fingerprint"]).join(old, "fingerprint", "left")
    return known.select(
        F.coalesce("_id", F.concat(F.lit("ALT_"), F.substring("fingerprint", 1, 32))).alias("alert_id"), *rows.columns,
        F.coalesce("_status", F.lit("ACTIVE")).alias("status"), F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"),
    )


def alerts(decided: DataFrame, keep_info: bool = False) -> DataFrame:
    """What is kept: one alert for each fingerprint; NONE never, INFO on request."""
    dropped = ["NONE"] if keep_info else ["NONE", "INFO"]
    return decided.where(~F.col("alert_level").isin(*dropped)).dropDuplicates(["fingerprint"])


def escalate(events: DataFrame) -> DataFrame:
    """Alerts of a site and day in order: a higher level than all before escalates, any other changes nothing.

    Returns each event with the level in force before (null at first), its effect and the level in force after.
    """
    order = Window.partitionBy("site_id", "site_day").orderBy("updated_at", "seq")
    step = events.withColumn("_r", rank(F.col("alert_level"))).withColumn("_before", F.max("_r").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    effect = F.when(F.col("_before").isNull(), "CREATED").when(F.col("_r") > F.col("_before"), "ESCALATED").otherwise("UNCHANGED")
    out = step.withColumn("previous_level", F.get(names, F.col("_before"))).withColumn("effect", effect)
    return out.withColumn("level_in_force", F.get(names, F.greatest("_r", F.coalesce("_before", F.lit(0))))).drop("_r", "_before")
