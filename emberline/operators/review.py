"""The review ledger: checks, consensus, queue, training export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.common import first_by

#: What a review may say.
STATUSES = ("IN_REVIEW", "COMPLETED", "ESCALATED")
DETERMINATIONS = ("INDUSTRIAL", "NONINDUSTRIAL", "REMAIN_UNKNOWN")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def validate(requests: DataFrame, required_reason: str = "EVIDENCE_REVIEWED") -> DataFrame:
    """Requests with ``error`` (null if valid): review_status, determination, confidence, reason_codes, evidence_refs, a_class."""
    done = F.col("review_status") == "COMPLETED"
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    error = (
        F.when(F.col("a_class") != "UNKNOWN", "site is not UNKNOWN").when(~F.col("review_status").isin(*STATUSES), "unknown status")
        .when(done & ~F.coalesce(F.col("determination").isin(*DETERMINATIONS), F.lit(False)), "determination").when(done & ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "confidence")
        .when(done & (size("evidence_refs") == 0), "evidence").when(done & ~F.coalesce(F.array_contains("reason_codes", required_reason), F.lit(False)), "reason")
        .when(~done & (F.col("determination").isNotNull() | F.col("confidence").isNotNull()), "not completed")
    )
    return requests.withColumn("error", error)


def consensus(ledger: DataFrame) -> DataFrame:
    """Completed reviews, each against the site's completed one before it, and whether it may teach."""
    order = Window.partitionBy("site_id").orderBy("reviewed_at", "review_id")
    prior = {c: F.lag(c).over(order) for c in ("reviewed_by", "determination", "confidence", "n_refs")}
    done = ledger.where("review_status = 'COMPLETED'").withColumns({f"prior_{k}": v for k, v in prior.items()})
    same = F.col("prior_reviewed_by").isNull() | (F.col("prior_reviewed_by") == F.col("reviewed_by"))
    out = done.withColumn("consensus", F.when(same, "SINGLE_REVIEW").when(F.col("prior_determination") == F.col("determination"), "VERIFIED").otherwise("CONFLICT"))
    eligible = (F.col("consensus") == "VERIFIED") & F.col("determination").isin("INDUSTRIAL", "NONINDUSTRIAL") & (F.col("confidence") == "HIGH") & (F.col("prior_confidence") == "HIGH") & (F.col("n_refs") > 0) & (F.col("prior_n_refs") > 0) & F.col("has_features")
    return out.withColumn("training_eligible", F.coalesce(eligible, F.lit(False)))


def with_consensus(ledger: DataFrame) -> DataFrame:
    """The whole ledger, completed reviews with their consensus."""
    return ledger.join(consensus(ledger).select("review_id", "consensus", "training_eligible"), "review_id", "left")


def queue(ledger: DataFrame, alerts: DataFrame, identity: DataFrame) -> DataFrame:
    """Sites of class UNKNOWN with an active alert (the last one), and where their review stands by its latest event."""
    last = first_by(with_consensus(ledger), ["site_id"], [F.desc("reviewed_at"), F.desc("review_id")])
    s, c = F.col("review_status"), F.col("consensus")
    status = F.when(s.isNull(), "PENDING").when(s == "IN_REVIEW", "IN_REVIEW").when((s == "ESCALATED") | (c == "CONFLICT"), "CONFLICT").when(c == "VERIFIED", "COMPLETED").otherwise("AWAITING_VERIFICATION")
    open_alerts = first_by(alerts.where("status = 'ACTIVE'"), ["site_id"], [F.desc("updated_at"), F.desc("alert_id")])
    unknown = identity.where("class = 'UNKNOWN'").select("site_id")
    return open_alerts.join(unknown, "site_id").join(last.select("site_id", "review_status", "consensus"), "site_id", "left").select("site_id", "alert_id", "alert_level", status.alias("queue_status"))


def queue_page(found: DataFrame, status: str = "OPEN", limit: int = 100) -> DataFrame:
    """A part of the queue (OPEN: all but COMPLETED; ALL; or one status): the first rows by site, with how many there are before the slice."""
    kept = found if status == "ALL" else found.where("queue_status <> 'COMPLETED'") if status == "OPEN" else found.where(F.col("queue_status") == status)
    total = kept.agg(F.count("*").alias("total_reviews"))
    return kept.orderBy("site_id").limit(limit).join(F.broadcast(total))  # one row of counts


def export(ledger: DataFrame) -> DataFrame:
    """Sites whose latest review may teach (latest first, then the test): label, reviewer, time."""
    last = first_by(with_consensus(ledger), ["site_id"], [F.desc("reviewed_at"), F.desc("review_id")])
    return last.where("training_eligible").select("site_id", "review_id", F.when(F.col("determination") == "INDUSTRIAL", 1).otherwise(0).alias("label"), "reviewed_by")


def resolved_alerts(alerts: DataFrame, ledger: DataFrame) -> DataFrame:
    """``alerts`` with those of verified sites resolved."""
    verified = with_consensus(ledger).where("consensus = 'VERIFIED'").select("site_id").distinct().withColumn("_v", F.lit(True))
    return alerts.join(verified, "site_id", "left").withColumn("status", F.when(F.col("_v"), "RESOLVED").otherwise(F.col("status"))).drop("_v")
