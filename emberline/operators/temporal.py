"""Temporal state of a site: timeline statistics, rules, and the state on each day of its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DORMANT_DAYS, GAP_DAYS, PERSISTENT_DAYS, PERSISTENT_LIFETIME, PERSISTENT_MONTHS, RECENT_DAYS, STATES
from emberline.operators.common import as_of, days_of


def timeline(detections: DataFrame, cutoff: str) -> DataFrame:
    """What the rules read, for each site with a day up to the cutoff."""
    days = days_of(as_of(detections, cutoff))
    gaps = days.withColumn("gap", F.datediff("acq_date", F.lag("acq_date").over(Window.partitionBy("site_id").orderBy("acq_date"))))
    ref = F.lit(cutoff).cast("date")
    ago = F.datediff(ref, "acq_date")
    long_gap = F.when(F.col("gap") >= GAP_DAYS, F.struct("acq_date", "gap"))
    out = gaps.groupBy("site_id").agg(
        F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), F.count("*").alias("active_days"),
        *[F.count_if(ago < n).alias(f"active_days_{n}") for n in (30, 90, 180, 365)],
        F.count_distinct(F.when(ago < 180, F.date_trunc("month", "acq_date"))).alias("active_months_180"), F.max(long_gap).alias("g"),
    )
    return out.select(
        "site_id", "first_date", "last_date", F.datediff(ref, "first_date").alias("days_since_first"), F.datediff(ref, "last_date").alias("days_since_last"), (F.datediff("last_date", "first_date") + 1).alias("lifetime_days"),
        "active_days", *[f"active_days_{n}" for n in (30, 90, 180, 365)], "active_months_180", F.col("g.gap").alias("last_long_gap_days"), F.datediff(ref, "g.acq_date").alias("reactivation_age_days"),
    )


def timelines(detections: DataFrame, cutoffs: list[str]) -> DataFrame:
    """``timeline`` for many dates in one pass: a row for each site and date from its first day on.

    A day is counted for all dates it may count for while it is read, so what is shuffled is a row for each site and
    date. Months are bits of a number.
    """
    days = days_of(as_of(detections, max(cutoffs)))
    gapped = days.withColumn("gap", F.datediff("acq_date", F.lag("acq_date").over(Window.partitionBy("site_id").orderBy("acq_date"))))
    dates = F.array(*[F.lit(x).cast("date") for x in sorted(set(cutoffs))])
    rows = gapped.withColumn("cutoff", F.explode(F.filter(dates, lambda x: x >= F.col("acq_date"))))
    ago = F.datediff("cutoff", "acq_date")
    out = rows.groupBy("site_id", "cutoff").agg(
        F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), F.count("*").alias("active_days"),
        *[F.count_if(ago < n).alias(f"active_days_{n}") for n in (30, 90, 180, 365)],
        F.bit_count(F.coalesce(F.bit_or(F.when(ago < 180, F.expr("shiftleft(1L, cast((year(cutoff)-year(acq_date))*12+month(cutoff)-month(acq_date) as int))"))), F.lit(0).cast("long"))).cast("long").alias("active_months_180"), F.max(F.when(F.col("gap") >= GAP_DAYS, F.struct("acq_date", "gap"))).alias("g"),
    )
    return out.select(
        "site_id", "cutoff", "first_date", "last_date", F.datediff("cutoff", "first_date").alias("days_since_first"), F.datediff("cutoff", "last_date").alias("days_since_last"), (F.datediff("last_date", "first_date") + 1).alias("lifetime_days"),
        "active_days", *[f"active_days_{n}" for n in (30, 90, 180, 365)], "active_months_180", F.col("g.gap").alias("last_long_gap_days"), F.datediff("cutoff", "g.acq_date").alias("reactivation_age_days"),
    )


def state() -> tuple[Column, Column]:
    """State and confidence from the columns of ``timeline``; the first rule that holds wins."""
    c = F.col
    recent = c("days_since_last") <= RECENT_DAYS
    rules = [
        ("REACTIVATED", recent & (c("days_since_first") > RECENT_DAYS) & (c("last_long_gap_days") >= GAP_DAYS) & (c("reactivation_age_days") <= RECENT_DAYS), F.when(c("active_days_30") == 1, "LOW").when((c("active_days_30") >= 3) & (c("last_long_gap_days") >= 180), "HIGH").otherwise("MEDIUM")),
        ("NEW", recent & (c("days_since_first") <= RECENT_DAYS), F.when(c("active_days_30") == 1, "LOW").when(c("active_days_30") >= 3, "HIGH").otherwise("MEDIUM")),
        ("PERSISTENT", recent & (c("lifetime_days") >= PERSISTENT_LIFETIME) & (c("active_months_180") >= PERSISTENT_MONTHS) & (c("active_days_180") >= PERSISTENT_DAYS), F.when((c("active_months_180") >= 4) & (c("active_days_180") >= 12), "HIGH").otherwise("MEDIUM")),
        ("DORMANT", c("days_since_last") > DORMANT_DAYS, F.when(c("days_since_last") >= 180, "HIGH").otherwise("MEDIUM")),
    ]
    name, confidence = F.lit(STATES[-1]), F.lit("MEDIUM")
    for label, rule, sure in reversed(rules):
        name, confidence = F.when(rule, label).otherwise(name), F.when(rule, sure).otherwise(confidence)
    return name, confidence


def temporal_state(detections: DataFrame, cutoff: str) -> DataFrame:
    """Each site's state as of a date, with what it follows from."""
    name, confidence = state()
    return timeline(detections, cutoff).withColumn("state", name).withColumn("confidence", confidence)


def state_counts(states: DataFrame) -> DataFrame:
    """Sites in each known state, zero included."""
    known = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return known.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("sites"))


def state_per_day(detections: DataFrame) -> DataFrame:
    """The state on each active day of each site, by the days up to it: frames over a day number, no self-join."""
    days = days_of(detections).withColumn("day", F.datediff("acq_date", F.lit("1970-01-01").cast("date")))
    order = Window.partitionBy("site_id").orderBy("day")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda n: order.rangeBetween(-(n - 1), 0)
    step = days.withColumn("gap", F.col("day") - F.lag("day").over(order)).withColumn("month", F.date_trunc("month", "acq_date"))
    long_gap = F.last(F.when(F.col("gap") >= GAP_DAYS, F.struct("day", "gap")), ignorenulls=True).over(past)
    out = step.select(
        "site_id", "acq_date", "day", F.min("day").over(past).alias("first"), *[F.count("*").over(last(n)).alias(f"active_days_{n}") for n in (30, 180)],
        F.size(F.array_distinct(F.collect_list("month").over(last(180)))).alias("active_months_180"), long_gap.alias("g"),
    )
    name, confidence = state()
    out = out.select("site_id", "acq_date", F.lit(0).alias("days_since_last"), (F.col("day") - F.col("first")).alias("days_since_first"), (F.col("day") - F.col("first") + 1).alias("lifetime_days"), "active_days_30", "active_days_180", "active_months_180", F.col("g.gap").alias("last_long_gap_days"), (F.col("day") - F.col("g.day")).alias("reactivation_age_days"))
    return out.select("site_id", "acq_date", name.alias("state"), confidence.alias("confidence"), "active_days_30", "active_days_180", "active_months_180")
