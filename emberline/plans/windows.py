"""Backfill planning: request windows, sources by day, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.common import small


def request_windows(spans: DataFrame, days: int = 5) -> DataFrame:
    """Spans (start, end) cut into windows of at most so many days: window_start, n_days."""
    starts = spans.withColumn("window_start", F.explode(F.expr(f"sequence(start, end, interval {days} days)")))
    return starts.withColumn("n_days", F.least(F.lit(days), F.datediff("end", "window_start") + 1))


def plan_sources(spark: SparkSession, availability: DataFrame, start: str, end: str, prefer: str = "VIIRS_NOAA20_NRT", days: int = 5) -> DataFrame:
    """Windows over a range of days, each from one source: the preferred one where it has the day, any other as a bridge.

    A day that no source has stops the job. ``availability``: data_id, min_date, max_date.
    """
    every = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 day)")).alias("day"))
    order = F.struct((F.col("data_id") != prefer).alias("p"), F.col("data_id").alias("data_id"))
    chosen = every.join(small(availability), F.col("day").between(F.col("min_date"), F.col("max_date")), "left").groupBy("day").agg(F.min(F.when(F.col("data_id").isNotNull(), order))["data_id"].alias("source"))
    checked = chosen.withColumn("source", F.coalesce("source", F.raise_error(F.concat(F.lit("no source for "), F.col("day").cast("string")))))
    order_days = Window.orderBy("day")  # one row for each day of the range
    marked = checked.withColumn("new", F.when(F.col("source") == F.lag("source").over(order_days), 0).otherwise(1))
    spans = marked.withColumn("island", F.sum("new").over(order_days)).groupBy("source", "island").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return request_windows(spans, days).select("source", "window_start", "n_days")


def coverage_gaps(windows: DataFrame, by: str = "source") -> DataFrame:
    """Days between windows that none covers: the days after all windows before, up to the next window's start."""
    order = Window.partitionBy(by).orderBy("window_start", "window_end").rowsBetween(Window.unboundedPreceding, -1)
    step = windows.withColumn("covered", F.max("window_end").over(order))
    return step.where(F.col("window_start") > F.date_add("covered", 1)).select(by, F.date_add("covered", 1).alias("gap_start"), F.date_sub("window_start", 1).alias("gap_end")).distinct()


def uncovered(planned: DataFrame, audited: DataFrame) -> DataFrame:
    """Planned windows that no completed audited window of the same family contains.

    Both stand in one line by start, the audited ones first at ties: one contains a planned window if the furthest
    end so far is not before its own.
    """
    done = audited.where("status = 'COMPLETED'").select("family", F.col("window_start").alias("_s"), F.col("window_end").alias("_e"))
    rows = planned.select("family", F.col("window_start").alias("_s"), F.struct(*planned.columns).alias("p"))
    line = Window.partitionBy("family").orderBy("_s", F.col("p").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = done.unionByName(rows, allowMissingColumns=True).withColumn("_furthest", F.max("_e").over(line))
    return both.where("p is not null").where(F.col("_furthest").isNull() | (F.col("_furthest") < F.col("p.window_end"))).select("p.*")


def outside_window(records: DataFrame, start: str, end: str) -> DataFrame:
    """Records whose date lies outside of the window that was asked for."""
    return records.where(~F.coalesce(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False)))


def require_window(records: DataFrame, start: str, end: str) -> DataFrame:
    """``records``, whose reading fails at the first one outside the window that was asked for."""
    inside = F.coalesce(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    day = F.when(inside, F.col("acq_date")).otherwise(F.raise_error(F.concat(F.lit("a record outside the window: "), F.coalesce(F.col("acq_date").cast("string"), F.lit("no date")))).cast("date"))
    return records.withColumn("acq_date", day)


def expectation_mismatches(replayed: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Properties of sites on days that aren't as expected (null: nothing expected): site_id, cutoff, property, expected, found; a site that is missing has no ``found``."""
    both = expected.alias("e").join(replayed.alias("r"), ["site_id", "cutoff"], "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(f"e.{c}").cast("string").alias("expected"), F.col(f"r.{c}").cast("string").alias("found")) for c in columns]))
    return both.select("site_id", "cutoff", pairs.alias("p")).select("site_id", "cutoff", "p.*").where("expected is not null and not (expected <=> found)")


def scenario_days(scenarios: DataFrame) -> DataFrame:
    """Every day of every scenario."""
    return scenarios.select("scenario_id", F.explode(F.expr("sequence(start_date, end_date, interval 1 day)")).alias("day"))


def bundle_status(scenarios: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Expected, found and invalid snapshots of each scenario (snapshots: scenario_id, day, valid)."""
    both = scenario_days(scenarios).join(snapshots, ["scenario_id", "day"], "left")
    return both.groupBy("scenario_id").agg(F.count("*").alias("expected"), F.count_if(F.col("valid").isNull()).alias("missing"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("complete", (F.col("missing") == 0) & (F.col("invalid") == 0))


def invalid_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios with an id used twice, dates out of order or a box that is none."""
    twice = F.count("*").over(Window.partitionBy("scenario_id")) > 1
    bad = twice | ~F.col("focal_date").between(F.col("start_date"), F.col("end_date")) | (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north"))
    return scenarios.withColumn("_bad", bad).where("_bad").drop("_bad")
