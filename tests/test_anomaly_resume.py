"""Going on from a day, a frozen reference, and hot values, each against the whole replay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.config import GROUPS
from emberline.operators import anomaly

DAYS = "site_id string, acq_date date, detections long, mean_frp double, max_frp double"


def history(rng, sites, most):
    import datetime

    rows = []
    for s in range(sites):
        day = datetime.date(2020, 1, 1)
        for _ in range(rng.randint(1, most)):
            day += datetime.timedelta(days=rng.choice([1, 1, 2, 3, 9, 40]))
            mean = round(rng.random() * 30, 3)
            rows.append((f"S{s}", day, rng.randint(1, 6), mean, mean + rng.choice([0.0, 2.5, 90.0])))
    return rows


def plain(df, names):
    return {(r.site_id, r.acq_date): tuple(None if r[n] is None else round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect()}


NAMES = ["history_days", "history_span", "scored", "intensity", "density", "recurrence_burst", "ewma", "cusum", "change"]


def test_late_days_equal_a_whole_replay(spark):
    rng = random.Random(2)
    rows = history(rng, 12, 60)
    held, state, scores = [], spark.createDataFrame([], anomaly.STATE), {}
    order = rng.sample(rows, len(rows))
    for k in range(5):
        part = order[k::5]
        held += part
        daily = spark.createDataFrame(held, DAYS)
        since = spark.createDataFrame([(r[0], r[1]) for r in part], "site_id string, day date")
        stored = spark.createDataFrame([(s, d, v[6], v[7]) for (s, d), v in scores.items()], "site_id string, acq_date date, ewma double, cusum double")
        found, states = anomaly.going_on(daily, since, state, stored)
        new = plain(found, NAMES)
        first = {}
        for s, d, *_ in part:
            first[s] = min(d, first.get(s, d))
        assert set(new) == {(s, d) for s, d, *_ in held if s in first and d >= first[s]}  # nothing before the change is worked out
        scores |= new
        kept = {r.site_id: tuple(r) for r in state.collect()} | {r.site_id: tuple(r) for r in states.collect()}
        state = spark.createDataFrame(list(kept.values()), anomaly.STATE)
    want = plain(anomaly.signals(spark.createDataFrame(rows, DAYS)), NAMES)
    assert set(scores) == set(want)
    for k, v in want.items():
        for a, b in zip(scores[k], v):
            assert a == b or a == pytest.approx(b, abs=1e-8)


def test_new_days_go_on_from_the_state_alone(spark):
    """Days before the change aren't needed once there is a state."""
    rng = random.Random(5)
    rows = sorted(history(rng, 4, 50))
    cutoff = sorted(r[1] for r in rows)[len(rows) // 2]
    old, late = [r for r in rows if r[1] <= cutoff], [r for r in rows if r[1] > cutoff]
    no_scores = spark.createDataFrame([], "site_id string, acq_date date, ewma double, cusum double")
    first = lambda part: spark.createDataFrame([(r[0], r[1]) for r in part], "site_id string, day date")
    _, states = anomaly.going_on(spark.createDataFrame(old, DAYS), first(old), spark.createDataFrame([], anomaly.STATE), no_scores)
    known = {r[0] for r in old}
    late = [r for r in late if r[0] in known]
    found, _ = anomaly.going_on(spark.createDataFrame(late, DAYS), first(late), states, no_scores)
    want = plain(anomaly.signals(spark.createDataFrame(rows, DAYS)), NAMES)
    got = plain(found, NAMES)
    assert set(got) == {(r[0], r[1]) for r in late}
    assert all(a == b or a == pytest.approx(b, abs=1e-8) for k in got for a, b in zip(got[k], want[k]))


def test_frozen_reference(spark):
    """Days of the reference rank as they do among themselves; later ones between its values."""
    rng = random.Random(6)
    found = anomaly.signals(spark.createDataFrame(history(rng, 30, 40), DAYS))
    cutoff = "2020-09-01"
    frozen = anomaly.reference(found, cutoff)
    got = {(r.site_id, r.acq_date): r for r in anomaly.against(found, frozen).collect()}
    want = {(r.site_id, r.acq_date): r for r in anomaly.calibrated(found, cutoff).collect()}
    assert set(got) == set(want)
    held = [r for r in want.values() if r.scored and str(r.acq_date) <= cutoff]
    raws = np.sort([round(r.c_raw, 9) for r in held])
    for k, r in want.items():
        for name in (*[f"{g}_pct" for g in GROUPS], "c_raw"):
            assert got[k][name] == pytest.approx(r[name]) if r[name] is not None else got[k][name] is None
        if r.scored:
            x = round(got[k].c_raw, 9)
            assert got[k].c_score == pytest.approx((np.searchsorted(raws, x, "left") + np.searchsorted(raws, x, "right")) / (2 * len(raws)))
    none = anomaly.against(found, anomaly.reference(found, "1999-01-01")).where("scored").agg(F.min("c_score"), F.max("c_score")).first()
    assert 0 <= none[0] <= none[1] <= 1


def test_hot_values_under_sort_merge_joins(spark):
    """Nearly all days hold zero; the joins are shuffled, as they are with large tables."""
    rows = spark.range(40_000).select(F.concat(F.lit("S"), F.col("id") % 500).alias("site_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 500).cast("int")).alias("acq_date"), (F.col("id") % 11 > 0).alias("scored"), *[F.when(F.col("id") % 97 == k, F.rand(k)).otherwise(0.0).alias(g) for k, g in enumerate(GROUPS)])
    rows = spark.createDataFrame(rows.toPandas())  # the same values at every reading
    rows = rows.withColumn("acq_date", F.col("acq_date").cast("date"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = anomaly.calibrated(rows, "2030-01-01")
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = got.select("site_id", "acq_date", "scored", *[f"{g}_pct" for g in GROUPS], *GROUPS).collect()
        spread = anomaly._ranked(rows, {GROUPS[0]: "p"}, "2030-01-01").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan
    assert spread < 0.5 * 40_000  # four partitions
    values = {g: np.sort([round(r[g], 9) for r in found if r.scored]) for g in GROUPS}
    for r in found[::37]:
        for g in GROUPS:
            x = round(r[g], 9)
            want = (np.searchsorted(values[g], x, "left") + np.searchsorted(values[g], x, "right")) / (2 * len(values[g]))
            assert r[f"{g}_pct"] == pytest.approx(want) if r.scored else r[f"{g}_pct"] is None
