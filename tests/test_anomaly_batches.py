"""Sites of equal length worked out together against each alone."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberline.config import GROUPS
from emberline.operators import anomaly


def test_sites_together_equal_each_alone(monkeypatch):
    """Any mix of lengths, long ones too, in groups of any size: the same numbers, bit by bit; no site goes alone but for the long ones."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 7, 7, 7, 30, 30, 31, anomaly.MATRIX, anomaly.MATRIX + 1, 30, 1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    days = np.concatenate([np.cumsum(rng.choice([1, 2, 9, 45], n)) + 8_000 for n in sizes])
    detections = rng.integers(1, 9, len(days))
    mean = np.round(rng.random(len(days)) * 50, 1)
    top = np.where(rng.random(len(days)) < 0.5, 20.0, mean + 1)
    want = [anomaly.site_history(*[x[a : a + n] for x in (days, detections, mean, top)]) for a, n in zip(starts, sizes)]
    alone, one = [], anomaly.site_history
    monkeypatch.setattr(anomaly, "site_history", lambda *x: alone.append(len(x[0])) or one(*x))
    for most in (anomaly._AT_ONCE, 1):
        monkeypatch.setattr(anomaly, "_AT_ONCE", most)
        got = anomaly.site_histories(starts, days, detections, mean, top)
        for name in want[0]:
            np.testing.assert_array_equal(got[name], np.concatenate([w[name] for w in want]), err_msg=name)
    assert alone == [anomaly.MATRIX + 1] * 2


def test_a_frozen_reference_is_asked_for_each_value_once(spark, monkeypatch):
    """Thousands of days that hold the same few values look these up once, so no task sorts the days of a value."""
    from pyspark.sql import functions as F

    days = spark.range(3_000).select(F.format_string("S%d", "id").alias("site_id"), F.lit("2000-01-01").cast("date").alias("acq_date"), F.lit(True).alias("scored"), *[(F.col("id") % n).cast("double").alias(g) for n, g in enumerate(anomaly.c.GROUPS, 2)])
    frozen = anomaly.cut(anomaly.reference(days, "2000-12-31"))
    asked, cut = [], anomaly.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["grp", "v", "held"]:
            asked.append(out.count())
        return out

    monkeypatch.setattr(anomaly, "cut", counted)
    found = anomaly.against(days, frozen)
    want = anomaly.calibrated(days, "2000-12-31")
    assert len(asked) == 2 and asked[0] == 2 + 3 + 4 + 5
    columns = ["site_id", *[f"{g}_pct" for g in anomaly.c.GROUPS], "c_score"]
    assert found.select(columns).exceptAll(want.select(columns)).count() == 0 and found.count() == 3_000


def test_sites_go_on_together(monkeypatch):
    """sites of any mix of lengths go on from a day in groups, only long ones day by day; a day's list is empty, never null."""
    rng = np.random.default_rng(5)
    lengths = [(0, 3), (4, 2), (4, 2), (10, 30), (1, 1), (anomaly.MATRIX, 3), (6, 0)]
    rows, want = [], []
    for s, (p, j) in enumerate(lengths):
        days = np.cumsum(rng.choice([1, 2, 9, 45], p + j)) + 8_000
        n, mean = rng.integers(1, 9, p + j), np.round(rng.random(p + j) * 50, 1)
        whole = anomaly.site_history(days, n, mean, mean + 1)
        before = np.flatnonzero(~np.isnan(whole["ewma"][:p]))
        last = (whole["ewma"][before[-1]], whole["cusum"][before[-1]]) if len(before) else (0.0, 0.0)
        none = {f"{x}_held": [] for x in anomaly._HELD}
        rows.append({"site_id": f"S{s}", "day": None, "since": int(days[p]) if j else 9_999_999, "n": None, "last_ewma": last[0], "last_cusum": last[1]} | none)
        rows += [{"site_id": f"S{s}", "day": int(d), "detections": int(a), "mean_frp": b, "max_frp": b + 1} | none for d, a, b in zip(days, n, mean)]
        want.append({k: v[p:] for k, v in whole.items()} | {"sorted": np.sort(mean + 1), "n": p + j})
    kinds = {"site_id": pa.string(), "day": pa.int32(), "detections": pa.int64(), "mean_frp": pa.float64(), "max_frp": pa.float64(), "since": pa.int32(), "first_day": pa.int32(), "last_day": pa.int32(), "n": pa.int64(), "last_ewma": pa.float64(), "last_cusum": pa.float64()} | {f"{x}_held": pa.list_(pa.float64()) for x in anomaly._HELD}
    steps, step = [], anomaly.Running.step
    monkeypatch.setattr(anomaly.Running, "step", lambda *x: steps.append(1) or step(*x))
    results, states = anomaly._gone_on(pa.Table.from_pylist(rows, schema=pa.schema(kinds)))
    for name in ("history_days", "history_span", "scored", "intensity", "density", "recurrence_burst", "ewma", "cusum"):
        got = np.array([{None: np.nan}.get(v, v) for v in results[name].to_pylist()], float)
        expected = np.concatenate([w[name] for w in want]).astype(float)
        np.testing.assert_allclose(got, np.where(expected == -1, np.nan, expected) if name == "history_span" else expected, rtol=0, atol=1e-12, err_msg=name)
    assert states["n"].to_pylist() == [w["n"] for w in want]
    assert all(np.array_equal(a, w["sorted"]) for a, w in zip(states["max_frp_held"].to_pylist(), want))
    assert len(steps) == 3


def test_few_values_are_looked_up_where_the_rows_are(spark):
    """a column of few different values shuffles no row to rank it; the ranks are those of the shuffled way."""
    rows = spark.range(3_000).select(F.concat(F.lit("S"), F.col("id") % 50).alias("site_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 50).cast("int")).alias("acq_date"), (F.col("id") % 11 > 0).alias("scored"), *[(F.col("id") % (97 + k) / 7 - 1).alias(g) for k, g in enumerate(GROUPS)])
    few = anomaly.calibrated(rows, "2020-02-01")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    names = ["site_id", "acq_date", "c_raw", "c_score"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        dealt = anomaly.calibrated(rows, "2020-02-01").select(*names).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(str, few.select(*names).collect())) == sorted(map(str, dealt))
