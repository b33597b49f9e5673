"""The engine's operators against golden values and against the SQL of their queries."""

import bisect
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberline.config import CORE, GROUPS, LOW, STRONG
from emberline.functions import geo, normalize
from emberline.operators import anomaly, daily, decide, identity, resolver, spatial, temporal, upsert
from emberline.plans import catalog
from emberline.sources import landing, sinks
from emberline.streaming import live

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, int) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v) if v is not None and not isinstance(v, (bool, str)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_distances_and_tiles(spark):
    lit = [F.lit(float(x)) for x in (20, 78, 21, 78)]
    row = one(spark, geo.haversine_m(*lit).alias("d"), geo.tile_id(F.lit(22.1), F.lit(72.5)).alias("a"), geo.tile_id(F.lit(-1.0), F.lit(-70.0)).alias("b"))
    assert 111_000 < row.d < 112_000 and (row.a, row.b) == ("N21E072", "S03W072")


def test_times_and_ids(spark):
    df = spark.createDataFrame([("621.0",), ("35",), (None,), ("123456",)], "t string")
    assert [r[0] for r in df.select(normalize.acq_time(F.col("t"))).collect()] == ["0621", "0035", "0000", "123456"]
    make = lambda lat, time: normalize.detection_id(F.lit("S"), F.lit("N20"), F.lit(lat), F.lit(72.5678), F.lit("2026-01-01"), F.lit(time))
    row = one(spark, make(22.12341, "0035").alias("a"), make(22.12344, "0035").alias("b"), make(22.12341, "0036").alias("c"))
    assert row.a == row.b != row.c


def test_strict_records_stop_the_job(spark):
    bad = spark.createDataFrame([("95", "1", "2025-01-01", "1", "", "D", None)], "latitude string, longitude string, acq_date string, acq_time string, frp string, daynight string, confidence string")
    with pytest.raises(Exception, match="latitude"):
        normalize.strict(normalize.normalize(bad)).collect()


def days(spark, site, *dates):
    return spark.createDataFrame([(site, d, 1, 5.0, 5.0) for d in dates], "site_id string, acq_date string, detections long, mean_frp double, max_frp double").withColumn("acq_date", F.to_date("acq_date"))


@pytest.mark.parametrize("dates, as_of, state", [(["2025-05-01", "2025-05-10"], "2025-05-15", "NEW"), (["2025-01-01", "2025-01-10"], "2025-05-15", "DORMANT"), (["2025-01-01", "2025-01-05", "2025-05-01"], "2025-05-10", "REACTIVATED")])
def test_temporal_states(spark, dates, as_of, state):
    assert temporal.temporal_state(days(spark, "S", *dates), as_of).first()["state"] == state


def test_short_history_has_no_score(spark):
    row = anomaly.anomaly_score(days(spark, "S", "2025-01-01", "2025-01-02", "2025-01-03"), "2025-12-31").orderBy(F.desc("acq_date")).first()
    assert row["level"] == "INSUFFICIENT_HISTORY" and row["c_score"] is None


def test_robust_baseline_of_a_list(monkeypatch):
    for most in (160, 0):  # all at once, and day by day
        monkeypatch.setattr(anomaly, "MATRIX", most)
        m, s = anomaly.prefix_robust(np.array([1.0, 9, 2, 8, 4]))
        assert m[5] == 4 and s[5] == pytest.approx(1.4826 * 3) and math.isnan(m[0])
        assert len(anomaly.prefix_robust(np.zeros(0))[0]) == 1
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(3, 300), 1)
    both = []
    for most in (1000, 0):
        monkeypatch.setattr(anomaly, "MATRIX", most)
        both.append(anomaly.prefix_robust(values))
    assert np.allclose(both[0][0], both[1][0], equal_nan=True, rtol=0, atol=1e-12) and np.allclose(both[0][1], both[1][1], equal_nan=True, rtol=0, atol=1e-12)


def test_a_site_with_very_many_days(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("S").alias("site_id"), F.date_add(F.lit("1960-01-01").cast("date"), F.col("id").cast("int")).alias("acq_date"), (F.col("id") % 7 + 1).alias("detections"), (F.col("id") % 13).cast("double").alias("mean_frp"), (F.col("id") % 17).cast("double").alias("max_frp"))
    got = anomaly.signals(rows).agg(F.count("*"), F.count_if("scored"), F.max("history_days")).first()
    assert tuple(got) == (n, n - 30, n - 1)


def test_midrank_counts_equal_values_by_half(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 2.5, 9.0, None)], "v double")
    assert [r[0] for r in df.select(anomaly.midrank(F.col("v"), [1.0, 2.0, 2.0, 3.0])).collect()] == [0.0, 0.125, 0.5, 0.75, 1.0, None]


def test_calibration_ranks_against_every_day(spark):
    rng = random.Random(7)
    rows = [(f"S{i % 50}", "2025-01-01" if i < 3000 else "2025-03-01", i % 11 > 0, *[rng.choice([0.0, round(rng.random() * 20, 4)]) for _ in range(4)]) for i in range(4000)]
    schema = "site_id string, acq_date string, scored boolean, " + ", ".join(f"{g} double" for g in GROUPS)
    df = spark.createDataFrame(rows, schema).withColumn("acq_date", F.to_date("acq_date"))
    got = anomaly.levels(anomaly.calibrated(df, "2025-02-01")).collect()
    held = [r for r in rows if r[2] and r[1] < "2025-02-01"]

    def rank(reference, v):
        return (bisect.bisect_left(reference, v) + bisect.bisect_right(reference, v)) / (2 * len(reference))

    groups = [sorted(round(r[3 + k], 9) for r in held) for k in range(4)]
    raw = lambda r: sum(sorted(rank(groups[k], round(r[3 + k], 9)) for k in range(4))[-2:]) / 2
    final = sorted(round(raw(r), 9) for r in held)
    want = sorted((r[0], *r[3:], rank(final, round(raw(r), 9))) for r in rows if r[2])
    assert len(got) == len(rows)
    assert sorted((r.site_id, *[r[g] for g in GROUPS], r.c_score) for r in got if r.scored) == want
    assert all(r.c_score is None for r in got if not r.scored)
    assert sum(r.level == "CRITICAL" and str(r.acq_date) < "2025-02-01" for r in got) == sum(rank(final, v) >= 0.999 for v in final) > 0


def test_daily_merge(spark):
    schema = "site_id string, acq_date string, detections long, mean_frp double, max_frp double"
    row = daily.merge_daily(spark.createDataFrame([("S", "d", 1, 30.0, 30.0)], schema), spark.createDataFrame([("S", "d", 2, 15.0, 20.0)], schema)).first()
    assert (row.detections, row.mean_frp, row.max_frp) == (3, 20.0, 30.0)


def test_identity_bands(spark):
    df = spark.createDataFrame([(STRONG, None), (CORE, None), (LOW, 0.98), (LOW, 0.85), (0.1, 0.99)], "p_core double, p_visual double")
    got = [r[0] for r in df.select(identity.decision(F.col("p_core"), F.col("p_visual"))).collect()]
    assert got[:3] == ["INDUSTRIAL_CORE_STRONG", "INDUSTRIAL_CORE_POSITIVE", "INDUSTRIAL_PRITHVI_RESCUE"] and got[3:] == ["UNKNOWN", "NONINDUSTRIAL"]


def test_escalation_never_goes_down(spark):
    df = spark.createDataFrame([("S", "d", t, t, level) for t, level in enumerate(("MEDIUM", "CRITICAL", "LOW"))], "site_id string, site_day string, updated_at long, seq long, alert_level string")
    assert [(r.effect, r.level_in_force) for r in decide.escalate(df).orderBy("seq").collect()] == [("CREATED", "MEDIUM"), ("ESCALATED", "CRITICAL"), ("UNCHANGED", "CRITICAL")]


def resolve(spark, new, members=()):
    d = spark.createDataFrame([(f"D{i}", float(a), float(b), i) for i, (a, b) in enumerate(new)], "detection_id string, latitude double, longitude double, seq long")
    m = spark.createDataFrame(list(members), "detection_id string, latitude double, longitude double, site_id string, candidate_id string")
    return {r.detection_id: r for r in resolver.resolve(d, m).collect()}


def test_resolver_matches_accumulates_and_promotes(spark):
    got = resolve(spark, [(22.0003, 72.0003), (24.0, 75.0), (24.0005, 75.0), (24.0, 75.0005), (24.0002, 75.0)], [("M1", 22.0, 72.0, "SITE_001", None), ("M2", 22.05, 72.05, "SITE_002", None)])
    assert got["D0"].status == "MATCHED" and got["D0"].site_id == "SITE_001" and got["D0"].distance_m < 100 and not got["D0"].ambiguous
    assert [got[f"D{i}"].status for i in range(1, 5)] == ["NEW_CANDIDATE", "CANDIDATE_ACCUMULATED", "PROMOTED", "MATCHED"]


def test_resolver_chain_and_ambiguity(spark):
    chain = resolve(spark, [(22.006, 72.0), (22.012, 72.0), (22.018, 72.0)], [("M1", 22.0, 72.0, "SITE_001", None)])
    assert {r.site_id for r in chain.values()} == {"SITE_001"}
    near = resolve(spark, [(22.002, 72.002)], [("M1", 22.0, 72.0, "SITE_001", None), ("M2", 22.005, 72.005, "SITE_002", None)])
    assert near["D0"].ambiguous


def test_versioned_table(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    table.write(spark.range(3))
    table.write(upsert.upsert(table.read(), spark.range(2, 5), ["id"]))
    assert sorted(r[0] for r in table.read().collect()) == [0, 1, 2, 3, 4]


def test_feed_pages_by_time_and_id(spark):
    alerts = spark.createDataFrame([(f"A{i}", "2025-01-01 00:00:00") for i in range(7)], "alert_id string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert live.alerts_since(alerts, None).count() == 5
    assert [r.alert_id for r in live.alerts_since(alerts, ("2025-01-01 00:00:00", "A3"), most=2).collect()] == ["A4", "A5"]
    assert live.frames(alerts).first()[0].startswith("event: alert\ndata: {")


def test_coverage_gaps_read_every_window(spark, tmp_path):
    orders = [(0, 1, "A", "2001-01-01"), (11, 1, "A", "2001-02-01"), (3, 1, "A", "2001-01-02"), (14, 1, "A", "2001-01-20"), (22, 2, "B", "2001-01-01")]  # a window lasts window_id % 5 days more
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(map(str, r)) for r in catalog.coverage_gaps(spark, str(tmp_path)).orderBy("gap_start").collect()]
    assert got == [("CUST_1", "2001-01-06", "2001-01-19"), ("CUST_1", "2001-01-25", "2001-01-31")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("S1", 22.1234567, 72.0, None), ("S2", 1.0, 2.0, "x")], "site_id string, latitude double, longitude double, note string")
    text = sinks.feature_collection(df.orderBy("site_id"), 2, 1)
    assert '"truncated":true' in text and "[72.0,22.12346]" in text and '"note":null' in text
    sinks.export(df, str(tmp_path / "a.csv"))
    assert spark.read.csv(str(tmp_path / "a.csv"), header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "a.txt"))
    assert sinks.backup(spark, {"t": df}, str(tmp_path / "b")).first().n_rows == 2
    with pytest.raises(ValueError):
        landing.require_columns(df, ["frp"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "site_id string, acq_date date, detections long, mean_frp double, max_frp double")
    assert temporal.temporal_state(none, "2025-01-01").count() == 0
    assert anomaly.signals(none).count() == 0
    points = spark.createDataFrame([], "detection_id string, latitude double, longitude double")
    assert spatial.cluster(points).count() == 0
