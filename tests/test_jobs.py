"""Jobs over the store: refreshes, rebuilds that go on where they stopped, evidence files, checks of files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from emberline.operators import audit
from emberline.plans import windows
from emberline.sources import bootstrap, landing
from emberline.streaming import jobs, live

SITES = [f"S{i}" for i in range(4)]


def begun(spark, root, days=40):
    """Four sites with some days each, as a backfill without results leaves them."""
    store = live.open_store(spark, root)
    batch = store.begin()
    batch.put("sites", spark.createDataFrame([(s, 10.0 + i, 20.0, "KNOWN") for i, s in enumerate(SITES)], "site_id string, latitude double, longitude double, status string"))
    every = spark.range(days * 4).select(F.concat(F.lit("S"), F.col("id") % 4).alias("site_id"), F.date_add(F.lit("2025-01-01").cast("date"), (F.floor(F.col("id") / 4) * 3).cast("int")).alias("acq_date"), (F.col("id") % 3 + 1).alias("detections"), (F.col("id") % 7).cast("double").alias("mean_frp"), (F.col("id") % 11 + 7).cast("double").alias("max_frp"))
    batch.put("daily", every)
    batch.put("detections", every.select(F.concat("site_id", F.col("acq_date").cast("string")).alias("detection_id"), "site_id", "acq_date", F.lit("VIIRS_NOAA20_NRT").alias("source_sensor"), F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"), F.col("max_frp").alias("frp"), F.lit("D").alias("daynight")))
    batch.commit()
    return store


def test_daily_refresh_skips_and_refuses(spark, tmp_path):
    store = begun(spark, str(tmp_path / "s"))
    assert jobs.refresh_states(store, "2025-02-01")["status"] == "COMPLETED"
    version = store.manifest()["version"]
    assert jobs.refresh_states(store, "2025-02-01")["status"] == "ALREADY_COMPLETED" and store.manifest()["version"] == version
    jobs.refresh_states(store, "2025-03-01")
    jobs.refresh_states(store, "2025-02-15")  # a past day: history only
    assert {str(r.as_of) for r in live.table(store, "b_latest").collect()} == {"2025-03-01"}
    assert live.table(store, "b_history").count() == 12
    with pytest.raises(ValueError, match="S0, S1, S2, S3"):
        jobs.refresh_states(store, "2024-12-31")
    store.truncate("b_history")
    assert live.table(store, "b_history").count() == 0 and live.table(store, "b_latest").count() == 4


def tables_of(store):
    out = {}
    for name in ("b_latest", "b_history", "a_latest", "a_history", "c_latest", "scores", "snapshots"):
        df = live.table(store, name)
        out[name] = sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    return out


def test_a_rebuild_goes_on_where_it_stopped(spark, tmp_path):
    planned = spark.createDataFrame([("F", "2025-01-01", "2025-01-05", "PLANNED")], "family string, window_start string, window_end string, status string")
    done = planned.withColumn("status", F.lit("COMPLETED"))
    pixels = spark.createDataFrame([(s, 50) for s in SITES], "site_id string, code int")
    how = {"planned": planned, "pixels": pixels}
    whole = begun(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="without coverage"):
        jobs.rebuild_snapshot(whole, "2025-05-01", "SRC", audited=planned, **how)
    assert jobs.rebuild_snapshot(whole, "2025-05-01", "SRC", audited=done, **how) == {"status": "COMPLETED", "started_at": "coverage", "stage": "publish"}
    want = tables_of(whole)
    assert len(want["a_latest"]) == 4 and len(want["scores"]) == 160 and "CURRENT" in want["snapshots"][0]

    stopped = begun(spark, str(tmp_path / "b"))
    for stage, after in zip(jobs.STAGES[:-1], jobs.STAGES[1:]):
        out = jobs.rebuild_snapshot(stopped, "2025-05-01", "SRC", audited=done, stop_after=stage, **how)
        assert out["stage"] == stage and out["status"] == "STOPPED"
    assert jobs.rebuild_snapshot(stopped, "2025-05-01", "SRC", audited=done, **how)["started_at"] == "publish"
    assert tables_of(stopped) == want

    # a site that is new lacks results; only it is worked out
    batch = stopped.begin()
    batch.put("sites", spark.createDataFrame([("NEW", 1.0, 2.0, "PROMOTED")], "site_id string, latitude double, longitude double, status string"))
    batch.put("daily", spark.createDataFrame([("NEW", "2025-04-01", 1, 2.0, 3.0)], "site_id string, acq_date string, detections long, mean_frp double, max_frp double"))
    batch.put("detections", spark.createDataFrame([("N1", "NEW", "2025-04-01", "VIIRS_NOAA20_NRT", 1.0, 2.0, 3.0, "N")], "detection_id string, site_id string, acq_date string, source_sensor string, latitude double, longitude double, frp double, daynight string"))
    batch.commit()
    with pytest.raises(ValueError, match="without results: identity 1"):
        jobs.rebuild_snapshot(stopped, "2025-05-02", "SRC", audited=done, missing_only=True, **how)
    more = pixels.union(spark.createDataFrame([("NEW", 10)], "site_id string, code int"))
    jobs.rebuild_snapshot(stopped, "2025-05-03", "SRC", planned, done, more, missing_only=True)
    now = tables_of(stopped)
    assert len(now["a_latest"]) == 5 and len(now["scores"]) == 161 and sum("CURRENT" in r for r in now["snapshots"]) == 1 and sum("SUPERSEDED" in r for r in now["snapshots"]) == 1
    assert jobs.rebuild_identities(stopped, "2025-02-01", pixels, spark.createDataFrame([("S1",), ("NEW",)], "site_id string")) == {"sites": 2, "scored": 1, "unavailable": 1}
    with pytest.raises(PermissionError):
        jobs.inject(stopped, pixels, "2025-05-02")


def test_evidence_files(spark, tmp_path):
    (tmp_path / "gem.csv").write_text("latitude,longitude,facility_name,subclass\n1,2,Plant A,coal\n3,4,,\n,5,No place,\n")
    rows = bootstrap.facility_evidence(bootstrap.read_csv(spark, str(tmp_path / "gem.csv")), bootstrap.FACILITIES["gem"]).collect()
    assert [(r.evidence_id, r.facility_name, r.facility_type, r.coordinate_quality) for r in rows] == [("GEM_00000", "Plant A", "coal", "EXACT"), ("GEM_00001", "PowerPlant_1", "power_plant", "EXACT")]
    (tmp_path / "icar.csv").write_text("latitude,longitude,event_date,event_end_date,acq_time\n1,2,2025-03-01,2025-03-04,10:30:00\n3,4,not a date,,\n5,6,2025-04-01,,late\n")
    rows = bootstrap.event_evidence(bootstrap.read_csv(spark, str(tmp_path / "icar.csv")), bootstrap.EVENTS["icar"]).collect()
    assert [(r.evidence_id, str(r.event_start), str(r.event_end), str(r.observed_at)) for r in rows] == [("ICAR_000000", "2025-03-01", "2025-03-04", "2025-03-01 10:30:00"), ("ICAR_000001", "None", "None", "None"), ("ICAR_000002", "2025-04-01", "None", "2025-04-01 00:00:00")]
    raw = spark.createDataFrame([("S1", "1", "2", "0.5", None)], "site_id string, latitude string, longitude string, tree_fraction string, crop_fraction string")
    row = bootstrap.sites(raw).first()
    assert (row.land_cover, row.spatial_stats, row.status) == ('{"tree_fraction":0.5}', None, "ACTIVE")
    b = spark.createDataFrame([("S1", "new", "low")], "site_id string, state string, confidence string")
    assert bootstrap.states(b).first()[:3] == ("S1", "NEW", "LOW") and bootstrap.states(b.drop("confidence")).first()[2] == "HIGH"
    with pytest.raises(Exception, match="no state: GONE"):
        bootstrap.states(b.withColumn("state", F.lit("GONE"))).collect()
    assert bootstrap.labels(spark.createDataFrame([("S1", "1", None), ("S2", "7", None)], "site_id string, label string, source string")).collect()[0][:] == ("S1", 1, "REFERENCE")
    many = bootstrap.numbered(spark.range(100).repartition(7)).select("n").collect()
    assert sorted(r[0] for r in many) == list(range(100))


def test_files_with_either_line_end(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.json").write_bytes(b"{\r\n}\r\n")
    (folder / "b.bin").write_bytes(b"x\r\ny")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    rows = [("a.json", digest(b"{\n}\n").upper(), False), ("b.bin", digest(b"x\ny"), False), ("c.txt", "0", True), ("d.txt", "0", False)]
    found = landing.verified_files(spark, str(folder), spark.createDataFrame(rows, "name string, sha256 string, optional boolean"))
    assert {r.name: r.status for r in found.collect()} == {"a.json": "OK", "b.bin": "INVALID", "c.txt": "ABSENT", "d.txt": "MISSING"}


def test_windows_and_protected_rows(spark):
    records = spark.createDataFrame([("2025-01-01",), ("2025-02-01",)], "acq_date string").withColumn("acq_date", F.to_date("acq_date"))
    assert windows.require_window(records, "2025-01-01", "2025-02-01").count() == 2
    with pytest.raises(Exception, match="outside the window: 2025-02-01"):
        windows.require_window(records, "2025-01-01", "2025-01-05").collect()
    rows = spark.createDataFrame([("protected_reviews", 2), ("duplicate_rows", 9)], "name string, n long")
    with pytest.raises(ValueError, match="protected_reviews 2"):
        audit.require_unprotected(rows)
    audit.require_unprotected(rows.where("name = 'duplicate_rows'"))
