"""The live path end to end: raw records to alerts, one commit a batch."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import anomaly
from emberline.operators.store import Batch
from emberline.streaming import live

RAW = "latitude string, longitude string, acq_date string, acq_time string, frp string, daynight string, confidence string, satellite string"
LAT, LON = 22.0, 72.0


def records(spark, *rows):
    """(latitude, longitude, date, time, frp)"""
    return spark.createDataFrame([(*map(str, r), "D", "nominal", "N20") for r in rows], RAW)


def at(i, date, time="0100", frp=5.0):
    return (LAT + 0.0005 * i, LON, date, time, frp)


def pixels(spark, *sites):
    return spark.createDataFrame([(s, 50) for s in sites], "site_id string, code int")


def rows(store, name, *columns):
    return sorted(tuple(r) for r in live.table(store, name).select(*columns).collect())


def test_batches_from_text_to_alerts(spark, tmp_path):
    store = live.open_store(spark, str(tmp_path / "s"))
    first = live.apply_batch(store, records(spark, at(0, "2025-05-01"), at(1, "2025-05-02")), "2025-05-10", 0, source_sensor="VIIRS_NOAA20_NRT")
    assert (first["status"], first["n_inserted"], first["n_promoted"], first["n_sites"]) == ("COMPLETED", 2, 0, 0)
    assert [r[0] for r in rows(store, "detections", "status")] == ["CANDIDATE_ACCUMULATED", "NEW_CANDIDATE"]

    # the third promotes, the fourth matches; earlier members get the site, in whatever month they lie
    second = live.apply_batch(store, records(spark, at(2, "2025-05-03"), at(3, "2025-05-03", "0200", 9.0)), "2025-05-10", 1, source_sensor="VIIRS_NOAA20_NRT")
    assert (second["status"], second["n_promoted"], second["n_sites"], second["n_failed"], second["n_alerts"]) == ("COMPLETED_DEGRADED", 1, 1, 1, 0)
    site = rows(store, "sites", "site_id", "latest_seen", F.round("latitude", 6))
    assert len(site) == 1 and str(site[0][1]) == "2025-05-03" and site[0][2] == round(LAT + 0.0005, 6)
    name = site[0][0]
    assert rows(store, "detections", "status", "site_id") == [("MATCHED", name), ("PROMOTED", name), ("PROMOTED_MEMBER", name), ("PROMOTED_MEMBER", name)]
    assert [(str(d), n, m) for d, n, m in rows(store, "daily", "acq_date", "detections", "max_frp")] == [("2025-05-01", 1, 5.0), ("2025-05-02", 1, 5.0), ("2025-05-03", 2, 9.0)]
    assert rows(store, "b_latest", "state") == [("NEW",)] and rows(store, "a_latest", "site_id") == []

    # with land cover there is an identity, and a new site is an alert; the same batch again writes nothing
    third = live.apply_batch(store, records(spark, at(0, "2025-05-05")), "2025-05-10", 2, source_sensor="VIIRS_NOAA20_NRT", pixels=pixels(spark, name), scorer=lambda f: f.withColumn("p_core", F.lit(0.5)), visual=True)
    assert (third["status"], third["n_alerts"], third["n_failed"]) == ("COMPLETED", 1, 0)
    assert rows(store, "alerts", "site_id", "alert_type", "alert_level", "status") == [(name, "NEW_SOURCE_REVIEW", "MEDIUM", "ACTIVE")]
    assert rows(store, "queue", "site_id", "state") == [(name, "PENDING")] and len(rows(store, "a_history", "inference_id")) == 1
    before = store.manifest()["version"]
    assert live.apply_batch(store, records(spark, at(0, "2025-05-05")), "2025-05-10", 2)["status"] == "REPEATED"
    assert store.manifest()["version"] == before

    # late by months, and a revision: the days before stay as they are, what follows is made anew
    late = live.apply_batch(store, records(spark, at(1, "2025-01-01", "0900", 3.0), at(2, "2025-05-03", "0100", 50.0)), "2025-05-10", 3, source_sensor="VIIRS_NOAA20_NRT")
    assert (late["n_inserted"], late["n_revised"]) == (1, 1)
    assert rows(store, "b_latest", "state") == [("REACTIVATED",)]
    assert dict((str(d), m) for d, m in rows(store, "daily", "acq_date", "max_frp"))["2025-05-03"] == 50.0
    want = {(r.site_id, r.acq_date): r.history_days for r in anomaly.signals(live.table(store, "daily")).collect()}
    assert {(s, d): h for s, d, h in rows(store, "scores", "site_id", "acq_date", "history_days")} == want

    # the archive's delivery of the same observation is known; the live one stays
    again = live.apply_batch(store, records(spark, at(2, "2025-05-03", "0100", 50.0)), "2025-05-10", 4, source_sensor="VIIRS_NOAA20_SP")
    assert (again["n_inserted"], again["n_unchanged"], again["n_crossed"]) == (0, 1, 1) and len(rows(store, "detections", "detection_id")) == 6

    # an earlier cutoff adds to history, and leaves the latest state
    live.apply_batch(store, records(spark, at(1, "2025-02-01", "0900", 3.0)), "2025-03-01", 5, source_sensor="VIIRS_NOAA20_NRT")
    assert [str(r[0]) for r in rows(store, "b_latest", "as_of")] == ["2025-05-10"] and len(rows(store, "b_history", "as_of")) == 2
    assert {r[0] for r in rows(store, "runs", "status")} == {"COMPLETED", "COMPLETED_DEGRADED"}
    assert [r for r in store.verify().collect() if r.expected != r.found] == []


def test_deferred_results(spark, tmp_path):
    store = live.open_store(spark, str(tmp_path / "s"))
    run = live.apply_batch(store, records(spark, at(0, "2025-05-01"), at(1, "2025-05-02"), at(2, "2025-05-03")), "2025-05-10", source_sensor="VIIRS_NOAA20_NRT", models=False)
    assert (run["status"], run["n_promoted"], run["n_sites"]) == ("COMPLETED", 1, 1)
    assert len(rows(store, "daily", "acq_date")) == 3 and rows(store, "b_latest", "state") == [] and rows(store, "scores", "site_id") == []


def test_a_batch_that_fails_or_is_killed_leaves_its_row_alone(spark, tmp_path, monkeypatch):
    store = live.open_store(spark, str(tmp_path / "s"))
    good = records(spark, at(0, "2025-05-01"), at(1, "2025-05-02"), at(2, "2025-05-03"))
    with pytest.raises(Exception, match="latitude"):
        live.apply_batch(store, records(spark, at(0, "2025-05-01"), (99, 72, "2025-05-01", "1", "1")), "2025-05-10", 0, source_sensor="X")
    assert rows(store, "runs", "status", "n_failed") == [("FAILED", 1)] and set(store.manifest()["tables"]) == {"runs"}

    put, calls = Batch.put, []

    def failing(self, name, *more):
        calls.append(name)
        if name == "daily":
            raise OSError("lost")
        return put(self, name, *more)

    monkeypatch.setattr(Batch, "put", failing)
    with pytest.raises(OSError):
        live.apply_batch(store, good, "2025-05-10", 0, source_sensor="X", models=False)
    monkeypatch.setattr(Batch, "put", put)
    assert "detections" in calls and set(store.manifest()["tables"]) == {"runs"} and store.files.names("detections") == []  # staged files are gone too

    # a driver that dies between its first row and its commit
    live._record(store, {"run_id": "RUN_dead", "status": "RUNNING"})
    assert live.recover(store) == 1 and rows(store, "runs", "status") == [("FAILED",)] * 3
    assert live.apply_batch(store, good, "2025-05-10", 0, source_sensor="X", models=False)["n_promoted"] == 1


def test_a_stream_of_landed_files(spark, tmp_path):
    store, folder = live.open_store(spark, str(tmp_path / "s")), str(tmp_path / "landing")
    records(spark, at(0, "2025-05-01"), at(1, "2025-05-02"), at(2, "2025-05-03")).write.csv(folder, header=True)
    stream = lambda: spark.readStream.schema(RAW).csv(folder, header=True)
    live.ingest(store, stream(), "2025-05-10", source_sensor="VIIRS_NOAA20_NRT", models=False).awaitTermination()
    records(spark, at(1, "2025-05-04")).write.mode("append").csv(folder, header=True)
    live.ingest(store, stream(), lambda: "2025-05-11", source_sensor="VIIRS_NOAA20_NRT", models=False).awaitTermination()
    live.ingest(store, stream(), "2025-05-12", source_sensor="VIIRS_NOAA20_NRT", models=False).awaitTermination()  # nothing new
    assert [s for (s,) in rows(store, "detections", "status")] == ["MATCHED", "PROMOTED", "PROMOTED_MEMBER", "PROMOTED_MEMBER"]
    assert store.manifest()["marks"] == {"live": 1} and len(rows(store, "daily", "acq_date")) == 4
