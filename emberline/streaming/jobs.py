"""Jobs over the store: the daily refresh of states, and the rebuild of the present snapshot in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import STACK_VERSION
from emberline.operators import audit, identity, temporal
from emberline.operators.common import cut
from emberline.operators.store import Store
from emberline.operators.upsert import newer, publish_snapshot
from emberline.plans import windows
from emberline.streaming.live import EMPTY, _now, _Work, apply_batch, table


def refresh_states(store: Store, as_of: str) -> dict:
    """Every site's temporal state as of a day; nothing if all have it already. A site without a day up to it is an error."""
    batch = store.begin()
    day = F.lit(as_of).cast("date")
    sites = table(batch, "sites").select("site_id")
    count = sites.count()
    history, latest = table(batch, "b_history"), table(batch, "b_latest")
    if history.where(F.col("as_of") == day).count() == count and latest.count() == count:
        return {"status": "ALREADY_COMPLETED", "as_of": as_of, "sites": count}
    found = cut(temporal.temporal_state(table(batch, "daily").join(sites, "site_id", "left_semi"), as_of).withColumn("as_of", day))
    lost = sites.join(found, "site_id", "left_anti").orderBy("site_id").limit(10).collect()  # names for the message
    if lost:
        raise ValueError("sites without activity up to the day: " + ", ".join(r[0] for r in lost))
    rows = found.select(*[part.split()[0] for part in EMPTY["b_history"].split(", ")])
    batch.put("b_latest", newer(history, history, rows, ["site_id"]))
    batch.put("b_history", rows)
    batch.commit()
    return {"status": "COMPLETED", "as_of": as_of, "sites": count}


def rebuild_identities(store: Store, as_of: str, pixels: DataFrame, sites: DataFrame | None = None, scorer: identity.Scorer = identity.logistic_stand_in) -> dict:
    """Identity of some or all sites from their detections up to a day, in one commit; sites that lack land cover or detections are counted as unavailable."""
    batch = store.begin()
    work = _Work(store, batch, as_of, _now())
    every = table(batch, "sites").select("site_id")
    work.sites = cut(every if sites is None else every.join(sites.select("site_id").distinct(), "site_id", "left_semi"))
    work.touched = work.sites
    count = work.sites.count()
    scored = work.identify(pixels, scorer, False, until=as_of)
    batch.commit()
    return {"sites": count, "scored": scored, "unavailable": count - scored}


def inject(store: Store, records: DataFrame, as_of: str, enabled: bool = False, **how) -> dict:
    """Made-up records through the live path, where that is switched on; never otherwise."""
    if not enabled:
        raise PermissionError("made-up records are switched off")
    return apply_batch(store, records, as_of, stream="made-up", **how)


#: The stages of a rebuild; each is a commit that leaves its mark.
STAGES = ("coverage", "states", "results", "complete", "publish")


def rebuild_snapshot(store: Store, as_of: str, source: str, planned: DataFrame, audited: DataFrame, pixels: DataFrame, missing_only: bool = False, since: str = "1900-01-01", scorer: identity.Scorer = identity.logistic_stand_in, stop_after: str | None = None) -> dict:
    """Checks coverage, refreshes states, identity and anomaly results, checks that no site lacks one, and publishes the snapshot.

    A rebuild that was stopped goes on with the stage after the last one that was committed; one that is done is done
    again from the start. ``missing_only``: results only of sites that lack one; else of all with a day from ``since``
    on. ``planned`` and ``audited``: request windows (family, window_start, window_end, status). ``stop_after``: a
    stage to end with.
    """
    mark = f"rebuild:{as_of}:{source}"
    done = store.manifest()["marks"].get(mark, "")
    start = STAGES.index(done) + 1 if done in STAGES[:-1] else 0
    out = {"status": "COMPLETED", "started_at": STAGES[start]}
    for stage in STAGES[start:]:
        if stage == "states":
            refresh_states(store, as_of)
        batch = store.begin()
        if stage == "coverage":
            gaps = windows.uncovered(planned, audited).limit(10).collect()  # for the message
            if gaps:
                raise ValueError("windows without coverage from: " + ", ".join(str(r["window_start"]) for r in gaps))
        elif stage == "results":
            _results(store, batch, as_of, pixels, missing_only, since, scorer)
        elif stage == "complete":
            lacking = audit.missing(table(batch, "sites"), identity=table(batch, "a_latest"), state=table(batch, "b_latest"), anomaly=table(batch, "c_latest")).where("sites > 0").collect()  # a row for each table
            if lacking:
                raise ValueError("sites without results: " + ", ".join(f"{r['result']} {r['sites']}" for r in lacking))
        elif stage == "publish":
            batch.put("snapshots", cut(publish_snapshot(table(batch, "snapshots"), STACK_VERSION, as_of, source)))
        batch.marks[mark] = stage
        batch.commit()
        if stage == stop_after:
            return out | {"status": "STOPPED", "stage": stage}
    return out | {"stage": STAGES[-1]}


def _results(store: Store, batch, as_of: str, pixels: DataFrame, missing_only: bool, since: str, scorer: identity.Scorer) -> None:
    """Identity and anomaly results of the chosen sites."""
    sites, days = table(batch, "sites").select("site_id"), table(batch, "daily")
    if missing_only:
        has_all = table(batch, "a_latest").select("site_id").join(table(batch, "c_latest").select("site_id"), "site_id", "left_semi")
        chosen = sites.join(has_all, "site_id", "left_anti")
    else:
        chosen = days.where(F.col("acq_date") >= F.lit(since).cast("date")).select("site_id").distinct().join(sites, "site_id", "left_semi")
    work = _Work(store, batch, as_of, _now())
    work.sites = cut(chosen)
    work.days = cut(days.join(work.sites, "site_id", "left_semi"))
    work.touched = cut(work.days.groupBy("site_id").agg(F.min("acq_date").alias("acq_date")))  # every day follows from the first
    if work.touched.isEmpty():
        return
    work.identify(pixels, scorer, False)
    work.score()
