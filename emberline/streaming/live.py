"""The live path: landed records become detections, sites, site-days, results and alerts, batch by batch, each in one commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberline.config import FAMILY, FEATURES, GROUPS, LIVE_SOURCE, STACK_VERSION
from emberline.functions import normalize
from emberline.operators import anomaly, daily, decide, features, identity, resolver, temporal
from emberline.operators.common import as_of, cut, first_by
from emberline.operators.store import Conflict, Spec, Store, by_site, metrics
from emberline.operators.upsert import insert_absent, newer

#: Members lie in buckets of one degree, detections in those of a month: both follow from what makes a row itself.
_DEGREE = "concat_ws('_', cast(floor(latitude) as string), cast(floor(longitude) as string))"
SPECS = {
    "detections": Spec(("detection_id",), "date_format(acq_date, 'yyyyMM')", ("acq_date",)),
    "members": Spec(("detection_id",), _DEGREE, ("latitude", "longitude")),
    "sites": by_site(), "daily": by_site("site_id", "acq_date"),
    "a_latest": by_site(), "a_features": by_site(), "a_history": by_site("inference_id"),
    "b_latest": by_site(), "b_history": by_site("site_id", "as_of"),
    "c_latest": by_site(), "c_state": by_site(), "scores": by_site("site_id", "acq_date"), "c_reference": Spec(("grp", "v"), "grp", ("grp",)),
    "alerts": by_site("fingerprint"), "queue": by_site(), "snapshots": Spec(("snapshot_id",)), "runs": Spec(("run_id",)),
}

_PAYLOAD = "source_sensor string, satellite string, instrument string, latitude double, longitude double, acq_date date, acq_time string, frp double, bright_ti4 double, bright_ti5 double, scan double, track double, confidence string, daynight string, version string"
_RESOLVED = "site_id string, status string, distance_m double, ambiguous boolean, candidate_sites array<string>"
EMPTY = {
    "detections": f"detection_id string, physical_key string, {_PAYLOAD}, {_RESOLVED}",
    "members": "detection_id string, latitude double, longitude double, site_id string, candidate_id string, acq_date date",
    "sites": "site_id string, latitude double, longitude double, status string, promoted_at timestamp, latest_seen date",
    "daily": "site_id string, acq_date date, detections long, mean_frp double, max_frp double",
    "a_latest": "site_id string, p_core double, p_visual double, decision string, class string, visual_status string, as_of date, inference_id string",
    "b_history": "site_id string, state string, confidence string, last_date date, days_since_last int, active_days_30 long, active_days_90 long, active_days_180 long, active_days_365 long, as_of date",
    "c_state": anomaly.STATE,
    "c_latest": "site_id string, event_date date, level string, c_score double, c_raw double, drivers string",
    "scores": "site_id string, acq_date date, ewma double, cusum double, level string, c_score double",
    "c_reference": "grp string, part int, v double, low long, high long, total long",
    "alerts": "alert_id string, fingerprint string, site_id string, site_day date, alert_type string, alert_level string, evidence_required boolean, headline string, reason_codes string, is_escalation boolean, previous_level string, previous_type string, status string, created_at timestamp, updated_at timestamp",
    "queue": "site_id string, state string, owner string, lease_until timestamp, tried_at timestamp, attempts int, outcome string",
    "snapshots": "snapshot_id string, version string, snapshot_date date, source string, status string",
    "runs": "run_id string, stream string, batch long, status string, n_read long, n_unique long, n_inserted long, n_revised long, n_unchanged long, n_crossed long, n_promoted long, n_sites long, n_alerts long, n_failed long, error string, started_at timestamp, ended_at timestamp",
}
EMPTY["a_history"] = EMPTY["a_latest"]
EMPTY["b_latest"] = EMPTY["b_history"]
EMPTY["a_features"] = "site_id string, as_of date, " + ", ".join(f"{n} double" for n in FEATURES)


def open_store(spark: SparkSession, root: str) -> Store:
    """The live path's tables under a folder that driver and executors share."""
    return Store(spark, root, SPECS)


def table(source, name: str, buckets: list[str] | None = None) -> DataFrame:
    """A table of a store or of a batch with all its columns, empty where nothing was ever written."""
    found = source.read(name, buckets, empty=EMPTY[name])
    lacking = [f for f in StructType.fromDDL(EMPTY[name]).fields if f.name not in found.columns]
    return found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}) if lacking else found


# -- the ledger ------------------------------------------------------------------------------------------------------
def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def run_row(spark: SparkSession, run: dict) -> DataFrame:
    """One row of the ledger; what isn't known is null."""
    times = {c: F.lit(run.get(c)).cast("timestamp").alias(c) for c in ("started_at", "ended_at")}
    names = [part.split() for part in EMPTY["runs"].split(", ")]
    return spark.range(1).select(*[times.get(n) if n in times else F.lit(run.get(n)).cast(t).alias(n) for n, t in names])


def _record(store: Store, run: dict) -> None:
    """Writes a run's row alone, after any commit that comes between."""
    while True:
        batch = store.begin()
        batch.put("runs", run_row(store.spark, run))
        try:
            batch.commit()
            return
        except Conflict:
            continue


def recover(store: Store) -> int:
    """Marks runs that were killed (RUNNING, though nobody works on them) as FAILED; how many. For the start, before any batch."""
    lost = table(store, "runs").where("status = 'RUNNING'").withColumn("status", F.lit("FAILED")).withColumn("error", F.lit("killed")).withColumn("ended_at", F.lit(_now()).cast("timestamp"))
    batch = store.begin()
    found = batch.put("runs", cut(lost))["rows"]
    if found:
        batch.commit()
    else:
        batch.discard()
    return found


# -- one batch -------------------------------------------------------------------------------------------------------
def apply_batch(store: Store, records: DataFrame, day: str, batch: int | None = None, stream: str = "live", source_sensor: str | None = None, models: bool = True, pixels: DataFrame | None = None, scorer: identity.Scorer = identity.logistic_stand_in, visual: bool = False, at: str | None = None) -> dict:
    """One batch of raw records, from text to alerts, in one commit; its row of the ledger as a dict.

    A run is RUNNING in the ledger while it works, then COMPLETED, COMPLETED_DEGRADED (sites whose identity couldn't
    be scored, for want of land cover, are left without one) or FAILED with the error; of a failed or killed batch
    nothing but that row is left. ``batch`` numbers a stream's batches: one that is not above the last committed one
    writes nothing. An invalid record fails the whole batch. Without ``models`` the site-days are rebuilt and all
    results left to a later refresh. Any record is taken however late it is: its site-day is made anew, and what
    follows from it on. ``pixels`` (site_id, code): land cover; ``visual``: uncertain sites are queued for imagery.
    """
    if batch is not None and batch <= store.manifest()["marks"].get(stream, -1):
        return {"status": "REPEATED", "batch": batch, "stream": stream}
    run = {"run_id": f"RUN_{uuid.uuid4().hex}", "stream": stream, "batch": batch, "started_at": _now(), "status": "RUNNING"}
    _record(store, run)
    work = store.begin()
    try:
        run |= _Work(store, work, day, at or _now()).apply(records, source_sensor, models, pixels, scorer, visual)
        run |= {"ended_at": _now()}
        work.put("runs", run_row(store.spark, run))
        if batch is not None:
            work.marks[stream] = batch
        work.commit()
    except BaseException as error:
        work.discard()
        _record(store, run | {"status": "FAILED", "n_failed": 1, "error": str(error)[:2_000], "ended_at": _now()})
        raise
    return run


class _Work:
    """The steps of one batch over the tables as it leaves them."""

    def __init__(self, store: Store, batch, day: str, at: str) -> None:
        self.store, self.batch, self.day, self.at = store, batch, day, at
        self.cutoff = F.lit(day).cast("date")

    def read(self, name: str, near: DataFrame | None = None) -> DataFrame:
        """A table, or those of its buckets that the keys of ``near`` lie in."""
        return table(self.batch, name, None if near is None else self.store.buckets_of(name, near))

    def apply(self, records: DataFrame, source_sensor: str | None, models: bool, pixels: DataFrame | None, scorer: identity.Scorer, visual: bool) -> dict:
        counts = self.ingest(records, source_sensor)
        counts["status"] = "COMPLETED"
        if not counts.pop("touched"):
            return counts
        if models:
            self.days = cut(self.read("daily", self.touched).join(self.sites, "site_id", "left_semi"))
            failed = counts["n_sites"] - self.identify(pixels, scorer, visual)
            self.state()
            self.score()
            counts |= {"n_alerts": self.decide(), "n_failed": failed, "status": "COMPLETED_DEGRADED" if failed else "COMPLETED"}
        return counts

    # from records to site-days
    def ingest(self, records: DataFrame, source_sensor: str | None) -> dict:
        read, unique, kinds = Observation(), Observation(), Observation()
        raw = records if "_seq" in records.columns else records.withColumn("_seq", F.monotonically_increasing_id())
        raw = cut(raw.observe(read, F.count(F.lit(1)).alias("n")))
        typed = normalize.strict(normalize.full_records(raw, source_sensor))
        new = cut(first_by(typed, ["detection_id"], [F.desc("_seq")]).select("detection_id", "physical_key", *normalize.PAYLOAD, "_seq").observe(unique, F.count(F.lit(1)).alias("n")))
        out = {"n_read": metrics(read).get("n", 0), "n_unique": metrics(unique).get("n", 0)}
        if not out["n_unique"]:
            return out | {"touched": False}
        stored = self.read("detections", new)
        old = stored.join(new.select("detection_id"), "detection_id", "left_semi")
        # the live delivery of an observation counts, whichever came first
        family = stored.where(F.col("source_sensor").isin(*FAMILY)).select("physical_key", F.col("detection_id").alias("_other"), (F.col("source_sensor") != LIVE_SOURCE).alias("_p"))
        family = first_by(family, ["physical_key"], [F.col("_p"), F.col("_other")]).drop("_p")
        kept = [c for c in stored.columns if c not in ("detection_id", "physical_key")]
        both = new.join(old.select("detection_id", F.struct(*kept).alias("old")), "detection_id", "left").join(family, "physical_key", "left")
        changed = F.lit(False)
        for c in normalize.PAYLOAD:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"old.{c}"))
        crossed = F.col("_other").isNotNull() & F.col("source_sensor").isin(*FAMILY)
        kind = F.when(F.col("old").isNull(), F.when(crossed, "CROSSED").otherwise("INSERTED")).when(changed, "REVISED").otherwise("UNCHANGED")
        moved = (F.col("kind") == "INSERTED") | ((F.col("kind") == "REVISED") & ((F.col("latitude") != F.col("old.latitude")) | (F.col("longitude") != F.col("old.longitude"))))
        named = both.withColumn("kind", kind).drop("_other").withColumn("moved", moved)
        work = cut(named.observe(kinds, *[F.count_if(F.col("kind") == k).alias(k) for k in ("INSERTED", "REVISED", "UNCHANGED", "CROSSED")]))
        found = metrics(kinds)
        out |= {"n_inserted": found["INSERTED"], "n_revised": found["REVISED"], "n_unchanged": found["UNCHANGED"] + found["CROSSED"], "n_crossed": found["CROSSED"], "n_promoted": 0, "n_sites": 0, "n_alerts": 0, "n_failed": 0}
        if not found["INSERTED"] + found["REVISED"]:
            return out | {"touched": False}
        work = work.where(F.col("kind").isin("INSERTED", "REVISED"))
        events, owners = self.resolve(work.where("moved"))
        promoted, older = self.write_detections(work, events, owners)
        out["n_promoted"] = promoted
        self.touched = cut(older)
        if self.touched.isEmpty():
            return out | {"touched": False}
        self.sites = cut(self.touched.select("site_id").distinct())
        out["n_sites"] = self.write_days()
        return out | {"touched": True}

    def resolve(self, work: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What becomes of the detections, and the members whose owner changes, with their date."""
        steps = F.explode(F.array(*[F.lit(float(i)) for i in (-1, 0, 1)]))
        around = work.select("latitude", "longitude").distinct().withColumn("_a", steps).withColumn("_b", steps)
        near = around.select((F.col("latitude") + F.col("_a")).alias("latitude"), (F.pmod(F.col("longitude") + F.col("_b") + 180, F.lit(360.0)) - 180).alias("longitude"))
        polar = not work.where(F.abs("latitude") > 80).limit(1).isEmpty()  # where degrees are narrow all members are read
        members = self.read("members", None if polar else near).join(work.select("detection_id"), "detection_id", "left_anti")
        members = cut(members)
        asked = work.select("detection_id", "latitude", "longitude", F.col("_seq").alias("seq"))
        events, owners = resolver.resolve_batch(asked, members)
        dates = members.select("detection_id", "acq_date").unionByName(work.select("detection_id", "acq_date"))
        owners = cut(owners.join(dates, "detection_id"))
        self.batch.put("members", owners)
        self.known = members
        return cut(events), owners

    def write_detections(self, work: DataFrame, events: DataFrame, owners: DataFrame) -> tuple[int, DataFrame]:
        """Detections with what became of them, earlier members of candidates that are sites now, and new sites; the site-days that this touches."""
        by_candidate = F.col("status").isin("NEW_CANDIDATE", "CANDIDATE_ACCUMULATED")
        now = owners.select("detection_id", F.col("site_id").alias("_site"))
        became = events.select("detection_id", "status", "distance_m", "ambiguous", "candidate_sites").join(now, "detection_id")
        became = became.withColumn("status", F.when(by_candidate & F.col("_site").isNotNull(), "PROMOTED_MEMBER").otherwise(F.col("status")))
        columns = ["detection_id", "physical_key", *normalize.PAYLOAD]
        fresh = work.where("moved").select(*columns, "old").join(became, "detection_id").select(*columns, F.col("_site").alias("site_id"), "status", "distance_m", "ambiguous", "candidate_sites", "old")
        same = work.where("not moved").select(*columns, *[F.col(f"old.{c}").alias(c) for c in ("site_id", "status", "distance_m", "ambiguous", "candidate_sites")], "old")
        rows = cut(fresh.unionByName(same))
        joined = cut(owners.where("site_id is not null").join(work.select("detection_id"), "detection_id", "left_anti"))
        older = self.read("detections", joined).join(joined.select("detection_id", F.col("site_id").alias("_site")), "detection_id")
        older = cut(older.withColumn("site_id", F.col("_site")).withColumn("status", F.lit("PROMOTED_MEMBER")).drop("_site"))
        self.batch.put("detections", rows.drop("old").unionByName(older))
        made = events.where("status = 'PROMOTED'").select("site_id").distinct()
        # the place of a site is that of the three that made it; those that matched it later in the batch don't move it
        three = owners.join(made, "site_id").join(events.where("status = 'MATCHED'").select("detection_id"), "detection_id", "left_anti").groupBy("site_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
        sites = three.select("site_id", "latitude", "longitude", F.lit("PROMOTED").alias("status"), F.lit(self.at).cast("timestamp").alias("promoted_at"), F.lit(None).cast("date").alias("latest_seen"))
        promoted = self.batch.put("sites", sites)["rows"]
        day = rows.select("site_id", "acq_date").union(rows.select("old.site_id", "old.acq_date")).union(older.select("site_id", "acq_date"))
        return promoted, day.where("site_id is not null").distinct()

    def write_days(self) -> int:
        """Touched site-days made anew from all their detections, and when each site was seen last; how many sites."""
        held = self.read("detections", self.touched).where("site_id is not null").join(self.touched, ["site_id", "acq_date"], "left_semi")
        days = cut(daily.daily_activity(held))
        gone = self.touched.join(days, ["site_id", "acq_date"], "left_anti")
        self.batch.put("daily", days, gone)
        last = self.read("daily", self.touched).join(self.sites, "site_id", "left_semi").groupBy("site_id").agg(F.max("acq_date").alias("_seen"))
        known = self.read("sites", self.touched)
        seen = self.sites.join(known, "site_id", "left").join(last, "site_id", "left").withColumn("latest_seen", F.col("_seen")).drop("_seen")
        return self.batch.put("sites", cut(seen))["rows"]

    # results
    def identify(self, pixels: DataFrame | None, scorer: identity.Scorer, visual: bool, until: str | None = None) -> int:
        """Identity of touched sites that have land cover; latest, features, and history where the inference is new; how many."""
        if pixels is None:
            self.a = self.read("a_latest").limit(0)
            return 0
        held = self.read("detections").where(F.col("source_sensor").isin(*FAMILY)).join(self.sites, "site_id", "left_semi")
        held = held if until is None else as_of(held, until)
        held = cut(held.select("site_id", "latitude", "longitude", "acq_date", "frp", "daynight"))
        cover = pixels.join(self.sites, "site_id", "left_semi")
        vectors = features.identity_vector(held, self.read("sites", self.touched), cover).join(cover.select("site_id").distinct(), "site_id", "left_semi")
        last = held.groupBy("site_id").agg(F.max("acq_date").alias("as_of"))
        scored = identity.guard(identity.score(vectors, list(FEATURES), scorer).withColumn("p_visual", F.lit(None).cast("double")), visual).join(last, "site_id")
        named = scored.withColumn("version", F.lit(STACK_VERSION)).withColumn("inference_id", identity.inference_id("site_id", *FEATURES, "as_of", "version", "p_visual"))
        named = cut(named)
        self.a = named
        columns = [part.split()[0] for part in EMPTY["a_latest"].split(", ")]
        count = self.batch.put("a_latest", named.select(*columns))["rows"]
        self.batch.put("a_features", named.select("site_id", "as_of", *FEATURES))
        self.batch.put("a_history", insert_absent(self.read("a_history", self.touched), named.select(*columns), ["inference_id"]))
        waiting = insert_absent(self.read("queue", self.touched).where("state <> 'DONE'"), named.where("should_queue").select("site_id"), ["site_id"])
        self.batch.put("queue", waiting.select("site_id", F.lit("PENDING").alias("state")))
        return count

    def state(self) -> None:
        """Temporal state as of the cutoff: a row of history for it, and the latest one unless history has gone further."""
        columns = [part.split()[0] for part in EMPTY["b_history"].split(", ")]
        self.b = cut(temporal.temporal_state(self.days, self.day).withColumn("as_of", self.cutoff).select(*columns))
        history = self.read("b_history", self.touched)
        self.batch.put("b_latest", newer(history, history, self.b, ["site_id"]))
        self.batch.put("b_history", self.b)

    def score(self) -> None:
        """Anomaly results of the days that follow from what changed, up to the cutoff."""
        days = self.days.where(F.col("acq_date") <= self.cutoff)
        states, scores = self.read("c_state", self.touched), self.read("scores", self.touched)
        later = days.join(states.select("site_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("last_day")).alias("_l")), "site_id").where("acq_date > _l").select("site_id", F.col("acq_date").alias("day"))
        since = self.touched.where(F.col("acq_date") <= self.cutoff).select("site_id", F.col("acq_date").alias("day")).union(later)
        found, now = anomaly.going_on(days, since, states.join(self.sites, "site_id", "left_semi"), scores.join(self.sites, "site_id", "left_semi"))
        ranked = cut(anomaly.levels(anomaly.against(found, self.reference())))
        gone = self.touched.join(self.days, ["site_id", "acq_date"], "left_anti").join(scores.select("site_id", "acq_date"), ["site_id", "acq_date"], "left_semi")
        self.batch.put("scores", ranked, gone)
        self.batch.put("c_state", now)
        last = ranked.groupBy("site_id").agg(F.max_by(F.struct(F.col("acq_date").alias("event_date"), "level", "c_score", "c_raw", "drivers"), "acq_date").alias("l")).select("site_id", "l.*")
        self.c = cut(last)
        whole = self.days.groupBy("site_id").agg(F.max("acq_date").alias("_last")).where(F.col("_last") <= self.cutoff).select("site_id")
        self.batch.put("c_latest", self.c.join(whole, "site_id", "left_semi"))

    def reference(self) -> DataFrame:
        held = self.read("c_reference")
        if not held.isEmpty():
            return held
        return cut(anomaly.reference(self.read("scores").limit(0).select("site_id", "acq_date", F.lit(True).alias("scored"), *[F.lit(0.0).alias(g) for g in GROUPS]), self.day))

    def decide(self) -> int:
        """Alerts that follow; how many were written."""
        joined = self.a.select("site_id", "decision").join(self.b.select("site_id", "state"), "site_id").join(self.c.select("site_id", "level", F.col("event_date").alias("site_day")), "site_id", "left")
        joined = joined.withColumn("level", F.coalesce("level", F.lit("INSUFFICIENT_HISTORY"))).withColumn("site_day", F.coalesce("site_day", self.cutoff))
        rows = decide.merge_alerts(self.read("alerts", self.touched), decide.decide(joined), self.at)
        return self.batch.put("alerts", cut(rows))["rows"]


def freeze_reference(store: Store, found: DataFrame, cutoff: str) -> None:
    """Stores what later days are ranked by, from signals of days up to a cutoff."""
    batch = store.begin()
    frozen = cut(anomaly.reference(found, cutoff))
    old = table(batch, "c_reference").select("grp", "v").join(frozen, ["grp", "v"], "left_anti")
    batch.put("c_reference", frozen, old)
    batch.commit()


def load_members(store: Store, sites: DataFrame, members: DataFrame) -> None:
    """Sites (site_id, latitude, longitude) and their members (detection_id, latitude, longitude, site_id, candidate_id, acq_date) that there were before the first batch."""
    batch = store.begin()
    batch.put("sites", sites.select("site_id", "latitude", "longitude", F.lit("KNOWN").alias("status")))
    batch.put("members", members)
    batch.commit()


def ingest(store: Store, stream: DataFrame, day: Callable[[], str] | str, name: str = "live", every: str | None = None, **how) -> StreamingQuery:
    """Runs ``apply_batch`` for each micro-batch of a stream: over all that has landed and then stops, or ``every`` so often.

    The stream's own checkpoint says what is new, the mark in the manifest which batches are in: one that was
    committed just before the driver was lost isn't applied twice. One batch at a time.
    """
    recover(store)

    def batch(records: DataFrame, number: int) -> None:
        apply_batch(store, records, day() if callable(day) else day, number, name, **how)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.root}/_streams/{name}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# -- the feed --------------------------------------------------------------------------------------------------------
def alerts_since(alerts: DataFrame, mark: tuple[str, str] | None, first: int = 5, most: int = 50) -> DataFrame:
    """The next page of the feed: at first the newest ``first``, then those beyond the mark (updated_at, alert_id), oldest first.

    The mark holds the id as well, so alerts that share a time are never skipped at a page's end.
    """
    if mark is None:
        return alerts.orderBy(F.desc("updated_at"), F.desc("alert_id")).limit(first)
    at, alert = F.lit(mark[0]).cast("timestamp"), F.lit(mark[1])
    beyond = alerts.where((F.col("updated_at") > at) | ((F.col("updated_at") == at) & (F.col("alert_id") > alert)))
    return beyond.orderBy("updated_at", "alert_id").limit(most)


def frames(alerts: DataFrame, event: str = "alert") -> DataFrame:
    """Server-sent event text for each alert."""
    return alerts.select(F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct(*alerts.columns)), F.lit("\n\n")).alias("frame"))
