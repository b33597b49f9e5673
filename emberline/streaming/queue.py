"""Sites that wait for imagery, as leases in the store: each is held by one worker at a time, whoever dies meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.common import cut
from emberline.operators.serving import retry_due
from emberline.operators.store import Conflict, Store
from emberline.operators.upsert import insert_absent
from emberline.streaming.live import table

#: Minutes that a worker has for what it claimed, and that a site without imagery waits.
LEASE_MINUTES, RETRY_MINUTES = 30, 60


def enqueue(store: Store, sites: DataFrame) -> int:
    """Sites that aren't waiting already, or are done; how many."""
    while True:
        batch = store.begin()
        waiting = table(batch, "queue").where("state <> 'DONE'")
        new = insert_absent(waiting, sites.select("site_id"), ["site_id"]).select("site_id", F.lit("PENDING").alias("state"), F.lit(0).alias("attempts"))
        found = batch.put("queue", cut(new))["rows"]
        if not found:
            batch.discard()
            return 0
        if _committed(batch):
            return found


def claim(store: Store, owner: str, now: str, most: int = 10, minutes: int = LEASE_MINUTES) -> list[str]:
    """At most so many sites that nobody holds, now this worker's for a while: waiting ones, those whose lease is over, and those whose imagery was not to be had an hour ago.

    Two workers that claim at once start from one manifest, so only the first commits; the other looks again.
    """
    at = F.lit(now).cast("timestamp")
    while True:
        batch = store.begin()
        age = (F.unix_timestamp(at) - F.unix_timestamp("tried_at")) / 60
        free = (F.col("state") == "PENDING") | ((F.col("state") == "LEASED") & (F.col("lease_until") <= at)) | ((F.col("state") == "UNAVAILABLE") & retry_due(F.col("state"), age, RETRY_MINUTES))
        chosen = table(batch, "queue").where(free).orderBy("attempts", "site_id").limit(most)
        held = chosen.withColumns({"state": F.lit("LEASED"), "owner": F.lit(owner), "lease_until": at + F.expr(f"interval {minutes} minutes"), "attempts": F.coalesce("attempts", F.lit(0)) + 1})
        held = cut(held)
        if not batch.put("queue", held)["rows"]:
            batch.discard()
            return []
        if _committed(batch):
            return [r[0] for r in held.select("site_id").orderBy("site_id").collect()]  # at most ``most``


def finish(store: Store, owner: str, site: str, outcome: str, now: str) -> bool:
    """Ends a lease: DONE, REJECTED_CLOUD, or UNAVAILABLE (tried again later); false if the lease is no longer this worker's."""
    at = F.lit(now).cast("timestamp")
    while True:
        batch = store.begin()
        mine = table(batch, "queue").where((F.col("site_id") == site) & (F.col("state") == "LEASED") & (F.col("owner") == owner) & (F.col("lease_until") > at))
        ended = mine.withColumns({"state": F.lit("UNAVAILABLE" if outcome == "UNAVAILABLE" else "DONE"), "outcome": F.lit(outcome), "tried_at": at, "owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp")})
        if not batch.put("queue", cut(ended))["rows"]:
            batch.discard()
            return False
        if _committed(batch):
            return True


def stats(store: Store) -> DataFrame:
    """How many sites are in each state."""
    return table(store, "queue").groupBy("state").agg(F.count("*").alias("sites"))


def _committed(batch) -> bool:
    try:
        return batch.commit()
    except Conflict:
        return False
