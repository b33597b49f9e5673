"""The alert feed as a streaming source: ``alert_feed`` reads a store's alerts onward from (updated_at, alert_id)."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_COLUMNS = ["updated_at", "alert_id", "fingerprint", "site_id", "alert_type", "alert_level", "headline", "status"]


def sse(event: str, payload: dict) -> str:
    """A server-sent event."""
    return f"event: {event}\ndata: {json.dumps(payload, default=str)}\n\n"


class _Alerts:
    """The alerts of one manifest, read batch by batch; what is kept are the rows of a page."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(root)

    def manifest(self, version: int | None = None) -> dict | None:
        found = [f.path for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/_manifests", allow_not_found=True)) if f.path.endswith(".json")]
        names = sorted(found) if version is None else [f for f in found if f.endswith(f"/{version:012d}.json")]
        if not names:
            return None
        with self.fs.open_input_stream(names[-1]) as f:
            return json.loads(f.read())

    def beyond(self, manifest: dict, mark: tuple[int, str] | None) -> Iterator[tuple[tuple[int, str], dict]]:
        """Active alerts after a mark, each once: the newest layer's row of a fingerprint counts."""
        held = manifest["tables"].get("alerts")
        if not held:
            return
        kinds = {f["name"]: f["type"] for f in held["schema"]["fields"]}
        layers = [(layer["path"], None) for layer in reversed(held["layers"])]
        base: dict[str, list[str]] = {}
        for bucket, path in held["base"].items():
            base.setdefault(path, []).append(bucket)
        seen: set[str] = set()  # of alerts beyond the mark, and of those that a layer replaced
        columns = [c for c in _COLUMNS if c in kinds]
        for path, buckets in [*layers, *base.items()]:
            data = ds.dataset(f"{self.root}/{path}", filesystem=self.fs, format="parquet", ignore_prefixes=["_SUCCESS", "."], partitioning=ds.partitioning(pa.schema([("_bucket", pa.string())]), flavor="hive"))
            test = None if buckets is None else ds.field("_bucket").isin(buckets)
            if mark is not None:
                late = ds.field("updated_at") >= pa.scalar(mark[0], pa.timestamp("us")).cast(data.schema.field("updated_at").type)
                test = late if test is None else test & late
            for batch in data.to_batches(columns=[*columns, "_gone"], filter=test):
                times = batch.column("updated_at").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
                for row, at in zip(batch.drop_columns(["updated_at"]).to_pylist(), times):
                    if row["fingerprint"] in seen:
                        continue
                    seen.add(row["fingerprint"])
                    if row["_gone"] or row["status"] != "ACTIVE" or at is None:
                        continue
                    key = (at, row["alert_id"])
                    if mark is None or key > mark:
                        yield key, row | {"updated_at": _EPOCH + timedelta(microseconds=at)}


class _Reader(SimpleDataSourceStreamReader):
    """Offsets hold the mark and the manifest it was read from, so a page that is read again is the same page."""

    def __init__(self, options: dict[str, str]) -> None:
        self.alerts = _Alerts(options["root"])
        self.first, self.most = int(options.get("first", 5)), int(options.get("most", 50))
        self.beat = str(options.get("heartbeat", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {"at": None, "id": None, "version": 0, "beats": 0}

    @staticmethod
    def _mark(offset: dict) -> tuple[int, str] | None:
        return None if offset["at"] is None else (offset["at"], offset["id"])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        manifest = self.alerts.manifest()
        mark, found = self._mark(start), []
        if manifest is not None:
            rows = self.alerts.beyond(manifest, mark)
            if mark is None:  # the newest few, oldest of them first
                found = sorted(heapq.nlargest(self.first, rows, key=lambda r: r[0]), key=lambda r: r[0])
            else:
                found = heapq.nsmallest(self.most, rows, key=lambda r: r[0])
        if found:
            (at, name), _ = found[-1]
            return iter([self._row(r) for _, r in found]), {"at": at, "id": name, "version": manifest["version"], "beats": start["beats"]}
        if self.beat:
            return iter([self._ping()]), start | {"beats": start["beats"] + 1}
        return iter([]), start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if end["beats"] > start["beats"]:
            return iter([self._ping()])
        manifest, low, high = self.alerts.manifest(end["version"]), self._mark(start), self._mark(end)
        if manifest is None or high is None:
            return iter([])
        rows = [r for r in self.alerts.beyond(manifest, low) if r[0] <= high]
        rows = heapq.nlargest(self.first, rows, key=lambda r: r[0]) if low is None else rows
        return iter([self._row(r) for _, r in sorted(rows, key=lambda r: r[0])])

    @staticmethod
    def _row(row: dict) -> tuple:
        payload = {c: row[c] for c in _COLUMNS if c in row}
        return "alert", row["alert_id"], row["updated_at"], sse("alert", payload)

    @staticmethod
    def _ping() -> tuple:
        now = datetime.now(timezone.utc)
        return "ping", None, now, sse("ping", {"type": "ping", "timestamp": now.isoformat()})


class AlertFeed(DataSource):
    """Options: root (the store's folder), first (alerts of the first page), most (of a later page), heartbeat (a ping where there is nothing new)."""

    @classmethod
    def name(cls) -> str:
        return "alert_feed"

    def schema(self) -> str:
        return "event string, alert_id string, updated_at timestamp, frame string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)
