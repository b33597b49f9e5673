"""Area requests as Spark data sources: ``area_records`` (batch and stream) and ``area_availability``.

A request asks for at most five days of a box of one source, and each is one partition, so requests run side by side
on the executors and one that is lost is made again alone. Answers are kept by request in a cache that driver and
executors share; offline the cache is all there is.
"""

from __future__ import annotations

import csv
import io
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from emberline.config import LIVE_SOURCE
from emberline.sources.landing import AREA_COLUMNS

#: The longest request in days, and the box that is asked for unless another is named (west, south, east, north).
MOST_DAYS, BOX = 5, "67,6,98,38"
#: Seconds that the n-th wait takes n times, by what went wrong.
WAITS = {"rate": 5.0, "server": 3.0, "network": 2.0}
#: What an answer says that is an error in spite of its status.
BAD_KEY, EXHAUSTED = ("Bad Map Key", "Invalid MAP_KEY"), "Transaction limit exceeded"


@dataclass
class Window(InputPartition):
    """One request: a day and how many from it on."""

    start: date | None
    days: int

    def __post_init__(self) -> None:
        if not 1 <= self.days <= MOST_DAYS:
            raise ValueError(f"a request asks for 1 to {MOST_DAYS} days, not {self.days}")


def windows(start: date, end: date, days: int = MOST_DAYS) -> list[Window]:
    """The requests that cover a range of days, both ends included."""
    Window(start, days)
    out = []
    while start <= end:
        out.append(Window(start, min(days, (end - start).days + 1)))
        start += timedelta(days=days)
    return out


class Cache:
    """Answers by request, in a folder of any file system that Arrow reaches."""

    def __init__(self, folder: str) -> None:
        self._fs, self._folder = fs.FileSystem.from_uri(folder)

    def place(self, source: str, bbox: str, window: Window) -> str:
        return f"{self._folder}/area_{source}_{bbox.replace(',', '_')}_{window.days}d_{window.start or 'latest'}.csv"

    def read(self, source: str, bbox: str, window: Window) -> str | None:
        place = self.place(source, bbox, window)
        if self._fs.get_file_info(place).type != fs.FileType.File:
            return None
        with self._fs.open_input_stream(place) as f:
            return f.read().decode()

    @contextmanager
    def lines(self, source: str, bbox: str, window: Window) -> Iterator[Iterable[str]]:
        """An answer line by line, so a long one is never held; none where it isn't there."""
        place = self.place(source, bbox, window)
        if self._fs.get_file_info(place).type != fs.FileType.File:
            yield []
            return
        with self._fs.open_input_stream(place) as f:
            yield io.TextIOWrapper(f, encoding="utf-8", newline="")

    @contextmanager
    def writing(self, source: str, bbox: str, window: Window) -> Iterator:
        """A stream for an answer that comes in parts. Whole or not at all: written under another name first."""
        place = self.place(source, bbox, window)
        self._fs.create_dir(self._folder, recursive=True)
        staged = f"{place}.{uuid.uuid4().hex}.tmp"
        with self._fs.open_output_stream(staged) as f:
            yield f
        self._fs.move(staged, place)

    def write(self, source: str, bbox: str, window: Window, text: str) -> None:
        with self.writing(source, bbox, window) as f:
            f.write(text.encode())


class Client:
    """Requests with waits by what went wrong; the key is in no message."""

    def __init__(self, options: dict[str, str]) -> None:
        get = lambda name, default=None: options.get(name, default)
        self.base, self.key = (get("base_url") or "").rstrip("/"), get("key") or ""
        self.source, self.bbox = get("source", LIVE_SOURCE), get("bbox", BOX)
        self.retries, self.timeout, self.pace = int(get("retries", 3)), float(get("timeout", 30)), float(get("pace", 1))
        self.offline = str(get("offline", "false")).lower() == "true"
        self.cache = Cache(get("cache")) if get("cache") else None

    def url(self, window: Window) -> str:
        day = f"/{window.start}" if window.start else ""
        return f"{self.base}/area/csv/{self.key or 'NO_KEY'}/{self.source}/{self.bbox}/{window.days}{day}"

    def ask(self, url: str) -> str:
        """The answer's text; waits and asks again after a limit, a server's fault or a lost connection."""
        wrong = ""
        for attempt in range(1, self.retries + 1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    text = answer.read().decode().strip()
            except urllib.error.HTTPError as error:
                if error.code != 429 and error.code < 500:
                    raise RuntimeError(f"the request was refused: {error.code}") from None
                wrong, wait = f"status {error.code}", WAITS["rate" if error.code == 429 else "server"]
            except (urllib.error.URLError, OSError) as error:
                wrong, wait = f"no answer: {getattr(error, 'reason', error)}".replace(self.key or "\0", "***"), WAITS["network"]
            else:
                if any(x in text for x in BAD_KEY):
                    raise PermissionError("the key was refused")
                if EXHAUSTED in text:
                    raise RuntimeError("the key's requests are used up")
                return text
            if attempt < self.retries:
                time.sleep(wait * attempt * self.pace)
        raise RuntimeError(f"no answer after {self.retries} requests; the last: {wrong}")

    def text(self, window: Window) -> str:
        """A request's answer: from the cache where it is there, else asked for and kept."""
        held = self.cache.read(self.source, self.bbox, window) if self.cache and (self.offline or window.start) else None
        if held is not None or self.offline:
            return held or ""
        if not self.key:
            raise RuntimeError("a key is needed unless offline")
        text = self.ask(self.url(window))
        if self.cache:
            self.cache.write(self.source, self.bbox, window, text)
        return text


def parsed(text: str | Iterable[str], columns: list[str]) -> Iterator[tuple]:
    """A CSV's rows (a text, or its lines) by the names of its columns; those it lacks are null."""
    for row in csv.DictReader(io.StringIO(text) if isinstance(text, str) else text):
        yield tuple(row.get(c) for c in columns)


def _dates(options: dict[str, str]) -> tuple[date, date]:
    start = date.fromisoformat(options["start"])
    return start, date.fromisoformat(options.get("end", options["start"]))


_SCHEMA = ", ".join(f"{c} string" for c in AREA_COLUMNS) + ", source_sensor string, window_start date"


class _Records:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.days = int(options.get("days", MOST_DAYS))
        Window(None, self.days)

    def read(self, partition: Window) -> Iterator[tuple]:
        client = Client(self.options)
        if client.offline and client.cache:
            with client.cache.lines(client.source, client.bbox, partition) as lines:
                for row in parsed(lines, AREA_COLUMNS):
                    yield (*row, client.source, partition.start)
            return
        for row in parsed(client.text(partition), AREA_COLUMNS):
            yield (*row, client.source, partition.start)


class _Reader(_Records, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        if "start" not in self.options:
            return [Window(None, self.days)]  # the latest days, whatever they are
        return list(windows(*_dates(self.options), self.days))


class _StreamReader(_Records, DataSourceStreamReader):
    """Days as offsets: each day is asked for once, up to ``end``, or yesterday where none is named."""

    def initialOffset(self) -> dict:
        return {"day": self.options["start"]}

    def latestOffset(self) -> dict:
        last = date.fromisoformat(self.options["end"]) + timedelta(days=1) if "end" in self.options else date.today()
        return {"day": max(last, date.fromisoformat(self.options["start"])).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return list(windows(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(days=1), self.days))

    def commit(self, end: dict) -> None:
        pass


class AreaRecords(DataSource):
    """Options: base_url, key, source, bbox, start, end (days, included), days (a request's, 1 to 5), cache, offline, retries, timeout, pace (1: the waits as they are)."""

    @classmethod
    def name(cls) -> str:
        return "area_records"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Available(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = Client(self.options)
        if client.offline or not client.key:
            return
        text = client.ask(f"{client.base}/data_availability/csv/{client.key}/{client.source}")
        for name, low, high in parsed(text, ["data_id", "min_date", "max_date"]):
            yield name, date.fromisoformat(low), date.fromisoformat(high)


class AreaAvailability(DataSource):
    """The days that each source has; no rows without a key."""

    @classmethod
    def name(cls) -> str:
        return "area_availability"

    def schema(self) -> str:
        return "data_id string, min_date date, max_date date"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Available(self.options)


def register(spark: SparkSession) -> None:
    for source in (AreaRecords, AreaAvailability):
        spark.dataSource.register(source)


def land(records: DataFrame, cache: str, source: str, start: str, end: str, bbox: str = BOX, days: int = MOST_DAYS) -> int:
    """Keeps records as the answers of the requests that cover a range of days, a file for each, empty ones too; how many.

    A record lies in the request of its day; one without a readable day, or outside the range, in the first. Spark
    sorts the records by request and a task writes them as they come, so no request is ever held as a whole.
    """
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    asked = windows(first, last, days)
    day = F.try_to_date("acq_date", "yyyy-MM-dd")
    place = F.floor(F.datediff(day, F.lit(start).cast("date")) / days)
    spark = records.sparkSession
    every = spark.range(len(asked)).select(F.col("id").alias("request"))  # a number for each request of the range
    inside = F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    columns = [c for c in AREA_COLUMNS if c in records.columns]
    dealt = records.select(*[F.col(c).cast("string").alias(c) for c in columns], F.when(inside, place).otherwise(0).cast("long").alias("request"))

    # a row for every request comes before its records
    heads = every.select(*[F.lit(None).cast("string").alias(c) for c in columns], "request", F.lit(False).alias("record"))
    ordered = dealt.withColumn("record", F.lit(True)).unionByName(heads).repartition("request").sortWithinPartitions("request", "record")

    def write(batches):
        with ExitStack() as open_files:
            file = None
            for batch in batches:
                frame = batch.to_pandas()
                for request, part in frame.groupby("request", sort=True):
                    if not part["record"].iloc[0]:
                        open_files.close()  # the request before is complete
                        file = open_files.enter_context(Cache(cache).writing(source, bbox, asked[int(request)]))
                        file.write((",".join(columns) + "\n").encode())
                        yield pa.RecordBatch.from_pydict({"request": pa.array([request], pa.int64())})
                    rows = part.loc[part["record"], columns]
                    if len(rows):
                        file.write(rows.to_csv(index=False, header=False, lineterminator="\n").encode())

    return ordered.mapInArrow(write, "request long").count()
