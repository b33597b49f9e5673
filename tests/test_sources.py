"""Requests against a local stub, the cache, the feed, the queue, tiles and landed files."""

import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from emberline.operators.store import Batch, Conflict
from emberline.sources import area, feed, landing, tiles
from emberline.streaming import live, queue

HEAD = "latitude,longitude,acq_date,acq_time,frp,satellite,daynight\n"


@pytest.fixture
def stub():
    """A server that gives what a list says, one after another for each path, and the last of it from then on."""
    answers, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            held = answers.get(self.path, [(200, HEAD)])
            status, text = held.pop(0) if len(held) > 1 else held[0]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", answers, asked
    server.shutdown()


def reader(spark, base, **options):
    area.register(spark)
    held = {"base_url": base, "key": "SECRET", "pace": "0.001", "start": "2025-01-01", "end": "2025-01-07", "bbox": "1,2,3,4", "source": "S"} | options
    return spark.read.format("area_records").options(**{k: v for k, v in held.items() if v is not None})


def test_windows_and_their_bounds():
    got = area.windows(*(area.date.fromisoformat(d) for d in ("2025-01-01", "2025-01-07")))
    assert [(str(w.start), w.days) for w in got] == [("2025-01-01", 5), ("2025-01-06", 2)]
    for days in (0, 6):
        with pytest.raises(ValueError, match="1 to 5"):
            area.Window(None, days)
    assert area.Client({"base_url": "http://x/", "key": "k"}).url(area.Window(None, 1)) == "http://x/area/csv/k/VIIRS_NOAA20_NRT/67,6,98,38/1"


def test_requests_are_made_again_and_kept(spark, stub, tmp_path):
    base, answers, asked = stub
    one, two = "/area/csv/SECRET/S/1,2,3,4/5/2025-01-01", "/area/csv/SECRET/S/1,2,3,4/2/2025-01-06"
    answers[one] = [(429, ""), (503, ""), (200, HEAD + "1.5,2.5,2025-01-02,35,7.5,N20,D\n1,2,2025-01-03,0040,,N20,N\n")]
    cache = str(tmp_path / "cache")
    df = reader(spark, base, cache=cache).load()
    assert df.rdd.getNumPartitions() == 2
    rows = sorted(tuple(r) for r in df.select("latitude", "frp", "instrument", "source_sensor", F.col("window_start").cast("string")).collect())
    assert rows == [("1", "", None, "S", "2025-01-01"), ("1.5", "7.5", None, "S", "2025-01-01")]
    assert asked.count(one) == 3 and asked.count(two) == 1
    again = reader(spark, "http://127.0.0.1:9", cache=cache, offline="true", key=None).load()
    assert again.count() == 2 and asked.count(one) == 3
    assert reader(spark, base, cache=cache, end="2025-01-05").load().count() == 2 and asked.count(one) == 3  # the cache answers first
    assert reader(spark, base, offline="true", key=None, start="2030-01-01", end="2030-01-20").load().count() == 0


@pytest.mark.parametrize(("answer", "says", "times"), [((200, "Bad Map Key."), "key was refused", 1), ((200, "Transaction limit exceeded"), "used up", 1), ((404, ""), "refused: 404", 1), ((500, ""), "after 3 requests", 3)])
def test_errors_by_class(stub, answer, says, times):
    base, answers, asked = stub
    client = area.Client({"base_url": base, "key": "SECRET", "pace": "0.001"})
    window = area.Window(None, 1)
    answers[client.url(window).removeprefix(base)] = [answer]
    with pytest.raises((RuntimeError, PermissionError), match=says) as error:
        client.text(window)
    assert len(asked) == times and "SECRET" not in str(error.value)


def test_no_connection_and_no_key(spark):
    with pytest.raises(RuntimeError, match="no answer"):
        area.Client({"base_url": "http://127.0.0.1:9", "key": "SECRET", "pace": "0.001"}).text(area.Window(None, 1))
    with pytest.raises(RuntimeError, match="key is needed"):
        area.Client({"base_url": "http://127.0.0.1:9"}).text(area.Window(None, 1))
    with pytest.raises(Exception, match="1 to 5"):
        reader(spark, "http://127.0.0.1:9", days="6").load().collect()


def test_availability_and_a_stream_of_days(spark, stub, tmp_path):
    base, answers, asked = stub
    answers["/data_availability/csv/SECRET/S"] = [(200, "data_id,min_date,max_date\nS,2025-01-01,2025-02-01\n")]
    area.register(spark)
    options = {"base_url": base, "key": "SECRET", "source": "S", "bbox": "1,2,3,4", "pace": "0.001"}
    assert [tuple(map(str, r)) for r in spark.read.format("area_availability").options(**options).load().collect()] == [("S", "2025-01-01", "2025-02-01")]
    for day in ("2025-01-01", "2025-01-06", "2025-01-08"):
        for days in (1, 2, 5):
            answers[f"/area/csv/SECRET/S/1,2,3,4/{days}/{day}"] = [(200, HEAD + f"1,2,{day},1,1,N20,D\n")]

    def run(end):
        stream = spark.readStream.format("area_records").options(**options, start="2025-01-01", end=end).load()
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("acq_date").collect())

    assert run("2025-01-07") == ["2025-01-01", "2025-01-06"]
    assert run("2025-01-09") == ["2025-01-01", "2025-01-06", "2025-01-08"]  # goes on after the last day it had


def alerts(spark, *rows):
    held = [(a, f"F{a}", t, s) for a, t, s in rows]
    return spark.createDataFrame(held, "alert_id string, fingerprint string, updated_at string, status string").withColumns({"updated_at": F.to_timestamp("updated_at"), "site_id": F.lit("S")})


def test_feed_goes_on_after_restarts(spark, tmp_path):
    """Alerts that share a time, over pages and restarts: none twice, none left out."""
    store = live.open_store(spark, str(tmp_path / "s"))
    spark.dataSource.register(feed.AlertFeed)

    def put(*rows):
        batch = store.begin()
        batch.put("alerts", alerts(spark, *rows))
        batch.commit()

    def poll(**options):
        stream = spark.readStream.format("alert_feed").options(root=store.root, most="4", **options).load()
        before = {r.path for r in spark.read.format("binaryFile").load(str(tmp_path / "out") + "/*.parquet").collect()} if (tmp_path / "out").exists() else set()
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out")).select("event", "alert_id", "updated_at", "frame", F.input_file_name().alias("f")).collect()
        return [r for r in sorted(found, key=lambda r: (r.updated_at, r.alert_id or "")) if r.f.replace("file:///", "file:/") not in before]

    put(*[(f"A{i}", "2025-01-01 00:00:00", "ACTIVE") for i in range(8)], ("X", "2025-01-02 00:00:00", "RESOLVED"))
    assert [r.alert_id for r in poll()] == ["A3", "A4", "A5", "A6", "A7"]  # the newest five, oldest first
    put(*[(f"B{i}", "2025-01-01 00:00:00", "ACTIVE") for i in range(6)], ("A0", "2025-01-03 00:00:00", "ACTIVE"))
    got = [r.alert_id for _ in range(3) for r in poll()]
    assert got == ["B0", "B1", "B2", "B3", "B4", "B5", "A0"]
    ping = poll(heartbeat="true")
    assert [r.event for r in ping] == ["ping"] and ping[0].frame.startswith("event: ping\ndata: {")
    put(("A0", "2025-01-04 00:00:00", "ACKNOWLEDGED"), ("C", "2025-01-04 00:00:00", "ACTIVE"))
    last = poll()
    assert [r.alert_id for r in last] == ["C"] and last[0].frame.startswith("event: alert\ndata: {") and last[0].frame.endswith("\n\n")


def test_leases(spark, tmp_path, monkeypatch):
    store = live.open_store(spark, str(tmp_path / "s"))
    sites = spark.createDataFrame([(f"S{i}",) for i in range(4)], "site_id string")
    assert queue.enqueue(store, sites) == 4 and queue.enqueue(store, sites) == 0
    assert queue.claim(store, "one", "2025-01-01 00:00:00", 2) == ["S0", "S1"]
    commit, once = Batch.commit, []

    def raced(self, *more):
        """Another worker commits between this one's look and its commit."""
        if not once:
            once.append(True)
            monkeypatch.setattr(Batch, "commit", commit)
            assert queue.claim(store, "two", "2025-01-01 00:01:00", 1) == ["S2"]
        return commit(self, *more)

    monkeypatch.setattr(Batch, "commit", raced)
    assert queue.claim(store, "three", "2025-01-01 00:01:00", 1) == ["S3"]
    assert queue.claim(store, "four", "2025-01-01 00:02:00") == []
    assert queue.finish(store, "one", "S0", "DONE", "2025-01-01 00:05:00") and not queue.finish(store, "two", "S0", "DONE", "2025-01-01 00:05:00")
    assert queue.finish(store, "two", "S2", "UNAVAILABLE", "2025-01-01 00:05:00")
    assert queue.claim(store, "five", "2025-01-01 00:30:30") == ["S1"]  # its lease is over; the first worker's end comes too late
    assert not queue.finish(store, "one", "S1", "DONE", "2025-01-01 00:32:00")
    assert queue.claim(store, "six", "2025-01-01 01:05:00") == ["S1", "S2", "S3"]  # two leases over, one tried an hour ago
    assert {r.state: r.sites for r in queue.stats(store).collect()}["DONE"] == 1
    with pytest.raises(Conflict):
        a, b = store.begin(), store.begin()
        a.put("queue", sites.withColumn("state", F.lit("DONE")))
        b.put("queue", sites.withColumn("state", F.lit("DONE")))
        a.commit()
        b.commit()


def test_tiles_read_only_what_windows_need(spark, tmp_path):
    rng = random.Random(1)
    degrees, size = 0.0025, 400
    places = [(rng.uniform(10.5, 12), rng.uniform(70.5, 72)) for _ in range(30)] + [(90 - 32 * 400 * degrees, -180 + 250.6 * 400 * degrees)]  # the last lies on a border
    values = {}
    for lat, lon in places:
        for _ in range(60):
            row, col = int((90 - lat - rng.uniform(-0.02, 0.02)) / degrees), int((lon + 180 + rng.uniform(-0.02, 0.02)) / degrees)
            values[row, col] = rng.choice([10, 50, 80])
    pixels = spark.createDataFrame([(r, c, v) for (r, c), v in values.items()], "row long, col long, value int")
    folder = str(tmp_path / "tiles")
    written = tiles.write_tiles(pixels.union(pixels.withColumn("value", F.lit(1))), folder, size, 50).collect()
    assert {r.tile for r in written} == {f"r{r // size}c{c // size}" for r, c in values}
    sites = spark.createDataFrame([(f"S{i}", a, b) for i, (a, b) in enumerate(places)] + [("FAR", -40.0, 0.0)], "site_id string, latitude double, longitude double")
    found = tiles.window_counts(sites, folder, degrees, size).collect()
    got = {}
    for r in found:
        if r.site_id is not None:
            got[r.site_id, r.value] = got.get((r.site_id, r.value), 0) + r.n
    want = {}
    bounds = sites.select("site_id", *[b.alias(n) for n, b in tiles.window_bounds(F.col("latitude"), F.col("longitude")).items()]).collect()
    for b in bounds:
        for r in range(int((90 - b.north) // degrees), int((90 - b.south) // degrees) + 1):
            for c in range(int((b.west + 180) // degrees), int((b.east + 180) // degrees) + 1):
                key = (b.site_id, values.get((r, c), 0))
                want[key] = want.get(key, 0) + 1
    assert got == want and got["FAR", 0] == sum(n for (s, _), n in got.items() if s == "FAR")
    opened = [r for r in found if r.site_id is None]
    assert len(opened) == len({r.tile for r in opened})  # one opening for each tile
    assert sum(r.n for r in opened) <= sum(r.blocks for r in written)


def test_landed_files(spark, tmp_path):
    place = landing.landing_path(str(tmp_path / "l"), "S", "1,2,3,4", "2025-01-01")
    assert place.endswith("/source=S/bbox=1_2_3_4/start=2025-01-01")
    raw = spark.createDataFrame([("1", "2", "2025-01-01", "35", "D")], "latitude string, longitude string, acq_date string, acq_time string, daynight string")
    full = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in landing.AREA_COLUMNS])
    full.write.csv(place, header=True)
    read = landing.read_area_csv(spark, str(tmp_path / "l"))
    assert read.first().acq_time == "35" and read.first()["source"] == "S"
    stream = landing.stream_area_csv(spark, str(tmp_path / "l"))
    stream.writeStream.format("memory").queryName("landed").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("landed").count() == 1
    full.write.parquet(str(tmp_path / "p"))
    assert landing.read_parquet(spark, str(tmp_path / "p"), ["latitude"], limit=1).count() == 1
    with pytest.raises(ValueError, match="nothing"):
        landing.read_parquet(spark, str(tmp_path / "p"), ["nothing"])
    both = spark.createDataFrame([(None, "b"), ("a", "c")], "x string, y string")
    assert [r[0] for r in both.select(landing.first_present(both, "absent", "x", "y", default="z")).collect()] == ["b", "a"]
    assert both.select(landing.first_present(both, "absent", default="z")).first()[0] == "z"


def test_a_long_answer_is_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    """One request with many batches of records, others empty: all come back, and no whole answer is made or read."""
    monkeypatch.setattr(area.Cache, "read", lambda *_: pytest.fail("read as a whole"))
    monkeypatch.setattr(area.Client, "text", lambda *_: pytest.fail("read as a whole"))
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("latitude"), F.lit('a "b", c').alias("longitude"), F.when(F.col("id") % 3 > 0, "2020-01-01").otherwise("none").alias("acq_date"), F.lit(None).cast("string").alias("frp"))
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert area.land(rows, str(tmp_path / "cache"), "SRC", "2020-01-01", "2020-01-15") == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    reader = area._Records({"cache": str(tmp_path / "cache"), "offline": "true", "source": "SRC"})
    counts, asked = [], area.windows(area.date(2020, 1, 1), area.date(2020, 1, 15))
    for window in asked:
        found = list(reader.read(window))
        counts.append(len(found))
        if found:
            assert {r[area.AREA_COLUMNS.index("latitude")] for r in found} == {str(i) for i in range(30_000)}
            assert {r[area.AREA_COLUMNS.index("longitude")] for r in found} == {'a "b", c'}
            assert {r[area.AREA_COLUMNS.index("frp")] for r in found} == {""}
    assert counts == [30_000, 0, 0]
