"""Neighbours and density clusters against all pairs of points."""

import random
from math import cos, radians

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import spatial

SCHEMA = "detection_id string, latitude double, longitude double"


def distances(points):
    lat, lon = (np.radians([p[i] for p in points]) for i in (1, 2))
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(1, a)))


def clustered(points, least=3):
    far = distances(points)
    near = far <= 750
    cores = set(np.flatnonzero(near.sum(1) >= least).tolist())
    out = {}
    for p in sorted(cores, key=lambda i: points[i][0]):
        reach = [p]
        while reach:
            q = reach.pop()
            if q not in out:
                out[q] = (points[p][0], "CORE")
                reach += [x for x in np.flatnonzero(near[q]).tolist() if x in cores and x not in out]
    for p in range(len(points)):
        if p not in cores:
            best = min(((far[p, q], out[q][0]) for q in np.flatnonzero(near[p]).tolist() if q in cores), default=None)
            out[p] = (best[1], "BORDER") if best else (None, "NOISE")
    return {points[i][0]: v for i, v in out.items()}


def scattered(rng, count, lat, lon, span_m):
    step = span_m / 111_320
    return [(lat + rng.random() * step, (lon + rng.random() * step / max(cos(radians(lat)), 1e-6) + 180) % 360 - 180) for _ in range(count)]


@pytest.mark.parametrize(("seed", "few"), [(1, 10_000), (2, 0)])
def test_clusters_against_all_pairs(spark, monkeypatch, seed, few):
    """Sparse and dense regions, places shared by several points, the equator, the date line and a pole."""
    monkeypatch.setattr(spatial, "_FEW", few)
    rng = random.Random(seed)
    places = scattered(rng, 200, 22, 72, 9_000) + scattered(rng, 90, 22.5, 72, 2_500) + scattered(rng, 60, -0.02, 5, 5_000) + scattered(rng, 60, 30, 179.98, 5_000) + scattered(rng, 30, 89.985, 0, 2_500) + scattered(rng, 20, -89.99, 0, 400)
    places += [p for p in places if rng.random() < 0.1] + [places[0]] * 3 + [(60.0, 60.0)] * 4 + [(61.0, 60.0)] * 2
    points = [(f"D{i:05d}", a, b) for i, (a, b) in enumerate(places)]
    rng.shuffle(points)
    df = spark.createDataFrame([*points, ("NONE", None, 1.0)], SCHEMA)
    got = {r.detection_id: (r.cluster, r.role) for r in spatial.cluster(df).collect()}
    assert got == clustered(points) | {"NONE": (None, "NOISE")}
    far = distances(points)
    near = {r.detection_id: (r.neighbors, r.farthest_m) for r in spatial.neighbors(df.where("latitude is not null")).collect()}
    assert near == {p[0]: (int((far[i] <= 750).sum()), pytest.approx(max(far[i][far[i] <= 750]), abs=1e-3)) for i, p in enumerate(points)}


def test_dense_cells_that_only_inner_places_link(spark):
    """Two dense cells whose outer places are too far apart, but not all of them."""
    step = 1 / 111_320
    west = [(10 + y * step, 20 + x * step) for x, y in ((0, 0), (0, 520), (300, 260), (0, 260), (10, 5), (5, 515))]
    east = [(10 + y * step, 20 + x * step) for x, y in ((1060, 0), (1060, 520), (1040, 260), (1560, 0), (1560, 520))]
    points = [(f"D{i:02d}", a, b) for i, (a, b) in enumerate(west + east)]
    got = {r.detection_id: (r.cluster, r.role) for r in spatial.cluster(spark.createDataFrame(points, SCHEMA)).collect()}
    assert got == clustered(points) and len({c for c, _ in got.values()}) == 1


def test_a_hundred_thousand_points_in_one_cell(spark):
    rows = spark.range(100_000).select(F.format_string("D%06d", "id").alias("detection_id"), (10 + F.col("id") % 400 * 1e-5).alias("latitude"), (20 + F.floor(F.col("id") / 400) * 1.5e-5).alias("longitude"))
    found = spatial.cluster(rows).groupBy("cluster", "role").count().collect()
    assert [tuple(r) for r in found] == [("D000000", "CORE", 100_000)]


def test_one_place_of_most_points(spark):
    rows = spark.range(30_000).select(F.format_string("D%06d", "id").alias("detection_id"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") / 1000).alias("latitude"), F.lit(6.0).alias("longitude"))
    found = spatial.cluster(rows)
    assert found.count() == 30_000 and found.where("role = 'CORE'").count() >= 20_000
    assert spatial.neighbors(rows.where("latitude = 5")).agg(F.min("neighbors"), F.max("neighbors")).first()[:] == (20_000, 20_000)


def test_dealt_side_is_not_broadcast(spark, tmp_path, capsys):
    """A radius join's dealt side is nine times what Spark takes it for; neither side is ever broadcast."""
    spark.range(50).select(F.col("id"), (F.col("id") / 1000.0).alias("latitude"), F.lit(1.0).alias("longitude")).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    met = spatial.radius_join(p, p, 750.0)
    met.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert met.count() == sum(abs(a - b) * 111.195 <= 750.0 for a in range(50) for b in range(50))


def test_neighbours_are_counted_block_by_block(monkeypatch):
    """no pair is a row: a task reads a cell's asking places, then the others in blocks, whatever batches they come in."""
    import pyarrow as pa

    monkeypatch.setattr(spatial, "_ASKING", 4)
    monkeypatch.setattr(spatial, "_BLOCK", 20)
    rng = np.random.default_rng(2)
    lat, lon, w = 10 + rng.random(40) * 0.012, 179.995 + rng.random(40) * 0.01, rng.integers(1, 4, 40)
    lon = np.where(lon > 180, lon - 360, lon)
    rows = [{"cy": cy, "cx": 5, "latitude": a, "longitude": b, "w": n} for cy in (1, 2) for n_of in (lambda n: None, int) for a, b, n in ((a, b, n_of(n)) for a, b, n in zip(lat, lon, w)) if cy == 1 or n is not None]
    kinds = pa.schema({"cy": pa.int64(), "cx": pa.int64(), "latitude": pa.float64(), "longitude": pa.float64(), "w": pa.int64()})
    table = pa.Table.from_pylist(rows, schema=kinds)
    found = pa.Table.from_batches(list(spatial._counts(iter(table.to_batches(max_chunksize=7)), 750.0)))
    share = np.sin(np.radians(lat[:, None] - lat) / 2) ** 2 + np.cos(np.radians(lat))[:, None] * np.cos(np.radians(lat)) * np.sin(np.radians(lon[:, None] - lon) / 2) ** 2
    metres = 2 * 6_371_000.0 * np.arcsin(np.sqrt(share))
    assert found.column("neighbors").to_pylist() == ((metres <= 750) @ w).tolist()
    np.testing.assert_allclose(found.column("farthest_m").to_numpy(), np.where(metres <= 750, metres, 0).max(1), atol=1e-6)


def test_places_of_dense_cells_are_not_written(spark, monkeypatch):
    """of dense cells only sums are gathered; their places are read where a link is open and else neither written nor dealt out."""
    written = []

    def counted(df, real=spatial.cut):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(spatial, "cut", counted)
    rows = spark.range(20_000).select(F.format_string("D%06d", "id").alias("detection_id"), (10 + F.col("id") % 100 * 2e-4).alias("latitude"), (20 + F.floor(F.col("id") / 100) * 1e-4).alias("longitude"))
    assert [tuple(r) for r in spatial.cluster(rows).groupBy("cluster", "role").count().collect()] == [("D000000", "CORE", 20_000)]
    assert sum(written) < 5_000


def test_points_of_hot_cells_look_up_by_broadcast(spark, monkeypatch):
    """cells of very many points are looked up apart from the others; points whose place is no number are noise."""
    monkeypatch.setattr(spatial, "HOT_CELL", 5)
    rng = random.Random(5)
    points = [(f"D{i:05d}", a, b) for i, (a, b) in enumerate(scattered(rng, 60, 22, 72, 5_000) + scattered(rng, 30, 22.1, 72, 700))]
    got = {r.detection_id: (r.cluster, r.role) for r in spatial.cluster(spark.createDataFrame([*points, ("NAN", float("nan"), 1.0), ("NONE", None, 1.0)], SCHEMA)).collect()}
    assert got == clustered(points) | {"NAN": (None, "NOISE"), "NONE": (None, "NOISE")}


def test_blocks_hold_all_within_reach(spark):
    """a point goes to every block that holds a point within reach of it, and once to its own."""
    from emberline.functions.geo import dealt_blocks

    rng = random.Random(6)
    places = [p for lat, lon in ((0.0, 0.0), (22.0, 72.0), (-45.0, 179.97), (89.95, 10.0), (-89.99, -100.0), (66.0, -179.99)) for p in scattered(rng, 120, lat, lon, 9_000)]
    places += [(-a, b) for a, b in places[:60]] + [(90.0, 0.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0)]
    places = [(max(-90.0, min(90.0, a)), b) for a, b in places]
    points = [(f"D{i:05d}", a, b) for i, (a, b) in enumerate(places)]
    for side in (1.0, 4.0):
        rows = dealt_blocks(spark.createDataFrame(points, SCHEMA), side * 750.0, 750.0).collect()
        assert sorted(r.detection_id for r in rows if r.own) == [p[0] for p in points]
        assert len({(r.detection_id, r.cy, r.cx) for r in rows}) == len(rows)
        own = {r.detection_id: (r.cy, r.cx) for r in rows if r.own}
        there = {(r.detection_id, r.cy, r.cx) for r in rows}
        for i, j in np.argwhere(distances(points) <= 750).tolist():
            assert (points[i][0], *own[points[j][0]]) in there


def test_places_are_dealt_to_few_blocks(spark, monkeypatch, tmp_path):
    """a place that is far from other blocks is one row that counts and one that asks, not ten; only hot places are looked up in copies."""
    real, folder = spatial._counts, str(tmp_path)

    def counted(batches, radius_m):
        import uuid
        from pathlib import Path

        held = list(batches)
        Path(folder, uuid.uuid4().hex).write_text(str(sum(b.num_rows for b in held)))
        return real(iter(held), radius_m)

    monkeypatch.setattr(spatial, "_counts", counted)
    monkeypatch.setattr(spatial, "HOT_PLACE", 5, raising=False)
    rng = random.Random(7)
    places = scattered(rng, 1_500, 22, 72, 40_000) + [(22.1, 72.1)] * 9 + [(22.2, 72.2)] * 3
    points = [(f"D{i:05d}", a, b) for i, (a, b) in enumerate(places)]
    far = distances(points)
    got = {r.detection_id: (r.neighbors, r.farthest_m) for r in spatial.neighbors(spark.createDataFrame([*points, ("NONE", None, 1.0)], SCHEMA)).collect()}
    rows = sum(int(f.read_text()) for f in tmp_path.iterdir())
    want = {p[0]: (int((far[i] <= 750).sum()), pytest.approx(max(far[i][far[i] <= 750]), abs=1e-3)) for i, p in enumerate(points)}
    assert got == want | {"NONE": (None, None)}
    assert 2 * 1_502 <= rows < 3 * 1_502
