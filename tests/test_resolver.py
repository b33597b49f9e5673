"""The resolver against one pass over all detections, in any order of arrival and however the globe is cut."""

import random
from math import acos, cos, degrees, radians, sqrt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.operators import resolver

DETECTIONS = "detection_id string, latitude double, longitude double, seq long"
MEMBERS = "detection_id string, latitude double, longitude double, site_id string, candidate_id string"


def one_pass(new, members):
    """Every detection against every member, in order."""
    owner, place, kind, out = {}, {}, {}, {}
    for d, lat, lon, site, candidate in members:
        owner[d], place[d], kind[site or candidate] = site or candidate, (lat, lon), "site" if site else "candidate"
    for d, lat, lon, _ in sorted(new, key=lambda r: (r[3], r[0])):
        best = {}
        for m, p in place.items():
            far = resolver.metres((lat, lon), p)
            if far <= 750:
                best[owner[m]] = min(far, best.get(owner[m], 9e9))
        sites, candidates = (sorted((x, n) for n, x in best.items() if kind[n] == k) for k in ("site", "candidate"))
        place[d] = (lat, lon)
        if sites:
            owner[d] = sites[0][1]
            out[d] = ("MATCHED", sites[0][1], None, round(sites[0][0], 6), len(sites) > 1, [n for _, n in sites])
            continue
        name = candidates[0][1] if candidates else resolver.name_of("CAND_", d)
        owner[d], kind[name] = name, "candidate"
        held = [m for m, o in owner.items() if o == name]
        if not candidates:
            out[d] = ("NEW_CANDIDATE", None, name, None, False, None)
        elif len(held) < 3:
            out[d] = ("CANDIDATE_ACCUMULATED", None, name, round(candidates[0][0], 6), False, None)
        else:
            site = resolver.name_of("SITE_", min(held))
            kind[site] = "site"
            for m in held:
                owner[m] = site
            out[d] = ("PROMOTED", site, name, round(candidates[0][0], 6), False, None)
    return out, owner, kind


def scattered(rng, count, lat, lon, span_m):
    """Places around one, in a square of so many metres."""
    step = span_m / 111_320
    return [(lat + rng.random() * step, (lon + rng.random() * step / max(cos(radians(lat)), 1e-6) + 180) % 360 - 180) for _ in range(count)]


def check(spark, new, members, **how):
    events, changed = resolver.resolve_batch(spark.createDataFrame(new, DETECTIONS), spark.createDataFrame(members, MEMBERS), **how)
    got = {r[0]: (r.status, r.site_id, r.candidate_id, None if r.distance_m is None else round(r.distance_m, 6), r.ambiguous, r.candidate_sites) for r in events.collect()}
    want, owner, kind = one_pass(new, members)
    assert got == want
    before = {d: s or c for d, _, _, s, c in members}
    moved = {r.detection_id: r.site_id or r.candidate_id for r in changed.collect()}
    assert before | moved == owner
    assert {d for d, o in owner.items() if before.get(d) != o} == set(moved)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_cubes(spark, seed):
    """A dense region wider than a cube, points over a corner, the date line and a pole; stored sites and candidates."""
    rng = random.Random(seed)
    places = scattered(rng, 120, 22.0, 72.0, 24_000) + scattered(rng, 25, -10.0, 179.98, 5_000) + scattered(rng, 12, 89.99, 10.0, 900) + scattered(rng, 25, 22.05, 72.05, 900)
    rng.shuffle(places)
    new = [(f"D{rng.random():.12f}", a, b, rng.randint(0, 150)) for a, b in places]  # several arrive at once
    old = [(f"M{i}", a, b, f"SITE_{i % 5}", None) for i, (a, b) in enumerate(scattered(rng, 12, 22.0, 72.0, 24_000))]
    a, b = scattered(rng, 1, 22.1, 72.1, 10)[0]
    old += [("N1", a, b, None, "CAND_x"), ("N2", a + 0.006, b, None, "CAND_x")]
    check(spark, new, old, cube_m=9_500.0)


def test_members_carry_over(spark):
    """Three batches, each against the members that the ones before left, equal one batch of all."""
    rng = random.Random(4)
    places = scattered(rng, 90, 40.0, -3.0, 9_000)
    new = [(f"D{i:03d}", a, b, i) for i, (a, b) in enumerate(places)]
    want, owner, _ = one_pass(new, [])
    held, got = spark.createDataFrame([], MEMBERS), {}
    for part in (new[:30], new[30:60], new[60:]):
        events, changed = resolver.resolve_batch(spark.createDataFrame(part, DETECTIONS), held)
        got |= {r.detection_id: r.status for r in events.collect()}
        rows = {r.detection_id: tuple(r) for r in held.collect()} | {r.detection_id: tuple(r) for r in changed.collect()}
        held = spark.createDataFrame(list(rows.values()), MEMBERS)
    assert got == {d: w[0] for d, w in want.items()}
    assert {r.detection_id: r.site_id or r.candidate_id for r in held.collect()} == owner


def test_no_places_and_no_rows(spark):
    none = spark.createDataFrame([], MEMBERS)
    assert resolver.resolve(spark.createDataFrame([], DETECTIONS), none).collect() == []
    assert resolver.resolve(spark.createDataFrame([("D", None, 2.0, 1)], DETECTIONS), none).collect() == []


def test_a_place_that_very_many_share(spark):
    """Thousands of detections in one place match one site, each after the ones before it."""
    rows = spark.range(20_000).select(F.format_string("D%05d", "id").alias("detection_id"), F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"), F.col("id").alias("seq"))
    counts = {r.status: r["count"] for r in resolver.resolve(rows, spark.createDataFrame([], MEMBERS)).groupBy("status").count().collect()}
    assert counts == {"NEW_CANDIDATE": 1, "CANDIDATE_ACCUMULATED": 1, "PROMOTED": 1, "MATCHED": 19_997}


def test_later_rounds_hold_only_what_is_near(spark, monkeypatch):
    """Points far from every one that waits are in no later round; the result is that of one pass."""
    rng = random.Random(9)
    held, cut = [], resolver.cut

    def counted(df):
        out = cut(df)
        if "pending" in out.columns and "event" not in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(resolver, "cut", counted)
    # apart by more than the reach, in cubes of 50 km: most of them wait for nothing
    new = [(f"D{k:02d}-{i}", a, b, rng.randint(0, 99)) for k in range(40) for i, (a, b) in enumerate(scattered(rng, 6, 21.0 + 0.1 * (k % 8), 71.0 + 0.1 * (k // 8), 900))]
    check(spark, new, [])
    assert len(held) > 1 and held[0] == len(new) and max(held[1:]) < len(new) / 2


def swept(new, members, radius_m=750.0):
    """One cube that holds everything."""
    kinds = pa.schema([("detection_id", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("seq", pa.int64()), ("site_id", pa.string()), ("candidate_id", pa.string()), ("pending", pa.bool_()), ("own", pa.bool_())])
    rows = [(*r, None, None, True, True) for r in new] + [(d, a, b, -1, s, c, False, True) for d, a, b, s, c in members]
    return resolver._swept(pa.table([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds), radius_m, 3 * radius_m).to_pylist()


@pytest.mark.parametrize(("clump", "rows"), [(8_192, 4), (8_192, 32), (0, 32)])
def test_clumps_however_they_are_looked_up(monkeypatch, clump, rows):
    """sites that reach all that is left, sites side by side, few and many places, stored members; detections that share places."""
    monkeypatch.setattr(resolver, "_CLUMP", clump)
    monkeypatch.setattr(resolver, "_ROWS", rows)
    rng = random.Random(11)
    spots = [p for k in range(12) for p in scattered(rng, 40, 20.0 + 0.05 * k, 70.0, 300 + 150 * k)]
    new = [(f"D{i:04d}", *rng.choice(spots), rng.randint(0, 400)) for i in range(700)]
    old = [(f"M{i}", *rng.choice(spots), f"SITE_{i % 3}" if i % 2 else None, None if i % 2 else f"CAND_{i % 5}") for i in range(8)]
    want, owner, kind = one_pass(new, old)
    got = swept(new, old)
    found = {r["detection_id"]: (r["status"], r["site_id"], r["candidate_id"], None if r["distance_m"] is None else round(r["distance_m"], 6), r["ambiguous"], r["candidate_sites"]) for r in got if r["event"]}
    assert found == want
    before = {d: s or c for d, _, _, s, c in old}
    moved = {r["detection_id"]: r["now_site"] or r["now_candidate"] for r in got}
    assert before | moved == owner and not any(r["pending"] for r in got)


def test_one_site_takes_all_it_reaches_at_once(monkeypatch):
    """detections that a clump's one site reaches aren't taken one by one."""
    taken, real = [], resolver.Cube.resolve
    monkeypatch.setattr(resolver.Cube, "resolve", lambda *a: taken.append(1) or real(*a))
    rng = random.Random(12)
    new = [(f"D{i:04d}", a, b, i) for i, (a, b) in enumerate(scattered(rng, 600, 20.0, 70.0, 400))]
    assert sum(r["status"] == "MATCHED" for r in swept(new, [])) == 597
    assert len(taken) < 10


def test_rounds_do_not_grow_with_the_detections(spark, monkeypatch):
    """a site that lies on borders in several rounds isn't cut in all that follow."""
    steps, cut = [], resolver.cut

    def counted(df):
        steps.extend(["event"] if "event" in df.columns else [])
        return cut(df)

    monkeypatch.setattr(resolver, "cut", counted)
    # on the equator, x half a side from a border and y a quarter of one, as near as it gets
    radius, side = resolver.EARTH_RADIUS_M, resolver.CUBE_M
    x = min(((k + 0.5) * side for k in range(20, 120)), key=lambda x: abs(sqrt(radius**2 - x * x) / side % 1 - 0.25))
    lon = degrees(acos(x / radius))
    rng = random.Random(13)
    new = [(f"D{i:03d}", (rng.random() - 0.5) * 0.01, lon + (rng.random() - 0.5) * 0.01, i) for i in range(60)]
    check(spark, new, [])
    assert len(steps) <= 6
