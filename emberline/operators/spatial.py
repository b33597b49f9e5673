"""Radius joins over grid cells and density clustering."""

from __future__ import annotations

from collections.abc import Iterator
from math import degrees

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.config import CLUSTER_MIN_POINTS, CLUSTER_RADIUS_M, EARTH_RADIUS_M, EVIDENCE_RADIUS_KM
from emberline.functions.geo import dealt_around, dealt_blocks, haversine_m, with_cell
from emberline.operators.common import SALTS, components, cut, first_by, small


def radius_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs within a radius, anywhere on the globe: columns of ``left`` as they are, of ``right`` with ``r_`` before, and ``distance_m``.

    Both sides meet by grid cell: the left one is dealt to the cells around each point, so the join has an equality
    that Spark can hash, and the distance is checked on what meets. No pair beyond a neighbouring cell is made.
    Rows without a place meet nothing. Spark takes the dealt side for as small as the points and would broadcast it,
    nine rows for each, so the join is by sorting.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    a = dealt_around(left.where(lat.isNotNull() & lon.isNotNull()), radius_m)
    b = with_cell(right.where(lat.isNotNull() & lon.isNotNull()), radius_m)
    b = b.select("cy", "cx", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    met = a.join(b.hint("merge"), ["cy", "cx"]).withColumn("distance_m", haversine_m(lat, lon, F.col("r_latitude"), F.col("r_longitude")))
    return met.where(F.col("distance_m") <= radius_m).drop("cy", "cx")


def places_of(points: DataFrame, key: str) -> DataFrame:
    """Different places, each with the least key there (``k``) and how many points it has (``w``); points without a place have none."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return points.where(lat.isNotNull() & lon.isNotNull()).groupBy("latitude", "longitude").agg(F.min(key).alias("k"), F.count("*").alias("w"))


#: Places with more points are looked up in copies.
HOT_PLACE = 10_000


def at_places(points: DataFrame, found: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``found`` (by latitude and longitude) for every point that lies there; only of ``places`` (written) that very many share it goes out in copies."""
    on = ["latitude", "longitude"]
    nowhere = F.col("latitude").isNull() | F.col("longitude").isNull()
    left = points.select(key, *on).withColumn("_salt", F.when(nowhere, F.xxhash64(key)).otherwise(F.lit(0)))  # these meet nothing
    right = found.withColumn("_salt", F.lit(0).cast("long"))
    hot = places.where(F.col("w") > HOT_PLACE).select(*on, F.lit(True).alias("_hot"))
    if not hot.isEmpty():
        left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(F.col("_salt"))).drop("_hot")
        copies = F.when(F.col("_hot"), F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).otherwise(F.array("_salt"))
        right = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], "left").drop(*on, "_salt")


#: The side of a block of ``neighbors``, in radii: narrower ones have more places near their borders, wider ones are fewer tasks' work.
_SIDES = 16


def neighbors(points: DataFrame, key: str = "detection_id", radius_m: float = CLUSTER_RADIUS_M) -> DataFrame:
    """How many points lie within the radius of each, itself included, and the distance of the farthest. Distances are between places, however many points share one.

    Every place goes to its block once, and to another block only if that is within the radius. A task reads a block's
    asking places first and then all to be counted, part by part, so no pair is ever a row.
    """
    p = cut(places_of(points, key).select("latitude", "longitude", "w"))
    dealt = dealt_blocks(p, _SIDES * radius_m, radius_m).repartition("cy", "cx")
    w = F.col("w")  # a place that asks is a row of its own, made where it is needed
    sides = dealt.withColumn("w", F.explode(F.when(F.col("own"), F.array(F.lit(None).cast("long"), w)).otherwise(F.array(w))))
    met = sides.sortWithinPartitions("cy", "cx", F.asc_nulls_first("w"))
    found = met.select("cy", "cx", "latitude", "longitude", "w").mapInArrow(lambda batches: _counts(batches, radius_m), "latitude double, longitude double, neighbors long, farthest_m double")
    return at_places(points, found, p, key)


#: Asking places that are held against a block of others at once, and the pairs of a block at most.
_ASKING, _BLOCK = 256, 1 << 16


class _Places:
    """Places sorted so that neighbours lie together, in tiles with their bounds."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, radius_m: float, step: int) -> None:
        a, b = np.radians(lat), np.radians(lon)
        units = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
        self.order = np.lexsort(np.floor(units * (EARTH_RADIUS_M / radius_m)))
        self.lat, self.lon, self.cos, self.units = lat[self.order], lon[self.order], np.cos(a)[self.order], units[:, self.order]
        starts = np.arange(0, len(lat), step)
        self.tiles = [slice(i, i + step) for i in starts.tolist()]
        self.low, self.high = (f.reduceat(self.units, starts, axis=1) if len(lat) else np.zeros((3, 0)) for f in (np.minimum, np.maximum))


class _Cell:
    """A cell's asking places with what has been counted for them so far."""

    def __init__(self, radius_m: float) -> None:
        self.most, self.parts, self.n = radius_m, [], None
        self.square = (2 * np.sin(radius_m / EARTH_RADIUS_M / 2)) ** 2  # of the chord
        self.even = self.square * 1e-8  # squares less apart may be of equal distances

    def ask(self, lat: np.ndarray, lon: np.ndarray) -> None:
        self.parts.append((lat, lon))

    def close(self) -> None:
        if self.n is None:
            self.lat, self.lon = (np.concatenate(x) if self.parts else np.zeros(0) for x in (zip(*self.parts) if self.parts else ((), ())))
            self.asks = _Places(self.lat, self.lon, self.most, _ASKING)
            self.n, self.far, self.chord = np.zeros(len(self.lat), np.int64), np.full(len(self.lat), -1.0), np.full(len(self.lat), -1.0)

    def _metres(self, other: _Places, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By the formula of ``haversine_m``."""
        a = self.asks
        share = np.sin(np.radians(other.lat[j] - a.lat[i]) / 2) ** 2 + a.cos[i] * other.cos[j] * np.sin(np.radians(other.lon[j] - a.lon[i]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(share, 1.0)))

    def meet(self, lat: np.ndarray, lon: np.ndarray, w: np.ndarray) -> None:
        """Counts places for all that ask.

        Chords tell who is near and who is farthest, tiles that are too far apart are left out; where that is close,
        the distance decides.
        """
        self.close()
        asks, other = self.asks, _Places(lat, lon, self.most, max(_BLOCK // _ASKING, 1))
        weight = w[other.order].astype(np.float64)
        apart = np.maximum(np.maximum(other.low[:, None] - asks.high[:, :, None], asks.low[:, :, None] - other.high[:, None]), 0.0)
        for x, y in np.argwhere((apart**2).sum(0) <= self.square + self.even).tolist():
            a, b = asks.tiles[x], other.tiles[y]
            square = np.zeros((len(asks.lat[a]), len(other.lat[b])))
            for one, two in zip(asks.units, other.units):
                gap = one[a, None] - two[b]
                gap *= gap
                square += gap
            near = square <= self.square + self.even
            i, j = np.nonzero(near & (square >= self.square - self.even))
            if len(i):
                near[i, j] = self._metres(other, i + a.start, j + b.start) <= self.most
            self.n[a] += (near.astype(np.float64) @ weight[b]).astype(np.int64)
            square[~near] = -1.0
            self.chord[a] = np.maximum(self.chord[a], square.max(1))
            i, j = np.nonzero(square >= np.maximum(self.chord[a, None] - self.even, 0.0))
            np.maximum.at(self.far, i + a.start, self._metres(other, i + a.start, j + b.start))

    def done(self) -> pa.RecordBatch:
        self.close()
        n, far = np.empty_like(self.n), np.empty_like(self.far)
        n[self.asks.order], far[self.asks.order] = self.n, self.far
        return pa.RecordBatch.from_arrays([pa.array(self.lat), pa.array(self.lon), pa.array(n), pa.array(far)], names=["latitude", "longitude", "neighbors", "farthest_m"])


def _counts(batches: Iterator[pa.RecordBatch], radius_m: float) -> Iterator[pa.RecordBatch]:
    """Counts and farthest distances of asking places (no ``w``), of rows sorted by cell, asking ones first."""
    at, cell, done, rows = None, None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cy, cx, lat, lon = (batch.column(x).to_numpy() for x in ("cy", "cx", "latitude", "longitude"))
        asks = batch.column("w").is_null().to_numpy(zero_copy_only=False)
        w = batch.column("w").fill_null(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (cy[1:] != cy[:-1]) | (cx[1:] != cx[:-1])]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cy)]):
            if (cy[a], cx[a]) != at:
                if cell is not None and cell.parts:
                    done.append(cell.done())
                    rows += done[-1].num_rows
                at, cell = (cy[a], cx[a]), _Cell(radius_m)
            middle = a + int(asks[a:b].sum())
            if middle > a:
                cell.ask(lat[a:middle], lon[a:middle])
            if b > middle and cell.parts:
                cell.meet(lat[middle:b], lon[middle:b], w[middle:b])
        if rows >= 10_000:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done, rows = [], 0
    if cell is not None and cell.parts:
        done.append(cell.done())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


#: Pairs of cells with at most so many pairs of places are tested by a join, others block by block with an early end.
_FEW = 10_000
#: The side of a small cell, as a share of the radius: any two points of one are within the radius.
_SIDE = 0.999 / 2**0.5


#: Bits of a place's share of its small cell's height, and of its width: steps of at most a millimetre.
_BITS = 20
#: Points of cells with more of them look their cell up by broadcast.
HOT_CELL = 10_000


def _cells_round(row: Column, side: float) -> Column:
    """How many small cells go round the globe in a row of latitude."""
    low = F.least(F.abs(row), F.abs(row + 1)) * side  # where the row is widest
    return F.greatest(F.ceil(F.cos(F.radians(low)) * 360 / side), F.lit(1))


def _small_side(radius_m: float) -> float:
    return degrees(radius_m * _SIDE / EARTH_RADIUS_M)


def _small_cells(points: DataFrame, radius_m: float) -> DataFrame:
    """Points with their small cell (gy, gx) and their place in it, rounded down, as one number by latitude first (ys) and one by longitude first (xs)."""
    side, steps = _small_side(radius_m), 1 << _BITS
    up = F.col("latitude") / side
    out = points.withColumn("gy", F.floor(up)).withColumn("_u", (F.col("longitude") + 180) / 360 * _cells_round(F.col("gy"), side))
    out = out.withColumn("gx", F.pmod(F.floor("_u"), _cells_round(F.col("gy"), side)))
    qy, qx = (F.floor((v - F.floor(v)) * steps).cast("long") for v in (up, F.col("_u")))
    return out.withColumn("ys", qy * steps + qx).withColumn("xs", qx * steps + qy).drop("_u")


def _ends(prefix: str, radius_m: float) -> list[tuple[Column, Column]]:
    """Latitude and longitude of a cell's southernmost, northernmost, westernmost and easternmost places, right to a millimetre."""
    side, steps = _small_side(radius_m), 1 << _BITS
    gy, gx = F.col(f"{prefix}gy"), F.col(f"{prefix}gx")
    out = []
    for name in ("south", "north", "west", "east"):
        high, low = F.floor(F.col(prefix + name) / steps), F.col(prefix + name) % steps
        qy, qx = (high, low) if name in ("south", "north") else (low, high)
        out.append(((gy + (qy + 0.5) / steps) * side, (gx + (qx + 0.5) / steps) * 360 / _cells_round(gy, side) - 180))
    return out


def _linked(frame: pd.DataFrame, radius_m: float) -> bool:
    """Whether a place of one cell is within the radius of a place of the other; the likeliest are tried first."""
    sides = [frame[frame["side"] == i] for i in (0, 1)]
    units = []
    for f in sides:
        lat, lon = np.radians(f["latitude"].to_numpy()), np.radians(f["longitude"].to_numpy())
        units.append(np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1))
    a, b = (u[np.argsort(((u - o.mean(0)) ** 2).sum(1), kind="stable")] for u, o in (units, units[::-1]))
    most = (2 * np.sin(radius_m / EARTH_RADIUS_M / 2)) ** 2
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 4096):
            if (((a[i : i + 256, None] - b[None, j : j + 4096]) ** 2).sum(2) <= most).any():
                return True
    return False


def _met_cells(cells: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a cell (a) and a dense one (b) that may hold places within the radius of each other, two dense ones once.

    Cells meet by the middle of their places. ``near``: outer places of two dense cells show that they are linked.
    """
    south, north, west, east = _ends("", radius_m)
    middle = cells.select("low", "gy", "gx", "total", "dense", "south", "north", "west", "east", ((south[0] + north[0]) / 2).alias("latitude"), ((west[1] + east[1]) / 2).alias("longitude"))
    met = radius_join(middle, middle.where("dense").drop("dense"), 2 * radius_m).where("not dense or low < r_low")
    sure = radius_m - 0.01  # ends are right to a millimetre
    near = F.lit(False)
    for y in _ends("r_", radius_m):
        for x in _ends("", radius_m):
            near = near | (haversine_m(*x, *y) <= sure)
    return cut(met.select(F.col("low").alias("a"), F.col("r_low").alias("b"), "dense", (F.col("total") * F.col("r_total")).alias("most"), (F.col("dense") & near).alias("near")))


def _tested(open_pairs: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Of pairs of dense cells (a, b: their least keys) those with places within the radius of each other."""
    cells = places.where("dense").select("low", "latitude", "longitude")
    # few places: all of one against all of the other in the join itself
    one, other = (cells.select(F.col("low").alias(c), F.col("latitude").alias(f"{c}_lat"), F.col("longitude").alias(f"{c}_lon")) for c in ("a", "b"))
    tried = open_pairs.where(F.col("most") <= _FEW).select("a", "b").join(one, "a").join(other, "b")
    few = tried.where(haversine_m(*[F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]) <= radius_m).select("a", "b")
    many = open_pairs.where(F.col("most") > _FEW).select("a", "b")
    of = lambda c, i: many.join(cells, F.col(c) == F.col("low")).select("a", "b", F.lit(i).alias("side"), "latitude", "longitude")
    kind = open_pairs.schema["a"].dataType.simpleString()

    def tested(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[["a", "b"]].head(1 if _linked(frame, radius_m) else 0)

    exact = of("a", 0).unionByName(of("b", 1)).groupBy("a", "b").applyInPandas(tested, f"a {kind}, b {kind}")
    return few.distinct().unionByName(exact)


def _by_cell(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``points`` with what ``labels`` (written; one row a cell) says of their cell; the few cells of very many points go out by broadcast."""
    rest = labels.drop("total")
    hot = labels.where(F.col("total") > HOT_CELL).drop("total")
    if hot.isEmpty():
        return points.join(rest, ["gy", "gx"], "left")
    cold = points.join(F.broadcast(hot.select("gy", "gx")), ["gy", "gx"], "left_anti")
    return points.join(F.broadcast(hot), ["gy", "gx"]).unionByName(cold.join(labels.where(F.col("total") <= HOT_CELL).drop("total"), ["gy", "gx"], "left"))


def cluster(points: DataFrame, key: str = "detection_id", radius_m: float = CLUSTER_RADIUS_M, min_points: int = CLUSTER_MIN_POINTS) -> DataFrame:
    """Density clusters: a point with ``min_points`` neighbours (itself included) is a core; linked cores share a
    label (their least key); other points take the nearest core within reach (the lesser label at ties), or none.

    Points fall into small cells, in which any two are neighbours: all points of a cell with ``min_points`` are
    cores without a look at any other, and all cores of a cell have one label. Of dense cells only a count, the least
    key and the four outer places are gathered. Places are read for cells with few points, the dense cells around
    those, and pairs of dense cells that neither outer places nor other cells link: distances are worked out from the
    few places, and between dense cells only until one is short enough. So a cell may hold any number of points, at
    one place or at many, and points are shuffled to be summed up by cell and to look their cell up. Returns key,
    cluster, role (CORE, BORDER, NOISE) for every row; points without a place are NOISE; an empty table gives an
    empty result.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    somewhere = F.coalesce(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))
    placed = _small_cells(points.where(somewhere).select(F.col(key).alias("k"), "latitude", "longitude"), radius_m)
    ends = [f("ys" if n in ("south", "north") else "xs").alias(n) for n, f in (("south", F.min), ("north", F.max), ("west", F.min), ("east", F.max))]
    cells = placed.groupBy("gy", "gx").agg(F.count("*").alias("total"), F.min("k").alias("low"), *ends)
    cells = cut(cells.withColumn("dense", F.col("total") >= min_points))

    # dense cells that outer places link are one already; only pairs that are still apart are open
    met = _met_cells(cells, radius_m)
    lone = cells.where("dense").select(F.col("low").alias("a"), F.col("low").alias("b"))
    known = components(met.where("near").select("a", "b").unionByName(lone))
    of = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    open_pairs = cut(met.where("dense and not near").join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select("a", "b", "most", "ra", "rb"))
    wanted = met.where("not dense").select(F.col("b").alias("low")).union(open_pairs.select("a")).union(open_pairs.select("b")).distinct()
    fetched = cells.where("not dense").select("gy", "gx", "dense", "low").union(cells.where("dense").join(wanted, "low", "left_semi").select("gy", "gx", "dense", "low"))
    read = placed.select("k", "latitude", "longitude", "gy", "gx").join(small(cut(fetched)), ["gy", "gx"])
    places = cut(read.groupBy("gy", "gx", "latitude", "longitude", "dense", "low").agg(F.min("k").alias("k"), F.count("*").alias("w")))

    # around places of cells with few points: by cell where that is dense, by place elsewhere
    sparse = places.where("not dense").select("k", "latitude", "longitude")
    other = places.select("latitude", "longitude", "w", "dense", F.when(F.col("dense"), F.col("low")).alias("low"), F.when(~F.col("dense"), F.col("k")).alias("place"))
    near = cut(radius_join(sparse, other, radius_m).groupBy("k", "r_dense", "r_low", "r_place").agg(F.sum("r_w").alias("w"), F.min("distance_m").alias("d")))
    few = places.where("not dense").select("k", "gy", "gx", "latitude", "longitude")
    cores = few.join(near.groupBy("k").agg(F.sum("w").alias("w")).where(F.col("w") >= min_points).select("k"), "k").select("k", "gy", "gx")
    named = cut(cores.join(cores.groupBy("gy", "gx").agg(F.min("k").alias("name")), ["gy", "gx"]).select("k", "name"))  # a cell's cores go by the least of them

    by_place = near.join(named.select(F.col("k").alias("r_place"), F.col("name").alias("r_name")), "r_place", "left")
    reached = by_place.select("k", "d", F.when(F.col("r_dense"), F.col("r_low")).otherwise(F.col("r_name")).alias("core")).where("core is not null")
    reached = cut(reached.join(of("core"), "core", "left").select("k", "d", F.coalesce("rcore", "core").alias("core")))
    links = reached.join(named, "k").select(F.col("name").alias("a"), F.col("core").alias("b")).where("a <> b").distinct()
    tested = _tested(open_pairs, places, radius_m).join(open_pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    alone = named.select(F.col("name").alias("a"), F.col("name").alias("b")).unionByName(known.select(F.col("root").alias("a"), F.col("root").alias("b"))).distinct()
    roots = cut(components(links.unionByName(tested).unionByName(alone)))

    border = reached.join(named.select("k"), "k", "left_anti").join(roots.select(F.col("node").alias("core"), "root"), "core")
    border = first_by(border, ["k"], [F.col("d"), F.col("root")]).select("k", "root", F.lit("BORDER").alias("role"))
    sparse_cores = named.join(roots.withColumnRenamed("node", "name"), "name").select("k", "root", F.lit("CORE").alias("role"))
    spots = few.join(border.unionByName(sparse_cores), "k").groupBy("gy", "gx").agg(F.collect_list(F.struct("latitude", "longitude", "root", "role")).alias("spots"))
    dense = cells.where("dense").select("gy", "gx", "total", F.col("low").alias("core")).join(of("core"), "core").join(roots.select(F.col("node").alias("rcore"), "root"), "rcore").select("gy", "gx", "total", "root")
    labels = cut(dense.unionByName(spots.withColumn("total", F.lit(0).cast("long")), allowMissingColumns=True))

    found = _by_cell(placed.select("k", "latitude", "longitude", "gy", "gx"), labels)
    spot = F.get(F.filter("spots", lambda x: (x["latitude"] == lat) & (x["longitude"] == lon)), F.lit(0))
    role = F.when(F.col("root").isNotNull(), "CORE").otherwise(F.coalesce(spot["role"], F.lit("NOISE")))
    nowhere = points.where(~somewhere).select(key, F.lit(None).cast(points.schema[key].dataType).alias("cluster"), F.lit("NOISE").alias("role"))
    return found.select(F.col("k").alias(key), F.coalesce("root", spot["root"]).alias("cluster"), role.alias("role")).unionByName(nowhere)


def facilities_near(sites: DataFrame, facilities: DataFrame, radius_km: float = EVIDENCE_RADIUS_KM) -> DataFrame:
    """Facilities within a radius of each site, with the distance."""
    return radius_join(sites.select("site_id", "latitude", "longitude"), facilities, radius_km * 1000).select("site_id", F.col("r_evidence_id").alias("evidence_id"), "distance_m")


def events_near(sites: DataFrame, events: DataFrame, cutoff: str, days: int, radius_km: float = EVIDENCE_RADIUS_KM) -> DataFrame:
    """Events within a radius whose time meets the window around a date; one without an end goes on, one without a start never meets."""
    ref = F.lit(cutoff).cast("date")
    met = events.where((F.col("event_start") <= F.date_add(ref, days)) & (F.col("event_end").isNull() | (F.col("event_end") >= F.date_sub(ref, days))))
    return radius_join(sites.select("site_id", "latitude", "longitude"), met, radius_km * 1000).select("site_id", F.col("r_evidence_id").alias("evidence_id"), "distance_m")
