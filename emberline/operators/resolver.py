"""The resolver: new detections against sites and candidates, one after another in the order they arrive.

Order matters only among points that are near each other. What a detection becomes depends on members within the
radius of it, and on whether a candidate among them has been promoted; a promotion comes from a detection within the
radius of another member. So it depends on detections within twice the radius and the extent of a candidate (its
*reach*), and on those before it alone.

The globe is dealt into cubes, far wider than the reach. Each round a task takes a cube with the points around it
and resolves in order every detection of the cube for which no earlier one within reach is still open. Detections
near a border wait for the next round, in which the cubes lie elsewhere. The earliest open detection is always
resolved, so the rounds end; what they find is what one pass over all detections would. No task holds a region of
points that hang together, however far it goes: it holds a cube.
"""

from __future__ import annotations

import hashlib
from math import asin, cos, floor, radians, sin, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.config import CLUSTER_MIN_POINTS, CLUSTER_RADIUS_M, EARTH_RADIUS_M
from emberline.operators.common import cut, first_by, unite

#: The side of a cube. Wider ones need fewer rounds, narrower ones give more tasks.
CUBE_M = 50_000.0
#: How far the cubes move each round, in sides; no two rounds have them in one place.
_SHIFT = (0.8191725134, 0.6710436067, 0.5497004779)
#: Later rounds have fewer points and wider cubes, at most so many times.
_WIDER = 8.0

_OUT = "event boolean, pending boolean, close boolean, detection_id string, latitude double, longitude double, seq long, status string, site_id string, candidate_id string, distance_m double, ambiguous boolean, candidate_sites array<string>, now_site string, now_candidate string"
_TYPES = {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (f.split(" ") for f in _OUT.split(", "))])
#: Distances that are worked out at once, at most, unless one point has more.
_BLOCK = 1_000_000


def _cells(units: np.ndarray, metres: float) -> tuple[np.ndarray, int, int]:
    """The grid cell of each place as a number, and how far two cells side by side are apart in it along the first axis and the second; along the third it is one."""
    cells = np.floor(units / (metres / EARTH_RADIUS_M)).astype(np.int64)
    cells -= cells.min(0) - 1
    _, ny, nz = (int(x) for x in cells.max(0) + 2)
    return (cells[:, 0] * ny + cells[:, 1]) * nz + cells[:, 2], ny * nz, nz


class Grid:
    """Places by grid cell, for those within a distance of some of them."""

    def __init__(self, units: np.ndarray, metres: float) -> None:
        self.units, size = np.ascontiguousarray(units.T).T, metres / EARTH_RADIUS_M
        self.most = (2 * sin(size / 2)) ** 2 * 1.000001  # the square of the chord
        self.key, dx, dy = _cells(units, metres)
        self.order = np.argsort(self.key, kind="stable")
        held = self.key[self.order]
        beside = np.array([x * dx + y * dy for x in (-1, 0, 1) for y in (-1, 0, 1)])  # three cells in a row are one range
        self.low = np.searchsorted(held, self.key[:, None] + beside - 1, "left")
        self.many = np.searchsorted(held, self.key[:, None] + beside + 1, "right") - self.low
        self.total = self.many.sum(1)

    def near(self, asked: np.ndarray, since: np.ndarray, until: np.ndarray) -> list[np.ndarray]:
        """For each of some places those within the distance that are there (``since``, by place) before a time (``until``, by place asked), nearest first."""
        low, many = self.low[asked].ravel(), self.many[asked].ravel()
        ends = np.cumsum(many)
        other = self.order[np.arange(ends[-1]) + np.repeat(low - ends + many, many)]
        total = self.total[asked]
        square = np.zeros(len(other))
        for axis in self.units.T:
            apart = axis[other] - np.repeat(axis[asked], total)
            apart *= apart
            square += apart
        kept = np.flatnonzero((square <= self.most) & (since[other] < np.repeat(until, total)))
        cuts = np.searchsorted(kept, np.cumsum(total)).tolist()
        other, square = other[kept], square[kept]
        return [other[a:b][np.argsort(square[a:b])] for a, b in zip([0, *cuts], cuts)]


class Near:
    """Points by grid cell, for whether any lies within a distance of a place; points come one by one."""

    def __init__(self, metres: float) -> None:
        self.size = metres / EARTH_RADIUS_M
        self.most = (2 * sin(self.size / 2)) ** 2 * 1.000001
        self.cells: dict[tuple[int, int, int], list] = {}
        self.full: set[tuple[int, int, int]] = set()

    def _small(self, u: tuple[float, float, float]) -> tuple[int, int, int]:
        """A cell in which any two points are within the distance."""
        return tuple(floor(x / self.size * 1.7321) for x in u)

    def add(self, u: tuple[float, float, float]) -> None:
        self.full.add(self._small(u))
        held = self.cells.setdefault(tuple(floor(x / self.size) for x in u), [0, np.empty((4, 3))])
        n, places = held
        if n == len(places):
            places = held[1] = np.concatenate([places, np.empty_like(places)])
        places[n], held[0] = u, n + 1

    def any(self, u: tuple[float, float, float]) -> bool:
        if self._small(u) in self.full:
            return True
        x, y, z = (floor(v / self.size) for v in u)
        for c in ((a, b, d) for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) for d in (z - 1, z, z + 1)):
            if c in self.cells:
                n, places = self.cells[c]
                if (((places[:n] - u) ** 2).sum(1) <= self.most).any():
                    return True
        return False


def metres(p: tuple[float, float], q: tuple[float, float]) -> float:
    a = sin(radians(q[0] - p[0]) / 2) ** 2 + cos(radians(p[0])) * cos(radians(q[0])) * sin(radians(q[1] - p[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(a)))


def _units(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)


def name_of(prefix: str, detection: str) -> str:
    """Names follow from a detection, so a batch that is done again gives the same ones."""
    return prefix + hashlib.sha256(detection.encode()).hexdigest()[:16]


#: What becomes of a detection, by number.
_STATUS = ("MATCHED", "NEW_CANDIDATE", "CANDIDATE_ACCUMULATED", "PROMOTED")
_MATCHED, _NEW, _ACCUMULATED, _PROMOTED = range(4)


class Cube:
    """The members around some detections, and what becomes of these in order. Points go by number, in order; so do places, names and owners."""

    def __init__(self, radius_m: float, ids: pa.Array, places: list[tuple[float, float]]) -> None:
        self.radius, self.ids, self.places = radius_m, ids, places
        self.names: list[str] = []
        self.called: list[int] = []  # an owner's name
        self.is_site: list[bool] = []
        self.of: dict[str, int] = {}
        self.held: list[list[int]] = []  # a candidate's members
        n = len(ids)
        self.owner, self.came, self.site, self.candidate = (np.full(n, -1, np.int64) for _ in range(4))  # came: the candidate that a point came by
        self.status, self.distance, self.moved = np.full(n, -1, np.int8), np.full(n, np.nan), np.zeros(n, bool)
        self.sites: dict[int, list[int]] = {}  # those in reach, where there are several

    def _name(self, name: str) -> int:
        self.names.append(name)
        return len(self.names) - 1

    def _owner(self, name: str, site: bool) -> int:
        owner = self.of.get(name)
        if owner is None:
            owner = self.of[name] = len(self.called)
            self.called.append(self._name(name))
            self.is_site.append(site)
            self.held.append([])
        return owner

    def _join(self, owner: int, point: int) -> None:
        self.owner[point] = owner
        if not self.is_site[owner]:
            self.held[owner].append(point)

    def store(self, point: int, site: str | None, candidate: str | None) -> int:
        """A member that was there before."""
        owner = self._owner(candidate if site is None else site, site is not None)
        self._join(owner, point)
        if candidate is not None:
            self.came[point] = self.called[owner] if site is None else self._name(candidate)
        return owner

    def resolve(self, point: int, place: tuple[float, float], near: list[tuple[int, int]]) -> int:
        """What becomes of a detection, by the owners with a member in reach and the place of each one's nearest member; its owner."""
        found = sorted((metres(place, self.places[at]), self.names[self.called[o]], o) for o, at in near)
        found = [x for x in found if x[0] <= self.radius]
        sites = [x for x in found if self.is_site[x[2]]]
        self.moved[point] = True
        if sites:
            distance, _, owner = sites[0]
            self._join(owner, point)
            self.status[point], self.site[point], self.distance[point] = _MATCHED, self.called[owner], distance
            if len(sites) > 1:
                self.sites[point] = [self.called[o] for _, _, o in sites]
            return owner
        if not found:
            owner = self._owner(name_of("CAND_", self.ids[point].as_py()), False)
            self._join(owner, point)
            self.status[point], self.candidate[point], self.came[point] = _NEW, self.called[owner], self.called[owner]
            return owner
        distance, _, owner = found[0]
        self._join(owner, point)
        name, held = self.called[owner], self.held[owner]
        self.status[point], self.candidate[point], self.came[point], self.distance[point] = _ACCUMULATED, name, name, distance
        if len(held) >= CLUSTER_MIN_POINTS:
            site = name_of("SITE_", min(self.ids[p].as_py() for p in held))
            del self.of[self.names[name]]
            self.of[site], self.called[owner], self.is_site[owner] = owner, self._name(site), True
            self.status[point], self.site[point] = _PROMOTED, self.called[owner]
            self.moved[held] = True
        return owner

    def match(self, owner: int, points: np.ndarray, distances: np.ndarray) -> None:
        """Detections that have one site in reach and become its members."""
        self.owner[points], self.site[points], self.distance[points] = owner, self.called[owner], distances
        self.status[points], self.moved[points] = _MATCHED, True


class Nearest:
    """For every place of a clump and every owner the nearest place with a member of it; members come one by one."""

    def __init__(self, units: np.ndarray, metres: float) -> None:
        self.axes = np.ascontiguousarray(units.T)
        self.most = (2 * sin(metres / EARTH_RADIUS_M / 2)) ** 2 * 1.000001
        self.slot: dict[int, int] = {}
        self.owners: list[int] = []
        self.entered: set[tuple[int, int]] = set()
        self.best, self.at = np.full((4, len(units)), np.inf), np.zeros((4, len(units)), np.int64)

    def enter(self, owner: int, place: int) -> None:
        if (owner, place) in self.entered:
            return
        self.entered.add((owner, place))
        slot = self.slot.setdefault(owner, len(self.owners))
        if slot == len(self.owners):
            self.owners.append(owner)
            if slot == len(self.best):
                self.best, self.at = np.concatenate([self.best, np.full_like(self.best, np.inf)]), np.concatenate([self.at, self.at])
        square = 0.0
        for axis in self.axes:
            apart = axis - axis[place]
            apart *= apart
            square = square + apart
        nearer = square < self.best[slot]
        np.copyto(self.best[slot], square, where=nearer)
        self.at[slot][nearer] = place

    def near(self, turn: int, place: int) -> list[tuple[int, int]]:  # noqa: ARG002
        """Owners with a member in reach, each with the place of its nearest."""
        return [(self.owners[k], int(self.at[k, place])) for k, x in enumerate(self.best[: len(self.owners), place].tolist()) if x <= self.most]


class Around:
    """The same for clumps of very many places: those around a place are looked up by cell, when it is asked for."""

    def __init__(self, units: np.ndarray, metres: float, place: np.ndarray, since: np.ndarray, asked: np.ndarray) -> None:
        self.grid, self.place, self.since = Grid(units, metres), place, since
        block = np.cumsum(self.grid.total[place[asked]]) // _BLOCK
        self.blocks, self.held = iter(np.split(asked, np.flatnonzero(np.diff(block)) + 1)), {}
        # who has a member at a place: none (-1), one, or several (-2 less their place in the list)
        self.at = np.full(len(units), -1, np.int64)
        self.several: list[list[int]] = []

    def enter(self, owner: int, place: int) -> None:
        there = int(self.at[place])
        if there == -1:
            self.at[place] = owner
        elif there < -1:
            if owner not in self.several[-2 - there]:
                self.several[-2 - there].append(owner)
        elif there != owner:
            self.at[place] = -2 - len(self.several)
            self.several.append([there, owner])

    def near(self, turn: int, place: int) -> list[tuple[int, int]]:
        while turn not in self.held:
            ask = next(self.blocks)
            some, which = np.unique(self.place[ask], return_inverse=True)
            until = np.zeros(len(some), np.int64)
            until[which] = ask  # the last one counts
            near = self.grid.near(some, self.since, until)
            self.held = {t: near[w] for t, w in zip(ask.tolist(), which.tolist())}
        near = self.held[turn]
        held, best = self.at[near].tolist(), {}
        for there in dict.fromkeys(held):  # nearest first
            if there != -1:
                at = int(near[held.index(there)])
                for owner in (there,) if there >= 0 else self.several[-2 - there]:
                    best.setdefault(owner, at)
        return list(best.items())


def _clumps(units: np.ndarray, size_m: float) -> np.ndarray:
    """The clump of every place; places of two clumps are farther apart than the size."""
    key, dx, dy = _cells(units, size_m)
    held, cell = np.unique(key, return_inverse=True)
    root = np.arange(len(held))
    ahead = [x * dx + y * dy + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    beside = np.array(ahead)[:, None] + held
    at = np.minimum(np.searchsorted(held, beside), len(held) - 1)
    which, a = np.nonzero(held[at] == beside)
    unite(root, a, at[which, a])
    return root[cell]


#: Places whose distances to those before them are worked out at once.
_ROWS = 32


def _one_site(cube: Cube, owner: int, points: np.ndarray, place: np.ndarray, held: np.ndarray, names: np.ndarray, units: np.ndarray) -> bool:
    """Resolves all points that are left of a clump at once if its one site is in reach of each at its turn; else none.

    Then each becomes a member, whatever candidates there are, and its distance is that to the nearest place with a
    member, an old one's or one of a point before it. ``held``: places with a member.
    """
    new, first = np.unique(place, return_index=True)
    there = np.isin(new, held)
    new, first = new[~there], first[~there]
    order = np.argsort(first)
    new, first = new[order], first[order]
    every = np.concatenate([held, new])
    most, axes = (2 * sin(cube.radius / EARTH_RADIUS_M / 2)) ** 2 * 1.000001, np.ascontiguousarray(units[every].T)
    nearest = np.zeros(len(new), np.int64)
    later = np.triu_indices(_ROWS)
    for a in range(0, len(new), _ROWS):
        low, high = len(held) + a, min(len(held) + a + _ROWS, len(every))
        square = axes[0, low:high, None] - axes[0, :high]
        square *= square
        for axis in axes[1:]:
            apart = axis[low:high, None] - axis[:high]
            apart *= apart
            square += apart
        square[:, low:][later if high - low == _ROWS else np.triu_indices(high - low)] = np.inf
        nearest[a : a + _ROWS] = square.argmin(1)
        if (square[np.arange(high - low), nearest[a : a + _ROWS]] > most).any():
            return False
    far = [metres(cube.places[x], cube.places[y]) for x, y in zip(names[new].tolist(), names[every[nearest]].tolist())]
    if max(far, default=0.0) > cube.radius:
        return False
    distances = np.zeros(len(points))
    distances[first] = far
    cube.match(owner, points, distances)
    return True


#: Clumps of more places look up by cell what is near.
_CLUMP = 8_192


def _resolved(cube: Cube, points: np.ndarray, asks: np.ndarray, place: np.ndarray, units: np.ndarray, stored: dict[int, tuple[str | None, str | None]]) -> None:
    """Resolves a clump: its members and the detections that are asked for, in order."""
    names, since, place = np.unique(place, return_index=True, return_inverse=True)
    order = np.argsort(since)
    names, since, turn = names[order], since[order], np.argsort(order)
    place, units = turn[place], units[names]
    look = Nearest(units, cube.radius) if len(names) <= _CLUMP else Around(units, cube.radius, place, since, np.flatnonzero(asks))
    old = np.flatnonzero(~asks)
    sites, members, last = set(), {}, old[-1] if len(old) else -1
    try_at = 0 if len(names) <= _CLUMP else len(points)
    for i, (point, ask, at) in enumerate(zip(points.tolist(), asks.tolist(), place.tolist())):
        if i >= try_at and len(sites) == 1 and i > last:
            (owner,) = sites
            if _one_site(cube, owner, points[i:], place[i:], np.array(sorted(members[owner])), names, units):
                return
            try_at = 2 * i + 8
        if ask:
            owner = cube.resolve(point, cube.places[names[at]], [(o, names[p]) for o, p in look.near(i, at)])
        else:
            owner = cube.store(point, *stored[point])
        look.enter(owner, at)
        members.setdefault(owner, set()).add(at)
        if cube.is_site[owner]:
            sites.add(owner)


def _waiting(units: np.ndarray, place: np.ndarray, pending: np.ndarray, own: np.ndarray, reach_m: float) -> np.ndarray:
    """Which pending points, in order, have to wait: those of other cubes, and those with an earlier one that waits within reach. ``units``: of places."""
    wait = pending & ~own
    if not wait.any():
        return wait
    # only points in clumps of pending ones with one that waits can be within reach of any
    held, at = np.unique(place[pending], return_inverse=True)
    clump = _clumps(units[held], reach_m)[at]
    points = np.flatnonzero(pending)
    near, added = Near(reach_m), set()
    for i in points[np.isin(clump, clump[wait[points]])].tolist():
        u = tuple(units[place[i]].tolist())
        if wait[i] or near.any(u):
            wait[i] = True
            if place[i] not in added:
                added.add(place[i])
                near.add(u)
    return wait


def _close(units: np.ndarray, waiting: np.ndarray, reach_m: float) -> np.ndarray:
    """Which places lie in the cells in and around those of some of them."""
    key, dx, dy = _cells(units, reach_m)
    beside = np.array([x * dx + y * dy + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    return np.isin(key, np.unique(key[waiting])[:, None] + beside)


def _named(numbers: np.ndarray, names: list[str]) -> pa.Array:
    """Names by number; none for -1."""
    return pa.array(names, pa.string()).take(pa.array(numbers, mask=numbers < 0))


def _swept(table: pa.Table, radius_m: float, reach_m: float) -> pa.Table:
    """One cube, one round: what becomes of the detections that can be resolved, every point whose owner changed, and the cube's own points that wait."""
    table = table.take(pc.sort_indices(table, [("seq", "ascending"), ("detection_id", "ascending")])).combine_chunks()
    lat, lon, pending, own = (table.column(c).to_numpy() for c in ("latitude", "longitude", "pending", "own"))
    if not (pending & own).any():
        return _ARROW.empty_table()
    at, place = np.unique(lat + 1j * lon, return_inverse=True)
    units = _units(at.real, at.imag)
    ids = table.column("detection_id").chunk(0)
    cube = Cube(radius_m, ids, list(zip(at.real.tolist(), at.imag.tolist())))
    wait = _waiting(units, place, pending, own, reach_m)
    there = np.flatnonzero(~wait)
    old = np.flatnonzero(~pending)
    stored = dict(zip(old.tolist(), zip(*(table.column(c).take(pa.array(old)).to_pylist() for c in ("site_id", "candidate_id")))))
    clump = _clumps(units, radius_m)[place[there]]
    order = np.argsort(clump, kind="stable")
    there, clump = there[order], clump[order]
    asks = pending[there]
    for part in np.split(np.arange(len(there)), np.flatnonzero(np.diff(clump)) + 1):
        if asks[part].any():
            _resolved(cube, there[part], asks[part], place[there[part]], units, stored)
    rows = np.concatenate([np.flatnonzero(cube.moved), np.flatnonzero(wait & own)])
    out = table.select(["pending", "detection_id", "latitude", "longitude", "seq"]).take(pa.array(rows))
    status, site, owner = cube.status[rows], cube.site[rows], cube.owner[rows]
    event, matched, several = status >= 0, status == _MATCHED, np.array([int(r) in cube.sites for r in rows]) if cube.sites else np.zeros(len(rows), bool)
    lists = [cube.sites.get(r, [s]) if m else [] for r, s, m in zip(rows.tolist(), site.tolist(), matched.tolist())] if cube.sites else None
    many = np.array([len(x) for x in lists]) if cube.sites else matched.astype(np.int64)
    flat = np.array([s for x in lists for s in x], np.int64) if cube.sites else site[matched]
    ends = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32(), mask=np.concatenate([~matched, [False]]))
    called, is_site = np.array([*cube.called, -1]), np.array([*cube.is_site, False])
    fields = {
        "event": pa.array(event), "pending": pa.array(owner < 0), "close": pa.array(_close(units, place[wait], reach_m)[place[rows]]), **{c: out.column(c) for c in ("detection_id", "latitude", "longitude", "seq")},
        "status": _named(status.astype(np.int64), list(_STATUS)), "site_id": _named(site, cube.names), "candidate_id": _named(cube.candidate[rows], cube.names),
        "distance_m": pa.array(cube.distance[rows], mask=np.isnan(cube.distance[rows])), "ambiguous": pa.array(several, mask=~event), "candidate_sites": pa.ListArray.from_arrays(ends, _named(flat, cube.names)),
        "now_site": _named(np.where(is_site[owner], called[owner], -1), cube.names), "now_candidate": _named(cube.came[rows], cube.names),
    }
    return pa.table([fields[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)


def _axes() -> list[Column]:
    lat, lon = F.radians("latitude"), F.radians("longitude")
    return [c * EARTH_RADIUS_M for c in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))]


def _dealt(points: DataFrame, side: float, around: float, shift: tuple[float, float, float]) -> DataFrame:
    """Every point in its cube (``own``) and in those it is near to."""
    out = points.withColumns({f"c{a}": c / side + s for a, c, s in zip("xyz", _axes(), shift)})
    for axis in "xyz":  # a cube is far wider than two such borders
        at = F.col(f"c{axis}")
        within = (at - F.floor(at)) * side
        steps = [F.array(*map(F.lit, some)) for some in ((-1, 0), (0, 1), (0,))]
        out = out.withColumn(f"_{axis}", F.when(within <= around, steps[0]).when(side - within <= around, steps[1]).otherwise(steps[2])).withColumn(f"c{axis}", F.floor(at))
    for axis in "xyz":
        out = out.withColumn(f"_{axis}", F.explode(f"_{axis}")).withColumn(f"c{axis}", F.col(f"c{axis}") + F.col(f"_{axis}"))
    return out.withColumn("own", (F.col("_x") == 0) & (F.col("_y") == 0) & (F.col("_z") == 0)).drop("_x", "_y", "_z")


def _extent(members: DataFrame) -> float:
    """How far apart the members of a candidate lie, at most."""
    x, y, z = _axes()
    spread = members.where("site_id is null").select("candidate_id", x.alias("x"), y.alias("y"), z.alias("z")).groupBy("candidate_id")
    sides = [F.max(a) - F.min(a) for a in "xyz"]
    return spread.agg(F.sqrt(sum((s * s for s in sides[1:]), sides[0] * sides[0])).alias("d")).agg(F.max("d")).first()[0] or 0.0


def resolve_batch(detections: DataFrame, members: DataFrame, radius_m: float = CLUSTER_RADIUS_M, cube_m: float = CUBE_M) -> tuple[DataFrame, DataFrame]:
    """What becomes of each detection, and the members that are new or have another owner.

    A detection joins the nearest site within the radius (the lesser id at ties; more than one in reach is
    ambiguous) and is at once a member; else it joins the nearest candidate; a candidate of three is promoted to a
    site. ``detections``: detection_id, latitude, longitude, seq (ties by id), those without a place are left out.
    ``members``: detection_id, latitude, longitude, site_id, candidate_id (a site where both are there). Returns
    (detection_id, status, site_id, candidate_id, distance_m, ambiguous, candidate_sites) and (detection_id,
    latitude, longitude, site_id, candidate_id).
    """
    none, placed = F.lit(None).cast("string"), "latitude is not null and longitude is not null"
    old = members.where(placed).select("detection_id", "latitude", "longitude", F.lit(-1).cast("long").alias("seq"), "site_id", "candidate_id", F.lit(False).alias("pending"))
    new = detections.where(placed).select("detection_id", "latitude", "longitude", F.col("seq").cast("long").alias("seq"), none.alias("site_id"), none.alias("candidate_id"), F.lit(True).alias("pending"))
    points = cut(old.unionByName(new))
    reach = (2 * radius_m + max(radius_m, _extent(points.where("not pending")))) * 1.00001
    side, total = max(cube_m, 4 * reach), points.count()
    found, alone = None, points.where("not pending").isEmpty()
    rounds, wider = 0, 1.0
    while True:
        dealt = _dealt(points, side * wider, reach, tuple(rounds * s % 1.0 for s in _SHIFT))
        if rounds or not alone:  # cubes that hold members alone are left out
            dealt = dealt.join(dealt.where("own and pending").select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_semi")
        swept = dealt.groupBy("cx", "cy", "cz").applyInArrow(lambda table: _swept(table, radius_m, reach), _OUT)
        step = cut(swept.withColumn("round", F.lit(rounds)))
        found = step if found is None else found.unionByName(step)
        rounds += 1
        waiting = step.where("pending").select(points.columns)
        if waiting.isEmpty():
            break
        # a later round needs what is within reach of a point that waits, and no more
        cells = {f"k{a}": F.floor(c / reach) for a, c in zip("xyz", _axes())}
        steps = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
        asked = waiting.select(*[c.alias(k) for k, c in cells.items()]).distinct()
        for axis in "xyz":
            asked = asked.withColumn("_d", steps).withColumn(f"k{axis}", F.col(f"k{axis}") + F.col("_d")).drop("_d").distinct()
        asked = cut(asked)
        around = lambda df: df.withColumns(cells).join(asked, list(cells), "left_semi").drop(*cells)  # noqa: E731, B023
        now = around(step.where("close and not pending").select("detection_id", "latitude", "longitude", "seq", F.col("now_site").alias("site_id"), F.col("now_candidate").alias("candidate_id"), "pending"))
        context = now
        if rounds > 1 or not alone:
            context = now.unionByName(around(points.where("not pending")).join(now.select("detection_id"), "detection_id", "left_anti"))
        points = cut(waiting.unionByName(context))
        wider = min(_WIDER, max(1.0, sqrt(total / points.count())))
    last = first_by(found.where("not pending"), ["detection_id"], [F.desc("round")])
    changed = last.select("detection_id", "latitude", "longitude", F.col("now_site").alias("site_id"), F.col("now_candidate").alias("candidate_id"))
    return found.where("event").drop("event", "pending", "close", "latitude", "longitude", "seq", "now_site", "now_candidate", "round"), changed


def resolve(detections: DataFrame, members: DataFrame, radius_m: float = CLUSTER_RADIUS_M, cube_m: float = CUBE_M) -> DataFrame:
    """The first result of ``resolve_batch``."""
    return resolve_batch(detections, members, radius_m, cube_m)[0]
