"""Site-relative anomaly: robust baselines of strictly earlier days, recursions, empirical calibration."""

from __future__ import annotations

from bisect import insort
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberline import config as c
from emberline.operators.common import as_of, cut


#: Histories of at most so many days are sorted all at once, longer ones grow a sorted list day by day.
MATRIX = 160
#: What the per-site pass returns.
_NUMBERS = [f"{x}_{p}" for x in ("max_frp", "mean_frp", "density", "gap") for p in "ms"] + ["intensity", "density", "recurrence_burst", "ewma", "cusum"]
_DAY = "site_id string, acq_date date, history_days long, history_span int, gaps int, gap double, scored boolean"


def prefix_robust(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and scale of the first k values, for every k from 0 to all; of none NaN and the least scale.

    The scale is that of the deviations from the median, or of the quartiles' distance where those vanish, never tiny.
    """
    n = len(values)
    if n <= MATRIX:
        k = np.arange(n + 1)
        held = np.sort(np.where(np.arange(n)[None, :] < k[:, None], values, np.inf), axis=1) if n else np.zeros((1, 0))
        held = np.concatenate([held, np.full((n + 1, 1), np.inf)], axis=1)
        with np.errstate(invalid="ignore"):
            middle = lambda s: (s[k, np.maximum(k - 1, 0) // 2] + s[k, k // 2]) / 2
            m = middle(held)
            mad = middle(np.sort(np.abs(held - np.where(k > 0, m, 0.0)[:, None]), axis=1))

            def quantile(q: float) -> np.ndarray:
                at = q * np.maximum(k - 1, 0)
                low = np.floor(at).astype(int)
                x, y = held[k, low], held[k, np.minimum(low + 1, np.maximum(k - 1, 0))]
                return x + (y - x) * (at - low)

            iqr = quantile(0.75) - quantile(0.25)
    else:
        held_list: list[float] = []
        rows = [(np.nan, np.nan, np.nan)]
        for v in values.tolist():
            insort(held_list, v)
            rows.append(_of_sorted(held_list))
        m, mad, iqr = (np.array(c) for c in zip(*rows))
    with np.errstate(invalid="ignore"):
        mad = c.MAD_SCALE * mad
        scale = np.maximum(np.maximum(np.where(mad < c.SCALE_FLOOR, iqr / c.IQR_SCALE, mad), c.SCALE_SHARE * np.abs(m)), c.SCALE_LEAST)
    m[0], scale[0] = np.nan, c.SCALE_LEAST
    return m, scale


def _of_sorted(s: list[float]) -> tuple[float, float, float]:
    """Median, median deviation from it and quartiles' distance of a sorted list, without reading the whole of it."""
    n = len(s)
    m = (s[(n - 1) // 2] + s[n // 2]) / 2

    def deviation(k: int) -> float:
        """The k-th least distance from the median: the k values nearest to it stand side by side."""
        low, high = 0, n - k
        while low < high:
            mid = (low + high) // 2
            if m - s[mid] > s[mid + k] - m:
                low = mid + 1
            else:
                high = mid
        return max(m - s[low], s[low + k - 1] - m)

    def quantile(q: float) -> float:
        at = q * (n - 1)
        low = int(at)
        return s[low] + (s[min(low + 1, n - 1)] - s[low]) * (at - low)

    return m, (deviation((n + 1) // 2) + deviation(n // 2 + 1)) / 2, quantile(0.75) - quantile(0.25)


def site_history(days: np.ndarray, detections: np.ndarray, mean_frp: np.ndarray, max_frp: np.ndarray) -> dict[str, np.ndarray]:
    """Everything of one site's days, in order: baselines of strictly earlier days, signals, and both recursions.

    A gap of more than the reset time starts both recursions anew; days without history enough change nothing and
    have no signals.
    """
    n = len(days)
    gap = np.concatenate([[np.nan], np.diff(days).astype(float)])
    density = np.array([log(1.0 + d) for d in detections.tolist()])
    k = np.arange(n)
    span = np.where(k > 0, days - days[0], -1)
    gaps = np.maximum(k - 1, 0)
    out = {"history_days": k, "history_span": span, "gaps": gaps, "gap": gap}
    z = {}
    for name, x, before in (("max_frp", max_frp, k), ("mean_frp", mean_frp, k), ("density", density, k), ("gap", gap[1:], gaps)):
        m, s = prefix_robust(x)
        out[f"{name}_m"], out[f"{name}_s"] = m[before], s[before]
        value, centre = (gap, m[before]) if name == "gap" else (x, m[before])
        with np.errstate(invalid="ignore"):
            z[name] = np.clip(((centre - value) if name == "gap" else (value - centre)) / s[before], 0.0, c.Z_CAP)
    scored = (k >= c.MIN_HISTORY) & (span >= c.MIN_SPAN_DAYS)
    out["scored"] = scored
    out["intensity"] = np.where(scored, np.maximum(z["max_frp"], z["mean_frp"]), np.nan)
    out["density"] = np.where(scored, z["density"], np.nan)
    out["recurrence_burst"] = np.where(scored, np.where(gaps >= c.MIN_GAPS, z["gap"], 0.0), np.nan)
    ewma, cusum, e, total = np.full(n, np.nan), np.full(n, np.nan), 0.0, 0.0
    x = np.maximum(out["intensity"], out["density"]).tolist()
    for i in np.flatnonzero(scored).tolist():
        if gap[i] > c.RESET_GAP_DAYS:
            e = total = 0.0
        e = c.EWMA_ALPHA * x[i] + (1 - c.EWMA_ALPHA) * e
        total = max(0.0, min(total + x[i] - c.CUSUM_K, c.CUSUM_CAP))
        ewma[i], cusum[i] = e, total
    return out | {"ewma": ewma, "cusum": cusum}


#: Numbers that a group of sites of one length may make at once, prefix by prefix.
_AT_ONCE = 1_000_000


def _prefix_robust_each(values: np.ndarray, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``prefix_robust`` of each row, for the first ``since`` values and more; all rows have at most ``MATRIX`` values."""
    sites, n = values.shape
    k = np.arange(since, n + 1)
    row = k - since
    held = np.full((sites, len(k), n + 1), np.inf)
    held[:, :, :n] = np.where(np.arange(n) < k[:, None], values[:, None, :], np.inf)
    held.sort(axis=2)
    with np.errstate(invalid="ignore"):
        middle = lambda x: (x[:, row, np.maximum(k - 1, 0) // 2] + x[:, row, k // 2]) / 2
        m = middle(held)
        apart = np.abs(held - np.where(k > 0, m, 0.0)[:, :, None])
        apart.sort(axis=2)
        mad = middle(apart)

        def quantile(q: float) -> np.ndarray:
            at = q * np.maximum(k - 1, 0)
            low = np.floor(at).astype(int)
            x, y = held[:, row, low], held[:, row, np.minimum(low + 1, np.maximum(k - 1, 0))]
            return x + (y - x) * (at - low)

        iqr = quantile(0.75) - quantile(0.25)
        mad = c.MAD_SCALE * mad
        scale = np.maximum(np.maximum(np.where(mad < c.SCALE_FLOOR, iqr / c.IQR_SCALE, mad), c.SCALE_SHARE * np.abs(m)), c.SCALE_LEAST)
    m[:, k == 0], scale[:, k == 0] = np.nan, c.SCALE_LEAST
    return m, scale


def _densities(detections: np.ndarray) -> np.ndarray:
    """What counts of a day are compared by."""
    some, which = np.unique(detections, return_inverse=True)
    return np.array([log(1.0 + d) for d in some.tolist()])[which].reshape(detections.shape)


def _histories_each(days: np.ndarray, detections: np.ndarray, mean_frp: np.ndarray, max_frp: np.ndarray) -> dict[str, np.ndarray]:
    """``site_history`` of many sites with the same number of days, a row for each."""
    sites = len(days)
    gap = np.concatenate([np.full((sites, 1), np.nan), np.diff(days, axis=1).astype(float)], axis=1)
    values = {"max_frp": max_frp, "mean_frp": mean_frp, "density": _densities(detections), "gap": gap[:, 1:]}
    return _going_on_each(days, gap, values, 0, days[:, 0], np.zeros(sites), np.zeros(sites))[0]


def _going_on_each(days: np.ndarray, gap: np.ndarray, values: dict[str, np.ndarray], held: int, first: np.ndarray, e: np.ndarray, total: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """``site_history`` of the days that follow ``held`` days of each site, a row for each site, and where both recursions end.

    ``values`` holds all of a site's values (gaps are one less), those of earlier days in any order and first;
    ``first`` is its first day, ``e`` and ``total`` are the recursions so far.
    """
    k = held + np.arange(days.shape[1])
    span = np.where(k > 0, days - first[:, None], -1)
    gaps = np.maximum(k - 1, 0)
    out = {"history_days": np.broadcast_to(k, days.shape), "history_span": span, "gaps": np.broadcast_to(gaps, days.shape), "gap": gap}
    z = {}
    for name, before in (("max_frp", k), ("mean_frp", k), ("density", k), ("gap", gaps)):
        m, s = _prefix_robust_each(values[name], before[0])
        out[f"{name}_m"], out[f"{name}_s"] = m, s = m[:, before - before[0]], s[:, before - before[0]]
        with np.errstate(invalid="ignore"):
            z[name] = np.clip((m - gap if name == "gap" else values[name][:, held:] - m) / s, 0.0, c.Z_CAP)
    scored = (k >= c.MIN_HISTORY) & (span >= c.MIN_SPAN_DAYS)
    out["scored"] = scored
    out["intensity"] = np.where(scored, np.maximum(z["max_frp"], z["mean_frp"]), np.nan)
    out["density"] = np.where(scored, z["density"], np.nan)
    out["recurrence_burst"] = np.where(scored, np.where(gaps >= c.MIN_GAPS, z["gap"], 0.0), np.nan)
    ewma, cusum = np.full(days.shape, np.nan), np.full(days.shape, np.nan)
    x = np.maximum(out["intensity"], out["density"])
    for i in np.flatnonzero(scored.any(0)).tolist():
        on = scored[:, i]
        anew = on & (gap[:, i] > c.RESET_GAP_DAYS)
        e, total = np.where(anew, 0.0, e), np.where(anew, 0.0, total)
        e = np.where(on, c.EWMA_ALPHA * x[:, i] + (1 - c.EWMA_ALPHA) * e, e)
        total = np.where(on, np.maximum(0.0, np.minimum(total + x[:, i] - c.CUSUM_K, c.CUSUM_CAP)), total)
        ewma[on, i], cusum[on, i] = e[on], total[on]
    return out | {"ewma": ewma, "cusum": cusum}, e, total


def site_histories(starts: np.ndarray, days: np.ndarray, detections: np.ndarray, mean_frp: np.ndarray, max_frp: np.ndarray) -> dict[str, np.ndarray]:
    """``site_history`` of every site of a table; ``starts``: where each begins. Sites with as many days are worked out together."""
    sizes = np.diff(np.append(starts, len(days)))
    columns: dict[str, np.ndarray] = {}

    def put(at: np.ndarray, found: dict[str, np.ndarray]) -> None:
        for name, values in found.items():
            if name not in columns:
                columns[name] = np.empty(len(days), values.dtype)
            columns[name][at] = values

    for n in np.unique(sizes).tolist():
        chosen = starts[sizes == n]
        if n > MATRIX:
            for a in chosen.tolist():
                put(np.arange(a, a + n), site_history(*[x[a : a + n] for x in (days, detections, mean_frp, max_frp)]))
            continue
        step = max(1, _AT_ONCE // (n + 1) ** 2)
        for i in range(0, len(chosen), step):
            at = chosen[i : i + step, None] + np.arange(n)
            put(at, _histories_each(*[x[at] for x in (days, detections, mean_frp, max_frp)]))
    return columns


def histories(daily: DataFrame, numbers: list[str] = _NUMBERS) -> DataFrame:
    """Every site-day with those of its baselines, signals and recursions that are asked for, by one pass over each site's days.

    Site-days move once, to their site; a task reads its sites in order and holds the days of one at a time. What
    it returns are numbers: no list of a history is ever a value of a row. A null date or FRP is a day that is
    dropped, or 0; an empty table gives an empty result.
    """
    rows = daily.where(F.col("site_id").isNotNull() & F.col("acq_date").isNotNull()).select("site_id", F.datediff("acq_date", F.lit("1970-01-01").cast("date")).alias("day"), F.col("detections").cast("long").alias("detections"), F.coalesce(F.col("mean_frp").cast("double"), F.lit(0.0)).alias("mean_frp"), F.coalesce(F.col("max_frp").cast("double"), F.lit(0.0)).alias("max_frp"))
    ordered = rows.repartition("site_id").sortWithinPartitions("site_id", "day")
    kinds = f"{_DAY}, {', '.join(f'{n} double' for n in numbers)}"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def made(part: pa.Table) -> pa.RecordBatch:
        """All complete sites of a table."""
        sites = part.column("site_id").combine_chunks()
        day, n, mean, top = (part.column(x).to_numpy() for x in ("day", "detections", "mean_frp", "max_frp"))
        columns = site_histories(np.array(_starts(sites)), day, n, mean, top)
        return pa.RecordBatch.from_arrays(_day_arrays(sites, day, columns, numbers), schema=schema)

    def run(batches):
        for table in _whole_sites(batches):
            yield made(table)

    return ordered.mapInArrow(run, kinds).withColumn("change", F.greatest("ewma", "cusum"))


def _day_arrays(sites: pa.Array, day: np.ndarray, columns: dict[str, np.ndarray], numbers: list[str]) -> list[pa.Array]:
    """The columns of ``_DAY`` and the numbers, of NaN null."""
    whole = lambda k, t: pa.array(columns[k], t)
    arrays = [sites.cast(pa.string()), pa.array(day.astype(np.int32), pa.int32()).cast(pa.date32()), whole("history_days", pa.int64()), pa.array(columns["history_span"].astype(np.int32), pa.int32(), mask=columns["history_span"] < 0), pa.array(columns["gaps"].astype(np.int32)), pa.array(columns["gap"], from_pandas=True), whole("scored", pa.bool_())]
    return [*arrays, *[pa.array(columns[k], pa.float64(), from_pandas=True) for k in numbers]]


#: Sites are taken together until they have so many rows or bytes, so that many of them have equally many days.
_ROWS, _BYTES = 200_000, 1 << 25


def _whole_sites(batches):
    """Batches, sorted by site, as tables of complete sites."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < _ROWS and size < _BYTES or held[0].column("site_id")[0] == batch.column("site_id")[-1]:  # more sites are wanted, or one goes on
            continue
        table = pa.Table.from_batches(held)
        at = _starts(table.column("site_id").combine_chunks())[-1]
        yield table.slice(0, at)
        held = table.slice(at).combine_chunks().to_batches()
        rows, size = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _starts(sites: pa.Array) -> list[int]:
    """Where a new site begins."""
    if len(sites) < 2:
        return [0]
    return [0, *(np.flatnonzero(pc.not_equal(sites[1:], sites[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]


def baseline(daily: DataFrame) -> DataFrame:
    """Each site-day with its history (strictly earlier days) and the robust centre and scale of each signal."""
    return histories(daily).select("site_id", "acq_date", "history_days", "history_span", "gaps", *_NUMBERS[:8])


def signals(daily: DataFrame) -> DataFrame:
    """The raw signals and recursions of each site-day that has history enough (null otherwise); long gaps never raise one."""
    return histories(daily, _NUMBERS[8:]).drop("gaps")


def midrank(value: Column, reference: list[float] | None) -> Column:
    """The share of a sorted reference (bounded, so it is sent as a literal) below a value, equal ones by half; null for null.

    Both counts are found by halving steps, not by reading the whole reference for each row.
    """
    n = max(1, len(reference or []))
    refs = F.array(*[F.lit(float(x)) for x in reference or [0.0]])
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    count = lambda below: F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(F.get(refs, at + step - 1)), at + step).otherwise(at))
    return F.when(value.isNotNull(), (count(lambda r: r < value) + count(lambda r: r <= value)) / (2.0 * n))


#: Values and reference are compared at so many places: equal ones that differ by the last bits only still are.
PLACES = 9


def range_midranks(counts: DataFrame) -> DataFrame:
    """grp, v, midrank (and hot, where there) from different values with their numbers in the reference (grp, v, n).

    Values are cut into ranges, summed within each range, and each range begins at the sum of those before it (one
    number for each range and group), so neither a task nor the driver holds a whole group.
    """
    ranged = cut(counts.repartitionByRange("grp", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("grp", "part").agg(F.sum("n").alias("m"))
    every = Window.partitionBy("grp")
    starts = sums.select("grp", "part", (F.sum("m").over(every.orderBy("part")) - F.col("m")).alias("start"), F.sum("m").over(every).alias("total"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("grp", "part").orderBy("v"))
    step = ranged.join(F.broadcast(starts), ["grp", "part"])  # at most ranges times groups rows
    kept = [x for x in ("hot",) if x in counts.columns]
    return step.select("grp", "v", *kept, F.when(F.col("total") > 0, (2 * upto - F.col("n")) / (2.0 * F.col("total"))).otherwise(midrank(F.col("v"), None)).alias("midrank"))


def midranks(found: DataFrame, names: list[str], cutoff: str) -> DataFrame:
    """grp, v and midrank of every different value that scored days hold in ``names``, against all scored days up to a cutoff, and whether it is hot.

    Without any day up to the cutoff the reference is one zero.
    """
    return _midranks(_different(found, names, cutoff))


def _different(found: DataFrame, names: list[str], cutoff: str) -> DataFrame:
    """Every different value of scored days in ``names`` (written: grp, raw, v: rounded), how many hold it, and how many of these up to a cutoff (n).

    Values are counted as they are and rounded after that, so a value that many days hold is rounded once.
    """
    known = (F.col("acq_date") <= F.lit(cutoff).cast("date")).cast("long")
    long = found.where("scored").select(known.alias("_n"), F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("raw")) for g in names])).alias("p")).select("_n", "p.*")
    counts = long.where("raw is not null").groupBy("grp", "raw").agg(F.sum("_n").alias("n"), F.count("*").alias("held"))
    return cut(counts.withColumn("v", F.round("raw", PLACES) + 0.0))


def _midranks(different: DataFrame) -> DataFrame:
    """``midranks`` of counted values."""
    counts = different.groupBy("grp", "v").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    totals = different.groupBy("grp").agg((F.sum("held") / HOT).alias("_most"))
    return range_midranks(counts.join(F.broadcast(totals), "grp").withColumn("hot", F.col("held") > F.col("_most")).drop("held", "_most"))  # a row for each name


#: A value that more than one row in so many holds is hot: there are at most so many hot values of a column.
HOT = 200
#: Different values of a column that go to every executor whole, where Spark may broadcast at all.
LOOKUP = 200_000


def _ranks(found: DataFrame, names: list[str], cutoff: str) -> DataFrame:
    """The midrank of every value as it is in ``found`` (written: grp, raw, midrank, hot)."""
    different = _different(found, names, cutoff)
    return cut(different.select("grp", "raw", "v").join(_midranks(different), ["grp", "v"]).select("grp", "raw", "midrank", "hot"))


def _ranked(found: DataFrame, names: dict[str, str], cutoff: str) -> DataFrame:
    """``found`` with the midrank of each named column of scored days, under the name it is given."""
    ranks = _ranks(found, list(names), cutoff)
    return _given(found, ranks, names, _few(ranks))


def _few(ranks: DataFrame) -> set[str]:
    """The columns whose different values are few enough to go to every executor; none where broadcasts are off."""
    if not ranks.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > 0:
        return set()
    return {r.grp for r in ranks.groupBy("grp").count().collect() if r["count"] <= LOOKUP}  # a row for each name


def _given(found: DataFrame, ranks: DataFrame, names: dict[str, str], few: set[str]) -> DataFrame:
    """``found`` with the midranks of a written table (grp, raw, midrank, hot).

    A column of few different values looks them up where its rows are. Of others, most days of most sites hold the
    same few values (zero above all): those go out by broadcast, at most ``HOT`` of them; only rows of other values
    are dealt by their value, and rows without one are spread.
    """
    out = found
    for g, name in names.items():
        own = ranks.where(F.col("grp") == g).select(F.col("raw").alias("_v"), F.col("midrank").alias("_rank"), "hot")
        out = out.withColumn("_v", F.when(F.col("scored"), F.col(g)))
        if g in few:
            out = out.join(F.broadcast(own.drop("hot")), "_v", "left").withColumn(name, F.col("_rank")).drop("_v", "_rank")  # at most LOOKUP rows
            continue
        out = out.join(F.broadcast(own.where("hot").select("_v", F.col("_rank").alias("_first"))), "_v", "left")  # at most HOT rows
        cold = F.col("_first").isNull() & F.col("_v").isNotNull()
        out = out.withColumn("_key", F.when(cold, F.xxhash64(F.col("_v") + 0.0)).otherwise(F.xxhash64("site_id", "acq_date"))).withColumn("_v", F.when(cold, F.col("_v")))
        out = out.join(own.where("not hot").select("_v", "_rank", F.xxhash64(F.col("_v") + 0.0).alias("_key")), ["_key", "_v"], "left")
        out = out.withColumn(name, F.coalesce("_first", "_rank")).drop("_v", "_key", "_first", "_rank")
    return out


def _highest_two(found: DataFrame, few: set[str]) -> DataFrame:
    """``found`` with the mean of the two highest midranks of scored days; written where a join has dealt its rows, read twice otherwise."""
    a, b, x, y = (F.col(f"{g}_pct") for g in c.GROUPS)
    second = F.greatest(F.least(a, b), F.least(x, y), F.least(F.greatest(a, b), F.greatest(x, y)))
    out = found.withColumn("c_raw", F.when(F.col("scored"), (F.greatest(a, b, x, y) + second) / 2))
    return out if set(c.GROUPS) <= few else cut(out)


def calibrated(found: DataFrame, cutoff: str) -> DataFrame:
    """``found`` with the midrank of each group and of the mean of the two highest, against every scored day up to the cutoff."""
    found = cut(found)
    ranks = _ranks(found, list(c.GROUPS), cutoff)
    few = _few(ranks)
    out = _highest_two(_given(found, ranks, {g: f"{g}_pct" for g in c.GROUPS}, few), few)
    return _ranked(out, {"c_raw": "c_score"}, cutoff)


def levels(found: DataFrame) -> DataFrame:
    """Severity by the unrounded score, and the groups that drive it."""
    s = F.col("c_score")
    level = F.when(~F.col("scored"), "INSUFFICIENT_HISTORY").when(s >= c.CRITICAL, "CRITICAL").when(s >= c.ANOMALOUS, "ANOMALOUS").when(s >= c.ELEVATED, "ELEVATED").otherwise("NORMAL")
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"{g}_pct")).alias("p"), F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(c.GROUPS)]))
    high = F.filter(ranked, lambda r: r["p"] <= -c.ELEVATED)
    drivers = F.when(F.col("scored"), F.array_join(F.transform(F.when(F.size(high) > 0, high).otherwise(F.slice(ranked, 1, 1)), lambda r: r["g"]), ","))
    return found.withColumn("level", level).withColumn("drivers", drivers)


def anomaly_score(daily: DataFrame, cutoff: str) -> DataFrame:
    """The anomaly result of every site-day, calibrated on days up to the cutoff."""
    out = levels(calibrated(signals(daily), cutoff))
    numbers = [*c.GROUPS, *[f"{g}_pct" for g in c.GROUPS], "ewma", "cusum", "c_raw", "c_score"]
    return out.select("site_id", "acq_date", "history_days", "history_span", *[F.round(n, 6).alias(n) for n in numbers], "level", "drivers")


# -- a frozen reference, for days that come later ---------------------------------------------------------------------
def reference(found: DataFrame, cutoff: str) -> DataFrame:
    """What ``against`` ranks by: of each group and of the mean of the two highest, every different value of scored days up to a cutoff, with the numbers below it and up to it (grp, part, v, low, high, total)."""
    rows = cut(as_of(found, cutoff).where("scored"))
    raw = calibrated(rows, cutoff)
    names = [*c.GROUPS, "c_raw"]
    none = found.sparkSession.createDataFrame([(g, 0.0, 0) for g in names], "grp string, v double, n long")  # one zero where there is no day
    counts = _different(raw, names, cutoff).select("grp", "v", F.col("held").alias("n")).unionByName(none).groupBy("grp", "v").agg(F.sum("n").alias("n"))
    ranged = cut(counts.repartitionByRange("grp", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("grp", "part").agg(F.sum("n").alias("m"))
    every = Window.partitionBy("grp")
    starts = sums.select("grp", "part", (F.sum("m").over(every.orderBy("part")) - F.col("m")).alias("start"), F.sum("m").over(every).alias("total"))
    high = F.col("start") + F.sum("n").over(Window.partitionBy("grp", "part").orderBy("v"))
    one = F.when(F.col("total") == 0, 1).otherwise(0)
    return ranged.join(F.broadcast(starts), ["grp", "part"]).select("grp", "part", "v", (high - F.col("n")).alias("low"), (high + one).alias("high"), (F.col("total") + one).alias("total"))  # at most ranges times groups rows


def against(found: DataFrame, frozen: DataFrame) -> DataFrame:
    """``found`` with the midranks and the score of scored days against a frozen reference (as ``calibrated`` gives against the days themselves).

    A value takes the numbers of the last reference value up to it, found within its range; a range begins with the
    number of all values before it.
    """
    bounds = frozen.groupBy("grp", "part").agg(F.min("v").alias("least"), F.max("total").alias("of"))
    ranges = F.broadcast(bounds.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("least", "part", "of"))).alias("_ranges")))  # a number for each range

    def ranks_of(df: DataFrame, names: list[str]) -> DataFrame:
        long = df.where("scored").select(F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("v")) for g in names])).alias("p")).select("p.*")
        values = cut(long.where("v is not null").groupBy("grp", "v").agg(F.count("*").alias("held")))  # each is looked up once, however many days hold it
        most = values.groupBy("grp").agg((F.sum("held") / HOT).alias("_most"))
        values = values.withColumn("raw", F.col("v")).withColumn("v", F.round("raw", PLACES) + 0.0)
        upto = F.filter("_ranges", lambda r: r["least"] <= F.col("v"))
        # values before all of the reference have no range: nothing is below them
        asked = values.join(F.broadcast(most), "grp").join(ranges, "grp").withColumn("b", F.get(upto, F.size(upto) - 1))
        asked = asked.select("grp", "v", "b.part", "b.of", F.lit(None).cast("struct<v:double,low:bigint,high:bigint>").alias("r"), (F.col("held") > F.col("_most")).alias("hot"), "raw")
        known = frozen.select("grp", "v", "part", F.col("total").alias("of"), F.struct("v", "low", "high").alias("r"), F.lit(None).cast("boolean").alias("hot"), F.lit(None).cast("double").alias("raw"))
        wanted = asked.select("grp", "part").distinct()
        line = Window.partitionBy("grp", "part").orderBy("v", F.col("hot").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = known.join(wanted, ["grp", "part"], "left_semi").unionByName(asked).withColumn("last", F.last("r", ignorenulls=True).over(line)).where("hot is not null")
        rank = F.when(F.col("last.v") == F.col("v"), (F.col("last.low") + F.col("last.high")) / (2.0 * F.col("of"))).when(F.col("last").isNotNull(), F.col("last.high") / F.col("of").cast("double")).otherwise(0.0)
        return cut(met.select("grp", "raw", "hot", rank.alias("midrank")))

    ranks = ranks_of(found, list(c.GROUPS))
    few = _few(ranks)
    out = _highest_two(_given(found, ranks, {g: f"{g}_pct" for g in c.GROUPS}, few), few)
    ranks = ranks_of(out, ["c_raw"])
    return _given(out, ranks, {"c_raw": "c_score"}, _few(ranks))


# -- going on from a day ----------------------------------------------------------------------------------------------
class Running:
    """What the days of a site so far leave for the next one: four sorted histories, both recursions."""

    def __init__(self, held: dict[str, list[float]], first: int | None, last: int | None, n: int, ewma: float, cusum: float) -> None:
        self.held, self.first, self.last, self.n, self.ewma, self.cusum = held, first, last, n, ewma, cusum

    def step(self, day: int, detections: int, mean: float, top: float) -> dict:
        """A day's results, as ``site_history`` gives them."""
        n, gap = self.n, None if self.last is None else float(day - self.last)
        gaps = max(n - 1, 0)
        span = day - self.first if n else None
        out: dict = {"history_days": n, "history_span": span, "gaps": gaps, "gap": gap}
        values = {"max_frp": top, "mean_frp": mean, "density": log(1.0 + detections), "gap": gap}
        z = {}
        for name, held in self.held.items():
            m, s = None, c.SCALE_LEAST
            if held:
                m, mad, iqr = _of_sorted(held)
                mad *= c.MAD_SCALE
                s = max(iqr / c.IQR_SCALE if mad < c.SCALE_FLOOR else mad, c.SCALE_SHARE * abs(m), c.SCALE_LEAST)
            out[f"{name}_m"], out[f"{name}_s"] = m, s
            v = values[name]
            z[name] = None if m is None or v is None else min(max(((m - v) if name == "gap" else (v - m)) / s, 0.0), c.Z_CAP)
        scored = n >= c.MIN_HISTORY and span is not None and span >= c.MIN_SPAN_DAYS
        out |= {"scored": scored, "intensity": None, "density": None, "recurrence_burst": None, "ewma": None, "cusum": None}
        if scored:
            out["intensity"], out["density"], out["recurrence_burst"] = max(z["max_frp"], z["mean_frp"]), z["density"], z["gap"] if gaps >= c.MIN_GAPS else 0.0
            if gap is not None and gap > c.RESET_GAP_DAYS:
                self.ewma = self.cusum = 0.0
            x = max(out["intensity"], out["density"])
            self.ewma = c.EWMA_ALPHA * x + (1 - c.EWMA_ALPHA) * self.ewma
            self.cusum = max(0.0, min(self.cusum + x - c.CUSUM_K, c.CUSUM_CAP))
            out["ewma"], out["cusum"] = self.ewma, self.cusum
        for name, v in values.items():
            if v is not None:
                insort(self.held[name], v)
        self.first, self.last, self.n = day if self.first is None else self.first, day, n + 1
        return out


STATE = "site_id string, first_day int, last_day int, n long, last_ewma double, last_cusum double, max_frp_held array<double>, mean_frp_held array<double>, density_held array<double>, gap_held array<double>"
_HELD = ("max_frp", "mean_frp", "density", "gap")


def going_on(daily: DataFrame, since: DataFrame, states: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of the days from ``since`` (site_id, day: the first that changed) on, and every such site's new state.

    ``states`` (as returned; empty at first) lets a site whose change comes after all its days go on without reading
    them. For a late day the days before it are only sorted, and the recursions go on from the last scored of them
    in ``scores`` (site_id, acq_date, ewma, cusum). The result equals a replay of all days; its cost grows with the
    days from the change on. A state holds a site's four histories, so it grows with the site's days.
    """
    day = F.datediff("acq_date", F.lit("1970-01-01").cast("date"))
    start = since.groupBy("site_id").agg(F.min(F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("since"))
    begun = start.join(states, "site_id", "left").withColumn("after", F.coalesce(F.col("last_day") < F.col("since"), F.lit(False)))
    last = scores.where("ewma is not null").join(begun.where("not after").select("site_id", "since"), "site_id").where(day < F.col("since"))
    last = last.groupBy("site_id").agg(F.max_by(F.struct("ewma", "cusum"), "acq_date").alias("_l"))
    begun = cut(begun.join(last, "site_id", "left"))
    known = lambda x: F.when(F.col("after"), F.col(x))
    none = F.array().cast("array<double>")  # of a day; Spark's Arrow writer goes back over all nulls before a null list
    head = begun.select(
        "site_id", F.lit(None).cast("int").alias("day"), F.lit(None).cast("long").alias("detections"), F.lit(None).cast("double").alias("mean_frp"), F.lit(None).cast("double").alias("max_frp"), "since",
        *[known(x).alias(x) for x in ("first_day", "last_day", "n")], *[F.coalesce(F.when(F.col("after"), F.col(f"last_{x}")).otherwise(F.col(f"_l.{x}")), F.lit(0.0)).alias(f"last_{x}") for x in ("ewma", "cusum")], *[F.coalesce(known(f"{x}_held"), none).alias(f"{x}_held") for x in _HELD],
    )
    frp = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x)
    days = daily.where(F.col("acq_date").isNotNull()).withColumn("day", day).join(begun.select("site_id", "since", "after"), "site_id").where(~F.col("after") | (F.col("day") >= F.col("since")))
    days = days.select("site_id", "day", F.col("detections").cast("long").alias("detections"), frp("mean_frp"), frp("max_frp"), *[none.alias(f"{x}_held") for x in _HELD])
    ordered = head.unionByName(days, allowMissingColumns=True).repartition("site_id").sortWithinPartitions("site_id", F.asc_nulls_first("day"))
    numbers = _NUMBERS[8:]
    schema = f"{_DAY}, {', '.join(f'{n} double' for n in numbers)}, {STATE.split(', ', 1)[1]}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = [f.split()[0] for f in _DAY.split(", ")] + numbers
    state_names = [f.split()[0] for f in STATE.split(", ")][1:]

    def run(batches):
        for table in _whole_sites(batches):
            results, states = _gone_on(table)
            for part in (results, states):
                size = len(part["site_id"])
                yield pa.RecordBatch.from_arrays([part[f.name] if f.name in part else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    # a state's row has no date
    made = cut(ordered.mapInArrow(run, schema))
    results = made.where("acq_date is not null").select(*names).withColumn("change", F.greatest("ewma", "cusum")).drop("gaps")
    return results, made.where("acq_date is null").select("site_id", *state_names)


def _gone_on(table: pa.Table) -> tuple[dict[str, pa.Array], dict[str, pa.Array]]:
    """Results of the new days, and the new state, of all sites of a table: of each a row with its state so far, then its days in order.

    Sites with as many earlier and new days are worked out together, long ones day by day.
    """
    sites = table.column("site_id").combine_chunks()
    at = np.array(_starts(sites))
    size = np.diff(np.append(at, len(sites))) - 1  # days
    heads = table.take(pa.array(at))
    told = lambda x: heads.column(x).combine_chunks()
    known = told("n").is_valid().to_numpy(zero_copy_only=False)
    since, n, first, last = (told(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("since", "n", "first_day", "last_day"))
    e, total = told("last_ewma").to_numpy().copy(), told("last_cusum").to_numpy().copy()
    day, detections = (table.column(x).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("day", "detections"))
    mean, top = (table.column(x).combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False) for x in ("mean_frp", "max_frp"))

    of = np.repeat(np.arange(len(at)), size + 1)
    fresh = day >= since[of]
    fresh[at] = False
    new = np.bincount(of[fresh], minlength=len(at))
    held = np.where(known, n, size - new)
    some = size > 0
    first[some & ~known] = day[at[some & ~known] + 1]
    gap = np.concatenate([[np.nan], np.diff(day).astype(float)])
    gap[at[some] + 1] = np.where(known[some] & (n[some] > 0), day[at[some] + 1] - last[some], np.nan)

    # a site's earlier values stand in its state's lists or in its rows, the new ones in its rows
    lists = {x: told(f"{x}_held") for x in _HELD}
    stored = {x: lists[x].flatten().to_numpy(zero_copy_only=False) for x in _HELD}
    rows = {"max_frp": top, "mean_frp": mean, "density": _densities(detections), "gap": gap}
    everything = {x: np.concatenate([stored[x], rows[x]]) for x in _HELD}
    begins = {x: np.where(known, np.concatenate([[0], np.cumsum(lists[x].value_lengths().to_numpy())[:-1]]), len(stored[x]) + at + (2 if x == "gap" else 1)) for x in _HELD}
    fresh_at = at + 1 + size - new  # the first new row
    length = {x: np.maximum(held + new - 1, 0) if x == "gap" else held + new for x in _HELD}
    ends = {x: np.cumsum(length[x]) for x in _HELD}
    kept = {x: np.empty(int(length[x].sum())) for x in _HELD}
    out_at = np.cumsum(new) - new
    columns: dict[str, np.ndarray] = {}

    def put(where: np.ndarray, found: dict[str, np.ndarray]) -> None:
        for name, v in found.items():
            if name not in columns:
                columns[name] = np.empty(int(new.sum()), v.dtype)
            columns[name][where] = v

    def all_values(x: str, chosen: np.ndarray, p: int, j: int) -> np.ndarray:
        """Earlier values, then new ones, of sites with ``p`` and ``j`` days; the first day of all has no gap."""
        before, skipped = (max(p - 1, 0), 1 if p == 0 and j else 0) if x == "gap" else (p, 0)
        old = everything[x][begins[x][chosen, None] + np.arange(before)]
        return np.concatenate([old, everything[x][len(stored[x]) + fresh_at[chosen, None] + np.arange(skipped, j)]], axis=1)

    which, group = np.unique(np.stack([held, new], 1), axis=0, return_inverse=True)
    order = np.argsort(group, kind="stable")
    for (p, j), mates in zip(which.tolist(), np.split(order, np.cumsum(np.bincount(group))[:-1])):
        step = max(1, _AT_ONCE // ((p + j + 1) * (j + 1))) if p + j <= MATRIX else 1
        for i in range(0, len(mates), step):
            chosen = mates[i : i + step]
            values = {x: all_values(x, chosen, p, j) for x in _HELD}
            at_rows = fresh_at[chosen, None] + np.arange(j)
            if j and p + j <= MATRIX:
                found, e[chosen], total[chosen] = _going_on_each(day[at_rows], gap[at_rows], values, p, first[chosen], e[chosen], total[chosen])
                put(out_at[chosen, None] + np.arange(j), found)
            elif j:
                one = int(chosen[0])
                running = Running({x: np.sort(values[x][0, : max(p - 1, 0) if x == "gap" else p]).tolist() for x in _HELD}, int(first[one]) if p else None, int(day[fresh_at[one]] - gap[fresh_at[one]]) if p else None, p, float(e[one]), float(total[one]))
                found = [running.step(int(day[r]), int(detections[r]), float(mean[r]), float(top[r])) for r in at_rows[0].tolist()]
                put(out_at[one] + np.arange(j), {x: np.array([{None: -1 if x == "history_span" else np.nan}.get(f[x], f[x]) for f in found]) for x in found[0]})
                e[one], total[one] = running.ewma, running.cusum
            for x in _HELD:
                width = values[x].shape[1]
                kept[x][(ends[x] - length[x])[chosen, None] + np.arange(width)] = np.sort(values[x], axis=1)
    number = held + new
    last = np.where(some, day[at + size], last)
    whole = lambda v, t: pa.array(v.astype(t), mask=number == 0)
    offsets = {x: pa.array(np.concatenate([[0], ends[x]]).astype(np.int32)) for x in _HELD}
    states = {"site_id": sites.take(pa.array(at)).cast(pa.string()), "first_day": whole(first, np.int32), "last_day": whole(last, np.int32), "n": pa.array(number), "last_ewma": pa.array(e), "last_cusum": pa.array(total)} | {f"{x}_held": pa.ListArray.from_arrays(offsets[x], pa.array(kept[x])) for x in _HELD}
    if not new.any():
        return {"site_id": pa.array([], pa.string())}, states
    numbers = _NUMBERS[8:]
    arrays = _day_arrays(sites.filter(pa.array(fresh)), day[fresh], columns, numbers)
    return dict(zip([*[f.split()[0] for f in _DAY.split(", ")], *numbers], arrays)), states


def latest_status(scored: DataFrame, cutoff: str) -> DataFrame:
    """Each site's last result up to a cutoff; one older than 30 days is no recent event, without a score."""
    last = as_of(scored, cutoff).groupBy("site_id").agg(F.max_by(F.struct("acq_date", "level", "c_score"), "acq_date").alias("l")).select("site_id", "l.*")
    old = F.datediff(F.lit(cutoff).cast("date"), "acq_date") > c.RECENT_DAYS
    return last.select("site_id", F.col("acq_date").alias("c_date"), F.when(old, "NO_RECENT_EVENT").otherwise(F.col("level")).alias("c_status"), F.when(~old, F.col("c_score")).alias("c_score"))


def replay_each(daily: DataFrame, sites: list[str] | None, cutoff: str) -> DataFrame:
    """The chronological replay for some or all sites, up to a cutoff: signals and recursions of every day."""
    kept = as_of(daily, cutoff)
    return signals(kept if sites is None else kept.where(F.col("site_id").isin(sites)))
