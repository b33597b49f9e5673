"""The engine's queries over the driver's tables, each beside the DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.config import FEATURES
from emberline.functions import geo, normalize
from emberline.operators import anomaly, audit, daily, decide, features, identity, resolver, review, serving, spatial, temporal, upsert
from emberline.operators.common import cut, first_by, shared_folder
from emberline.plans import windows
from emberline.sources import area, bootstrap, tiles
from emberline.sources.adapters import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUTOFF = "2001-06-30"
CALIBRATION_END = "1999-12-31"
BOX = (70.0, 8.0, 90.0, 30.0)

def register(*views: str, sql: str | None = None):
    """Adds a query under its function's name; ``sql`` follows the named views and may open more tables itself."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(*views) + ("," if sql.lstrip().startswith("--with") else "") + sql.replace("--with", "")
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# -- SQL that several counterparts share ---------------------------------------------------------------------
DAILY = "daily as (select site_id, acq_date, count(*) as detections, avg(coalesce(frp,0.0)) as mean_frp, max(coalesce(frp,0.0)) as max_frp from detections group by site_id, acq_date)"
TIMELINE = f"""days as (select distinct site_id, acq_date from detections where acq_date <= date '{CUTOFF}'),
gapped as (select *, acq_date - lag(acq_date) over (partition by site_id order by acq_date) as gap, date '{CUTOFF}' - acq_date as ago from days),
timeline as (select site_id, min(acq_date) as first_date, max(acq_date) as last_date, date '{CUTOFF}' - min(acq_date) as days_since_first, date '{CUTOFF}' - max(acq_date) as days_since_last,
 max(acq_date) - min(acq_date) + 1 as lifetime_days, count(*) as active_days, count(*) filter (ago < 30) as active_days_30, count(*) filter (ago < 90) as active_days_90, count(*) filter (ago < 180) as active_days_180, count(*) filter (ago < 365) as active_days_365,
 count(distinct date_trunc('month', acq_date)) filter (ago < 180) as active_months_180, max_by(gap, acq_date) filter (gap >= 90) as last_long_gap_days, date '{CUTOFF}' - max(acq_date) filter (gap >= 90) as reactivation_age_days from gapped group by site_id)"""
RULES = """case when days_since_last<=30 and days_since_first>30 and last_long_gap_days>=90 and reactivation_age_days<=30 then 'REACTIVATED' when days_since_last<=30 and days_since_first<=30 then 'NEW'
 when days_since_last<=30 and lifetime_days>=90 and active_months_180>=3 and active_days_180>=6 then 'PERSISTENT' when days_since_last>90 then 'DORMANT' else 'INTERMITTENT' end as state"""
SURE = """case state when 'REACTIVATED' then case when active_days_30=1 then 'LOW' when active_days_30>=3 and last_long_gap_days>=180 then 'HIGH' else 'MEDIUM' end when 'NEW' then case when active_days_30=1 then 'LOW' when active_days_30>=3 then 'HIGH' else 'MEDIUM' end
 when 'PERSISTENT' then case when active_months_180>=4 and active_days_180>=12 then 'HIGH' else 'MEDIUM' end when 'DORMANT' then case when days_since_last>=180 then 'HIGH' else 'MEDIUM' end else 'MEDIUM' end as confidence"""
STATES = f"{TIMELINE}, stated as (select *, {RULES} from timeline), states as (select *, {SURE} from stated)"


def _robust(x: str) -> str:
    """Centre and scale of a history list, as select items."""
    mad = f"1.4826*list_aggregate(list_transform(h_{x}, lambda v: abs(v-{x}_m)),'median')"
    return f"greatest(case when {mad}<1e-4 then ({x}_q3-{x}_q1)/1.349 else {mad} end, 0.05*abs({x}_m), 1e-3) as {x}_s"


_KINDS = ("max_frp", "mean_frp", "density", "gap")
BASELINE = f"""{DAILY}, g0 as (select site_id, acq_date, max_frp, mean_frp, ln(1+cast(detections as double)) as density, cast(acq_date - lag(acq_date) over (partition by site_id order by acq_date) as double) as gap from daily),
g1 as (select site_id, acq_date, max_frp, mean_frp, density, gap, count(*) over b as history_days, acq_date - min(acq_date) over b as history_span, count(gap) over b as gaps,
 {', '.join(f"quantile_cont({x},0.5) over b as {x}_m, quantile_cont({x},0.25) over b as {x}_q1, quantile_cont({x},0.75) over b as {x}_q3, list({x}) filter ({x} is not null) over b as h_{x}" for x in _KINDS)}
 from g0 window b as (partition by site_id order by acq_date rows between unbounded preceding and 1 preceding)),
base as (select *, {', '.join(map(_robust, _KINDS))} from g1)"""
SIGNALS = f"""{BASELINE}, sig as (select site_id, acq_date, history_days, history_span, gap, history_days>=5 and coalesce(history_span>=30,false) as scored,
 greatest(0.0,least(greatest((max_frp-max_frp_m)/max_frp_s,(mean_frp-mean_frp_m)/mean_frp_s),20.0)) as i0, greatest(0.0,least((density-density_m)/density_s,20.0)) as d0, case when gaps>=3 then greatest(0.0,least((gap_m-gap)/gap_s,20.0)) else 0.0 end as r0 from base),
signals as (select site_id, acq_date, history_days, history_span, gap, scored, case when scored then i0 end as intensity, case when scored then d0 end as density, case when scored then r0 end as recurrence_burst from sig)"""
CHANGE = f"""{SIGNALS}, numbered as (select *, greatest(intensity,density) as x, coalesce(gap>30,false) as fresh, row_number() over (partition by site_id order by acq_date) as n from signals where scored),
fold as (select site_id, acq_date, n, 0.35*x as ewma, greatest(0.0,least(x-2.0,50.0)) as cusum from numbered where n=1
 union all select m.site_id, m.acq_date, m.n, 0.35*m.x+(1-0.35)*case when m.fresh then 0.0 else f.ewma end, greatest(0.0,least(case when m.fresh then 0.0 else f.cusum end+m.x-2.0,50.0)) from fold f join numbered m on m.site_id=f.site_id and m.n=f.n+1),
changed as (select s.*, f.ewma, f.cusum, greatest(f.ewma,f.cusum) as change from signals s left join fold f using (site_id, acq_date))"""
_GROUPS = ("intensity", "density", "recurrence_burst", "change")


def _ranks(name: str, value: str, table: str) -> str:
    """Midranks of every different value of scored days against all scored days of calibration."""
    return f"n_{name} as (select round({value},9) as v, count(*) filter (acq_date <= date '{CALIBRATION_END}') as n from {table} where scored group by 1), rank_{name} as (select v, (2*sum(n) over (order by v)-n)/(2.0*sum(n) over ()) as p from n_{name})"


_FIRST = "list_reverse_sort([intensity_pct,density_pct,recurrence_burst_pct,change_pct])"
SCORED = f"""{CHANGE}, {', '.join(_ranks(g, g, 'changed') for g in _GROUPS)},
pct as (select c.*, {', '.join(f'rank_{g}.p as {g}_pct' for g in _GROUPS)} from changed c {' '.join(f'left join rank_{g} on case when c.scored then round(c.{g},9) end = rank_{g}.v' for g in _GROUPS)}),
raw as (select *, case when scored then ({_FIRST}[1]+{_FIRST}[2])/2 end as c_raw from pct), {_ranks('final', 'c_raw', 'raw')},
score as (select raw.*, rank_final.p as c_score from raw left join rank_final on case when scored then round(c_raw,9) end = rank_final.v),
leveled as (select *, case when not scored then 'INSUFFICIENT_HISTORY' when c_score>=0.999 then 'CRITICAL' when c_score>=0.99 then 'ANOMALOUS' when c_score>=0.95 then 'ELEVATED' else 'NORMAL' end as level,
 list_sort([{', '.join(f"{{'p': -{g}_pct, 'i': {i}, 'g': '{g}'}}" for i, g in enumerate(_GROUPS))}]) as by_pct from score),
scored as (select *, case when scored then array_to_string(list_transform(case when by_pct[1].p <= -0.95 then list_filter(by_pct, lambda r: r.p <= -0.95) else by_pct[1:1] end, lambda r: r.g), ',') end as drivers from leveled)"""
IDENTITY = """ranked_a as (select *, row_number() over (partition by site_id order by as_of desc, inference_id desc) as rn from a_history {where}),
ident as (select site_id, p_core, p_visual, as_of, case when p_core>=0.975 then 'INDUSTRIAL_CORE_STRONG' when p_core>=0.885 then 'INDUSTRIAL_CORE_POSITIVE' when p_core>=0.405 then case when coalesce(p_visual>=0.965,false) then 'INDUSTRIAL_PRITHVI_RESCUE' else 'UNKNOWN' end else 'NONINDUSTRIAL' end as decision from ranked_a where rn=1),
a_now as (select *, case when decision like 'INDUSTRIAL@_%' escape '@' then 'INDUSTRIAL' else decision end as class from ident)"""
DECIDE = {
    "alert_type": [("ind and level='CRITICAL'", "CRITICAL_INDUSTRIAL_ANOMALY", "CRITICAL", "true"), ("ind and state='REACTIVATED' and level in ('ELEVATED','ANOMALOUS')", "INDUSTRIAL_REACTIVATION_ANOMALY", "HIGH", "true"), ("ind and level='ANOMALOUS'", "HIGH_INDUSTRIAL_ANOMALY", "HIGH", "true"), ("unk and level='CRITICAL'", "UNKNOWN_CRITICAL_REVIEW", "HIGH", "true"), ("unk and level in ('ELEVATED','ANOMALOUS')", "UNKNOWN_ANOMALY_REVIEW", "MEDIUM", "true"), ("ind and level='ELEVATED'", "INDUSTRIAL_ELEVATION", "MEDIUM", "false"), ("state='NEW' and (unk or ind) and level='INSUFFICIENT_HISTORY'", "NEW_SOURCE_REVIEW", "MEDIUM", "true"), ("ind and level='NORMAL'", "NORMAL_INDUSTRIAL_OPERATION", "INFO", "false"), ("decision='NONINDUSTRIAL'", "NONINDUSTRIAL_ACTIVITY", "LOW", "false")],
}


def _case(part: int, last: str) -> str:
    quote = "" if part == 3 else "'"
    return "case " + " ".join(f"when {r[0]} then {quote}{r[part]}{quote}" for r in DECIDE["alert_type"]) + f" else {quote}{last}{quote} end"


DECIDED = "select *, decision like 'INDUSTRIAL@_%' escape '@' as ind, decision='UNKNOWN' as unk from "
OPEN_ALERT = "top_alert as (select * from (select *, row_number() over (partition by site_id order by updated_at desc, alert_id desc) as rn from alerts where status='ACTIVE') where rn=1)"
HAVERSINE = "2*6371000.0*asin(sqrt(least(1.0,pow(sin(radians({b}.latitude-{a}.latitude)/2),2)+cos(radians({a}.latitude))*cos(radians({b}.latitude))*pow(sin(radians({b}.longitude-{a}.longitude)/2),2))))"


# -- site-days and normalisation --------------------------------------------------------------------------------
@register("detections", sql=f"--with {DAILY} select site_id, acq_date, detections, round(mean_frp,6) as mean_frp, max_frp from daily")
def daily_activity(spark, sf_dir):
    return daily.daily_activity(view(spark, sf_dir, "detections")).select("site_id", "acq_date", "detections", *r6("mean_frp"), "max_frp")


@register("detections", sql="--with o as (select site_id, acq_date, count(*) as n, avg(frp) as m, max(frp) as x from detections where source_sensor='VIIRS_NOAA20_SP' group by all), w as (select site_id, acq_date, count(*) as n, avg(frp) as m, max(frp) as x from detections where source_sensor<>'VIIRS_NOAA20_SP' group by all) select site_id, acq_date, coalesce(o.n,0)+coalesce(w.n,0) as detections, round((coalesce(o.n*o.m,0)+coalesce(w.n*w.m,0))/(coalesce(o.n,0)+coalesce(w.n,0)),6) as mean_frp, greatest(o.x,w.x) as max_frp from o full join w using (site_id, acq_date)")
def daily_activity_merge(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    old, new = (daily.daily_activity(d.where(test)) for test in ("source_sensor = 'VIIRS_NOAA20_SP'", "source_sensor <> 'VIIRS_NOAA20_SP'"))
    return daily.merge_daily(old, new).select("site_id", "acq_date", "detections", *r6("mean_frp"), "max_frp")


_NORMAL = """--with t as (select record_id, try_cast(nullif(latitude,'') as double) as latitude, try_cast(longitude as double) as longitude, try_cast(acq_date as date) as acq_date, regexp_replace(trim(coalesce(acq_time,'0000')),'^([0-9]+)\\.0$','\\1') as t0, coalesce(try_cast(frp as double),0.0) as frp, upper(trim(coalesce(daynight,'D'))) as daynight, lower(trim(coalesce(confidence,'nominal'))) as confidence from raw_records),
n as (select record_id, latitude, longitude, acq_date, case when length(t0)>=4 then t0 else lpad(t0,4,'0') end as acq_time, frp, daynight, confidence from t),
norm as (select *, case when latitude is null or not latitude between -90 and 90 then 'latitude' when longitude is null or not longitude between -180 and 180 then 'longitude' when acq_date is null then 'acq_date' when not regexp_matches(acq_time,'^([01][0-9]|2[0-3])[0-5][0-9]$') then 'acq_time' when daynight not in ('D','N') then 'daynight' end as reject_reason from n)"""


@register("raw_records", sql=_NORMAL + " select record_id, round(latitude,6) as latitude, round(longitude,6) as longitude, acq_date, acq_time, frp, daynight, confidence, reject_reason from norm")
def normalize_detections(spark, sf_dir):
    return normalize.normalize(view(spark, sf_dir, "raw_records")).select("record_id", *r6("latitude", "longitude"), "acq_date", "acq_time", "frp", "daynight", "confidence", "reject_reason")


@register("raw_records", sql=_NORMAL + " select coalesce(reject_reason,'ACCEPTED') as reason, count(*) as n_records from norm group by 1")
def rejected_records(spark, sf_dir):
    return normalize.normalize(view(spark, sf_dir, "raw_records")).groupBy(F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("n_records"))


@register("detections", sql=" select sha256(source_sensor||'_'||satellite||'_'||printf('%.4f',latitude)||'_'||printf('%.4f',longitude)||'_'||cast(acq_date as varchar)||'_'||acq_time) as detection_id, count(*) as copies from detections group by 1")
def detection_ids(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    made = normalize.detection_id(*[F.col(c) for c in ("source_sensor", "satellite", "latitude", "longitude", "acq_date", "acq_time")])
    return d.groupBy(made.alias("detection_id")).agg(F.count("*").alias("copies"))


# -- features -----------------------------------------------------------------------------------------------------
_THERMAL = "thermal as (select site_id, count(*) as detections, avg(frp) as frp_mean, max(frp) as frp_max, stddev_samp(frp) as frp_std, avg(case when daynight='N' then 1.0 else 0.0 end) as night_ratio, quantile_cont(frp,0.1) as frp_p10, quantile_cont(frp,0.25) as frp_p25, quantile_cont(frp,0.5) as frp_median, quantile_cont(frp,0.75) as frp_p75, quantile_cont(frp,0.9) as frp_p90 from detections group by site_id)"
_THERMAL_NAMES = ("frp_mean", "frp_max", "frp_std", "night_ratio", "frp_p10", "frp_p25", "frp_median", "frp_p75", "frp_p90", "frp_iqr", "frp_cv")


@register("detections", sql=f"--with {_THERMAL} select site_id, detections, {', '.join(f'round({n},6) as {n}' for n in _THERMAL_NAMES[:9])}, round(frp_p75-frp_p25,6) as frp_iqr, round(frp_std/greatest(frp_mean,1e-6),6) as frp_cv from thermal")
def thermal_features(spark, sf_dir):
    return features.thermal(view(spark, sf_dir, "detections")).select("site_id", "detections", *r6(*_THERMAL_NAMES))


@register("detections", sql="--with d as (select site_id, acq_date, count(*) as n from detections group by all), g as (select *, acq_date - lag(acq_date) over (partition by site_id order by acq_date) as gap, max(acq_date) over (partition by site_id) as last from d) select site_id, cast(sum(n) as bigint) as detections, count(*) as active_days, min(acq_date) as first_date, max(acq_date) as last_date, count(*) filter (last-acq_date<7) as active_days_7d, count(*) filter (last-acq_date<30) as active_days_30d, count(*) filter (last-acq_date<90) as active_days_90d, count(*) filter (last-acq_date<365) as active_days_365d, round(avg(gap),6) as mean_gap, median(gap) as median_gap, greatest(1,max(acq_date)-min(acq_date)+1) as lifetime_days, round(sum(n)/count(*),6) as detections_per_day from g group by site_id")
def recurrence_features(spark, sf_dir):
    return features.recurrence(view(spark, sf_dir, "detections")).withColumns({c: F.round(c, 6) for c in ("mean_gap", "detections_per_day")})


@register("detections", "sites", sql="--with m as (select d.site_id, sqrt(pow(radians(d.longitude-s.longitude)*cos(radians(s.latitude))*6371008.8,2)+pow(radians(d.latitude-s.latitude)*6371008.8,2)) as x from detections d join sites s using (site_id)) select site_id, round(quantile_cont(x,0.5),4) as distance_median_m, round(quantile_cont(x,0.9),4) as distance_p90_m, round(stddev_pop(x),4) as distance_std_m from m group by site_id")
def spatial_features(spark, sf_dir):
    found = features.dispersion(view(spark, sf_dir, "detections"), view(spark, sf_dir, "sites"))
    return found.select("site_id", *[F.round(c, 4).alias(c) for c in ("distance_median_m", "distance_p90_m", "distance_std_m")])


@register("pixels", sql=" select site_id, count(*) filter (code>0) as valid_pixels, " + ", ".join(f"round(count(*) filter (code={c})/nullif(count(*) filter (code>0),0),6) as cover_{n}" for c, n in features.LAND_COVER.items()) + " from pixels group by site_id")
def landcover_fractions(spark, sf_dir):
    return features.land_cover(view(spark, sf_dir, "pixels")).select("site_id", "valid_pixels", *r6(*[f"cover_{n}" for n in features.LAND_COVER.values()]))


@register("pixels", sql=" select site_id, round(avg(case when fmask&31<>0 or fmask=255 then 1.0 else 0.0 end),6) as cloud_fraction from pixels group by site_id")
def cloud_fractions(spark, sf_dir):
    return features.cloud_fraction(view(spark, sf_dir, "pixels")).select("site_id", *r6("cloud_fraction"))


@register("sites", sql=" select site_id, case when floor(latitude/3)*3>=0 then 'N' else 'S' end||lpad(cast(cast(abs(floor(latitude/3)*3) as bigint) as varchar),2,'0')||case when floor(longitude/3)*3>=0 then 'E' else 'W' end||lpad(cast(cast(abs(floor(longitude/3)*3) as bigint) as varchar),3,'0') as tile, round(latitude-1000/111320.0,6) as south, round(latitude+1000/111320.0,6) as north, round(longitude-1000/(111320.0*cos(radians(latitude))),6) as west, round(longitude+1000/(111320.0*cos(radians(latitude))),6) as east from sites")
def worldcover_tiles(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    return view(spark, sf_dir, "sites").select("site_id", geo.tile_id(lat, lon).alias("tile"), *[F.round(c, 6).alias(n) for n, c in geo.window_bounds(lat, lon).items()])


@register("granules", sql="--with dated as (select granule, site_id, cast(make_date(cast(regexp_extract(granule,'\\.(20\\d{2}|19\\d{2})(\\d{3})T',1) as int),1,1)+cast(regexp_extract(granule,'\\.(20\\d{2}|19\\d{2})(\\d{3})T',2) as int)-1 as date) as acq_date, cloud from granules), r as (select *, coalesce(abs(acq_date - date '1998-06-15'),10000) as days_off, coalesce(cloud,101.0) as cloud_rank from dated where abs(acq_date - date '1998-06-15')<=60) select site_id, granule, days_off, cloud_rank from (select *, row_number() over (partition by site_id order by days_off, cloud_rank, granule) as rn from r) where rn=1")
def best_granules(spark, sf_dir):
    dated = view(spark, sf_dir, "granules").withColumn("acq_date", normalize.granule_date(F.col("granule")))
    return serving.best_granules(dated, None, "1998-06-15", 60).select("site_id", "granule", "days_off", "cloud_rank")


# -- temporal state ------------------------------------------------------------------------------------------------
@register("detections", sql=f"--with {TIMELINE} select * from timeline")
def timeline_stats(spark, sf_dir):
    return temporal.timeline(view(spark, sf_dir, "detections"), CUTOFF)


@register("detections", sql=f"--with {STATES} select site_id, state, confidence from states")
def temporal_state(spark, sf_dir):
    return temporal.temporal_state(view(spark, sf_dir, "detections"), CUTOFF).select("site_id", "state", "confidence")


@register("detections", sql=f"--with {STATES}, known as (select unnest(['REACTIVATED','NEW','PERSISTENT','DORMANT','INTERMITTENT']) as state) select k.state, count(s.site_id) as sites from known k left join states s using (state) group by k.state")
def temporal_state_counts(spark, sf_dir):
    return temporal.state_counts(temporal.temporal_state(view(spark, sf_dir, "detections"), CUTOFF))


_PER_DAY = f"""--with days as (select distinct site_id, acq_date from detections), gapped as (select *, acq_date - lag(acq_date) over (partition by site_id order by acq_date) as gap from days),
tl as (select r.site_id, r.acq_date, 0 as days_since_last, r.acq_date-min(d.acq_date) as days_since_first, r.acq_date-min(d.acq_date)+1 as lifetime_days, count(*) filter (r.acq_date-d.acq_date<30) as active_days_30, count(*) filter (r.acq_date-d.acq_date<180) as active_days_180, count(distinct date_trunc('month',d.acq_date)) filter (r.acq_date-d.acq_date<180) as active_months_180, max_by(d.gap,d.acq_date) filter (d.gap>=90) as last_long_gap_days, r.acq_date-max(d.acq_date) filter (d.gap>=90) as reactivation_age_days from days r join gapped d on d.site_id=r.site_id and d.acq_date<=r.acq_date group by r.site_id, r.acq_date), st as (select *, {RULES} from tl) select site_id, acq_date, state, {SURE}, active_days_30, active_days_180, active_months_180 from st"""


@register("detections", sql=_PER_DAY)
def temporal_state_per_day(spark, sf_dir):
    return temporal.state_per_day(view(spark, sf_dir, "detections"))


# -- anomaly ---------------------------------------------------------------------------------------------------------
def _daily(spark, sf_dir):
    return daily.daily_activity(view(spark, sf_dir, "detections"))


@register("detections", sql=f"--with {BASELINE} select site_id, acq_date, history_days, history_span, gaps, {', '.join(f'round({x}_m,6) as {x}_m, round({x}_s,6) as {x}_s' for x in _KINDS)} from base")
def robust_baseline(spark, sf_dir):
    return anomaly.baseline(_daily(spark, sf_dir)).select("site_id", "acq_date", "history_days", "history_span", "gaps", *r6(*[f"{x}_{p}" for x in _KINDS for p in "ms"]))


@register("detections", sql=f"--with {SIGNALS} select site_id, acq_date, history_days, scored, round(intensity,6) as intensity, round(density,6) as density, round(recurrence_burst,6) as recurrence_burst from signals")
def anomaly_signals(spark, sf_dir):
    return anomaly.signals(_daily(spark, sf_dir)).select("site_id", "acq_date", "history_days", "scored", *r6("intensity", "density", "recurrence_burst"))


@register("detections", sql=f"--with {CHANGE} select site_id, acq_date, round(ewma,6) as ewma, round(cusum,6) as cusum from changed")
def ewma_cusum(spark, sf_dir):
    return anomaly.signals(_daily(spark, sf_dir)).select("site_id", "acq_date", *r6("ewma", "cusum"))


@register("detections", sql=f"--with {SIGNALS}, {_ranks('i', 'intensity', 'signals')} select site_id, acq_date, round(p,6) as midrank from signals join rank_i on round(intensity,9)=v where scored")
def midrank_percentile(spark, sf_dir):
    found = anomaly.signals(_daily(spark, sf_dir)).where("scored").select("site_id", "acq_date", "scored", F.round("intensity", anomaly.PLACES).alias("intensity"))
    found = cut(found)
    ranks = anomaly.midranks(found, ["intensity"], CALIBRATION_END).select(F.col("v").alias("intensity"), "midrank")
    return found.join(ranks, "intensity").select("site_id", "acq_date", *r6("midrank"))


@register("detections", sql=f"--with {SCORED} select site_id, acq_date, history_days, {', '.join(f'round({g}_pct,6) as {g}_pct' for g in _GROUPS)}, round(c_raw,6) as c_raw, round(c_score,6) as c_score, level, drivers from scored")
def anomaly_score(spark, sf_dir):
    found = anomaly.anomaly_score(_daily(spark, sf_dir), CALIBRATION_END)
    return found.select("site_id", "acq_date", "history_days", *[f"{g}_pct" for g in _GROUPS], "c_raw", "c_score", "level", "drivers")


@register("detections", sql=f"--with {SCORED} select level, count(*) as site_days, count(distinct site_id) as sites from scored group by level")
def anomaly_level_counts(spark, sf_dir):
    """Site-days and sites of each anomaly level."""
    found = anomaly.anomaly_score(_daily(spark, sf_dir), CALIBRATION_END)
    return found.groupBy("level").agg(F.count("*").alias("site_days"), F.count_distinct("site_id").alias("sites"))


LATE = "1998-01-01"


@register("detections", sql=f"--with {CHANGE} select site_id, acq_date, history_days, round(ewma,6) as ewma, round(cusum,6) as cusum from changed where acq_date > date '{LATE}'")
def replay_from_a_day(spark, sf_dir):
    """Days after one, worked out from the scores before it and the histories up to it; equal to a replay of all days."""
    days = cut(_daily(spark, sf_dir))
    late = F.lit(LATE).cast("date")
    scores = anomaly.signals(days.where(F.col("acq_date") <= late)).select("site_id", "acq_date", "ewma", "cusum")
    since = days.where(F.col("acq_date") > late).select("site_id", F.col("acq_date").alias("day"))
    found, _ = anomaly.going_on(days, since, spark.createDataFrame([], anomaly.STATE), scores)
    return found.select("site_id", "acq_date", "history_days", *r6("ewma", "cusum"))


@register("detections", sql=f"--with {SCORED} select site_id, acq_date, round(c_raw,6) as c_raw, round(c_score,6) as c_score, level from scored where acq_date > date '{CALIBRATION_END}'")
def scores_by_frozen_reference(spark, sf_dir):
    """Days after calibration, scored against the reference as it was frozen, without the days it was made from."""
    found = cut(anomaly.signals(_daily(spark, sf_dir)))
    frozen = cut(anomaly.reference(found, CALIBRATION_END))
    later = found.where(F.col("acq_date") > F.lit(CALIBRATION_END).cast("date"))
    return anomaly.levels(anomaly.against(later, frozen)).select("site_id", "acq_date", *r6("c_raw", "c_score"), "level")


# -- identity and decision ----------------------------------------------------------------------------------------------
@register("a_history", sql=f"--with {IDENTITY.format(where='')} select site_id, p_core, decision, class, case when p_visual is not null then 'AVAILABLE' when p_core>=0.405 and p_core<0.885 then 'PENDING' else 'NOT_TRIGGERED' end as visual_status, p_visual is null and p_core>=0.405 and p_core<0.885 as should_queue from a_now")
def identity_guard(spark, sf_dir):
    return serving.latest_identity(view(spark, sf_dir, "a_history")).select("site_id", "p_core", "decision", "class", "visual_status", "should_queue")


@register("detections", sql=f"--with {_THERMAL}, z as (select site_id, 1/(1+exp(-(1.5*night_ratio+0.8*ln(1+detections)-0.6*coalesce(frp_std/greatest(frp_mean,1e-6),0.0)-2.0))) as p_core from thermal) select site_id, round(p_core,6) as p_core from z")
def identity_stand_in(spark, sf_dir):
    return identity.logistic_stand_in(features.thermal(view(spark, sf_dir, "detections"))).select("site_id", *r6("p_core"))


LAST_C = f"""lastc as (select site_id, max(acq_date) as c_date, arg_max(level,acq_date) as lv, arg_max(round(c_score,6),acq_date) as sc from scored where acq_date <= date '{CUTOFF}' group by site_id),
c as (select site_id, c_date, lv, case when date '{CUTOFF}'-c_date>30 then 'NO_RECENT_EVENT' else lv end as c_status, case when date '{CUTOFF}'-c_date<=30 then sc end as c_score from lastc)"""
_DECIDE_SQL = f"""--with {IDENTITY.format(where='')}, {STATES}, {SCORED}, {LAST_C},
j as ({DECIDED} (select a.site_id, c.c_date as site_day, a.decision, s.state, c.lv as level from a_now a join states s using (site_id) join c using (site_id))),
o as (select site_id, site_day, decision, state, level, {_case(1, 'NO_ALERT')} as alert_type, {_case(2, 'NONE')} as alert_level, {_case(3, 'false')} as evidence_required from j)"""


def _scored(spark, sf_dir):
    return anomaly.anomaly_score(_daily(spark, sf_dir), CALIBRATION_END)


def _identity_and_state(spark, sf_dir):
    return serving.latest_identity(view(spark, sf_dir, "a_history")), temporal.temporal_state(view(spark, sf_dir, "detections"), CUTOFF)


@register("a_history", "detections", sql=_DECIDE_SQL + " select site_id, site_day, alert_type, alert_level, evidence_required, 'A='||decision||',B='||state||',C='||level as reason_codes, sha256(site_id||'_'||cast(site_day as varchar)||'_'||alert_type||'_2026-09-04-r1') as fingerprint from o where alert_level not in ('NONE','INFO')")
def decision_alerts(spark, sf_dir):
    """Alerts of each site's last day up to the cutoff, by the anomaly level of that day."""
    a, b = _identity_and_state(spark, sf_dir)
    last = _scored(spark, sf_dir).where(F.col("acq_date") <= F.lit(CUTOFF).cast("date")).groupBy("site_id").agg(F.max("acq_date").alias("site_day"), F.max_by("level", "acq_date").alias("level"))
    joined = a.join(b, "site_id").join(last, "site_id").select("site_id", "site_day", "decision", "state", "level")
    return decide.alerts(decide.decide(joined)).select("site_id", "site_day", "alert_type", "alert_level", "evidence_required", "reason_codes", "fingerprint")


@register("a_history", "detections", sql=_DECIDE_SQL + " select alert_type, alert_level, count(*) as n from o where alert_level<>'NONE' group by 1,2")
def decision_alerts_with_info(spark, sf_dir):
    """The same with INFO kept, counted by type and level."""
    a, b = _identity_and_state(spark, sf_dir)
    last = _scored(spark, sf_dir).where(F.col("acq_date") <= F.lit(CUTOFF).cast("date")).groupBy("site_id").agg(F.max("acq_date").alias("site_day"), F.max_by("level", "acq_date").alias("level"))
    joined = a.join(b, "site_id").join(last, "site_id").select("site_id", "site_day", "decision", "state", "level")
    return decide.alerts(decide.decide(joined), keep_info=True).groupBy("alert_type", "alert_level").agg(F.count("*").alias("n"))


_RANK = "case alert_level when 'INFO' then 1 when 'LOW' then 2 when 'MEDIUM' then 3 when 'HIGH' then 4 when 'CRITICAL' then 5 else 0 end"


@register("alerts", sql=f"--with r as (select *, {_RANK} as rk from alerts), b as (select *, max(rk) over (partition by site_id, site_day order by updated_at, seq rows between unbounded preceding and 1 preceding) as before from r) select alert_id, case when before is null then 'CREATED' when rk>before then 'ESCALATED' else 'UNCHANGED' end as effect, ['NONE','INFO','LOW','MEDIUM','HIGH','CRITICAL'][before+1] as previous_level, ['NONE','INFO','LOW','MEDIUM','HIGH','CRITICAL'][greatest(rk,coalesce(before,0))+1] as level_in_force from b")
def same_day_escalation(spark, sf_dir):
    return decide.escalate(view(spark, sf_dir, "alerts")).select("alert_id", "effect", "previous_level", "level_in_force")


# -- serving ------------------------------------------------------------------------------------------------------------
_BOX = "latitude between 8.0 and 30.0 and longitude between 70.0 and 90.0"
_VIEW = f"""--with {IDENTITY.format(where='')}, {STATES}, {SCORED}, {LAST_C}, {OPEN_ALERT}, vp as (select s.site_id, round(s.latitude,5) as latitude, round(s.longitude,5) as longitude, coalesce(a.class,'UNAVAILABLE') as a_class, coalesce(b.state,'UNAVAILABLE') as b_state, coalesce(c.c_status,'UNAVAILABLE') as c_status, round(a.p_core,4) as p_core, round(c.c_score,4) as c_score, b.last_date as latest_seen, t.alert_id, t.alert_level, t.updated_at as alert_at from sites s left join a_now a using (site_id) left join states b using (site_id) left join c using (site_id) left join top_alert t using (site_id) where {_BOX})"""
_VIEW_TABLES = ("sites", "a_history", "detections", "alerts")
_VIEW_COLUMNS = "site_id latitude longitude a_class b_state c_status p_core c_score latest_seen alert_id alert_level".split()


def _viewport(spark, sf_dir, **wanted):
    a, b = _identity_and_state(spark, sf_dir)
    c = anomaly.latest_status(_scored(spark, sf_dir), CUTOFF)
    return serving.viewport(view(spark, sf_dir, "sites"), a, b, c, view(spark, sf_dir, "alerts"), BOX, **wanted)


@register(*_VIEW_TABLES, sql=_VIEW + f" select {', '.join(_VIEW_COLUMNS)}, epoch_us(alert_at) as alert_at from vp order by vp.alert_at desc nulls last, c_score desc nulls last, latest_seen desc nulls last, site_id limit 200")
def site_viewport(spark, sf_dir):
    return serving.page(_viewport(spark, sf_dir), 200).select(*_VIEW_COLUMNS, F.unix_micros("alert_at").alias("alert_at"))


@register(*_VIEW_TABLES, sql=_VIEW + " select a_class, b_state, c_status, count(*) as sites, count(alert_id) as with_alert from vp group by 1,2,3")
def viewport_counts(spark, sf_dir):
    return _viewport(spark, sf_dir).groupBy("a_class", "b_state", "c_status").agg(F.count("*").alias("sites"), F.count("alert_id").alias("with_alert"))


@register(*_VIEW_TABLES, sql=_VIEW + " select site_id, a_class, b_state, c_status, alert_level from vp where a_class='INDUSTRIAL' and c_status='NO_RECENT_EVENT' and alert_level='CRITICAL'")
def viewport_filtered(spark, sf_dir):
    """The viewport under equality filters, which are upper-cased; ALL filters nothing."""
    return _viewport(spark, sf_dir, a_class="industrial", b_state="all", c_status="no_recent_event", severity="Critical").select("site_id", "a_class", "b_state", "c_status", "alert_level")


@register(*_VIEW_TABLES, sql=_VIEW + " select count(*) filter (b_state in ('NEW','PERSISTENT')) as chosen, count(*) as every from vp")
def visible_sites(spark, sf_dir):
    """Sites that a choice of states shows, and those that an empty choice shows."""
    found = _viewport(spark, sf_dir)
    return found.agg(F.count_if(serving.selected(F.col("b_state"), ["NEW", "PERSISTENT"])).alias("chosen"), F.count_if(serving.selected(F.col("b_state"), [])).alias("every"))


@register(*_VIEW_TABLES, sql=_VIEW + " select b_state, count(*) filter (a_class='INDUSTRIAL') as INDUSTRIAL, count(*) filter (a_class='UNKNOWN') as UNKNOWN, count(*) filter (a_class='NONINDUSTRIAL') as NONINDUSTRIAL, count(*) filter (a_class='UNAVAILABLE') as UNAVAILABLE from vp group by 1")
def viewport_classes(spark, sf_dir):
    """Loaded sites by state and class, a column for each class."""
    return _viewport(spark, sf_dir).groupBy("b_state").pivot("a_class", ["INDUSTRIAL", "UNKNOWN", "NONINDUSTRIAL", "UNAVAILABLE"]).agg(F.count(F.lit(1))).na.fill(0)


@register("detections", sql=f"--with {SCORED}, d as (select * from daily where acq_date <= date '{CUTOFF}'), w as (select site_id, count(*) as total_active_days, min(acq_date) as first_date, max(acq_date) as last_date from d group by site_id) select d.site_id, d.acq_date, d.detections, round(d.mean_frp,6) as mean_frp, s.level, round(s.c_score,6) as c_score, w.total_active_days, w.first_date, w.last_date from d left join scored s using (site_id, acq_date) join w using (site_id)")
def site_timeline(spark, sf_dir):
    return serving.timeline(_daily(spark, sf_dir), _scored(spark, sf_dir), CUTOFF).select("site_id", "acq_date", "detections", *r6("mean_frp"), "level", "c_score", "total_active_days", "first_date", "last_date")


@register("alerts", "sites", "a_history", sql=f"--with {IDENTITY.format(where='')} select alert_id, site_id, site_day, alert_level, status, round(latitude,6) as latitude, round(longitude,6) as longitude, class as a_class from (select l.*, s.latitude, s.longitude, a.class from alerts l join sites s using (site_id) left join a_now a using (site_id) where status='ACTIVE') order by updated_at desc, alert_id desc limit 500")
def alert_feed(spark, sf_dir):
    found = serving.alert_feed(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "sites"), serving.latest_identity(view(spark, sf_dir, "a_history")), limit=500)
    return found.select("alert_id", "site_id", "site_day", "alert_level", "status", *r6("latitude", "longitude"), "a_class")


@register("detections", sql=f" select site_id, acq_date, acq_time, frp, round(latitude,5) as latitude, round(longitude,5) as longitude from detections where {_BOX} order by acq_date desc, frp desc, site_id, acq_time, detections.latitude, detections.longitude limit 1000")
def firms_layer(spark, sf_dir):
    found = serving.hot_spots(view(spark, sf_dir, "detections"), BOX, 1000)
    return found.select("site_id", "acq_date", "acq_time", "frp", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))


_REPLAY = f"""--with {IDENTITY.format(where=f"where as_of <= date '{CUTOFF}'")}, {STATES}, {SCORED},
{LAST_C},
j as ({DECIDED} (select b.site_id, b.state, b.confidence, b.last_date as latest_seen, a.decision, a.class as a_class, a.p_core, coalesce(c.c_status,'UNAVAILABLE') as c_status, coalesce(c.c_status,'UNAVAILABLE') as level, c.c_score from sites p join states b using (site_id) left join a_now a using (site_id) left join c using (site_id))),
o as (select *, {_case(1, 'NO_ALERT')} as t0, {_case(2, 'NONE')} as l0 from j), f as (select *, decision is not null and c_status not in ('NO_RECENT_EVENT','UNAVAILABLE') and l0 not in ('NONE','INFO') as shown from o)
select site_id, a_class, round(p_core,4) as p_core, state as b_state, confidence, c_status, round(c_score,4) as c_score, latest_seen, case when shown then t0 end as alert_type, case when shown then l0 end as alert_level from f"""


@register("sites", "a_history", "detections", sql=_REPLAY)
def replay_snapshot(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    scored = anomaly.anomaly_score(daily.daily_activity(d), CALIBRATION_END)
    return serving.replay(view(spark, sf_dir, "sites"), d, view(spark, sf_dir, "a_history"), scored, CUTOFF)


def _replayed(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    return serving.replay(view(spark, sf_dir, "sites"), d, view(spark, sf_dir, "a_history"), anomaly.anomaly_score(daily.daily_activity(d), CALIBRATION_END), CUTOFF)


@register("sites", "a_history", "detections", sql=_REPLAY.replace("\n    select", " select").replace("select site_id, a_class, round(p_core,4)", ", r as (select site_id, a_class, round(p_core,4)", 1) + ") select site_id, b_state, c_status, latest_seen, (select count(*) from r) as total_count, (select count(*) from r)>100 as truncated from r order by latest_seen desc, site_id limit 100")
def replay_page(spark, sf_dir):
    """The first hundred rows of the replay, with the number of all."""
    return serving.replay_page(cut(_replayed(spark, sf_dir)), 100).select("site_id", "b_state", "c_status", "latest_seen", "total_count", "truncated")


SITE = "SITE_0000074"


@register("sites", "a_history", "detections", sql=_REPLAY + f" where site_id='{SITE}'")
def site_detail_as_of(spark, sf_dir):
    """One site as it was known on a date."""
    one = lambda n: view(spark, sf_dir, n).where(F.col("site_id") == SITE)
    # the ranks are against all sites' days, so the anomaly result is made from every site before one is taken
    return serving.replay(one("sites"), one("detections"), one("a_history"), _scored(spark, sf_dir).where(F.col("site_id") == SITE), CUTOFF)


@register("sites", "a_history", "detections", "alerts", sql=f"--with {IDENTITY.format(where='')}, {STATES}, {SCORED}, {LAST_C}, t as (select * from alerts where status='ACTIVE' order by created_at desc, alert_id desc) select s.site_id, a.class, a.decision, b.state, b.last_date, c.c_status, round(c.c_score,6) as c_score, t.alert_id, t.alert_level from sites s left join a_now a using (site_id) left join states b using (site_id) left join c using (site_id) left join (select * from (select *, row_number() over (partition by site_id order by created_at desc, alert_id desc) as rn from alerts where status='ACTIVE') where rn=1) t using (site_id) where site_id='{SITE}'")
def site_detail(spark, sf_dir):
    """One site with all its present results; its alert is the active one created last."""
    a, b = _identity_and_state(spark, sf_dir)
    c = anomaly.latest_status(_scored(spark, sf_dir), CUTOFF)
    found = serving.detail(view(spark, sf_dir, "sites"), a.select("site_id", "class", "decision"), b.select("site_id", "state", "last_date"), c, view(spark, sf_dir, "alerts"), SITE)
    return found.select("site_id", "class", "decision", "state", "last_date", "c_status", F.round("c_score", 6).alias("c_score"), "alert_id", "alert_level")


@register("detections", sql=f" select site_id, acq_date, acq_time, frp from detections where site_id='{SITE}' and acq_date <= date '{CUTOFF}' order by acq_date desc, acq_time desc, latitude, longitude limit 1000")
def recent_site_detections(spark, sf_dir):
    return serving.recent_detections(view(spark, sf_dir, "detections"), SITE, CUTOFF).select("site_id", "acq_date", "acq_time", "frp")


@register("a_history", "detections", "alerts", sql=f"--with {IDENTITY.format(where='')}, {STATES}, {SCORED}, {LAST_C}, k as ({' union all '.join(f"select '{m}' as model, unnest({list(x)}) as category" for m, x in serving.CATEGORIES.items())}), n as (select 'a' as model, class as category, count(*) as n from a_now group by 2 union all select 'b', state, count(*) from states group by 2 union all select 'c', c_status, count(*) from c group by 2 union all select 'alert', alert_level, count(*) from alerts where status='ACTIVE' group by 2) select model, category, coalesce(n,0) as n from k left join n using (model, category)")
def model_counts(spark, sf_dir):
    a, b = _identity_and_state(spark, sf_dir)
    return serving.model_counts(a, b, anomaly.latest_status(_scored(spark, sf_dir), CUTOFF), view(spark, sf_dir, "alerts"))


@register("a_history", "detections", sql=f"--with {IDENTITY.format(where='')}, {STATES}, {SCORED}, {LAST_C} select site_id, class, state, c_status from c join a_now using (site_id) join states using (site_id) where c_status in ('ELEVATED','ANOMALOUS','CRITICAL') or state='REACTIVATED'")
def raised_or_reactivated(spark, sf_dir):
    a, b = _identity_and_state(spark, sf_dir)
    return serving.raised_or_reactivated(a, b, anomaly.latest_status(_scored(spark, sf_dir), CUTOFF)).select("site_id", "class", "state", "c_status")


# -- space ----------------------------------------------------------------------------------------------------------------
@register("sites", "facilities", sql=f" select s.site_id, f.evidence_id, round({HAVERSINE.format(a='s', b='f')},3) as distance_m from sites s join facilities f on abs(s.latitude-f.latitude)<0.1 and abs(s.longitude-f.longitude)<0.2 where {HAVERSINE.format(a='s', b='f')} <= 10000")
def evidence_radius(spark, sf_dir):
    return spatial.facilities_near(view(spark, sf_dir, "sites"), view(spark, sf_dir, "facilities")).withColumn("distance_m", F.round("distance_m", 3))


@register("sites", "event_evidence", sql=f" select s.site_id, e.evidence_id, round({HAVERSINE.format(a='s', b='e')},3) as distance_m from sites s join event_evidence e on abs(s.latitude-e.latitude)<0.1 and abs(s.longitude-e.longitude)<0.2 where {HAVERSINE.format(a='s', b='e')} <= 10000 and e.event_start <= date '1998-06-15'+7 and (e.event_end is null or e.event_end >= date '1998-06-15'-7)")
def evidence_events(spark, sf_dir):
    return spatial.events_near(view(spark, sf_dir, "sites"), view(spark, sf_dir, "event_evidence"), "1998-06-15", 7).withColumn("distance_m", F.round("distance_m", 3))


_PTS = "points as (select latitude, longitude, min(ingest_key) as pid, count(*) as w from detections group by latitude, longitude)"
# places meet by rows of latitude: a place's own and the two beside it, each once
_PAIRS = _PTS + f", banded as (select *, cast(floor(latitude/0.007) as bigint) as band from points), dealt as (select *, band+unnest([-1,0,1]) as meets from banded), pairs as (select a.pid as a, b.pid as b, b.w as w, {HAVERSINE.format(a='a', b='b')} as d from dealt a join banded b on a.meets=b.band where abs(a.longitude-b.longitude)<0.0095 and {HAVERSINE.format(a='a', b='b')} <= 750)"


def _keyed(spark, sf_dir):
    return view(spark, sf_dir, "detections").select("ingest_key", "latitude", "longitude")


@register("detections", sql=f"--with {_PAIRS}, found as (select a as pid, sum(w) as neighbors, round(max(d),3) as farthest_m from pairs group by a) select d.ingest_key, cast(f.neighbors as bigint) as neighbors, f.farthest_m from detections d join points p on p.latitude=d.latitude and p.longitude=d.longitude join found f on f.pid=p.pid")
def spatial_neighbors(spark, sf_dir):
    """How many detections lie within the cluster radius of each."""
    return spatial.neighbors(_keyed(spark, sf_dir), "ingest_key").select("ingest_key", "neighbors", F.round("farthest_m", 3).alias("farthest_m"))


_DBSCAN = f"""--with {_PAIRS}, cores as (select a as pid from pairs group by a having sum(w)>=3), cc as (select p.a, p.b, p.d from pairs p join cores x on x.pid=p.a join cores y on y.pid=p.b),
reach as (select a as pid, min(b) as root, 0 as n from cc group by a union all select pid, root, n+1 from (select x.pid, min(r.root) as root, max(r.n) as n, bool_or(r.root<x.root) as moved from reach x join cc c on c.a=x.pid join reach r on r.pid=c.b group by x.pid) where n<60), roots as (select pid, min(root) as cluster from reach group by pid),
border as (select pid, cluster from (select p.a as pid, r.cluster, row_number() over (partition by p.a order by p.d, r.cluster) as rn from pairs p join roots r on r.pid=p.b where p.a not in (select pid from cores)) where rn=1)
select d.ingest_key, coalesce(r.cluster,b.cluster) as cluster, case when r.pid is not null then 'CORE' when b.pid is not null then 'BORDER' else 'NOISE' end as role from detections d join points pt on pt.latitude=d.latitude and pt.longitude=d.longitude left join roots r using (pid) left join border b on b.pid=pt.pid"""


@register("detections", sql=_DBSCAN)
def dbscan_sites(spark, sf_dir):
    """The cluster and role of every detection."""
    return spatial.cluster(_keyed(spark, sf_dir), "ingest_key")


@register()
def incremental_resolver(spark, sf_dir):
    """Every detection in the order of its ingestion, against no stored member at first."""
    d = view(spark, sf_dir, "detections")
    points = d.select(F.col("ingest_key").alias("detection_id"), "latitude", "longitude", F.col("ingest_id").alias("seq"))
    none = spark.createDataFrame([], "detection_id string, latitude double, longitude double, site_id string, candidate_id string")
    return resolver.resolve(points, none).drop("candidate_sites")


# -- audits and ledgers ----------------------------------------------------------------------------------------------------
_DUP = """--with k as (select detection_id, site_id, source_sensor, ingested_at, satellite, acq_date, acq_time, round(cast(latitude as decimal(18,8)),4) as lat4, round(cast(longitude as decimal(18,8)),4) as lon4 from redelivery),
dup as (select detection_id, site_id, kept_id from (select s.detection_id, s.site_id, n.detection_id as kept_id, row_number() over (partition by s.detection_id order by n.ingested_at, n.detection_id) as rn from k s join k n using (satellite, acq_date, acq_time, lat4, lon4) where s.source_sensor='VIIRS_NOAA20_SP' and n.source_sensor='VIIRS_NOAA20_NRT') where rn=1)"""


@register("redelivery", sql=_DUP + " select * from dup")
def delivery_duplicate_pairs(spark, sf_dir):
    return audit.delivery_duplicates(view(spark, sf_dir, "redelivery"))


@register("redelivery", sql=_DUP + " select source_sensor, count(*) as kept from redelivery where detection_id not in (select detection_id from dup) group by 1")
def cross_delivery_dedup(spark, sf_dir):
    return audit.without_redeliveries(view(spark, sf_dir, "redelivery")).groupBy("source_sensor").agg(F.count("*").alias("kept"))


_PROMO = " select candidate_id, count(*) filter (retained) as kept from candidate_members where promoted_site_id is not null group by 1 having count(*) filter (retained) < 3"


@register("candidate_members", sql=_PROMO)
def invalid_promotions_having(spark, sf_dir):
    return audit.invalid_promotions(view(spark, sf_dir, "candidate_members"))


@register("redelivery", "candidate_members", sql=_DUP + f", bad as ({_PROMO}) select site_id from dup union select promoted_site_id from candidate_members where promoted_site_id is not null and candidate_id in (select candidate_id from bad)")
def affected_sites_union(spark, sf_dir):
    return audit.affected_sites(audit.delivery_duplicates(view(spark, sf_dir, "redelivery")), view(spark, sf_dir, "candidate_members"))


@register("detections", "a_history", sql=" select site_id, as_of as acq_date, count(*) as n_rows from a_history a where not exists (select 1 from detections d where d.site_id=a.site_id and d.acq_date=a.as_of) group by 1,2")
def orphan_inference_anti(spark, sf_dir):
    inference = view(spark, sf_dir, "a_history").select("site_id", F.col("as_of").alias("acq_date"))
    return audit.orphans(inference, _daily(spark, sf_dir)).groupBy("site_id", "acq_date").agg(F.count("*").alias("n_rows"))


@register("sites", "a_history", "alerts", "detections", sql=" select 'a' as result, count(*) as sites from sites where site_id not in (select site_id from a_history) union all select 'alerts', count(*) from sites where site_id not in (select site_id from alerts) union all select 'b', count(*) from sites where site_id not in (select site_id from detections)")
def missing_model_audit(spark, sf_dir):
    return audit.missing(view(spark, sf_dir, "sites"), a=view(spark, sf_dir, "a_history"), alerts=view(spark, sf_dir, "alerts"), b=view(spark, sf_dir, "detections"))


@register("sites", "a_history", "alerts", sql=" select site_id from sites where site_id not in (select site_id from a_history) union select site_id from sites where site_id not in (select site_id from alerts)")
def missing_sites_union(spark, sf_dir):
    s = view(spark, sf_dir, "sites").select("site_id")
    return s.join(view(spark, sf_dir, "a_history"), "site_id", "left_anti").union(s.join(view(spark, sf_dir, "alerts"), "site_id", "left_anti")).distinct()


@register("candidate_members", sql=" select candidate_id, count(*) as members, round(avg(latitude),6) as latitude, round(avg(longitude),6) as longitude, epoch_us(min(observed_at)) as first_seen, epoch_us(max(observed_at)) as last_seen from candidate_members group by 1")
def candidate_stats(spark, sf_dir):
    return daily.candidate_stats(view(spark, sf_dir, "candidate_members")).select("candidate_id", "members", *r6("latitude", "longitude"), *[F.unix_micros(c).alias(c) for c in ("first_seen", "last_seen")])


@register("candidate_members", sql=" select candidate_id, detection_id from (select *, row_number() over (partition by candidate_id order by acq_date, acq_time, observed_at, detection_id) as rn from candidate_members) where rn<=3")
def candidate_first_three(spark, sf_dir):
    return audit.first_members(view(spark, sf_dir, "candidate_members"))


@register("coverage_windows", sql="--with spans as (select source, min(window_start) as s, max(window_end) as e from coverage_windows group by source) select source, cast(unnest(generate_series(s, e, interval 5 day)) as date) as window_start, least(5, e - cast(unnest(generate_series(s, e, interval 5 day)) as date) + 1) as n_days from spans")
def backfill_windows(spark, sf_dir):
    spans = view(spark, sf_dir, "coverage_windows").groupBy("source").agg(F.min("window_start").alias("start"), F.max("window_end").alias("end"))
    return windows.request_windows(spans).select("source", "window_start", "n_days")


@register("coverage_windows", sql="--with c as (select *, max(window_end) over (partition by source order by window_start, window_end rows between unbounded preceding and 1 preceding) as covered from coverage_windows) select distinct source, cast(covered+1 as date) as gap_start, cast(window_start-1 as date) as gap_end from c where window_start>covered+1")
def coverage_gaps(spark, sf_dir):
    return windows.coverage_gaps(view(spark, sf_dir, "coverage_windows"))


@register("detections", "candidate_members", sql=" select distinct site_id from detections where acq_date > date '2001-10-01' union select promoted_site_id from candidate_members where promoted_site_id is not null")
def incremental_touched_sites(spark, sf_dir):
    promoted = view(spark, sf_dir, "candidate_members").where("promoted_site_id is not null").select(F.col("promoted_site_id").alias("site_id"))
    return audit.touched_sites(view(spark, sf_dir, "detections"), "2001-10-01", promoted)


_BURDEN = " select site_day, count(*) as alerts, count(distinct site_id) as sites, count(*) filter (alert_level in ('HIGH','CRITICAL')) as high_or_critical, count(*) filter (evidence_required) as evidence_required from alerts group by 1"


@register("alerts", sql=_BURDEN)
def alert_burden_daily(spark, sf_dir):
    return audit.burden_by_day(view(spark, sf_dir, "alerts"))


@register("alerts", sql=" select alert_type, alert_level, count(*) as alerts, count(distinct site_id) as sites from alerts group by 1,2")
def alert_burden_by_type(spark, sf_dir):
    return audit.burden_by_type(view(spark, sf_dir, "alerts"))


@register("alerts", sql=f"--with d as ({_BURDEN}) select count(*) as days, round(avg(alerts),6) as mean_daily, median(alerts) as median_daily, max(alerts) as max_daily from d")
def alert_burden_summary(spark, sf_dir):
    return audit.burden_summary(view(spark, sf_dir, "alerts")).withColumn("mean_daily", F.round("mean_daily", 6))


_CLASS = "case when p_core>=0.885 then 'INDUSTRIAL' when p_core>=0.405 then case when coalesce(p_visual>=0.965,false) then 'INDUSTRIAL' else 'UNKNOWN' end else 'NONINDUSTRIAL' end"


@register("alerts", "a_history", sql=f"--with m as (select l.alert_id, l.site_id, h.as_of, {_CLASS} as class, h.inference_id from alerts l left join a_history h on h.site_id=l.site_id and h.as_of<=l.site_day), r as (select *, row_number() over (partition by alert_id order by as_of desc nulls last, inference_id desc nulls last) as rn from m) select alert_id, site_id, as_of, case when as_of is not null then class end as class from r where rn=1 and (as_of is null or class<>'INDUSTRIAL')")
def claim_violations_asof(spark, sf_dir):
    return audit.claims_as_of(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "a_history"))


_CONSENSUS = """done as (select *, lag(reviewed_by) over w as pb, lag(determination) over w as pd, lag(confidence) over w as pc from reviews where review_status='COMPLETED' window w as (partition by site_id order by reviewed_at, review_id)),
cons as (select *, case when pb is null or pb=reviewed_by then 'SINGLE_REVIEW' when pd=determination then 'VERIFIED' else 'CONFLICT' end as consensus from done),
elig as (select *, coalesce(consensus='VERIFIED' and determination in ('INDUSTRIAL','NONINDUSTRIAL') and confidence='HIGH' and pc='HIGH' and has_features,false) as training_eligible from cons),
ledger as (select r.*, e.consensus, e.training_eligible from reviews r left join elig e using (review_id)), lastr as (select * from (select *, row_number() over (partition by site_id order by reviewed_at desc, review_id desc) as rn from ledger) where rn=1)"""


@register("reviews", sql=f"--with {_CONSENSUS} select review_id, site_id, consensus, training_eligible from elig")
def review_consensus(spark, sf_dir):
    return review.consensus(view(spark, sf_dir, "reviews")).select("review_id", "site_id", "consensus", "training_eligible")


@register("reviews", "alerts", "a_history", sql=f"--with {_CONSENSUS}, {OPEN_ALERT}, {IDENTITY.format(where='')} select t.site_id, t.alert_id, t.alert_level, case when l.review_status is null then 'PENDING' when l.review_status='IN_REVIEW' then 'IN_REVIEW' when l.review_status='ESCALATED' or l.consensus='CONFLICT' then 'CONFLICT' when l.consensus='VERIFIED' then 'COMPLETED' else 'AWAITING_VERIFICATION' end as queue_status from top_alert t join a_now a on a.site_id=t.site_id and a.class='UNKNOWN' left join lastr l on l.site_id=t.site_id")
def review_queue(spark, sf_dir):
    return review.queue(view(spark, sf_dir, "reviews"), view(spark, sf_dir, "alerts"), serving.latest_identity(view(spark, sf_dir, "a_history")))


@register("reviews", sql=f"--with {_CONSENSUS} select site_id, review_id, case when determination='INDUSTRIAL' then 1 else 0 end as label, reviewed_by from lastr where training_eligible")
def review_export(spark, sf_dir):
    return review.export(view(spark, sf_dir, "reviews"))


@register("detections", sql=f" select count(distinct site_id) as sites, max(acq_date) as last_date, count(distinct site_id) filter (date '{CUTOFF}'-acq_date between 0 and 30) as active_30d from detections where acq_date <= date '{CUTOFF}'")
def global_stats(spark, sf_dir):
    b = temporal.timeline(view(spark, sf_dir, "detections"), CUTOFF)
    return b.agg(F.count("*").alias("sites"), F.max("last_date").alias("last_date"), F.count_if(F.col("days_since_last") <= 30).alias("active_30d"))


# -- keyed writes: alerts with even numbers are stored, those with a number divisible by three come in resolved -------------
def _stored_and_new(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts").select("alert_id", "site_id", "status", "alert_level", "seq")
    return alerts.where("seq % 2 = 0"), alerts.where("seq % 3 = 0").withColumn("status", F.when(F.col("seq") % 5 == 0, F.col("status")).when(F.col("seq") % 7 > 0, "RESOLVED"))


_STORE = "--with stored as (select alert_id, site_id, status, alert_level from alerts where seq%2=0), incoming as (select alert_id, site_id, case when seq%5=0 then status when seq%7>0 then 'RESOLVED' end as status, alert_level from alerts where seq%3=0) "


@register("alerts", sql=_STORE + "select alert_id, status, alert_level from stored where alert_id not in (select alert_id from incoming) union all select alert_id, status, alert_level from incoming")
def alerts_upserted(spark, sf_dir):
    old, new = _stored_and_new(spark, sf_dir)
    return upsert.upsert(old, new, ["alert_id"]).select("alert_id", "status", "alert_level")


@register("alerts", sql=_STORE + "select alert_id, status from incoming where alert_id not in (select alert_id from stored)")
def alerts_inserted(spark, sf_dir):
    old, new = _stored_and_new(spark, sf_dir)
    return upsert.insert_absent(old, new, ["alert_id"]).select("alert_id", "status")


@register("alerts", sql=_STORE + "select alert_id, status from stored where alert_id not in (select alert_id from incoming)")
def alerts_deleted(spark, sf_dir):
    old, new = _stored_and_new(spark, sf_dir)
    return upsert.delete(old, new, ["alert_id"]).select("alert_id", "status")


@register("alerts", sql=_STORE + "select s.alert_id, case when i.alert_id is null then s.status else i.status end as status from stored s left join incoming i using (alert_id)")
def alerts_updated(spark, sf_dir):
    """Statuses taken from what comes in, null ones too."""
    old, new = _stored_and_new(spark, sf_dir)
    return upsert.update_from(old, new, ["alert_id"], ["status"]).select("alert_id", "status")


@register("alerts", sql=_STORE + "select i.alert_id, i.status from incoming i join stored s using (alert_id) where i.status is distinct from s.status")
def alerts_changed(spark, sf_dir):
    old, new = _stored_and_new(spark, sf_dir)
    return upsert.changed(old, new, ["alert_id"]).select("alert_id", "status")


@register("alerts", sql=" select alert_id, case when seq%4=0 and status='ACTIVE' then 'ACKNOWLEDGED' else status end as status, case when seq%4=0 and status='ACTIVE' then 'operator' end as acknowledged_by from alerts")
def alerts_acknowledged(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts")
    return serving.acknowledge(alerts, alerts.where("seq % 4 = 0"), "operator", "2024-02-01 00:00:00").select("alert_id", "status", "acknowledged_by")


@register("reviews", "alerts", sql=f"--with {_CONSENSUS} select alert_id, case when l.site_id in (select site_id from ledger where consensus='VERIFIED') then 'RESOLVED' else status end as status from alerts l")
def alerts_resolved_by_review(spark, sf_dir):
    return review.resolved_alerts(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "reviews")).select("alert_id", "status")


_MERGED = f"""--with fp as (select alert_id, site_id, site_day, alert_type, alert_level, status, created_at, seq, evidence_required, sha256(site_id||'_'||cast(site_day as varchar)||'_'||alert_type||'_2026-09-04-r1') as fingerprint, {_RANK} as rk from alerts),
stored as (select * from (select *, row_number() over (partition by fingerprint order by seq) as rn from fp where seq%2=0) where rn=1),
dec as (select * from (select *, row_number() over (partition by site_id, site_day order by seq desc) as rn from fp where seq%2=1) where rn=1),
held as (select * from (select *, row_number() over (partition by site_id, site_day order by created_at desc, alert_id desc) as hn from stored where status='ACTIVE') where hn=1),
j as (select d.*, h.alert_level as old_level, h.rk as old_rank from dec d left join held h using (site_id, site_day))
select coalesce(s.alert_id, 'ALT_'||substr(j.fingerprint,1,32)) as alert_id, j.fingerprint, j.alert_level, coalesce(s.status,'ACTIVE') as status, j.old_level is not null as is_escalation, j.old_level as previous_level, case when j.old_level is null then 'R' else 'R,ESCALATED_FROM_'||j.old_level end as reason_codes
from j left join stored s using (fingerprint) where j.alert_level not in ('NONE','INFO') and (j.old_rank is null or j.rk>j.old_rank)"""


@register("alerts", sql=_MERGED)
def alerts_merged(spark, sf_dir):
    """What a day's decisions write over stored alerts (those with even numbers): new ones, and escalations of the same day."""
    rows = view(spark, sf_dir, "alerts").withColumn("fingerprint", decide.fingerprint(F.col("site_id"), F.col("site_day"), F.col("alert_type")))
    stored = first_by(rows.where("seq % 2 = 0"), ["fingerprint"], [F.col("seq")])
    decided = first_by(rows.where("seq % 2 = 1"), ["site_id", "site_day"], [F.desc("seq")]).withColumn("reason_codes", F.lit("R"))
    found = decide.merge_alerts(stored, decided.select("fingerprint", "site_id", "site_day", "alert_type", "alert_level", "evidence_required", "reason_codes"), "2024-02-01 00:00:00")
    return found.select("alert_id", "fingerprint", "alert_level", "status", "is_escalation", "previous_level", "reason_codes")


@register("a_history", sql="--with l as (select site_id, max(as_of) as last from a_history where inference_id%2=0 group by 1) select a.site_id, a.as_of, a.inference_id from (select * from (select *, row_number() over (partition by site_id order by as_of, inference_id) as rn from a_history where inference_id%2=1) where rn=1) a left join l using (site_id) where last is null or as_of>=last")
def latest_if_newer(spark, sf_dir):
    """Results that may replace a site's latest one: those not before any in its history."""
    rows = view(spark, sf_dir, "a_history")
    history = rows.where("inference_id % 2 = 0")
    new = first_by(rows.where("inference_id % 2 = 1"), ["site_id"], [F.col("as_of"), F.col("inference_id")])
    return upsert.newer(history, history, new, ["site_id"]).select("site_id", "as_of", "inference_id")


@register("a_history", sql=" select site_id, inference_id from a_history where inference_id%3=0 and inference_id not in (select inference_id from a_history where inference_id%2=0)")
def inferences_inserted(spark, sf_dir):
    """Inferences whose id the history lacks."""
    rows = view(spark, sf_dir, "a_history")
    return upsert.insert_absent(rows.where("inference_id % 2 = 0"), rows.where("inference_id % 3 = 0"), ["inference_id"]).select("site_id", "inference_id")


# -- reviews ---------------------------------------------------------------------------------------------------------------
_REFS = "list_sort(list_distinct(list_filter(list_transform(string_split({0},','), lambda x: upper(trim(x))), lambda x: x<>'')))"


@register("review_requests", sql=f"--with q as (select *, {_REFS.format('evidence_text')} as refs, {_REFS.format('reason_text')} as codes, review_status='COMPLETED' as done from review_requests) select request_id, array_to_string(refs,',') as refs, case when a_class<>'UNKNOWN' then 'site is not UNKNOWN' when review_status not in ('IN_REVIEW','COMPLETED','ESCALATED') then 'unknown status' when done and coalesce(determination,'') not in ('INDUSTRIAL','NONINDUSTRIAL','REMAIN_UNKNOWN') then 'determination' when done and coalesce(confidence,'') not in ('HIGH','MEDIUM','LOW') then 'confidence' when done and coalesce(len(refs),0)=0 then 'evidence' when done and not coalesce(list_contains(codes,'EVIDENCE_REVIEWED'),false) then 'reason' when not done and (determination is not null or confidence is not null) then 'not completed' end as error from q")
def review_validation(spark, sf_dir):
    """What is wrong with each review that was sent in, after its references and reasons are put in order."""
    asked = view(spark, sf_dir, "review_requests").withColumn("evidence_refs", normalize.sorted_refs(F.col("evidence_text"))).withColumn("reason_codes", normalize.sorted_refs(F.col("reason_text")))
    return review.validate(asked).select("request_id", F.array_join("evidence_refs", ",").alias("refs"), "error")


# -- planning, bundles and repair --------------------------------------------------------------------------------------------
@register("coverage_windows", sql=" select p.window_id from coverage_windows p where not exists (select 1 from coverage_windows a where a.status='COMPLETED' and a.source=p.source and a.window_start<=p.window_start and a.window_end>=p.window_end)")
def uncovered_windows(spark, sf_dir):
    w = view(spark, sf_dir, "coverage_windows").withColumnRenamed("source", "family")
    return windows.uncovered(w, w).select("window_id")


@register("coverage_windows", sql="--with av as (select data_id, min(window_start) as lo, case when data_id='2-HIGH' then date '1995-06-30' else max(window_start) end as hi from coverage_windows group by 1), days as (select cast(unnest(generate_series(date '1995-01-01', date '1996-12-31', interval 1 day)) as date) as day), ch as (select day, list_sort(list([case when data_id='2-HIGH' then '0' else '1' end, data_id]))[1][2] as source from days join av on day between lo and hi group by day), m as (select *, case when source=lag(source) over (order by day) then 0 else 1 end as fresh from ch), isl as (select *, sum(fresh) over (order by day) as island from m), sp as (select source, min(day) as s, max(day) as e from isl group by source, island) select source, cast(unnest(generate_series(s, e, interval 5 day)) as date) as window_start, cast(least(5, e - cast(unnest(generate_series(s, e, interval 5 day)) as date) + 1) as bigint) as n_days from sp")
def backfill_plan(spark, sf_dir):
    """Request windows over two years, each from one source; the preferred one ends halfway and is bridged."""
    w = view(spark, sf_dir, "coverage_windows")
    spans = w.groupBy("data_id").agg(F.min("window_start").alias("min_date"), F.max("window_start").alias("max_date"))
    spans = spans.withColumn("max_date", F.when(F.col("data_id") == "2-HIGH", F.lit("1995-06-30").cast("date")).otherwise(F.col("max_date")))
    return windows.plan_sources(spark, spans, "1995-01-01", "1996-12-31", prefer="2-HIGH").withColumn("n_days", F.col("n_days").cast("long"))


@register("raw_records", sql=_NORMAL + " select count(*) as records, count(*) filter (not coalesce(acq_date between date '1995-01-01' and date '1995-12-31', false)) as outside from norm")
def payload_window_check(spark, sf_dir):
    """Records outside the window that was asked for (an unreadable date is outside)."""
    records = normalize.normalize(view(spark, sf_dir, "raw_records"))
    outside = windows.outside_window(records, "1995-01-01", "1995-12-31").agg(F.count("*").alias("outside"))
    return records.agg(F.count("*").alias("records")).join(outside)  # a row on each side


_SNAP = "--with d as (select scenario_key, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as day from scenarios), s as (select *, extract(day from day) as n from d) "


@register("scenarios", sql=_SNAP + "select scenario_key as scenario_id, count(*) as expected, count(*) filter (n%7=0) as missing, count(*) filter (n%7<>0 and n%5=0) as invalid, count(*) filter (n%7=0)=0 and count(*) filter (n%7<>0 and n%5=0)=0 as complete from s group by 1")
def demo_bundle_status(spark, sf_dir):
    """Expected, missing and invalid snapshots of each scenario: days divisible by seven are missing, of others those divisible by five invalid."""
    scenarios = view(spark, sf_dir, "scenarios").drop("scenario_id").withColumnRenamed("scenario_key", "scenario_id")
    snapshots = windows.scenario_days(scenarios).where("day(day) % 7 <> 0").withColumn("valid", F.expr("day(day) % 5 <> 0"))
    return windows.bundle_status(scenarios, snapshots)


@register("scenarios", sql=" select scenario_key from (select *, count(*) over (partition by scenario_id)>1 as twice from scenarios) where twice or not focal_date between start_date and end_date or west>=east or south>=north")
def invalid_scenarios(spark, sf_dir):
    return windows.invalid_scenarios(view(spark, sf_dir, "scenarios")).select("scenario_key")


@register("redelivery", sql=_DUP + ", kept as (select * from redelivery where detection_id not in (select detection_id from dup)) select site_id, acq_date, count(*) as detections, round(avg(coalesce(frp,0.0)),6) as mean_frp, max(coalesce(frp,0.0)) as max_frp from kept group by 1,2")
def repaired_days(spark, sf_dir):
    """Site-days after re-deliveries are taken out and the days that held one are made anew."""
    d = view(spark, sf_dir, "redelivery")
    _, days = audit.repair_deliveries(d, daily.daily_activity(d))
    return days.select("site_id", "acq_date", "detections", *r6("mean_frp"), "max_frp")


@register("candidate_members", "sites", sql=f"--with bad as ({_PROMO}), made as (select promoted_site_id as site_id, bool_and(candidate_id in (select candidate_id from bad)) as gone from candidate_members where promoted_site_id is not null group by 1) select 'members' as part, count(*) filter (promoted_site_id is not null and candidate_id not in (select candidate_id from bad)) as n from candidate_members union all select 'sites', count(*) from sites where site_id not in (select site_id from made where gone)")
def repaired_promotions(spark, sf_dir):
    """Members that still belong to a site, and sites that stay, after invalid promotions are taken back."""
    members, sites = audit.repair_promotions(view(spark, sf_dir, "candidate_members"), view(spark, sf_dir, "sites").select("site_id"))
    return members.agg(F.count("promoted_site_id").alias("n")).select(F.lit("members").alias("part"), "n").unionByName(sites.agg(F.count("*").alias("n")).select(F.lit("sites").alias("part"), "n"))


@register("candidate_members", "a_history", sql=f"--with bad as ({_PROMO}), gone as (select distinct promoted_site_id as site_id from candidate_members where candidate_id in (select candidate_id from bad)) select count(*) as n_rows, count(distinct site_id) as sites from a_history where site_id not in (select site_id from gone)")
def repair_cascade(spark, sf_dir):
    """Identity history without the sites of invalid promotions."""
    members = view(spark, sf_dir, "candidate_members")
    gone = members.join(audit.invalid_promotions(members).select("candidate_id"), "candidate_id", "left_semi").select(F.col("promoted_site_id").alias("site_id"))
    kept = audit.repair_cascade(gone, history=view(spark, sf_dir, "a_history"))["history"]
    return kept.agg(F.count("*").alias("n_rows"), F.count_distinct("site_id").alias("sites"))


@register("scenarios", "alerts", "sites", sql=" select 'twice' as test, count(*) as n from (select scenario_id from scenarios group by 1 having count(*)>1) union all select 'no site', count(*) from alerts where site_id not in (select site_id from sites)")
def integrity_checks(spark, sf_dir):
    """Keys that aren't unique, and alerts of unknown sites."""
    twice = audit.broken_keys(view(spark, sf_dir, "scenarios"), ["scenario_id"]).agg(F.count("*").alias("n")).select(F.lit("twice").alias("test"), "n")
    lost = audit.broken_references(view(spark, sf_dir, "alerts"), "site_id", view(spark, sf_dir, "sites")).agg(F.count("*").alias("n")).select(F.lit("no site").alias("test"), "n")
    return twice.unionByName(lost)


# -- identity features, evidence and text ------------------------------------------------------------------------------------
_COVER = "cover as (select site_id, " + ", ".join(f"count(*) filter (code={c})/nullif(count(*) filter (code>0),0) as {n}_fraction" for c, n in features.LAND_COVER.items()) + " from pixels group by site_id)"
_RECUR = "rd as (select site_id, acq_date, count(*) as n from detections group by all), rg as (select *, acq_date - lag(acq_date) over (partition by site_id order by acq_date) as gap, max(acq_date) over (partition by site_id) as last from rd), recur as (select site_id, sum(n) as detections, count(*) as active_days, greatest(1,max(acq_date)-min(acq_date)+1) as source_lifetime_days, count(*) filter (last-acq_date<7) as active_days_7, count(*) filter (last-acq_date<30) as active_days_30, count(*) filter (last-acq_date<90) as active_days_90, count(*) filter (last-acq_date<365) as active_days_365, avg(gap) as mean_recurrence_gap_days, median(gap) as median_recurrence_gap_days, sum(n)/count(*) as detections_per_active_day from rg group by site_id)"
_SPREAD = "sm as (select d.site_id, sqrt(pow(radians(d.longitude-s.longitude)*cos(radians(s.latitude))*6371008.8,2)+pow(radians(d.latitude-s.latitude)*6371008.8,2)) as x from detections d join sites s using (site_id)), spread as (select site_id, quantile_cont(x,0.5) as spatial_median_m, quantile_cont(x,0.9) as spatial_p90_m, stddev_pop(x) as spatial_std_m from sm group by site_id)"
_VECTOR = f"--with {_THERMAL}, {_RECUR}, {_SPREAD}, {_COVER}, vec as (select t.site_id, frp_mean as mean_frp, frp_median as median_frp, frp_max as max_frp, frp_std as std_frp, frp_std/greatest(frp_mean,1e-6) as frp_cv, frp_p10, frp_p25, frp_p75, frp_p90, frp_p75-frp_p25 as frp_iqr, night_ratio, r.* exclude (site_id), s.* exclude (site_id), c.* exclude (site_id) from thermal t join recur r using (site_id) join spread s using (site_id) left join cover c using (site_id))"


def _vectors(spark, sf_dir):
    return features.identity_vector(view(spark, sf_dir, "detections"), view(spark, sf_dir, "sites"), view(spark, sf_dir, "pixels"))


@register("detections", "sites", "pixels", sql=_VECTOR + f" select site_id, {', '.join(f'round(cast({n} as double),4) as {n}' for n in FEATURES)} from vec")
def identity_features(spark, sf_dir):
    """The identity model's features of each site, in its order."""
    return _vectors(spark, sf_dir).select("site_id", *[F.round(n, 4).alias(n) for n in FEATURES])


@register("detections", "sites", "pixels", sql=_VECTOR + ", chosen as (select * from vec order by sha256(site_id) limit 100) select site_id, 'max_frp' as feature, round(max_frp,6) as found, round(max_frp+0.5,6) as expected from chosen where max_frp>=40")
def golden_features(spark, sf_dir):
    """The golden check against expected values of which one feature is off wherever it is 40 or more."""
    found = cut(_vectors(spark, sf_dir))
    expected = found.withColumn("max_frp", F.when(F.col("max_frp") >= 40, F.col("max_frp") + 0.5).otherwise(F.col("max_frp")))
    return features.golden(found, expected, list(FEATURES)).select("site_id", "feature", *r6("found", "expected"))


@register("detections", "sites", "pixels", sql=_VECTOR + " select site_id, round(1/(1+exp(-(1.5*night_ratio+0.8*ln(1+detections)-0.6*coalesce(frp_cv,0.0)-2.0))),6) as p_core from vec")
def identity_scores(spark, sf_dir):
    """The stand-in scorer over the ordered features; another order would be an error."""
    return identity.score(_vectors(spark, sf_dir), list(FEATURES)).select("site_id", *r6("p_core"))


@register("sites", "a_history", sql=" select site_id from sites intersect select site_id from a_history")
def common_sites(spark, sf_dir):
    return view(spark, sf_dir, "sites").select("site_id").intersect(view(spark, sf_dir, "a_history").select("site_id"))


@register("sites", "facilities", sql=f" select s.site_id, f.evidence_id, round({HAVERSINE.format(a='s', b='f')},3) as distance_m from sites s join facilities f on abs(s.latitude-f.latitude)<0.1 and abs(s.longitude-f.longitude)<0.2 where {HAVERSINE.format(a='s', b='f')} <= 10000 order by distance_m, s.site_id, f.evidence_id limit 200")
def nearest_evidence(spark, sf_dir):
    """The two hundred nearest pairs of site and facility."""
    found = spatial.facilities_near(view(spark, sf_dir, "sites"), view(spark, sf_dir, "facilities")).withColumn("distance_m", F.round("distance_m", 3))
    return found.orderBy("distance_m", "site_id", "evidence_id").limit(200)


@register("pixels", sql=" select site_id, round(x,6) as cloud_fraction from (select site_id, avg(case when fmask&31<>0 or fmask=255 then 1.0 else 0.0 end) as x from pixels group by site_id) where x<=0.25")
def clear_sites(spark, sf_dir):
    """Sites whose imagery isn't rejected for cloud."""
    return features.cloud_fraction(view(spark, sf_dir, "pixels")).where("cloud_fraction <= 0.25").select("site_id", *r6("cloud_fraction"))


@register("detections", sql=" select site_id, acq_date, count(*) as detections, round_even(avg(coalesce(frp,0.0)),2) as mean_frp, round_even(max(coalesce(frp,0.0)),2) as max_frp from detections group by 1,2")
def daily_activity_rounded(spark, sf_dir):
    return daily.daily_activity(view(spark, sf_dir, "detections"), rounded=True).select("site_id", "acq_date", "detections", "mean_frp", "max_frp")


@register("sites", sql=" select site_id, sha256('v1|replay|2001-06-30|'||printf('%.5f,%.5f,%.5f,%.5f', longitude-1, latitude-1, longitude+1, latitude+1)||'|500') as name from sites")
def cache_names(spark, sf_dir):
    """The name under which each site's box is cached."""
    box = [F.col("longitude") - 1, F.col("latitude") - 1, F.col("longitude") + 1, F.col("latitude") + 1]
    return view(spark, sf_dir, "sites").select("site_id", normalize.cache_key("v1", "replay", F.lit(CUTOFF).cast("date"), box, F.lit(500)).alias("name"))


@register("review_requests", sql=" select request_id, array_to_string(list_filter(list_transform(string_split(evidence_text,','), lambda x: trim(x)), lambda x: x<>''),'|') as parts, lower(trim(cast(request_id%2 as varchar))) in ('1','true','yes','y') as yes, regexp_replace(evidence_text,'[^A-Za-z0-9_.-]','_','g') as path, replace('key=abc123 at '||review_status,'abc123','***') as message from review_requests")
def text_fields(spark, sf_dir):
    """Comma lists, yes or no, path parts and messages without their secret."""
    text = F.col("evidence_text")
    return view(spark, sf_dir, "review_requests").select("request_id", F.array_join(normalize.comma_list(text), "|").alias("parts"), normalize.truthy(F.col("request_id") % 2).alias("yes"), normalize.safe_path(text).alias("path"), normalize.redacted(F.concat(F.lit("key=abc123 at "), "review_status"), "abc123").alias("message"))


# -- many dates in one plan ------------------------------------------------------------------------------------------------
CUTOFFS = ("2000-06-30", "2001-03-31", CUTOFF)
_REPLAYS = " union all ".join(f"select *, date '{c}' as cutoff from ({_REPLAY.replace('--with', 'with recursive').replace(CUTOFF, c)})" for c in CUTOFFS)


def _replay_days(spark, sf_dir):
    scored = cut(_scored(spark, sf_dir))
    return serving.replay_days(view(spark, sf_dir, "sites"), view(spark, sf_dir, "detections"), view(spark, sf_dir, "a_history"), scored, list(CUTOFFS))


@register("sites", "a_history", "detections", sql=" " + _REPLAYS)
def replay_days(spark, sf_dir):
    """The replay of three dates at once."""
    return _replay_days(spark, sf_dir)


@register("sites", "a_history", "detections", sql=f" select site_id, cutoff, property, expected, found from (select e.site_id, e.cutoff, unnest([{{'property': 'b_state', 'expected': e.b_state, 'found': r.b_state}}, {{'property': 'c_status', 'expected': e.c_status, 'found': r.c_status}}], recursive := true) from (select site_id, c as cutoff, 'DORMANT' as b_state, case when c=date '{CUTOFF}' then 'NO_RECENT_EVENT' end as c_status from sites, (select unnest([{', '.join(f"date '{c}'" for c in CUTOFFS)}]) as c) where cast(substr(site_id,6) as int)%50=0) e left join ({_REPLAYS}) r using (site_id, cutoff)) where expected is not null and found is distinct from expected")
def expectation_mismatches(spark, sf_dir):
    """Every fiftieth site is expected to be dormant, and without recent event on the last date: those that aren't."""
    chosen = view(spark, sf_dir, "sites").where("cast(substr(site_id, 6) as int) % 50 = 0")
    days = F.explode(F.array(*[F.lit(c).cast("date") for c in CUTOFFS]))
    expected = chosen.select("site_id", days.alias("cutoff"), F.lit("DORMANT").alias("b_state")).withColumn("c_status", F.when(F.col("cutoff") == F.lit(CUTOFF).cast("date"), "NO_RECENT_EVENT"))
    return windows.expectation_mismatches(_replay_days(spark, sf_dir), expected, ["b_state", "c_status"])


# -- imagery, evidence, requests and rasters ----------------------------------------------------------------------------------
_DATED = "--with dated as (select granule, site_id, cast(make_date(cast(regexp_extract(granule,'\\.(20\\d{2}|19\\d{2})(\\d{3})T',1) as int),1,1)+cast(regexp_extract(granule,'\\.(20\\d{2}|19\\d{2})(\\d{3})T',2) as int)-1 as date) as acq_date, cloud from granules)"


@register("granules", sql=_DATED + f" select * from (select site_id, granule, acq_date, row_number() over (partition by site_id order by acq_date desc nulls last, granule, cloud nulls first) as place from dated where acq_date is null or acq_date <= date '1998-06-15') where place<=3")
def imagery_list(spark, sf_dir):
    """The three newest granules of each site that there were on a date."""
    dated = view(spark, sf_dir, "granules").withColumn("acq_date", normalize.granule_date(F.col("granule")))
    return serving.imagery_list(serving.imagery_as_of(dated, "1998-06-15"), 3).select("site_id", "granule", "acq_date", "place")


@register("reviews", "alerts", "a_history", sql=f"--with {_CONSENSUS}, {OPEN_ALERT}, {IDENTITY.format(where='')}, q as (select t.site_id, case when l.review_status is null then 'PENDING' when l.review_status='IN_REVIEW' then 'IN_REVIEW' when l.review_status='ESCALATED' or l.consensus='CONFLICT' then 'CONFLICT' when l.consensus='VERIFIED' then 'COMPLETED' else 'AWAITING_VERIFICATION' end as queue_status from top_alert t join a_now a on a.site_id=t.site_id and a.class='UNKNOWN' left join lastr l on l.site_id=t.site_id) select site_id, queue_status, (select count(*) from q where queue_status<>'COMPLETED') as total_reviews from q where queue_status<>'COMPLETED' order by site_id limit 25")
def review_queue_page(spark, sf_dir):
    """The first open reviews, and how many there are."""
    found = review.queue(view(spark, sf_dir, "reviews"), view(spark, sf_dir, "alerts"), serving.latest_identity(view(spark, sf_dir, "a_history")))
    return review.queue_page(cut(found), "OPEN", 25).select("site_id", "queue_status", "total_reviews")


_AUDIT = _DUP + """, members as (select detection_id, 'CAND_'||cast(ingested_at%500 as varchar) as candidate_id, case when ingested_at%500%2=0 then site_id end as promoted_site_id from redelivery),
touched as (select distinct candidate_id from members join dup using (detection_id)), promoted as (select distinct candidate_id, promoted_site_id as site_id from members join touched using (candidate_id) where promoted_site_id is not null),
kept as (select site_id, count(*) as k from redelivery where detection_id not in (select detection_id from dup) group by 1), invalid as (select p.* from promoted p left join kept using (site_id) where coalesce(k,0)<3)
select 'duplicate_rows' as name, count(*) as n from dup union all select 'affected_sites', count(*) from (select site_id from dup union select site_id from invalid) union all select 'affected_candidates', count(*) from touched union all select 'affected_promotions', count(*) from promoted
union all select 'invalid_promotions', count(*) from invalid union all select 'protected_reviews', count(*) from reviews where site_id in (select site_id from invalid) union all select 'protected_labels', count(*) from a_history where inference_id%10=0 and site_id in (select site_id from invalid)"""


@register("redelivery", "reviews", "a_history", sql=_AUDIT)
def repair_audit(spark, sf_dir):
    """What a repair of re-deliveries would touch, and what people have decided there."""
    d = view(spark, sf_dir, "redelivery")
    candidate = F.col("ingested_at") % 500
    members = d.select("detection_id", F.concat(F.lit("CAND_"), candidate.cast("string")).alias("candidate_id"), F.when(candidate % 2 == 0, F.col("site_id")).alias("promoted_site_id"))
    return audit.repair_audit(d, members, view(spark, sf_dir, "reviews"), view(spark, sf_dir, "a_history").where("inference_id % 10 = 0"))


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("raw_records", sql=_NORMAL + " select coalesce(reject_reason,'ACCEPTED') as reason, count(*) as n_records from norm group by 1")
def records_from_cache(spark, sf_dir):
    """Records kept as the answers of requests over all their days, read back offline by the data source, and what becomes of them."""
    folder = _scratch(spark, "cache")
    area.land(view(spark, sf_dir, "raw_records"), folder, "SRC", "1992-01-01", "1998-12-31")
    area.register(spark)
    read = spark.read.format("area_records").options(cache=folder, offline="true", source="SRC", start="1992-01-01", end="1998-12-31").load()
    none = {c: F.nullif(F.col(c), F.lit("")) for c in ("acq_time", "daynight", "confidence")}  # a CSV has no nulls
    return normalize.normalize(read.withColumns(none)).groupBy(F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("n_records"))


@register("facilities", sql=" select facility_name, 'power_plant' as facility_type, 'EXACT' as coordinate_quality, round(latitude,4) as latitude, round(longitude,4) as longitude, count(*) over () as ids from facilities")
def evidence_from_files(spark, sf_dir):
    """Facilities written as a CSV and read as evidence; as many different ids as rows."""
    folder = _scratch(spark, "evidence")
    view(spark, sf_dir, "facilities").drop("evidence_id").write.csv(folder, header=True)
    found = cut(bootstrap.facility_evidence(bootstrap.read_csv(spark, folder), bootstrap.FACILITIES["gem"]))
    ids = found.agg(F.count_distinct("evidence_id").alias("ids"))
    return found.select("facility_name", "facility_type", "coordinate_quality", *[F.round(c, 4).alias(c) for c in ("latitude", "longitude")]).join(F.broadcast(ids))  # one row of counts


_PIXEL = 0.0025
_RASTER = f"px as (select cast(floor((90.0-latitude)/{_PIXEL}) as bigint) as r, cast(floor((longitude+180)/{_PIXEL}) as bigint) as c, least(count(*),9)*10 as v from detections group by 1,2), win as (select site_id, floor((90.0-(latitude+1000/111320.0))/{_PIXEL}) as r0, floor((90.0-(latitude-1000/111320.0))/{_PIXEL}) as r1, floor((longitude-1000/(111320.0*cos(radians(latitude)))+180)/{_PIXEL}) as c0, floor((longitude+1000/(111320.0*cos(radians(latitude)))+180)/{_PIXEL}) as c1 from sites)"


@register("detections", "sites", sql=f"--with {_RASTER}, hit as (select w.site_id, p.v, count(*) as n from win w join px p on p.r between w.r0 and w.r1 and p.c between w.c0 and w.c1 group by 1,2) select site_id, cast(v as int) as code, cast(n as bigint) as pixels, round(n/sum(n) over (partition by site_id),6) as share from hit")
def cover_from_tiles(spark, sf_dir):
    """Shares of the classes around each site, read from a raster that Spark wrote as tiles (a pixel's class: ten times its detections, up to nine)."""
    folder = _scratch(spark, "tiles")
    pixels = view(spark, sf_dir, "detections").groupBy(*tiles.grid(F.col("latitude"), F.col("longitude"), _PIXEL)).agg((F.least(F.count("*"), F.lit(9)) * 10).alias("value"))
    tiles.write_tiles(pixels, folder).agg(F.sum("blocks")).collect()  # one row
    found = tiles.window_counts(view(spark, sf_dir, "sites"), folder, _PIXEL).where("site_id is not null and value > 0")
    counts = found.groupBy("site_id", F.col("value").alias("code")).agg(F.sum("n").alias("pixels"))
    whole = F.sum("pixels").over(Window.partitionBy("site_id"))
    return counts.select("site_id", "code", "pixels", F.round(F.col("pixels") / whole, 6).alias("share"))
