"""The driver's tables as the engine's domain tables.

Each view is a table and select expressions in the SQL that Spark and DuckDB share, so the engine's queries and
their DuckDB counterparts read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SITE = "'SITE_'||lpad(cast({0} as string),7,'0')"
_LAT = "cast(6.0 as double)+(({0}*7919)%3200)/cast(100.0 as double)"
_LON = "cast(67.0 as double)+(({0}*6007)%3100)/cast(100.0 as double)"

_DELIVERY = "cast(floor(l_orderkey/8.0) as bigint)"
_FOUR = "cast(floor(event_id/4.0) as bigint)"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "detections": ("lineitem", [
        f"{_SITE.format('l_partkey')} as site_id", "cast(l_shipdate as date) as acq_date",
        "lpad(cast((l_orderkey*7+l_linenumber*13)%24 as string),2,'0')||lpad(cast((l_orderkey*11+l_linenumber*17)%60 as string),2,'0') as acq_time",
        "cast(l_quantity as double) as frp", "case when l_returnflag='N' then 'N' else 'D' end as daynight",
        "case when l_linestatus='F' then 'VIIRS_NOAA20_SP' else 'VIIRS_NOAA20_NRT' end as source_sensor", "'N20' as satellite",
        f"{_LAT.format('l_partkey')}+(((l_orderkey*31+l_linenumber*17)%201)-100)*cast(0.00005 as double)+cast(0.00001 as double) as latitude",
        f"{_LON.format('l_partkey')}+(((l_orderkey*37+l_linenumber*13)%201)-100)*cast(0.00005 as double)+cast(0.00001 as double) as longitude",
        "l_orderkey as ingest_id", "l_linenumber as ingest_line",
        "cast(l_orderkey as string)||'-'||cast(l_linenumber as string)||'-'||cast(l_partkey as string)||'-'||cast(l_suppkey as string)||'-'||cast(cast(floor(l_extendedprice*100+0.5) as bigint) as string) as ingest_key",
    ]),
    "sites": ("part", [f"{_SITE.format('p_partkey')} as site_id", f"{_LAT.format('p_partkey')} as latitude", f"{_LON.format('p_partkey')} as longitude"]),
    "facilities": ("supplier", [
        "'FAC_'||lpad(cast(s_suppkey as string),5,'0') as evidence_id", "s_name as facility_name",
        f"{_LAT.format('s_suppkey')}+cast(0.03 as double) as latitude", f"{_LON.format('s_suppkey')} as longitude",
    ]),
    "a_history": ("orders", [
        f"{_SITE.format('o_custkey')} as site_id", "cast(o_orderdate as date) as as_of", "o_orderkey as inference_id",
        "((o_orderkey*37)%1000)/cast(1000.0 as double) as p_core", "case when o_orderkey%5=0 then ((o_orderkey*53)%1000)/cast(1000.0 as double) end as p_visual",
    ]),
    "alerts": ("events", [
        "'ALT_'||cast(event_id as string) as alert_id", f"{_SITE.format('user_id')} as site_id", "cast(ts as date) as site_day", "cast(ts as timestamp) as updated_at",
        "case event_type when 'error' then 'CRITICAL' when 'purchase' then 'HIGH' when 'signup' then 'MEDIUM' when 'click' then 'LOW' else 'INFO' end as alert_level",
        "upper(event_type)||'_REVIEW' as alert_type", "case when event_id%3=0 then 'ACKNOWLEDGED' else 'ACTIVE' end as status", "event_id%2=0 as evidence_required", "cast(ts as timestamp)-interval '1' hour*(event_id%5) as created_at", "event_id as seq",
    ]),
    "event_evidence": ("orders", [
        "'EVT_'||cast(o_orderkey as string) as evidence_id", "cast(o_orderdate as date) as event_start",
        "case when o_orderstatus='O' then cast(null as date) else cast(cast(o_orderdate as date)+interval '3' day as date) end as event_end",
        f"{_LAT.format('o_custkey')} as latitude", f"{_LON.format('o_custkey')} as longitude",
    ]),
    "reviews": ("events", [
        "event_id as review_id", f"{_SITE.format('user_id')} as site_id", "cast(ts as timestamp) as reviewed_at", "'reviewer_'||cast(event_id%3 as string) as reviewed_by",
        "case event_type when 'error' then 'ESCALATED' when 'view' then 'IN_REVIEW' else 'COMPLETED' end as review_status",
        "case event_type when 'error' then null when 'view' then null when 'purchase' then 'INDUSTRIAL' when 'signup' then 'NONINDUSTRIAL' else 'REMAIN_UNKNOWN' end as determination",
        "case when event_id%4=0 then 'MEDIUM' else 'HIGH' end as confidence", "event_id%7<>0 as has_features", "cast(event_id%3+1 as int) as n_refs",
    ]),
    "pixels": ("lineitem", [f"{_SITE.format('l_partkey')} as site_id", "case l_suppkey%11 when 0 then 0 when 1 then 10 when 2 then 20 when 3 then 30 when 4 then 40 when 5 then 50 when 6 then 60 when 7 then 80 when 8 then 90 when 9 then 95 else 100 end as code", "cast(case when l_orderkey%3=0 then l_orderkey%256 else 32*(l_orderkey%7) end as int) as fmask"]),
    "coverage_windows": ("orders", ["o_orderkey as window_id", "'CUST_'||cast(o_custkey as string) as source", "o_orderpriority as data_id", "cast(o_orderdate as date) as window_start", "cast(o_orderdate as date)+cast(o_orderkey%5 as int) as window_end", "case when o_orderkey%3=0 then 'COMPLETED' else 'FAILED' end as status"]),
    "scenarios": ("orders", ["'SC_'||cast(o_orderkey-(case when o_orderkey%40=0 then 1 else 0 end) as string) as scenario_id", "o_orderkey as scenario_key", "cast(o_orderdate as date) as start_date", "cast(o_orderdate as date)+3 as end_date", "cast(o_orderdate as date)+cast(o_orderkey%5 as int) as focal_date", "cast(70.0 as double)+o_orderkey%10 as west", "cast(70.0 as double)+o_orderkey%10+o_orderkey%7 as east", "cast(8.0 as double) as south", "cast(8.0 as double)+o_orderkey%9 as north"]),
    "review_requests": ("events", [
        "event_id as request_id", "case when event_id%7=0 then 'INDUSTRIAL' else 'UNKNOWN' end as a_class", "case event_type when 'error' then 'ESCALATED' when 'view' then 'IN_REVIEW' when 'click' then 'CLOSED' else 'COMPLETED' end as review_status",
        "case when event_type='view' and event_id%2=0 then null when event_id%11=0 then 'MAYBE' else 'INDUSTRIAL' end as determination", "case when event_type='view' and event_id%2=0 then null when event_type='error' and event_id%2=0 then null else 'HIGH' end as confidence",
        "case when event_id%3=0 then cast(null as string) else ' r2, R1,r1,, ref'||cast(event_id%4 as string) end as evidence_text", "case when event_id%5=0 then 'OTHER' else 'other,EVIDENCE_REVIEWED' end as reason_text",
    ]),
    "raw_records": ("lineitem", [
        "cast(l_orderkey as string)||'-'||cast(l_linenumber as string) as record_id",
        f"case when l_orderkey%97=0 then '95.5' when l_orderkey%89=0 then '' else cast({_LAT.format('l_partkey')} as string) end as latitude",
        f"cast({_LON.format('l_partkey')} as string) as longitude", "case when l_orderkey%83=0 then '1996-13-01' else cast(cast(l_shipdate as date) as string) end as acq_date",
        "case when l_orderkey%5=0 then ' '||cast((l_orderkey%9)*100+l_linenumber as string)||'.0' when l_orderkey%7=0 then cast(null as string) when l_orderkey%79=0 then '2561' else cast(l_linenumber as string) end as acq_time",
        "case when l_orderkey%6=0 then '' when l_orderkey%11=0 then 'n/a' else cast(cast(l_quantity as int) as string) end as frp",
        "case when l_orderkey%73=0 then 'x' when l_orderkey%3=0 then ' d ' when l_orderkey%10=0 then cast(null as string) else 'n' end as daynight",
        "case when l_orderkey%4=0 then cast(null as string) else ' Nominal ' end as confidence",
    ]),
    # eight orders in a row stand for deliveries of one place and day; the first of them is the archive's
    "redelivery": ("lineitem", [
        f"{_SITE.format('(1+(' + _DELIVERY + '*31)%1999)')} as site_id", f"cast(date '1995-01-01' + cast({_DELIVERY}%2000 as int) as date) as acq_date",
        f"lpad(cast(({_DELIVERY}+l_linenumber*13)%24 as string),2,'0')||lpad(cast(({_DELIVERY}*11+l_linenumber*17)%60 as string),2,'0') as acq_time",
        "'N20' as satellite", "case when l_orderkey%8=0 then 'VIIRS_NOAA20_SP' else 'VIIRS_NOAA20_NRT' end as source_sensor",
        f"{_LAT.format(_DELIVERY)} as latitude", f"{_LON.format(_DELIVERY)} as longitude", "cast(l_quantity as double) as frp",
        "cast(l_orderkey as string)||'-'||cast(l_linenumber as string)||'-'||cast(cast(floor(l_extendedprice) as bigint) as string)||'-'||cast(l_partkey as string)||'-'||cast(l_suppkey as string) as detection_id", "l_orderkey as ingested_at",
    ]),
    "candidate_members": ("events", [
        f"'CAND_'||cast({_FOUR} as string) as candidate_id", "event_id as detection_id", "cast(ts as date) as acq_date", "lpad(cast(event_id%24 as string),2,'0')||'00' as acq_time", "cast(ts as timestamp) as observed_at",
        "cast(10.0 as double)+(event_id%50)*cast(0.001 as double) as latitude", "cast(70.0 as double)+(event_id%40)*cast(0.001 as double) as longitude", f"case when {_FOUR}%2=0 then {_SITE.format(_FOUR)} end as promoted_site_id", "event_id%3<>0 as retained",
    ]),
    "granules": ("orders", ["'HLS.S30.T'||cast(o_custkey as string)||'.'||cast(1995+o_orderkey%7 as string)||lpad(cast(1+o_orderkey%365 as string),3,'0')||'T050000' as granule", f"{_SITE.format('o_custkey')} as site_id", "cast(o_orderdate as date) as acq_date", "case when o_orderkey%9<>0 then cast((o_orderkey*31)%101 as double) end as cloud"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's Parquet files; only the columns in use are read."""
    source, expressions = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*expressions)


def with_views(*names: str) -> str:
    """The same tables as the opening of a DuckDB query."""
    parts = [f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in names]
    return "with recursive " + ",\n".join(parts)
