"""Raw text fields as typed columns, and the identities made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def acq_time(c: Column) -> Column:
    """HHMM: null is 0000, a trailing .0 goes, short values get leading zeros, long ones stay."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit("0000"))), r"^(\d+)\.0$", "$1")
    return F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, "0"))


def number(c: Column, default: float | None = None) -> Column:
    """A double; null, empty and unreadable text give the default."""
    got = F.expr("null").cast("double") if c is None else c.try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def fixed4(c: Column) -> Column:
    """A coordinate with four decimals, as identities spell it."""
    return F.format_string("%.4f", c)


def detection_id(sensor: Column, satellite: Column, latitude: Column, longitude: Column, date: Column, time: Column) -> Column:
    """SHA-256 of sensor, satellite, place to four decimals, date and time."""
    return F.sha2(F.concat_ws("_", sensor, satellite, fixed4(latitude), fixed4(longitude), date.cast("string"), time), 256)


def physical_key(satellite: Column, latitude: Column, longitude: Column, date: Column, time: Column) -> Column:
    """What two deliveries of one observation share."""
    return F.concat_ws("_", satellite, fixed4(latitude), fixed4(longitude), date.cast("string"), time)


def normalize(raw: DataFrame) -> DataFrame:
    """Typed columns and ``reject_reason`` (null for valid records; the first failing test otherwise)."""
    latitude, longitude = number(F.col("latitude")), number(F.col("longitude"))
    date = F.try_to_date("acq_date", "yyyy-MM-dd")
    time = acq_time(F.col("acq_time"))
    day = F.upper(F.trim(F.coalesce("daynight", F.lit("D"))))
    valid_time = time.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")
    reason = (
        F.when(latitude.isNull() | ~latitude.between(-90, 90), "latitude")
        .when(longitude.isNull() | ~longitude.between(-180, 180), "longitude")
        .when(date.isNull(), "acq_date")
        .when(~valid_time, "acq_time")
        .when(~day.isin("D", "N"), "daynight")
    )
    return raw.select(
        *[c for c in raw.columns if c not in ("latitude", "longitude", "acq_date", "acq_time", "frp", "daynight", "confidence")],
        latitude.alias("latitude"), longitude.alias("longitude"), date.alias("acq_date"), time.alias("acq_time"),
        number(F.col("frp"), 0.0).alias("frp"), day.alias("daynight"), F.lower(F.trim(F.coalesce("confidence", F.lit("nominal")))).alias("confidence"), reason.alias("reject_reason"),
    )


#: What a record without these fields is taken to have.
DEFAULTS = {"satellite": "20", "instrument": "VIIRS", "version": "2.0NRT"}
#: The fields of a record that make it another one when they change.
PAYLOAD = ("source_sensor", "satellite", "instrument", "latitude", "longitude", "acq_date", "acq_time", "frp", "bright_ti4", "bright_ti5", "scan", "track", "confidence", "daynight", "version")


def full_records(raw: DataFrame, source_sensor: str | None = None) -> DataFrame:
    """All fields of ``PAYLOAD``, typed, with ``reject_reason``, detection_id and the physical key; fields that the input lacks are null, or their default.

    ``source_sensor`` names the source that was asked, where the records don't.
    """
    present = raw.columns
    sensor = F.coalesce(F.col("source_sensor") if "source_sensor" in present else F.lit(None).cast("string"), F.lit(source_sensor))
    filled = raw.withColumns({c: F.lit(None).cast("string") for c in PAYLOAD if c not in present}).withColumn("source_sensor", sensor)
    typed = normalize(filled)
    named = typed.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(d))) for c, d in DEFAULTS.items()} | {c: number(F.col(c)) for c in ("bright_ti4", "bright_ti5", "scan", "track")})
    key = [F.col(c) for c in ("satellite", "latitude", "longitude", "acq_date", "acq_time")]
    reason = F.coalesce("reject_reason", F.when(F.col("source_sensor").isNull(), "source_sensor"))
    return named.withColumn("reject_reason", reason).withColumn("detection_id", detection_id(F.col("source_sensor"), *key)).withColumn("physical_key", physical_key(*key))


def strict(normalized: DataFrame) -> DataFrame:
    """Valid records; a record that was rejected stops the job (the whole batch fails)."""
    checked = normalized.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), "reject_reason"))).otherwise(F.lit(None).cast("string")))
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def comma_list(c: Column) -> Column:
    """Trimmed non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: Column) -> Column:
    """Whether a text or number says yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def event_time(date: Column, time: Column) -> Column:
    """A timestamp of a date and an optional time of day; null where it can't be read."""
    return F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.coalesce(time, F.lit("00:00:00"))))


def no_nan(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def sorted_refs(c: Column) -> Column:
    """Different non-empty parts of a comma list in upper case, in order."""
    return F.array_sort(F.array_distinct(F.transform(comma_list(c), lambda x: F.upper(x))))


def redacted(text: Column, secret: str) -> Column:
    """A text without a secret."""
    return F.replace(text, F.lit(secret), F.lit("***")) if secret else text


def safe_path(c: Column) -> Column:
    """A text as one component of a path."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def cache_key(schema: str, namespace: str, date: Column, bbox: list[Column], limit: Column) -> Column:
    """The name of a cached reply."""
    box = F.concat_ws(",", *[F.format_string("%.5f", b) for b in bbox])
    return F.sha2(F.concat_ws("|", F.lit(schema), F.lit(namespace), date.cast("string"), box, limit.cast("string")), 256)


def granule_date(name: Column) -> Column:
    """The date in a granule's name: year and day of year after a dot, before a T."""
    year, day = (F.regexp_extract(name, r"\.(20\d{2}|19\d{2})(\d{3})T", i) for i in (1, 2))
    return F.when(year != "", F.date_add(F.make_date(F.when(year != "", year).cast("int"), F.lit(1), F.lit(1)), F.when(day != "", day).cast("int") - 1))
