"""Scalar column expressions, all JVM-side."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.schemas import STATUS_TEXT

# Fixed value: the characters stripped from both ends of a feed field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    white = F.lit(WHITESPACE)
    # Trimming a set of characters is slow, so it is done only where an end needs it.
    padded = (F.instr(white, F.left(c, F.lit(1))) > 0) | (F.instr(white, F.right(c, F.lit(1))) > 0)
    return F.nullif(F.when(padded, F.trim(c, white)).otherwise(c), F.lit(""))


def lenient_int(c: Column) -> Column:
    """Integer, NULL when the text is not one ('1.0' is not)."""
    return F.regexp_extract(c, r"^([+-]?[0-9]+)$", 1).try_cast("int")


def lenient_smallint(c: Column) -> Column:
    return F.regexp_extract(c, r"^([+-]?[0-9]+)$", 1).try_cast("smallint")


def lenient_double(c: Column) -> Column:
    """Double, NULL when the text is not a plain number (Java's '1.5d' is not)."""
    return F.regexp_extract(c, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$", 1).try_cast("double")


def location_type(c: Column) -> Column:
    return F.coalesce(lenient_smallint(c), F.lit(0).cast("smallint"))


def clock_seconds(c: Column) -> Column:
    """'24:47:00' as seconds into the service day; hours may pass 24."""
    good = F.regexp_extract(c, r"^([0-9]{1,3}:[0-5][0-9]:[0-5][0-9])$", 1)
    # Right-aligned to nine characters the parts have fixed places.
    fixed = F.lpad(F.nullif(good, F.lit("")), 9, "0")
    part = lambda at, n: F.substring(fixed, at, n).cast("int")
    return part(1, 3) * 3600 + part(5, 2) * 60 + part(8, 2)


def clock_text(seconds: Column) -> Column:
    """Seconds back to HH:MM:SS without wrapping at midnight."""
    return F.when(
        seconds.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(seconds / 3600),
            F.floor(F.pmod(seconds, F.lit(3600)) / 60),
            F.pmod(seconds, F.lit(60)).cast("long"),
        ),
    )


def clock_interval(seconds: Column) -> Column:
    """Seconds as a day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def hour_bucket(seconds: Column) -> Column:
    """Service-day hour, may be above 23."""
    return F.floor(seconds / 3600).cast("smallint")


def rt_trip_id(trip_id: Column) -> Column:
    """Realtime form of a trip id: what follows the first underscore, else all of it."""
    return F.substring(trip_id, F.instr(trip_id, "_") + 1, F.length(trip_id))


def hex_color(c: Column, default: str) -> Column:
    return F.concat(F.lit("#"), F.coalesce(c, F.lit(default)))


def half_even_int(c: Column) -> Column:
    """Round to the nearest integer, halves to even, after dropping interpolation noise."""
    return F.rint(F.round(c, 6)).cast("int")


def iso_utc(ts: Column) -> Column:
    """ISO text to the second; the session time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def status_text(code: Column) -> Column:
    """Status name of a code; NULL for any other code."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STATUS_TEXT.items()))
    return F.try_element_at(names, code)


def service_date(raw: Column, poll_ts: Column) -> Column:
    """YYYYMMDD text as a date, the poll's date when it does not parse."""
    parsed = F.when(raw.rlike(r"^[0-9]{8}$"), F.try_to_date(raw, "yyyyMMdd"))
    return F.coalesce(parsed, F.to_date(poll_ts))


def clamped_progress(elapsed: Column, needed: Column) -> Column:
    """Share of a journey done, within [0, 1]; 0 when nothing has to be travelled."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), elapsed / F.nullif(needed, F.lit(0.0))))


def text_head(c: Column, length: int = 180) -> Column:
    return F.concat(F.left(c, F.lit(length)), F.lit(" ..."))


def partition_name(prefix: str, day: Column) -> Column:
    return F.format_string(prefix + "_%s", F.date_format(day, "yyyyMMdd"))


def partition_day(prefix: str, name: Column) -> Column:
    """Day of a partition name, NULL when the name is not one of ours."""
    pattern = "^" + prefix + "_[0-9]{8}$"
    return F.when(name.rlike(pattern), F.try_to_date(F.right(name, F.lit(8)), "yyyyMMdd"))
