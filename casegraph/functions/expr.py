"""Column expressions shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def sig(x: Column, mid: float, slope: float) -> Column:
    """Logistic curve around mid."""
    return 1.0 / (1.0 + F.exp(-F.lit(slope) * (x - F.lit(mid))))


def clamp4(x: Column) -> Column:
    """Into [0, 1], four places."""
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 4)


def money(x: Column) -> Column:
    """Exact cents, so that sums do not depend on order; null counts as zero."""
    return F.coalesce(x, F.lit(0.0)).cast("decimal(18,2)")


def blank_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    """Absolute difference of two microsecond columns in hours."""
    return F.abs(a - b) / F.lit(HOUR_US)


# The layouts tried in order on ingest (day first before month first).
INGEST_LAYOUTS = (
    "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy H:m:s", "d/M/yyyy", "d-M-yyyy H:m:s", "d-M-yyyy", "M/d/yyyy H:m:s", "M/d/yyyy",
)
DETECTOR_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")


def ingest_time(x: Column) -> Column:
    """Text of a time as ISO with Z; text that no layout reads is kept."""
    t = F.trim(x)
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in INGEST_LAYOUTS])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'"), blank_null(x))


def detector_time(x: Column) -> Column:
    """Timestamp of an ISO text, null where it is none (a blank between date and time is none)."""
    t = F.regexp_replace(F.trim(x), r"(\+00:00)?Z?$", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DETECTOR_LAYOUTS])


def clean_time(x: Column) -> Column:
    """Timeline text of a time: trimmed, one Z, a date alone gets midnight; blank is null."""
    t = F.regexp_replace(blank_null(x), r"\+00:00Z$", "Z")
    return F.when(F.length(t) <= 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(t)


def amount(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[,₹]", "")).try_cast("double")


def yes(x: Column, *words: str, default: str = "") -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(default)))).isin(*words)


def key12(prefix: str, *parts: Column) -> Column:
    """A reproducible id: prefix and 12 hex digits of the parts' digest."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 12))


def sorted_union(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*arrays))))
