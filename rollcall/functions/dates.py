"""Dates in several written forms; the reference date is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M-d-yyyy")


def parse_date(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A date, or null where no format fits."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats)).cast("date")


def iso_or_same(text: Column) -> Column:
    """The date as yyyy-MM-dd; a text that is no date stays as it is, null becomes empty."""
    return F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), text, F.lit(""))


def date_or_last(text: Column) -> Column:
    """For range filters: what is no date counts as later than any."""
    return F.coalesce(parse_date(text), F.lit("9999-12-31").cast("date"))


def age_days(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def instant(stamp: Column, kind: str) -> Column:
    """The point in time of a stamp of this Spark type: one without a zone counts as UTC, not as the session's zone."""
    if kind != "timestamp_ntz":
        return stamp.cast("timestamp")
    since = (stamp - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    return F.timestamp_seconds(since.cast("decimal(20,6)"))


def hours_since(stamp: Column, now: Column) -> Column:
    """Hours between two timestamps, infinity for null."""
    return F.coalesce((now.cast("timestamp").cast("long") - stamp.cast("timestamp").cast("long")) / 3600.0, F.lit(float("inf")))


def calendar_features(day: Column) -> Column:
    """Month, day of year, and whether it lies in the session's lame-duck months."""
    return F.struct(F.month(day).alias("month"), F.dayofyear(day).alias("day_of_year"), ((F.month(day) >= 11) | (F.month(day) == 1)).alias("lame_duck"))


def chamber_code(name: Column) -> Column:
    """S, H or J for a chamber by name or code; other text is trimmed."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("s", "senate"), "S").when(low.isin("h", "house"), "H").when(low.isin("j", "joint"), "J").otherwise(F.trim(name))
