"""Message times as text (seconds, a dot, six digits), days and zones. Time and zone are always arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strict and the loose shape of a message time.
STRICT, LOOSE = r"\A[1-9][0-9]{9}\.[0-9]{6}\z", r"\A[0-9]+\.[0-9]+\z"
DAY_US = 86_400_000_000


def is_valid_ts(ts: Column) -> Column:
    """Ten digits that do not begin with 0, a dot, six digits; null gives null."""
    return ts.rlike(STRICT)


def is_loose_ts(ts: Column) -> Column:
    return ts.rlike(LOOSE)


def ts_micros(ts: Column) -> Column:
    """Microseconds of a strictly valid time, else null; exact, never by way of a double."""
    return F.when(is_valid_ts(ts), F.replace(ts, F.lit("."), F.lit("")).try_cast("bigint"))


def ts_sort_key(ts: Column) -> Column:
    """Sorts as a number; malformed times come first."""
    return F.coalesce(ts.try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))


def micros_ts(us: Column) -> Column:
    return F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


def utc_day(us: Column) -> Column:
    """The UTC date of microseconds since 1970, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(us / DAY_US).cast("int"))


def local_day_range(day: Column, zone: str) -> tuple[Column, Column]:
    """Microseconds of a local day's begin and end, for days of 23 and 25 hours too."""

    def at(d: Column) -> Column:
        return F.unix_micros(F.make_timestamp(F.year(d), F.month(d), F.day(d), F.lit(0), F.lit(0), F.lit(0), F.lit(zone)))

    return at(day), at(F.date_add(day, 1))


def local(us: Column, zone: str, pattern: str) -> Column:
    """Formats microseconds in a zone, whatever the session's zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))), pattern)


def _seconds_of(ts: Column) -> Column:
    """Whole seconds of a time that is a number in any notation, else null."""
    x = ts.try_cast("double")
    return F.when(x.between(-62_135_596_800.0, 253_402_300_799.0), F.floor(x))


def ts_clock(ts: Column, zone: str) -> Column:
    """Hours and minutes of a time in a zone; what is no number stays as it is."""
    return F.coalesce(local(_seconds_of(ts) * 1_000_000, zone, "HH:mm"), ts)


def ts_day(ts: Column, zone: str) -> Column:
    """The date of a time in a zone; ``unknown`` for what is no number."""
    return F.coalesce(local(_seconds_of(ts) * 1_000_000, zone, "yyyy-MM-dd"), F.when(ts.isNotNull(), "unknown"))


def iso_micros(us: Column) -> Column:
    """ISO 8601 with microseconds and Z; sorts as text."""
    return local(us, "UTC", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def backoff_seconds(attempts: Column) -> Column:
    """2, 4, 8, ... seconds after each failed attempt, up to 512."""
    return F.pow(F.lit(2), F.least(attempts, F.lit(8)) + 1).cast("bigint")


def thread_cache_seconds(age: Column) -> Column:
    """How long a fetched thread stays fresh by the age of its last reply in seconds; null: for ever.

    A minute in the first hour, ten in the first day, then a twentieth of the age but half an hour at least, up to a week.
    """
    return F.when(age < 3_600, F.lit(60.0)).when(age < 86_400, F.lit(600.0)).when(age < 7 * 86_400, F.greatest(age / 20, F.lit(1_800.0)))
