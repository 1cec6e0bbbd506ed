"""Time expressions: hour and weekday of the written wall clock, order by the instant."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow import config as C

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

_OFFSET = r"(Z|z|[+-]\d{2}:?\d{2})$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def wall_clock(text) -> Column:
    """Clock as written in an ISO string, offset ignored; null when the text is no time."""
    return F.regexp_replace(F.trim(col(text)), _OFFSET, "").try_cast("timestamp_ntz")


def instant(text) -> Column:
    """Point in time of an ISO string, offset applied; null when the text is no time."""
    return F.trim(col(text)).try_cast("timestamp")


def hour_of_day(ts) -> Column:
    return F.hour(col(ts))


def day_of_week(ts) -> Column:
    """Monday = 0."""
    return F.weekday(col(ts))


def is_weekend(ts) -> Column:
    return (day_of_week(ts) >= C.FIRST_WEEKEND_DAY).cast("int")


def unusual_hour_serving(ts, hours=None) -> Column:
    return hour_of_day(ts).isin(hours or C.SERVING_UNUSUAL_HOURS).cast("int")


def unusual_hour_training(ts) -> Column:
    return hour_of_day(ts).between(C.TRAINING_UNUSUAL_FIRST_HOUR, C.TRAINING_UNUSUAL_LAST_HOUR).cast("int")


def within_hours(ts, as_of, hours=C.RECENT_HOURS) -> Column:
    """At most this many hours old. Future rows count as recent, rows without a time do not."""
    return F.coalesce(micros(ts) >= micros(as_of) - F.lit(int(hours * HOUR_US)), F.lit(False))


def as_time(as_of) -> Column:
    """Argument `as_of`: a column, or the text of a timestamp."""
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
