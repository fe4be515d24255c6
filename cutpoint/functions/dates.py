"""UTC calendar expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def day(value: date) -> str:
    return f"DATE'{value.isoformat()}'"


def utc_time(value: datetime) -> str:
    return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"


def from_instant(x: str) -> str:
    """UTC wall-clock time of an instant. Counted from the epoch: the wall clock of a session zone repeats hours."""
    return f"timestampadd(MICROSECOND, unix_micros({x}), TIMESTAMP_NTZ'1970-01-01 00:00:00')"


def utc_wall_clock(df: DataFrame, name: str) -> str:
    """The column as a zone-less UTC timestamp, whatever the session time zone is.

    Zone-less input is taken to be UTC already.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return name
    if isinstance(dtype, T.TimestampType):
        return from_instant(name)
    raise TypeError(f"{name} must be a timestamp, not {dtype.simpleString()}")


def midnight(df: DataFrame, name: str, value: date) -> str:
    """Midnight UTC in the type of the raw column, so the comparison is pushed to the scan."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return f"TIMESTAMP_NTZ'{value.isoformat()} 00:00:00'"
    return f"TIMESTAMP_LTZ'{value.isoformat()} 00:00:00+00:00'"


def iso_weekday(x: str) -> str:
    """Monday = 1 … Sunday = 7."""
    return f"weekday({x}) + 1"


def weekday_name(x: str) -> str:
    """Mon … Sun."""
    return f"dayname({x})"


def time_dimensions(start: str) -> dict[str, str]:
    """The calendar columns that staging adds for a UTC start time."""
    today = f"to_date({start})"
    return {
        "activity_date": today,
        "day_num": iso_weekday(today),
        "day_of_week": weekday_name(today),
        "year_iso": f"extract(YEAROFWEEK FROM {today})",
        "week_iso": f"weekofyear({today})",
        "week_start_date": f"CAST(date_sub({today}, weekday({today})) AS TIMESTAMP_NTZ)",
    }
