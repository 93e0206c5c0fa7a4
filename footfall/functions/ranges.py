"""Report periods. "Now" is always an argument (`as_of`), so every report can be repeated."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

_DAYS = {"7d": 7, "30d": 30, "90d": 90}


@dataclass(frozen=True)
class DateRange:
    """A closed period in UTC; `previous` is the equally long, end-exclusive one before it."""

    start: datetime
    end: datetime

    def previous(self) -> "DateRange":
        return DateRange(self.start - (self.end - self.start), self.start)


def date_range(spec: str, as_of: datetime) -> DateRange:
    """`custom:YYYY-MM-DD:YYYY-MM-DD`, `today`, `1d`, `7d`, `30d` or `90d`; others mean 30 days."""
    if spec.startswith("custom:"):
        parts = spec.split(":")
        try:
            first, last = (date.fromisoformat(p) for p in parts[1:])
            return DateRange(
                datetime.combine(first, time.min), datetime.combine(last, time(23, 59, 59, 999000))
            )
        except ValueError:
            pass
    if spec in ("today", "1d"):
        return DateRange(datetime.combine(as_of.date(), time.min), as_of)
    return DateRange(as_of - timedelta(days=_DAYS.get(spec, 30)), as_of)


def last_days(days: int, as_of: datetime) -> DateRange:
    """From midnight `days` days before the day of `as_of`, up to `as_of`."""
    return DateRange(datetime.combine(as_of.date() - timedelta(days=days), time.min), as_of)


def instant(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the column's own type, so the comparison reaches the Parquet scan uncast."""
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)


def within(
    df: DataFrame, period: DateRange, column: str = "timestamp", end_inclusive: bool = True
) -> DataFrame:
    """Rows of the period. Also filters the partition column of that time, where there is one."""
    ts, last = F.col(column), instant(df, column, period.end)
    keep = (ts >= instant(df, column, period.start)) & (ts <= last if end_inclusive else ts < last)
    partition = {"timestamp": "event_date", "started_at": "session_date"}.get(column)
    if partition in df.columns:
        keep &= F.col(partition).between(F.lit(period.start.date()), F.lit(period.end.date()))
    return df.filter(keep)


def for_site(df: DataFrame, site_id: str | None) -> DataFrame:
    """One tenant when named, else all tenants."""
    return df if site_id is None else df.filter(F.col("site_id") == site_id)
