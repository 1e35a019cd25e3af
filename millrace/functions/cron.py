"""Schedules in five fields: minute, hour, day of month, month, day of week."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import zones

HORIZON_DAYS = 1500
# Names of months and days, and short forms of whole schedules.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
SHORT = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}


def named(text: str, names: list[str], first: int) -> str:
    """A field with names as numbers."""
    return re.sub(r"[a-z]{3}", lambda m: str(names.index(m[0]) + first) if m[0] in names else m[0], text.lower())


def field(text: str, low: int, high: int) -> list[int]:
    """The values of one field: lists of `*`, `a`, `a-b`, each with an optional `/step`; `a/step` goes on to the last value."""
    values = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first = low if span == "*" else int(a)
        last = high if span == "*" or (step and not b) else int(b or a)
        if not (low <= first <= last <= high) or (step and int(step) < 1):
            raise ValueError(f"not a field of a schedule: {text}")
        values.update(range(first, last + 1, int(step or 1)))
    return sorted(values)


def next_runs(rows: DataFrame, at: str, schedule: str) -> DataFrame:
    """rows with `next_run`, the first moment of the schedule strictly after the minute of `at`; null past the horizon.

    If both day fields are restricted, either suffices. Days are looked up once
    for each date that occurs.
    """
    minute, hour, day, month, week = SHORT.get(schedule.strip().lower(), schedule).split()
    month, week = named(month, MONTHS, 1), named(week, DAYS, 0)
    times = [h * 60 + m for h in field(hour, 0, 23) for m in field(minute, 0, 59)]
    days, months, weekdays = field(day, 1, 31), field(month, 1, 12), {d % 7 for d in field(week, 0, 7)}

    def runs_on(d: Column) -> Column:
        of_month, of_week = F.dayofmonth(d).isin(days), (F.dayofweek(d) - 1).isin(sorted(weekdays))
        either = of_month | of_week if day != "*" and week != "*" else of_month & of_week
        return F.month(d).isin(months) & either

    dates = rows.select(F.to_date(at).alias("_date")).where("_date is not null").distinct()
    later = F.array_min(F.filter(F.sequence(F.date_add("_date", 1), F.date_add("_date", HORIZON_DAYS)), runs_on))
    calendar = dates.select(F.col("_date").alias("_day"), runs_on(F.col("_date")).alias("_runs"), later.alias("_later"))
    now = F.hour(at) * 60 + F.minute(at)
    rest = F.when(F.col("_runs"), F.array_min(F.filter(F.array(*map(F.lit, times)), lambda t: t > now)))
    start = F.when(rest.isNotNull(), F.to_date(at)).otherwise(F.col("_later")).cast("timestamp")
    met = rows.join(calendar, F.to_date(at) == F.col("_day"), "left")
    return met.withColumn("next_run", F.timestamp_add("MINUTE", F.coalesce(rest, F.lit(times[0])), start)).drop("_day", "_runs", "_later")


def first_inside(rows: DataFrame, at: str, schedule: str, zone: str = "UTC", window: tuple[int, int] | None = None, days: int = HORIZON_DAYS) -> DataFrame:
    """rows with `next_run`, the first moment of the schedule after the minute of `at` whose minute of the zone's day is in the half-open window, which may go past midnight.

    Moments are timestamps without zone in UTC, the schedule and the window read the zone's clock. A time that the clock jumps over is none, of
    one that it shows twice the first is meant. null where `days` hold none, and where `at` is null. The times of a day inside the window are
    a constant, so the search is over dates alone, once for each date that occurs.
    """
    minute, hour, day, month, week = SHORT.get(schedule.strip().lower(), schedule).split()
    month, week = named(month, MONTHS, 1), named(week, DAYS, 0)
    months, of_month = field(month, 1, 12), field(day, 1, 31)
    of_week = sorted({d % 7 for d in field(week, 0, 7)})
    inside = lambda m: window is None or (window[0] <= m < window[1] if window[0] <= window[1] else m >= window[0] or m < window[1])
    times = [m for h in field(hour, 0, 23) for m in (h * 60 + m for m in field(minute, 0, 59)) if inside(m)]
    if not times:
        return rows.withColumn("next_run", F.lit(None).cast("timestamp_ntz"))

    def runs_on(d: Column) -> Column:
        a, b = F.dayofmonth(d).isin(of_month), (F.dayofweek(d) - 1).isin(of_week)
        return F.month(d).isin(months) & (a | b if day != "*" and week != "*" else a & b)

    def moments(d: Column) -> Column:
        each = F.transform(F.array(*map(F.lit, times)), lambda t: zones.moment_of(F.timestamp_add("MINUTE", t, d.cast("timestamp_ntz")), zone))
        return F.array_compact(each)

    local = F.to_date(zones.local_of(F.col(at), zone))
    dates = rows.select(local.alias("_day")).where("_day is not null").distinct()
    # a day's times can lie in a gap of the clock or be over, so three later days of the schedule are enough
    later = F.slice(F.filter(F.sequence(F.date_add("_day", -1), F.date_add("_day", days)), runs_on), 1, 5)
    calendar = dates.select("_day", F.array_sort(F.flatten(F.transform(later, moments))).alias("_moments"))
    met = rows.withColumn("_local", local).join(calendar, F.col("_local") == F.col("_day"), "left")
    now = F.date_trunc("minute", F.col(at)).cast("timestamp_ntz")
    return met.withColumn("next_run", F.array_min(F.filter("_moments", lambda m: m > now))).drop("_local", "_day", "_moments")
