"""Moments, durations, numbers and sizes as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ms: Column, millis: bool = False) -> Column:
    """Milliseconds since 1970 as a UTC moment."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if millis else "") + "'Z'")


def iso_offset(seconds: Column, minutes: Column) -> Column:
    """Seconds since 1970 as a moment in a zone so many minutes from UTC."""
    sign, far = F.when(minutes < 0, "-").otherwise("+"), F.abs(minutes)
    zone = F.format_string("%s%02d:%02d", sign, F.floor(far / 60).cast("int"), (far % 60).cast("int"))
    return F.concat(F.date_format(F.timestamp_seconds(seconds + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss"), zone)


def time_bound(text: Column) -> Column:
    """Seconds since 1970 of an integer, a date, or a date and time with T or a space and perhaps Z; null for anything else."""
    whole = F.when(text.rlike(r"^-?\d{1,18}$"), text.cast("bigint"))
    day = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.unix_date(F.try_to_date(text)).cast("bigint") * 86400)
    plain = F.regexp_replace(F.replace(text, F.lit("T"), F.lit(" ")), "Z$", "")
    moment = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\dZ?$"), F.unix_seconds(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss"))))
    return F.coalesce(whole, day, moment)


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm of a number of seconds."""
    ms = F.round(seconds * 1000).cast("bigint")
    part = lambda by, of: (F.floor(ms / by) % of).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), (ms % 1000).cast("int"))


def seconds_of(text: Column) -> Column:
    """Seconds of `S`, `MM:SS` or `HH:MM:SS`, with a fraction after a point or a comma; null for anything else."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    return F.when(F.trim(text).rlike(r"^(\d+:){0,2}\d+([.,]\d+)?$"), F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.cast("double")))


def minute_of_day(text: Column) -> Column:
    """Minutes since midnight of HH:MM; null where that is no time of day."""
    return F.when(text.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$"), F.split_part(text, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).cast("int"))


def retry_after(text: Column, most: int) -> Column:
    """Whole seconds to wait, at most `most`; null for what is no number of seconds."""
    return F.when(F.trim(text).rlike(r"^\d{1,9}$"), F.least(F.trim(text).cast("int"), F.lit(most)))


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit and one decimal beyond bytes."""
    unit = F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB", "TiB")))
    power = F.least(F.when(n > 0, F.floor(F.log(1024.0, n.cast("double")) + 1e-12)).otherwise(0), F.lit(4)).cast("int")
    return F.when(power == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.format_string("%.1f %s", n / F.pow(F.lit(1024.0), power), F.get(unit, power)))


def percent(part: Column, whole: Column) -> Column:
    """A percentage; all of nothing is 100."""
    return F.when(whole == 0, 100.0).otherwise(F.try_divide(part * 100.0, whole))


def backoff(failures: Column, base_s: int, most_s: int) -> Column:
    """Seconds to wait after failures in a row: none, then doubling up to a ceiling."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(base_s) * F.pow(F.lit(2.0), F.least(failures, F.lit(40)) - 1), F.lit(float(most_s))).cast("bigint"))


def scaled(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height shrunk so that the longer side is at most `most`, at least one each."""
    factor = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * factor + 0.5)).cast("bigint")
    return side(width), side(height)


def base64_bound(length: Column) -> Column:
    """Bytes that so many characters of base64 hold at most."""
    return (F.floor((length + 3) / 4) * 3).cast("bigint")
