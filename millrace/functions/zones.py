"""Clocks of zones with daylight saving; moments are timestamps without zone in UTC, so the session's zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_of(moment: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)


def moment_of(local: Column, zone: str) -> Column:
    """The moment when a zone's clock shows `local`: the first of two, null if the clock jumps over it."""
    moment = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.when(local_of(moment, zone) == local, moment)


def minute_in_zone(moment: Column, zone: str) -> Column:
    local = local_of(moment, zone)
    return F.hour(local) * 60 + F.minute(local)
