"""Instants: four spellings, compared in UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmweave.functions.text import col, full_strip


def instant(c: Column | str) -> Column:
    """Text (``Z``, offset, naive with T or space) -> timestamp; NULL when unparsable."""
    s = full_strip(col(c).cast("string"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))


def at(moment: dt.datetime | str | Column) -> Column:
    """A given clock reading as a timestamp column (operators never read the clock)."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, dt.datetime):
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=dt.timezone.utc)
        moment = moment.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(moment).cast("timestamp")


def plus(c: Column, *, days: int | Column = 0, hours: int | Column = 0, minutes: int | Column = 0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return c + F.make_dt_interval(as_col(days), as_col(hours), as_col(minutes), F.lit(0))


def minus(c: Column, *, days: int = 0, hours: int = 0) -> Column:
    return c - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(0), F.lit(0))


def iso_z(c: Column) -> Column:
    """UTC whatever the session's zone, second precision, ``Z`` suffix."""
    utc = F.to_utc_timestamp(F.date_trunc("second", c), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
