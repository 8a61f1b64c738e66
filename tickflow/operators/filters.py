"""F5 symbol selection and F6 lookback, with an explicit ``as_of`` instead of ``now()``."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.functions.timecols import utc_day


def as_of_column(as_of) -> Column:
    """``None`` -> ``current_timestamp()``; a Column as it is; a datetime or ISO text -> that instant,
    in UTC if it names no zone, whatever the zones of the driver and the session are."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=_dt.UTC)
    micros = (as_of - _dt.datetime(1970, 1, 1, tzinfo=_dt.UTC)) // _dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros).cast("long"))


def latest_time(df: DataFrame, ts_col: str) -> Column:
    """max(ts) of ``df`` as a scalar subquery (evaluated once, on the executors)."""
    return df.select(F.max(ts_col)).scalar()


def select_symbols(df: DataFrame, symbols: Iterable[str] | None, col: str = "Symbol") -> DataFrame:
    """keep the given symbols (all when ``None``).  Pushed to the scan / partition filter."""
    if symbols is None:
        return df
    return df.where(F.col(col).isin(list(symbols)))


def since(df: DataFrame, ts_col: str, as_of, hours: float) -> DataFrame:
    """rows with ``ts >= as_of - hours`` (inclusive edge; parts of an hour count).

    A table with the calendar partition columns gets the same bound on ``make_date(Year, Month,
    Day)``, since a time predicate alone prunes no folder: a literal and ``current_timestamp()`` fold into
    a partition filter, a scalar subquery prunes at run time."""
    cutoff = F.unix_micros(as_of_column(as_of)) - F.lit(round(hours * 3_600_000_000)).cast("long")
    out = df.where(F.col(ts_col) >= F.timestamp_micros(cutoff))
    if {"Year", "Month", "Day"} <= set(df.columns):
        out = out.where(F.make_date("Year", "Month", "Day") >= utc_day(cutoff))
    return out
