"""T1, T2 over a store: the newest rows of every symbol from the newest days alone.

The days are known from the folders' names.  One, two, four, ... of the newest are counted by symbol, until each
symbol that is asked for has its rows or all days are taken; the operator then reads those days.  A symbol with fewer
rows than asked for in the whole store takes the search to its end, which is the full read."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALENDAR = ("Year", "Month", "Day")


def since_day(df: DataFrame, day: _dt.date) -> DataFrame:
    """The rows from a day on; a filter on the folders' names."""
    return df.where(F.make_date(*CALENDAR) >= F.lit(day))


def search_back(
    df: DataFrame, days: Iterable[_dt.date], key: str, n: int, wanted: DataFrame, at_least: _dt.date | None = None
) -> tuple[DataFrame, _dt.date | None]:
    """The part of a store that holds the newest ``n`` rows of every key in ``wanted`` (its column ``key``) and the day
    it begins on; the whole store and None if the days don't suffice.  ``at_least``: days from here on are
    part of it in any case."""
    taken, ask = 0, 1
    for day in days:
        taken += 1
        if taken < ask or (at_least is not None and day > at_least):
            continue
        ask = 2 * taken
        part = since_day(df, day)
        have = part.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n)
        if wanted.join(have, key, "left_anti").isEmpty():
            return part, day
    return df, None
