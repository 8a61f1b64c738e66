"""Newest ``n`` rows per key for any ``n`` (T1, T2, T3): one plan, whatever ``n`` is.

Spark's own cut for ``row_number() <= n`` before a shuffle ends at a threshold of ``n`` (1000 by default);
beyond it, a plain window sorts a key's whole history in one task.  Here the rows are cut in three steps, none of
which depends on ``n``:

1. Days: rows are counted by (key, day), with a map-side combine, and days are added up from the newest
   back until they hold ``n`` rows.  Earlier days of the key are dropped by a join with one row a key.
2. Slots: what is left of a key, its last day's surplus included, is dealt over ``SLOTS`` hash slots; each keeps
   its newest ``n`` rows.
3. The key: at most ``SLOTS * n`` rows meet, and the rank among them is the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.functions.timecols import utc_day

#: Hash slots a key's rows are dealt over.
SLOTS = 32
CALENDAR = ("Year", "Month", "Day")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def day_of(df: DataFrame, time_col: str) -> Column:
    """A row's UTC day: from the calendar columns, which a partitioned store has in its folders' names, or else
    from the time.  Rows without a time count as the oldest."""
    if set(CALENDAR) <= set(df.columns):
        day = F.make_date(*CALENDAR)
    else:
        day = utc_day(F.unix_micros(time_col))
    return F.coalesce(day, F.lit("0001-01-01").cast("date"))


def first_days(df: DataFrame, key: str, time_col: str, n: int) -> DataFrame:
    """``key`` (under that name) and ``first_day``, the day on which the newest ``n`` rows of a key begin."""
    named = df.select(F.col(key).alias("key"), day_of(df, time_col).alias("first_day"))
    counts = named.groupBy("key", "first_day").agg(F.count(F.lit(1)).alias("k"))
    newer = Window.partitionBy("key").orderBy(F.col("first_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("newer", F.coalesce(F.sum("k").over(newer), F.lit(0)))
    return found.where(F.col("newer") < n).groupBy("key").agg(F.min("first_day").alias("first_day"))


def newest(
    df: DataFrame, key: str, time_col: str, n: int, ties: Sequence[str] = (), rank: str = "rank", days: bool = True
) -> DataFrame:
    """The newest ``n`` rows of every key with their ``rank`` (1 is the newest); equal times are ordered by
    ``ties``, descending.  Rows with a null key are dropped.  ``days`` off leaves step 1 out: for tables that are
    small already, such as aggregates."""
    rows = df.where(F.col(key).isNotNull())
    if days:
        cut, name = fresh(df, "key"), fresh(df, "first_day")
        begins = first_days(rows, key, time_col, n).toDF(cut, name)
        oldest = begins.agg(F.min(name)).scalar()
        rows = rows.where(day_of(df, time_col) >= oldest)  # a partition filter on a store
        rows = rows.join(begins, (F.col(key) == F.col(cut)) & (day_of(df, time_col) >= F.col(name))).drop(cut, name)
    order = [F.col(c).desc() for c in (time_col, *ties)]
    slot = fresh(df, "slot")
    dealt = rows.withColumn(slot, F.pmod(F.xxhash64(time_col, *ties), F.lit(SLOTS)))
    for keys in ((key, slot), (key,)):
        ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        # written so that the plan is the same at every n: Spark's own cut knows ``rank <= n`` only
        dealt = ranked.where(F.col(rank) - F.lit(n) <= 0)
    return dealt.drop(slot)
