"""Time helpers: epoch-ms <-> timestamp, calendar columns, candle buckets, text forms.

All of them are UTC, computed on epoch microseconds, and don't depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candle intervals and their widths in microseconds; unknown names fall back to 1m.
INTERVALS = {
    "1m": 60_000_000,
    "5m": 300_000_000,
    "15m": 900_000_000,
    "1h": 3_600_000_000,
    "4h": 14_400_000_000,
    "1d": 86_400_000_000,
}
DEFAULT_INTERVAL = "1m"

DAY = 86_400_000_000
#: Years 1 to 9999: what a timestamp can be printed and stored as.
MIN_MS, MAX_MS = -62_135_596_800_000, 253_402_300_799_999


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_to_ts(ms) -> Column:
    """Epoch milliseconds -> timestamp (exact; same as ``(ms / 1000).cast('timestamp')``).  A value
    outside the years 1 to 9999 gives NULL: one bad message must not fail its batch."""
    m = _col(ms)
    return F.when(m.between(MIN_MS, MAX_MS), F.timestamp_millis(m))


def utc_day(us: Column) -> Column:
    """The UTC date of epoch microseconds."""
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(DAY))) / F.lit(DAY)).cast("int"))


def ts_to_ms(ts) -> Column:
    """Timestamp -> epoch milliseconds, truncating sub-millisecond digits."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def calendar_columns(ts, hour: bool = False) -> dict[str, Column]:
    """Year / Month / Day (/ Hour) of a timestamp in UTC, as int columns."""
    us = F.unix_micros(_col(ts))
    t = utc_day(us)
    cols = {"Year": F.year(t), "Month": F.month(t), "Day": F.dayofmonth(t)}
    if hour:
        cols["Hour"] = F.floor(F.pmod(us, F.lit(DAY)) / F.lit(3_600_000_000)).cast("int")
    return cols


def interval_width(interval: str) -> int:
    return INTERVALS.get(interval, INTERVALS[DEFAULT_INTERVAL])


def bucket_start(ts, interval: str) -> Column:
    """Epoch-aligned start of the candle bucket holding ``ts`` (floor, also before 1970)."""
    width = F.lit(interval_width(interval))
    us = F.unix_micros(_col(ts))
    return F.timestamp_micros(us - F.pmod(us, width))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("long").cast("string"), width, "0")


def _clock(us: Column, between: str) -> Column:
    """The UTC date and time of day of epoch microseconds, whole seconds."""
    second = F.floor(F.pmod(us, F.lit(DAY)) / F.lit(1_000_000))
    parts = [F.floor(second / 3600), F.pmod(F.floor(second / 60), F.lit(60)), F.pmod(second, F.lit(60))]
    time = F.concat_ws(":", *[_padded(p, 2) for p in parts])
    return F.concat(utc_day(us).cast("string"), F.lit(between), time)


def iso_text(ts) -> Column:
    """ISO-8601 text as Python's ``datetime.isoformat()`` prints a naive UTC time:
    no fraction when the sub-second part is zero, else six fraction digits."""
    us = F.unix_micros(_col(ts))
    micros = F.pmod(us, F.lit(1_000_000))
    base = _clock(us, "T")
    return F.when(micros == 0, base).otherwise(F.concat(base, F.lit("."), _padded(micros, 6)))


def ms_text(ms) -> Column:
    """Epoch ms -> 'yyyy-MM-dd HH:mm:ss.SSS'; NULL and 0 (falsy) give NULL."""
    m = _col(ms)
    us = F.unix_micros(ms_to_ts(m))
    millis = F.floor(F.pmod(us, F.lit(1_000_000)) / 1000)
    return F.when(m != 0, F.concat(_clock(us, " "), F.lit("."), _padded(millis, 3)))
