"""OHLCV candles (A2, A3, A4), newest-N candles (T3) and display rounding.

Plan shape: scan -> bucket projection -> partial HashAggregate on (symbol, bucket) ->
exchange on (symbol, bucket) -> final HashAggregate.  The map side emits one partial row per
(symbol, bucket) it saw, so a symbol holding a third of all trades still sends only a handful of
rows per map task through the shuffle.  Open/close use ``min_by``/``max_by`` over a packed
``(time, id)`` key so that they stay in HashAggregate (see ``functions.ordering``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.numeric import round_by_quote
from tickflow.functions.ordering import time_id_key
from tickflow.functions.timecols import bucket_start
from tickflow.operators.filters import select_symbols, since
from tickflow.operators.ranking import newest

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


def candles(
    trades: DataFrame,
    interval: str = "1m",
    as_of=None,
    lookback_hours: float | None = None,
    symbols: Iterable[str] | None = None,
    rounded: bool = True,
) -> DataFrame:
    """One row per (symbol, bucket): open, high, low, close, volume (sum of notional), trades.

    ``interval`` is one of 1m 5m 15m 1h 4h 1d; any other value buckets by 1m while the
    ``interval`` column still echoes the request.  ``lookback_hours=None`` takes all history.
    """
    df = select_symbols(trades, symbols)
    if lookback_hours is not None:
        df = since(df, "TradeTime", as_of, lookback_hours)
    df = df.where(F.col("Symbol").isNotNull() & F.col("TradeTime").isNotNull())
    key = time_id_key("TradeTime", "TradeID")
    out = df.groupBy(
        F.col("Symbol").alias("symbol"),
        bucket_start("TradeTime", interval).alias("timestamp"),
    ).agg(
        F.min_by("Price", key).alias("open"),
        F.max("Price").alias("high"),
        F.min("Price").alias("low"),
        F.max_by("Price", key).alias("close"),
        F.sum("TradeValue").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    if rounded:
        out = out.select(
            "symbol",
            "timestamp",
            *[round_by_quote(c, "symbol").alias(c) for c in PRICE_COLUMNS],
            "trades",
        )
    return out.select("symbol", F.lit(interval).alias("interval"), *out.columns[1:])


def latest_candles(
    trades: DataFrame,
    interval: str = "1m",
    limit: int = 100,
    as_of=None,
    lookback_hours: float | None = 24,
    symbols: Iterable[str] | None = None,
    rounded: bool = True,
) -> DataFrame:
    """Price history as served: last ``lookback_hours`` before ``as_of``, newest ``limit``
    candles per symbol (T3).  The per-symbol limit runs on the aggregated candles."""
    c = candles(trades, interval, as_of, lookback_hours, symbols, rounded)
    return newest(c, "symbol", "timestamp", limit, rank="rn", days=False).drop("rn")
