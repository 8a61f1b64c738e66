"""Lookback trade statistics (A1, D14, F5, F6), requested-symbol defaults (A7) and the
symbol list (A5, T4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.numeric import round_fixed
from tickflow.operators.filters import select_symbols, since

_ROUNDED = ("total_volume", "avg_price", "min_price", "max_price")
NO_DATA = "No data found"


def trade_stats(
    trades: DataFrame,
    as_of=None,
    hours: float = 24,
    symbols: Iterable[str] | None = None,
    rounded: bool = True,
) -> DataFrame:
    """Per symbol over ``[as_of - hours, as_of]``-ish (lower edge inclusive): trade count,
    summed notional, average/min/max price.  One partial + final HashAggregate."""
    df = since(select_symbols(trades, symbols), "TradeTime", as_of, hours)
    out = (
        df.where(F.col("Symbol").isNotNull())
        .groupBy(F.col("Symbol").alias("symbol"))
        .agg(
            F.count(F.lit(1)).alias("total_trades"),
            F.sum("TradeValue").alias("total_volume"),
            F.avg("Price").alias("avg_price"),
            F.min("Price").alias("min_price"),
            F.max("Price").alias("max_price"),
        )
    )
    if rounded:
        out = out.select(
            "symbol", "total_trades", *[round_fixed(c, 2).alias(c) for c in _ROUNDED]
        )
    return out.withColumn("period_hours", F.lit(hours))


def requested_stats(
    trades: DataFrame,
    requested: DataFrame,
    as_of=None,
    hours: float = 24,
    rounded: bool = True,
) -> DataFrame:
    """Statistics for every requested symbol (column ``symbol``); a symbol without trades in
    the window gets zero count and volume, NULL prices and the message 'No data found'."""
    stats = trade_stats(trades, as_of, hours, rounded=rounded).drop("period_hours")
    j = requested.select("symbol").join(stats, "symbol", "left")
    return j.select(
        "symbol",
        F.coalesce("total_trades", F.lit(0)).cast("long").alias("total_trades"),
        F.coalesce("total_volume", F.lit(0.0)).alias("total_volume"),
        "avg_price",
        "min_price",
        "max_price",
        F.lit(hours).alias("period_hours"),
        F.when(F.col("total_trades").isNull(), F.lit(NO_DATA)).alias("message"),
    )


def available_symbols(trades: DataFrame) -> DataFrame:
    """Distinct symbols present in trades, ascending (A5, T4)."""
    return (
        trades.select(F.col("Symbol").alias("symbol"))
        .where(F.col("symbol").isNotNull())
        .distinct()
        .orderBy("symbol")
    )
