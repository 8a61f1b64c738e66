"""Latest-N trades (T1), latest book snapshot with top levels and spread (T2, D11-D13), and the
flat level view of a book.

Both "latest" operators cut a symbol's rows by days and hash slots before they rank them
(``operators.ranking``), with one plan for every ``n``: no symbol's history meets one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.book import DEFAULT_DEPTH, spread, zip_levels
from tickflow.operators.filters import select_symbols, since
from tickflow.operators.ranking import newest

NO_BOOK = "No orderbook data"


def latest_trades(
    trades: DataFrame, n: int = 10, symbols: Iterable[str] | None = None
) -> DataFrame:
    """Newest ``n`` trades per symbol; equal times are ordered by TradeID (newest first)."""
    df = select_symbols(trades, symbols)
    ranked = newest(df, "Symbol", "TradeTime", n, ("TradeID",))
    return ranked.select(
        F.col("Symbol").alias("symbol"),
        "rank",
        F.col("TradeTime").alias("time"),
        F.col("Price").alias("price"),
        F.col("Quantity").alias("quantity"),
        F.col("Side").alias("side"),
        F.col("TradeValue").alias("value"),
    )


def latest_book(
    book: DataFrame,
    depth: int = DEFAULT_DEPTH,
    symbols: Iterable[str] | None = None,
    as_of=None,
    lookback_hours: float | None = None,
) -> DataFrame:
    """Newest snapshot per symbol: ``bids``/``asks`` as ``array<struct<price, quantity>>`` (first
    ``depth`` levels in arrival order, shorter of price/quantity arrays wins) and ``spread``.

    By default the whole history is searched, as the reference does.  With ``lookback_hours``
    only snapshots in ``[as_of - lookback, ...)`` are considered, which on the day-partitioned
    store prunes the scan to the last days; a symbol without a snapshot in that window is absent.
    """
    df = select_symbols(book, symbols, col="symbol")
    if lookback_hours is not None:
        df = since(df, "event_time", as_of, lookback_hours)
    # Ties on event_time are broken by content so that the pick is repeatable.
    top = newest(df, "symbol", "event_time", 1, ("ask_prices", "bid_prices"))
    sides = top.select(
        "symbol",
        "event_time",
        zip_levels("bid_prices", "bid_quantities", depth).alias("bids"),
        zip_levels("ask_prices", "ask_quantities", depth).alias("asks"),
    )
    return sides.withColumn("spread", spread("bids", "asks"))


def requested_book(
    book: DataFrame,
    requested: DataFrame,
    depth: int = DEFAULT_DEPTH,
    as_of=None,
    lookback_hours: float | None = None,
) -> DataFrame:
    """The latest book of every requested symbol (column ``symbol``); a symbol without a
    snapshot gets NULLs and the message 'No orderbook data'."""
    found = latest_book(book, depth, as_of=as_of, lookback_hours=lookback_hours)
    found = found.withColumn("found", F.lit(True))
    message = F.when(F.col("found").isNull(), F.lit(NO_BOOK)).alias("message")
    return requested.select("symbol").join(found, "symbol", "left").select(
        *found.drop("found").columns, message
    )


def book_levels(book: DataFrame, depth: int | None = None) -> DataFrame:
    """Flat view, one row per (symbol, event_time, side, level): level 1 is the first level as
    delivered.  Accepts a decoded book (parallel arrays) or ``latest_book`` output.

    Both sides come out of one pass: a two-element array of (side, levels) is exploded, then
    the levels (a union of a bid branch and an ask branch would compute the input twice)."""
    if "bids" not in book.columns:
        book = book.select(
            "symbol",
            "event_time",
            zip_levels("bid_prices", "bid_quantities", depth).alias("bids"),
            zip_levels("ask_prices", "ask_quantities", depth).alias("asks"),
        )
    sides = F.array(
        F.struct(F.lit("bid").alias("side"), F.col("bids").alias("levels")),
        F.struct(F.lit("ask").alias("side"), F.col("asks").alias("levels")),
    )
    per_side = book.select("symbol", "event_time", F.inline(sides))
    return per_side.select(
        "symbol", "event_time", "side", F.posexplode("levels").alias("pos", "lvl")
    ).select(
        "symbol",
        "event_time",
        "side",
        (F.col("pos") + 1).alias("level"),
        F.col("lvl.price").alias("price"),
        F.col("lvl.quantity").alias("quantity"),
    )
