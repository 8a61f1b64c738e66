"""Wire schemas of the three feeds and the column contracts of the clean tables.

The JSON keys of the exchange feeds differ only by case (``e``/``E``, ``t``/``T``, ``o``/``O`` ...).
Resolving ``data.e`` against a struct that also holds ``E`` is ambiguous unless the session runs
case-sensitive, and a library must not depend on that flag.  So each feed is parsed with a struct
of the *wire* names (``from_json`` matches JSON keys exactly) and the parsed struct is then cast,
position by position, to a struct of distinct internal names.  One parse, no session flag.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: wire field names and types of the three feeds, in wire order. -------------
# Each entry: (JSON key, Spark type, internal name used after the positional rename).
TRADE_WIRE = [
    ("e", T.StringType(), "event_type"),
    ("E", T.LongType(), "event_ms"),
    ("s", T.StringType(), "symbol"),
    ("t", T.LongType(), "trade_id"),
    ("p", T.StringType(), "price"),
    ("q", T.StringType(), "quantity"),
    ("b", T.LongType(), "buyer_order_id"),
    ("a", T.LongType(), "seller_order_id"),
    ("T", T.LongType(), "trade_ms"),
    ("m", T.BooleanType(), "buyer_is_maker"),
    ("M", T.BooleanType(), "ignore_flag"),
]

TICKER_WIRE = [
    ("e", T.StringType(), "event_type"),
    ("E", T.LongType(), "event_ms"),
    ("s", T.StringType(), "symbol"),
    ("O", T.LongType(), "open_ms"),
    ("C", T.LongType(), "close_ms"),
    ("o", T.StringType(), "open"),
    ("h", T.StringType(), "high"),
    ("l", T.StringType(), "low"),
    ("c", T.StringType(), "close"),
    ("v", T.StringType(), "volume"),
    ("q", T.StringType(), "quote_volume"),
]

_LEVELS = T.ArrayType(T.ArrayType(T.StringType()))
BOOK_WIRE = [
    ("e", T.StringType(), "event_type"),
    ("E", T.LongType(), "event_ms"),
    ("s", T.StringType(), "symbol"),
    ("b", _LEVELS, "bids"),
    ("a", _LEVELS, "asks"),
]

# Fields each decoder actually reads; unread wire fields are not declared, so the JSON parser
# does not materialise them.
TRADE_USED = ("E", "s", "t", "p", "q", "T", "m")
TICKER_USED = ("e", "E", "s", "O", "C", "o", "h", "l", "c", "v", "q")
BOOK_USED = ("E", "s", "b", "a")


def wire_struct(wire, used=None) -> T.StructType:
    """Struct with the JSON keys as field names (for ``from_json``)."""
    return T.StructType(
        [T.StructField(k, t) for k, t, _ in wire if used is None or k in used]
    )


def internal_struct(wire, used=None) -> T.StructType:
    """Same struct, same order, fields renamed to their distinct internal names."""
    return T.StructType(
        [T.StructField(n, t) for k, t, n in wire if used is None or k in used]
    )


# --- Clean tables (output of the decoders). ----------------------------------------------------
TRADES = T.StructType(
    [
        T.StructField("Symbol", T.StringType()),
        T.StructField("TradeID", T.LongType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("EventTime", T.TimestampType()),
        T.StructField("TradeTime", T.TimestampType()),
        T.StructField("IsBuyerMaker", T.BooleanType()),
        T.StructField("Side", T.StringType()),
        T.StructField("TradeValue", T.DoubleType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("Hour", T.IntegerType()),
    ]
)

TICKERS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("open_time", T.TimestampType()),
        T.StructField("close_time", T.TimestampType()),
        T.StructField("open_price", T.DoubleType()),
        T.StructField("high_price", T.DoubleType()),
        T.StructField("low_price", T.DoubleType()),
        T.StructField("close_price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
    ]
)

_DOUBLES = T.ArrayType(T.DoubleType())
ORDERBOOK = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("bid_prices", _DOUBLES),
        T.StructField("bid_quantities", _DOUBLES),
        T.StructField("ask_prices", _DOUBLES),
        T.StructField("ask_quantities", _DOUBLES),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
    ]
)

# --- Accounts (string maps in the key-value store; one row per account here). -----------------
ACCOUNT_INFO = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)
ACCOUNT_BALANCE = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("usd", T.StringType()),
        T.StructField("btc", T.StringType()),
        T.StructField("reserved_usd", T.StringType()),
        T.StructField("reserved_btc", T.StringType()),
    ]
)

# Hive-style partition columns of the historical parquet store, per feed (the reference's layout).
# With thousands of symbols, DAY_PARTITIONS keeps the folder count at one per day; files are then
# sorted by (symbol, time) so that a symbol filter skips row groups by their min/max statistics.
DAY_PARTITIONS = ("Year", "Month", "Day")
TRADES_PARTITIONS = ("Symbol", "Year", "Month", "Day")
TICKERS_PARTITIONS = ("symbol", "Year", "Month", "Day")
ORDERBOOK_PARTITIONS = ("symbol", "Year", "Month", "Day")
