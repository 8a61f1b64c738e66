"""S5 — serving-table contracts: fixed column types and (time, symbol) order.

The serving store declares whole-second times for trades and tickers, a 0/1 byte for the maker
flag and no NULL symbol, id or time.  ``conform`` casts a clean table to its contract; rows the
contract cannot hold go to ``rejects``, with the reason, instead of being silently written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    name: str
    schema: T.StructType
    sort_cols: tuple[str, ...]
    symbol_col: str
    second_cols: tuple[str, ...] = ()  # times stored at whole seconds
    required: tuple[str, ...] = ()  # never NULL, besides the symbol


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_ts, _d, _i, _s, _l = T.TimestampType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.LongType()
_arr = T.ArrayType(T.DoubleType())

TRADES = Contract(
    "trades",
    _schema(
        ("Symbol", _s), ("TradeID", _l), ("Price", _d), ("Quantity", _d),
        ("EventTime", _ts), ("TradeTime", _ts), ("IsBuyerMaker", T.ByteType()), ("Side", _s),
        ("TradeValue", _d), ("Year", _i), ("Month", _i), ("Day", _i), ("Hour", _i),
    ),
    ("TradeTime", "Symbol"),
    "Symbol",
    ("EventTime", "TradeTime"),
    ("TradeID", "EventTime", "TradeTime"),
)

TICKERS = Contract(
    "tickers",
    _schema(
        ("symbol", _s), ("event_type", _s), ("event_time", _ts), ("open_time", _ts),
        ("close_time", _ts), ("open_price", _d), ("close_price", _d), ("high_price", _d),
        ("low_price", _d), ("volume", _d), ("quote_volume", _d), ("Year", _i), ("Month", _i),
        ("Day", _i),
    ),
    ("event_time", "symbol"),
    "symbol",
    ("event_time", "open_time", "close_time"),
    ("event_time", "open_time", "close_time"),
)

ORDERBOOK = Contract(
    "orderbook",
    _schema(
        ("symbol", _s), ("event_time", _ts), ("bid_prices", _arr), ("bid_quantities", _arr),
        ("ask_prices", _arr), ("ask_quantities", _arr), ("Year", _i), ("Month", _i), ("Day", _i),
    ),
    ("event_time", "symbol"),
    "symbol",
    required=("event_time",),
)


def missing(c: Contract) -> Column:
    """The columns that are NULL though the contract has them, as text; empty if the row fits."""
    names = (c.symbol_col, *c.required)
    return F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.lit(n)) for n in names])


def _column(df: DataFrame, c: Contract, f: T.StructField) -> Column:
    col = F.col(f.name)
    if f.name in c.second_cols:
        col = F.date_trunc("second", col)
    if isinstance(f.dataType, T.ByteType):
        col = F.coalesce(col.cast("byte"), F.lit(0).cast("byte"))
    return col.cast(f.dataType).alias(f.name)


def conform(df: DataFrame, c: Contract, sort: bool = True) -> DataFrame:
    """Rows the contract can hold, cast and ordered as the contract says."""
    out = df.where(missing(c) == "").select(
        *[_column(df, c, f) for f in c.schema.fields]
    )
    return out.sortWithinPartitions(*c.sort_cols) if sort else out


def rejects(df: DataFrame, c: Contract) -> DataFrame:
    """Rows kept by the decoder but not storable under the contract; ``reason`` names the columns
    that are NULL."""
    return df.withColumn("reason", missing(c)).where(F.col("reason") != "")


def create_if_absent(spark: SparkSession, path: str, c: Contract) -> None:
    """Create an empty table with the contract's schema unless one is there (``ignore``)."""
    spark.createDataFrame([], c.schema).write.mode("ignore").parquet(path)
