"""S7 — read the historical / serving tables with partition pruning.

The store is hive-partitioned by symbol and calendar day.  A time predicate alone prunes no
directory, so the reader states the day bounds on the partition columns as well.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    path: str | Iterable[str],
    contract: StructType | None = None,
    symbols: Iterable[str] | None = None,
    symbol_col: str = "Symbol",
    first_day: _dt.date | None = None,
    last_day: _dt.date | None = None,
) -> DataFrame:
    """Read a parquet table; optional symbol and day bounds become ``PartitionFilters``.

    With a ``contract`` the columns are read and returned in its order and types: partition values
    aren't guessed, so a symbol ``0700`` stays text.  Several paths, such as a streamed history
    and its backfill, are read as one table."""
    if not isinstance(path, str):
        parts = [
            read_table(spark, p, contract, symbols, symbol_col, first_day, last_day) for p in path
        ]
        return reduce(DataFrame.unionByName, parts)
    reader = spark.read if contract is None else spark.read.schema(contract)
    df = reader.parquet(path)
    if symbols is not None:
        df = df.where(F.col(symbol_col).isin(list(symbols)))
    day = F.make_date("Year", "Month", "Day")
    if first_day is not None:
        df = df.where(day >= F.lit(first_day))
    if last_day is not None:
        df = df.where(day <= F.lit(last_day))
    if contract is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields])
    return df
