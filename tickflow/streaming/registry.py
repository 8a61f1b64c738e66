"""A5 without opening data files: a small table beside the store that its writers keep, with one row for each symbol
and day of a batch.  Readers merge the rows.

A batch write (backfill) counts the months it wrote to in the store itself and replaces these months' rows, so a day that is
written again is right again; a stream adds one row a symbol and day for each micro-batch, replay-safe by the batch's number.
A registry is written after its store: what a failure leaves between the two is mended by the write's next run."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.sources.files import CALENDAR, Folder

SCHEMA = "symbol string, rows long, Day int, Year int, Month int"
BATCHED, STREAMED = "by_month", "by_batch"


def registry_path(root: str, name: str) -> str:
    """The registry of the store ``<root>/<name>``."""
    return os.path.join(root, "symbols", name)


def symbol_days(df: DataFrame, symbol_col: str) -> DataFrame:
    named = df.where(F.col(symbol_col).isNotNull())
    counted = named.groupBy(F.col(symbol_col).alias("symbol"), *CALENDAR).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("symbol", "rows", *CALENDAR)


def write_months(store: DataFrame, months: Iterable[tuple[int, int]], path: str, symbol_col: str) -> None:
    """Replaces the rows of some months by those of the store, of which only folders' names and symbols are read."""
    month = F.col("Year") * 100 + F.col("Month")
    part = store.where(month.isin([100 * y + m for y, m in months]))
    out = symbol_days(part, symbol_col).repartition(1)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Year", "Month").parquet(
        os.path.join(path, BATCHED)
    )


def read_registry(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """``symbol``, ``day`` and ``rows`` of several registries; None if one of them isn't there."""
    out = None
    for path in paths:
        there = [p for p in (BATCHED, STREAMED) if Folder(spark, path).exists(p)]
        if not there:
            return None
        for part in there:
            df = spark.read.schema(SCHEMA).parquet(os.path.join(path, part))
            df = df.select("symbol", F.make_date(*CALENDAR).alias("day"), "rows")
            out = df if out is None else out.unionByName(df)
    return out
