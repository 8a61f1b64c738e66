"""Closed days of a streamed store rewritten into few sorted files, in a second root.

A stream at a 2 s trigger leaves thousands of small files in a day.  ``compact_days`` writes the days before a
given one into the second root and publishes a handover, which names the days and the version of their files.  Readers
take a day either from the first root or, once a handover names it, from that version: each row once, before, during and
after.  Version folders are never written again, and the handover is one small file that appears as a whole, so a
run that fails leaves files that nobody reads, and the next run starts over.

The first root is only read.  The handover counts the files that a day's rewrite was made from; files that a
late batch adds to a handed-over day are read from the first root until the next run takes them in."""

from __future__ import annotations

import datetime as _dt
import json
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.sources.files import CALENDAR, Folder
from tickflow.sources.serving import read_table

VERSION = "Version"
_DATA, _FILES, _HANDOVER = "data", "files", "_handover"
_DAY = re.compile(r"/Year=(\d+)/Month=(\d+)/Day=(\d+)/")


@dataclass(frozen=True)
class DayReport:
    """Files of a day before and after its rewrite."""

    day: _dt.date
    files_before: int
    files_after: int


@dataclass(frozen=True)
class Handed:
    """A day handed over: the version that holds it, and how many files of the first root it was made from."""

    version: int
    files: int


def _day(file: str) -> _dt.date | None:
    m = _DAY.search(file)
    return _dt.date(*map(int, m.groups())) if m else None


def handover(spark: SparkSession, target: str) -> dict[_dt.date, Handed]:
    """The days that the newest handover names."""
    folder = Folder(spark, target)
    names = [n for n in folder.names(f"{_HANDOVER}/*.json") if n[:1].isdigit()]
    if not names:
        return {}
    told = json.loads(folder.read(f"{_HANDOVER}/{max(names)}"))
    return {_dt.date.fromisoformat(d): Handed(**h) for d, h in told.items()}


def _versions(spark: SparkSession, target: str) -> int:
    folder = Folder(spark, target)
    used = [n.partition("=")[2] for n in folder.names(f"{_DATA}/{VERSION}=*")]
    used += [n.partition(".")[0] for n in folder.names(f"{_HANDOVER}/*.json")]
    return max((int(v) for v in used if v.isdigit()), default=0)


def compact_days(
    spark: SparkSession,
    root: str,
    target: str,
    contract: T.StructType,
    before: _dt.date,
    sort_cols: Sequence[str] = ("Symbol", "TradeTime"),
    publish: bool = True,
) -> list[DayReport]:
    """Rewrites the days of ``root`` before ``before`` that no handover names with all their files, and hands
    them over.  Files and rows come from one listing of the root, so a batch that commits meanwhile is in both or in
    neither."""
    listed = read_table(spark, root, contract)
    files = [(d, f) for f in listed.inputFiles() if (d := _day(f)) is not None and d < before]
    counts = Counter(d for d, _ in files)
    named = handover(spark, target)
    days = sorted(d for d, n in counts.items() if d not in named or named[d].files != n)
    if not days:
        return []
    version = _versions(spark, target) + 1
    rows = listed.where(F.make_date(*CALENDAR).isin(days)).hint("rebalance", *CALENDAR)
    rows = rows.sortWithinPartitions(*CALENDAR, *sort_cols)
    rows.write.partitionBy(*CALENDAR).parquet(f"{target}/{_DATA}/{VERSION}={version}")
    chosen = set(days)
    taken = [(d, f) for d, f in files if d in chosen]
    spark.createDataFrame(taken, "day date, file string").write.parquet(f"{target}/{_FILES}/{VERSION}={version}")
    told = named | {d: Handed(version, counts[d]) for d in days}
    if publish:
        text = json.dumps({d.isoformat(): vars(h) for d, h in sorted(told.items())})
        Folder(spark, target).publish(f"{_HANDOVER}/{version:09d}.json", text)
    after = Counter(_day(f) for f in _stored(spark, target, contract).inputFiles() if f"/{VERSION}={version}/" in f)
    return [DayReport(d, counts[d], after[d]) for d in days]


def _stored(spark: SparkSession, target: str, contract: T.StructType) -> DataFrame:
    schema = T.StructType([*contract.fields, T.StructField(VERSION, T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{target}/{_DATA}")


def _late(spark: SparkSession, files: list[str], target: str, named: dict[_dt.date, Handed]) -> list[str]:
    """Files of handed-over days that their rewrite doesn't hold."""
    counts = Counter(_day(f) for f in files)
    days = [d for d, h in named.items() if counts[d] != h.files]
    if not days:
        return []
    held: set[str] = set()
    for version in {named[d].version for d in days}:
        known = spark.read.parquet(f"{target}/{_FILES}/{VERSION}={version}").where(F.col("day").isin(days))
        held.update(r.file for r in known.toLocalIterator())
    return [f for f in files if _day(f) in days and f not in held]


def read_compacted(
    spark: SparkSession,
    root: str,
    target: str,
    contract: T.StructType,
    symbols: Sequence[str] | None = None,
    symbol_col: str = "Symbol",
) -> DataFrame:
    """The store as one table: handed-over days from their versions, the others from the first root."""
    listed = read_table(spark, root, contract, symbols, symbol_col)
    named = handover(spark, target)
    if not named:
        return listed
    day = F.make_date(*CALENDAR)
    out = listed.where(~day.isin(list(named)) | day.isNull())
    late = _late(spark, listed.inputFiles(), target, named)
    if late:
        reader = spark.read.schema(contract).option("basePath", root)
        added = reader.parquet(*late).select(*contract.fieldNames())
        out = out.unionByName(added if symbols is None else added.where(F.col(symbol_col).isin(list(symbols))))
    in_use = F.lit(False)
    for version in sorted({h.version for h in named.values()}):
        of = [d for d, h in named.items() if h.version == version]
        in_use |= (F.col(VERSION) == version) & day.isin(of)
    stored = _stored(spark, target, contract).where(in_use).select(*contract.fieldNames())
    return out.unionByName(stored if symbols is None else stored.where(F.col(symbol_col).isin(list(symbols))))
