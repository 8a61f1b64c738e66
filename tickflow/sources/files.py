"""Folders of a store as its file system shows them: names only, no data file is opened.

Goes through Hadoop's file system, so any path that Spark can read works."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import SparkSession

CALENDAR = ("Year", "Month", "Day")


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, pattern: str) -> list[str]:
        """The last parts of the paths that match a pattern below the folder."""
        found = self._fs.globStatus(self._at(pattern))
        return [f.getPath().getName() for f in found] if found is not None else []

    def read(self, name: str) -> str:
        return self.spark.read.text(str(self._at(name).toString()), wholetext=True).first()[0]

    def publish(self, name: str, text: str) -> None:
        """Writes a small file that is either there as a whole or not at all; fails if it is there already."""
        at, hidden = self._at(name), self._at(f"{name.rpartition('/')[0]}/.{name.rpartition('/')[2]}.new")
        out = self._fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) or not self._fs.rename(hidden, at):
            raise FileExistsError(f"{self.path}/{name}")

    def _at(self, name: str):
        return self._new(f"{self.path}/{name}" if name else self.path)


def newest_days(spark: SparkSession, paths: Iterable[str], below: str | None = None) -> Iterator[_dt.date]:
    """The days of stores in ``Year=/Month=/Day=`` folders, newest first, listed as they are asked for.  ``below``
    is the partition column above them, if there is one (``Symbol``)."""
    folders = [Folder(spark, p) for p in paths]
    top = f"{below}=*/" if below else ""

    def values(pattern: str, column: str) -> list[int]:
        names = {n for f in folders for n in f.names(f"{top}{pattern}{column}=*")}
        found = (unquote(n).partition("=")[2] for n in names)
        return sorted((int(v) for v in found if v.lstrip("-").isdigit()), reverse=True)

    for year in values("", "Year"):
        for month in values(f"Year={year}/", "Month"):
            for day in values(f"Year={year}/Month={month}/", "Day"):
                yield _dt.date(year, month, day)


def layout_of(spark: SparkSession, path: str, symbol_col: str = "Symbol") -> tuple[str, ...] | None:
    """The partition columns of a store: the days', with the symbol above them or not; None for another layout."""
    folder = Folder(spark, path)
    if folder.names("Year=*"):
        return CALENDAR
    if folder.names(f"{symbol_col}=*/Year=*"):
        return (symbol_col, *CALENDAR)
    return None
