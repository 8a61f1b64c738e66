"""The market questions as served, over the written tables.

Each method mirrors one REST call of the reference with the same parameters and defaults, but
returns a DataFrame and accepts one symbol, several, or ``None`` for all symbols at once.
Reads go through the serving reader, so a symbol restriction becomes a partition filter.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators.accounts import (
    bulk_delete,
    delete_counts,
    delete_outcome,
    list_accounts,
    lookup_accounts,
)
from tickflow.operators.candles import latest_candles
from tickflow.operators.latest import latest_book, latest_trades, requested_book
from tickflow.operators.stats import available_symbols, requested_stats, trade_stats
from tickflow.sources.files import layout_of, newest_days
from tickflow.sources.newest import search_back
from tickflow.sources.serving import read_table
from tickflow.streaming.registry import read_registry, registry_path


def _symbols(symbol) -> list[str] | None:
    if symbol is None:
        return None
    return [symbol] if isinstance(symbol, str) else list(symbol)


class Market:
    """Questions over ``<root>/trades`` and ``<root>/orderbook`` (symbol/day partitioned
    history) and two account tables.  A streamed history and a backfill are two roots."""

    def __init__(
        self,
        spark: SparkSession,
        root: str | Iterable[str],
        accounts: tuple[DataFrame, DataFrame] | None = None,
    ):
        self.spark = spark
        self.roots = [root] if isinstance(root, str) else list(root)
        self.accounts = accounts

    def _table(self, name: str, schema, symbols, symbol_col) -> DataFrame:
        paths = [os.path.join(r, name) for r in self.roots]
        return read_table(self.spark, paths, schema, symbols, symbol_col)

    def trades(self, symbol=None) -> DataFrame:
        return self._table("trades", S.TRADES, _symbols(symbol), "Symbol")

    def book(self, symbol=None) -> DataFrame:
        return self._table("orderbook", S.ORDERBOOK, _symbols(symbol), "symbol")

    def registry(self, name: str = "trades") -> DataFrame | None:
        """``symbol``, ``day`` and ``rows`` as the writers of a table registered them; None without a registry."""
        return read_registry(self.spark, [registry_path(r, name) for r in self.roots])

    def newest(self, name: str, df: DataFrame, symbol, symbol_col: str, n: int) -> DataFrame:
        """The newest days of ``df``, as many as give every registered symbol its newest ``n`` rows; all of ``df`` if the
        table has no registry or isn't stored by day."""
        known = self.registry(name)
        paths = [os.path.join(r, name) for r in self.roots]
        layouts = {layout_of(self.spark, p, symbol_col) for p in paths}
        if known is None or len(layouts) > 1 or None in layouts:
            return df
        below = symbol_col if layouts.pop()[0] == symbol_col else None
        wanted = known.select(F.col("symbol").alias(symbol_col)).distinct()
        if symbol is not None:
            wanted = wanted.where(F.col(symbol_col).isin(_symbols(symbol)))
        last = known.agg(F.max("day")).first()[0]  # later days may hold symbols not registered yet
        days = newest_days(self.spark, paths, below)
        return search_back(df, days, symbol_col, n, wanted, at_least=last)[0]

    # GET /api/price-history/{symbol}?interval=1m&limit=100
    def price_history(self, symbol=None, interval: str = "1m", limit: int = 100, as_of=None):
        return latest_candles(self.trades(symbol), interval, limit, as_of, lookback_hours=24)

    # GET /api/realtime/{symbol}?limit=10
    def realtime(self, symbol=None, limit: int = 10) -> DataFrame:
        return latest_trades(self.newest("trades", self.trades(symbol), symbol, "Symbol", limit), n=limit)

    # GET /api/stats/{symbol}?hours=24 ; a requested symbol without trades gets zeros
    def stats(self, symbol=None, hours: float = 24, as_of=None) -> DataFrame:
        syms = _symbols(symbol)
        if syms is None:
            return trade_stats(self.trades(), as_of, hours)
        requested = self.spark.createDataFrame([(s,) for s in syms], "symbol string")
        return requested_stats(self.trades(syms), requested, as_of, hours)

    # GET /api/orderbook/{symbol} ; a requested symbol without a book gets a message
    def orderbook(
        self, symbol=None, depth: int = 10, as_of=None, lookback_hours: float | None = None
    ) -> DataFrame:
        syms = _symbols(symbol)
        book = self.book(syms)
        if lookback_hours is None:
            book = self.newest("orderbook", book, syms, "symbol", 1)
        if syms is None:
            return latest_book(book, depth, as_of=as_of, lookback_hours=lookback_hours)
        requested = self.spark.createDataFrame([(s,) for s in syms], "symbol string")
        return requested_book(book, requested, depth, as_of, lookback_hours)

    # GET /api/symbols
    def symbols(self) -> DataFrame:
        known = self.registry()
        if known is not None:
            return known.select("symbol").distinct().orderBy("symbol")
        return available_symbols(self.trades())

    # GET /user/get_all, GET /user/get/{id}, DELETE /user/delete/{id} (bulk)
    def users(self) -> DataFrame:
        info, bal = self._accounts()
        return list_accounts(info, bal)

    def user(self, user_ids: Iterable[str] | DataFrame) -> DataFrame:
        info, bal = self._accounts()
        return lookup_accounts(info, bal, self._ids(user_ids))

    def delete_users(self, user_ids: Iterable[str] | DataFrame):
        """Returns (surviving info, surviving balance, per-id outcome, counts)."""
        info, bal = self._accounts()
        req = self._ids(user_ids)
        info2, bal2 = bulk_delete(info, bal, req)
        outcome = delete_outcome(info, req)
        return info2, bal2, outcome, delete_counts(outcome)

    def _accounts(self):
        if self.accounts is None:
            raise ValueError("no account tables given")
        return self.accounts

    def _ids(self, user_ids) -> DataFrame:
        if isinstance(user_ids, DataFrame):
            return user_ids.select("user_id")
        return self.spark.createDataFrame([(str(u),) for u in user_ids], "user_id string")
