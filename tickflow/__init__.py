"""tickflow — market-data feeds and market questions as Spark DataFrame operators.

Layout
------
- ``tickflow.schemas``      wire schemas of the three feeds and the clean/serving contracts
- ``tickflow.functions``    Column -> Column helpers (numbers, time, ordering keys, book levels)
- ``tickflow.operators``    DataFrame -> DataFrame operators (decode, candles, stats, latest, accounts, publish)
- ``tickflow.sources``      Kafka / file stream sources, serving-table reader, feeds derived from tables
- ``tickflow.streaming``    stream sinks, triggers and the fan-out wiring
- ``tickflow.plans``        session helpers, serving contracts, plan inspection

Every operator takes and returns a DataFrame, works on batch and streaming input where that is
meaningful, covers all symbols at once, and never pulls rows to the driver.
"""

from tickflow.operators.decode import decode_book, decode_tickers, decode_trades
from tickflow.operators.candles import candles, latest_candles
from tickflow.operators.stats import available_symbols, requested_stats, trade_stats
from tickflow.operators.latest import book_levels, latest_book, latest_trades
from tickflow.operators.accounts import (
    bulk_delete,
    delete_outcome,
    list_accounts,
    lookup_accounts,
)
from tickflow.operators.publish import publish_json
from tickflow.market import Market

__all__ = [
    "Market",
    "available_symbols",
    "book_levels",
    "bulk_delete",
    "candles",
    "decode_book",
    "decode_tickers",
    "decode_trades",
    "delete_outcome",
    "latest_book",
    "latest_candles",
    "latest_trades",
    "list_accounts",
    "lookup_accounts",
    "publish_json",
    "requested_stats",
    "trade_stats",
]
