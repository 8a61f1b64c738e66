"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables in full, derives the feeds from them with Spark (wire JSON
-> decoders), and runs one operator over all symbols.  ``tickflow.oracle`` holds the equivalent
DuckDB SQL under the same names and column names.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.timecols import INTERVALS, iso_text, ms_text
from tickflow.market import Market
from tickflow.operators.accounts import (
    bulk_delete,
    delete_counts,
    delete_outcome,
    is_admin,
    list_accounts,
    lookup_accounts,
)
from tickflow.operators.account_store import AccountStore
from tickflow.operators.candles import candles, latest_candles
from tickflow.operators.decode import decode_book, decode_tickers, decode_trades
from tickflow.operators.filters import latest_time, select_symbols
from tickflow.operators.latest import book_levels, latest_book, latest_trades, requested_book
from tickflow.operators.messages import bad_messages
from tickflow.operators.stats import available_symbols, requested_stats, trade_stats
from tickflow.plans import contracts
from tickflow.plans.session import scratch_path, use_utc
from tickflow.sources import feeds
from tickflow.sources.files import Folder
from tickflow.sources.kafka import read_value_files
from tickflow.sources.serving import read_table
from tickflow.streaming.compact import compact_days, read_compacted
from tickflow.streaming.counts import BatchCounts
from tickflow.streaming.fanout import start_fanout, start_feed
from tickflow.streaming.registry import registry_path
from tickflow.streaming.restart import run_with_restarts
from tickflow.streaming.sinks import (
    AVAILABLE_NOW,
    BATCH_COL,
    write_history,
    write_parquet_stream,
    write_table_stream,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- clean tables derived from the driver's tables --------------------------------------------
def trades(spark, sf_dir) -> DataFrame:
    return decode_trades(feeds.trade_feed(table(spark, sf_dir, "events")))


def tickers(spark, sf_dir) -> DataFrame:
    return decode_tickers(feeds.ticker_feed(table(spark, sf_dir, "lineitem")))


def book(spark, sf_dir) -> DataFrame:
    return decode_book(
        feeds.book_feed(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    )


def _accounts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c, feeds.account_info(c), feeds.account_balance(c)


# --- queries ----------------------------------------------------------------------------------
def q_trades_decode(spark, sf_dir):
    return trades(spark, sf_dir)


def q_trades_side_notional(spark, sf_dir):
    t = trades(spark, sf_dir).where(F.col("Symbol").isNotNull())
    return t.groupBy(F.col("Symbol").alias("symbol"), F.col("Side").alias("side")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.round(F.sum("TradeValue"), 2).alias("notional"),
        F.round(F.sum("Quantity"), 2).alias("quantity"),
    )


def q_tickers_clean(spark, sf_dir):
    return tickers(spark, sf_dir)


def q_book_levels(spark, sf_dir):
    return book_levels(book(spark, sf_dir))


def _candles_query(interval: str) -> Query:
    def q(spark, sf_dir):
        return candles(trades(spark, sf_dir), interval)

    q.__name__ = f"q_candles_{interval}"
    return q


def q_candles_fallback(spark, sf_dir):
    """An unknown interval buckets by 1m and echoes the requested name."""
    return candles(trades(spark, sf_dir), "7m")


def q_candles_latest_n(spark, sf_dir):
    t = trades(spark, sf_dir)
    return latest_candles(t, "1m", limit=100, as_of=latest_time(t, "TradeTime"), lookback_hours=24)


def q_trade_stats(spark, sf_dir):
    t = trades(spark, sf_dir)
    return trade_stats(t, as_of=latest_time(t, "TradeTime"), hours=24)


def q_trade_stats_30d(spark, sf_dir):
    t = trades(spark, sf_dir)
    return trade_stats(t, as_of=latest_time(t, "TradeTime"), hours=720)


def q_trade_stats_requested(spark, sf_dir):
    t = trades(spark, sf_dir)
    requested = (
        t.select(F.col("Symbol").alias("symbol"))
        .where(F.col("symbol").isNotNull())
        .unionByName(tickers(spark, sf_dir).select("symbol"))
        .distinct()
    )
    return requested_stats(t, requested, as_of=latest_time(t, "TradeTime"), hours=24)


def q_symbols(spark, sf_dir):
    return available_symbols(trades(spark, sf_dir))


def q_latest_trades(spark, sf_dir):
    return latest_trades(trades(spark, sf_dir), n=10)


def q_latest_book(spark, sf_dir):
    return book_levels(latest_book(book(spark, sf_dir), depth=10))


def q_book_spread(spark, sf_dir):
    lb = latest_book(book(spark, sf_dir), depth=10)
    return lb.select(
        "symbol",
        "event_time",
        "spread",
        F.get("bids", 0)["price"].alias("best_bid"),
        F.get("asks", 0)["price"].alias("best_ask"),
        F.size("bids").alias("n_bids"),
        F.size("asks").alias("n_asks"),
    )


def q_accounts_list(spark, sf_dir):
    _, info, bal = _accounts(spark, sf_dir)
    return list_accounts(info, bal).withColumn("is_admin", is_admin())


def q_accounts_lookup(spark, sf_dir):
    c, info, bal = _accounts(spark, sf_dir)
    return lookup_accounts(info, bal, feeds.lookup_requests(c))


def q_accounts_bulk_delete(spark, sf_dir):
    c, info, bal = _accounts(spark, sf_dir)
    info2, bal2 = bulk_delete(info, bal, feeds.delete_requests(c))
    return list_accounts(info2, bal2)


def q_account_delete_outcome(spark, sf_dir):
    c, info, _ = _accounts(spark, sf_dir)
    return delete_outcome(info, feeds.delete_requests(c))


def q_account_delete_counts(spark, sf_dir):
    c, info, _ = _accounts(spark, sf_dir)
    return delete_counts(delete_outcome(info, feeds.delete_requests(c)))


def q_time_format(spark, sf_dir):
    t = trades(spark, sf_dir)
    return t.select(
        "TradeID",
        iso_text("TradeTime").alias("trade_time_iso"),
        ms_text(F.unix_millis("EventTime")).alias("event_time_text"),
    )


def q_json_publish(spark, sf_dir):
    return feeds.trade_feed(table(spark, sf_dir, "events")).select(
        F.col("value").cast("string").alias("value")
    )


def q_serving_contract(spark, sf_dir):
    return contracts.conform(trades(spark, sf_dir), contracts.TRADES)


def q_tickers_serving_contract(spark, sf_dir):
    return contracts.conform(tickers(spark, sf_dir), contracts.TICKERS)


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """A table as a file stream (one parquet file -> one micro-batch)."""
    src = os.path.join(sf_dir, f"{name}.parquet")
    schema = table(spark, sf_dir, name).schema
    if Folder(spark, src).names("*.parquet"):
        return spark.readStream.schema(schema).parquet(src)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _event_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "events")


def _event_batches(spark, sf_dir, files: int = 6):
    """The ``events`` table in the order of time as a stream of several micro-batches."""
    out = scratch_path(spark, "event-files")
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(out)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(out)


def q_stream_parquet(spark, sf_dir):
    """S1->S2: trades decoded from a stream, appended to symbol/day-partitioned parquet under
    ``availableNow``, read back through the serving reader."""
    out = scratch_path(spark, "stream-history")
    clean = decode_trades(feeds.trade_feed(_event_stream(spark, sf_dir)))
    q = write_parquet_stream(
        clean, out, out + "-checkpoint", S.TRADES_PARTITIONS, trigger=AVAILABLE_NOW
    )
    q.awaitTermination()
    return read_table(spark, out, contract=S.TRADES)


def q_stream_table_sink(spark, sf_dir):
    """One foreachBatch writes history and serving table from a persisted batch;
    the serving table is read back."""
    root = scratch_path(spark, "stream-fanout")
    clean = decode_trades(feeds.trade_feed(_event_stream(spark, sf_dir)))
    q = start_fanout(
        clean,
        "trades",
        root,
        root + "-checkpoint",
        S.TRADES_PARTITIONS,
        sort_cols=contracts.TRADES.sort_cols,
        trigger=AVAILABLE_NOW,
    )
    q.awaitTermination()
    served = spark.read.parquet(os.path.join(root, "serving", "trades")).drop(BATCH_COL)
    return served.select(*[F.col(f.name).cast(f.dataType) for f in S.TRADES.fields])


def q_stream_chained_serving(spark, sf_dir):
    """S10 default wiring: decoded stream -> history (exactly-once file sink) -> serving table
    under the contract, streamed from the history's committed files; the serving table is read
    back."""
    root = scratch_path(spark, "stream-chained")
    qs = start_feed(
        feeds.trade_feed(_event_stream(spark, sf_dir)),
        "trades",
        root,
        root + "-checkpoint",
        trigger=AVAILABLE_NOW,
    )
    for q in qs:
        q.awaitTermination()
    served = spark.read.parquet(os.path.join(root, "serving", "trades"))
    return served.select(*[F.col(f.name).cast(f.dataType) for f in contracts.TRADES.schema.fields])


def q_stream_two_checkpoints(spark, sf_dir):
    """The trade stream written twice into one table, under two checkpoints: batch numbers start
    again, and neither writer replaces the other's rows."""
    out = scratch_path(spark, "stream-two")
    clean = decode_trades(feeds.trade_feed(_event_stream(spark, sf_dir)))
    for checkpoint in ("-first", "-second"):
        write_table_stream(clean, out, out + checkpoint, trigger=AVAILABLE_NOW).awaitTermination()
    return read_table(spark, out, contract=S.TRADES)


def q_stream_plus_backfill(spark, sf_dir):
    """S2 and a backfill run twice, each in a folder of its own, read as one history."""
    out = scratch_path(spark, "stream-and-backfill")
    streamed, filled = os.path.join(out, "stream"), os.path.join(out, "backfill")
    clean = decode_trades(feeds.trade_feed(_event_stream(spark, sf_dir)))
    write_parquet_stream(
        clean, streamed, out + "-checkpoint", S.TRADES_PARTITIONS, trigger={"availableNow": True}
    ).awaitTermination()
    for _ in range(2):
        write_history(trades(spark, sf_dir), filled, S.DAY_PARTITIONS, ("Symbol", "TradeTime"))
    return read_table(spark, [streamed, filled], contract=S.TRADES)


def _served(spark, sf_dir) -> Market:
    """The served questions over a history in the day layout, with its registry."""
    out = scratch_path(spark, "served")
    write_history(
        trades(spark, sf_dir), os.path.join(out, "trades"), S.DAY_PARTITIONS, ("Symbol", "TradeTime"),
        registry=registry_path(out, "trades"),
    )
    return Market(spark, out)


def q_latest_trades_2000(spark, sf_dir):
    """T1 beyond the number up to which Spark itself cuts before a shuffle."""
    return latest_trades(trades(spark, sf_dir), n=2000)


def q_latest_trades_1500(spark, sf_dir):
    """As before, with a number that is less than every symbol's trades at sf0.01."""
    return latest_trades(trades(spark, sf_dir), n=1500)


def q_served_latest_trades(spark, sf_dir):
    """T1 over the store, from the newest days alone."""
    return _served(spark, sf_dir).realtime()


def q_served_latest_book(spark, sf_dir):
    """T2 over a store by day: the newest book of every symbol from the newest days alone."""
    out = scratch_path(spark, "served-book")
    write_history(
        book(spark, sf_dir), os.path.join(out, "orderbook"), S.DAY_PARTITIONS, ("symbol", "event_time"),
        registry=registry_path(out, "orderbook"), symbol_col="symbol",
    )
    return book_levels(Market(spark, out).orderbook())


def q_served_symbols(spark, sf_dir):
    """A5 from the registry, after a stream and a backfill that was run twice."""
    root = scratch_path(spark, "symbols")
    streamed, filled = os.path.join(root, "stream"), os.path.join(root, "backfill")
    raw = feeds.trade_feed(_event_stream(spark, sf_dir))
    for q in start_feed(raw, "trades", streamed, root + "-checkpoint", trigger=AVAILABLE_NOW):
        q.awaitTermination()
    early = trades(spark, sf_dir).where("Day <= 15")
    for _ in range(2):
        write_history(early, os.path.join(filled, "trades"), S.DAY_PARTITIONS, registry=registry_path(filled, "trades"))
    market = Market(spark, [os.path.join(streamed, "history"), filled])
    rows = market.registry().groupBy("symbol").agg(F.sum("rows").alias("trades"))
    return market.symbols().join(rows, "symbol")


def q_served_stats_24h(spark, sf_dir):
    m = _served(spark, sf_dir)
    return m.stats(as_of=latest_time(m.trades(), "TradeTime"))


def q_served_price_history(spark, sf_dir):
    m = _served(spark, sf_dir)
    return m.price_history(as_of=latest_time(m.trades(), "TradeTime"))


def q_candles_latest_20(spark, sf_dir):
    t = trades(spark, sf_dir)
    return latest_candles(t, "1m", limit=20, as_of=latest_time(t, "TradeTime"), lookback_hours=24)


def q_trades_one_symbol(spark, sf_dir):
    return select_symbols(trades(spark, sf_dir), ["BTCUSDT"])


def q_latest_book_depth3(spark, sf_dir):
    """The cut to the first levels binds: most books have more than three a side."""
    return book_levels(latest_book(book(spark, sf_dir), depth=3))


def q_orderbook_requested(spark, sf_dir):
    """Requested are the symbols of books and of tickers; the latter have no book."""
    b = book(spark, sf_dir)
    requested = b.select("symbol").unionByName(tickers(spark, sf_dir).select("symbol")).distinct()
    return requested_book(b, requested).select(
        "symbol",
        "event_time",
        "spread",
        F.get("bids", 0)["price"].alias("best_bid"),
        F.get("asks", 0)["price"].alias("best_ask"),
        "message",
    )


def q_orderbook_serving_contract(spark, sf_dir):
    return book_levels(contracts.conform(book(spark, sf_dir), contracts.ORDERBOOK))


def q_serving_rejects(spark, sf_dir):
    """Trades without a maker flag lose their symbol and those of the first hour their time; rows
    that the contract can't hold, by reason."""
    t = trades(spark, sf_dir)
    t = t.withColumn("Symbol", F.when(F.col("IsBuyerMaker").isNotNull(), F.col("Symbol")))
    t = t.withColumn("TradeTime", F.when(F.col("Hour") != 0, F.col("TradeTime")))
    return contracts.rejects(t, contracts.TRADES).groupBy("reason").agg(
        F.count(F.lit(1)).alias("trades")
    )


def q_account_delete_repeats(spark, sf_dir):
    """Every id is requested twice."""
    c, info, _ = _accounts(spark, sf_dir)
    requests = feeds.delete_requests(c)
    return delete_outcome(info, requests.unionByName(requests))


def q_accounts_admin(spark, sf_dir):
    """D19, D20 for every account, the admin's included."""
    _, info, _ = _accounts(spark, sf_dir)
    roles = info.select("user_id", F.coalesce("role", F.lit("user")).alias("role"))
    return roles.withColumn("is_admin", is_admin())


def q_stream_compacted(spark, sf_dir):
    """A store of many small files, streamed in several batches, with its closed days rewritten and handed over; the
    last day stays in the first root."""
    root = scratch_path(spark, "compacted")
    streamed, target = os.path.join(root, "stream"), os.path.join(root, "closed")
    clean = decode_trades(feeds.trade_feed(_event_batches(spark, sf_dir)))
    write_parquet_stream(
        clean, streamed, root + "-checkpoint", S.TRADES_PARTITIONS, trigger=AVAILABLE_NOW
    ).awaitTermination()
    last = read_table(spark, streamed, S.TRADES).agg(F.max(F.make_date("Year", "Month", "Day"))).first()[0]
    if last is not None:
        compact_days(spark, streamed, target, S.TRADES, before=last)
    return read_compacted(spark, streamed, target, S.TRADES)


def _damaged_run(spark, sf_dir):
    """The chained wiring over the damaged feed, in several batches, and the counts of its batches."""
    root = scratch_path(spark, "damaged")
    counts = BatchCounts()
    spark.streams.addListener(counts)
    try:
        raw = feeds.damaged_trade_feed(_event_batches(spark, sf_dir))
        qs = start_feed(raw, "trades", root, root + "-checkpoint", trigger=AVAILABLE_NOW)
        for q in qs:
            q.awaitTermination()
        counts.wait(*qs)
    finally:
        spark.streams.removeListener(counts)
    return root, counts


def q_stream_bad_messages(spark, sf_dir):
    """the messages that the decoder drops, by reason, from the stream's side output."""
    root, _ = _damaged_run(spark, sf_dir)
    bad = spark.read.parquet(os.path.join(root, "rejects", "trades_messages"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def q_stream_damaged_feed(spark, sf_dir):
    """the trades of a feed with damaged messages; the good ones are what they were."""
    root, _ = _damaged_run(spark, sf_dir)
    return read_table(spark, os.path.join(root, "history", "trades"), S.TRADES)


def q_stream_batch_counts(spark, sf_dir):
    """Rows in and out of every output of the default wiring, summed over its batches."""
    _, counts = _damaged_run(spark, sf_dir)
    rows = counts.dataframe(spark).groupBy("output")
    return rows.agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"))


def q_bad_tickers(spark, sf_dir):
    """tickers whose high is below their low, and why any other is dropped."""
    bad = bad_messages(feeds.ticker_feed(table(spark, sf_dir, "lineitem")), "tickers")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def _emptied_books(spark, sf_dir):
    """Books of finished orders have no level."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return feeds.book_feed_at_rest(orders, lines, F.col("o_orderstatus") == "F")


def q_book_rules(spark, sf_dir):
    """books without a level on either side are dropped."""
    return book_levels(decode_book(_emptied_books(spark, sf_dir)))


def q_bad_books(spark, sf_dir):
    """the books dropped, by reason."""
    bad = bad_messages(_emptied_books(spark, sf_dir), "orderbook")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def q_stream_orderbook(spark, sf_dir):
    """Orders as a stream, their lines at rest, joined to books and sent through the default wiring in the day
    layout; the serving table is read back as levels."""
    root = scratch_path(spark, "stream-book")
    raw = feeds.book_feed_at_rest(_stream(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    for q in start_feed(
        raw, "orderbook", root, root + "-checkpoint", AVAILABLE_NOW, history_partitions=S.DAY_PARTITIONS
    ):
        q.awaitTermination()
    return book_levels(spark.read.schema(S.ORDERBOOK).parquet(os.path.join(root, "serving", "orderbook")))


def q_stream_tickers(spark, sf_dir):
    """The ticker stream through the default wiring in the day layout; the serving table is read back."""
    root = scratch_path(spark, "stream-tickers")
    raw = feeds.ticker_feed(_stream(spark, sf_dir, "lineitem"))
    for q in start_feed(raw, "tickers", root, root + "-checkpoint", AVAILABLE_NOW, history_partitions=S.DAY_PARTITIONS):
        q.awaitTermination()
    return spark.read.schema(contracts.TICKERS.schema).parquet(os.path.join(root, "serving", "tickers"))


def _failing(clean: DataFrame, attempt: int) -> DataFrame:
    """Fails on the first attempt at the first batch that has a trade of the month's second half."""
    if attempt:
        return clean
    planted = F.col("Day") > 15
    checked = F.when(planted, F.raise_error(F.lit("planted failure")).cast("double")).otherwise(F.col("Price"))
    return clean.withColumn("Price", checked)


def q_stream_restart_files(spark, sf_dir):
    """A file sink's stream that fails in the midst of a later batch and is started again on its checkpoint."""
    root = scratch_path(spark, "restart-files")
    source = _event_batches(spark, sf_dir)

    def start(attempt):
        clean = _failing(decode_trades(feeds.trade_feed(source)), attempt)
        return write_parquet_stream(clean, root, root + "-checkpoint", S.TRADES_PARTITIONS, AVAILABLE_NOW)

    run_with_restarts(start)
    return read_table(spark, root, contract=S.TRADES)


def q_stream_restart_table(spark, sf_dir):
    """The table sink's stream, which fails after it wrote a batch and before the batch was committed."""
    root = scratch_path(spark, "restart-table")
    clean = decode_trades(feeds.trade_feed(_event_batches(spark, sf_dir)))

    def start(attempt):
        def told(batch_id, _):
            if not attempt and batch_id == 2:
                raise RuntimeError("planted failure")

        return write_table_stream(clean, root, root + "-checkpoint", trigger=AVAILABLE_NOW, on_batch=told)

    run_with_restarts(start)
    return read_table(spark, root, contract=S.TRADES)


def q_stream_admission(spark, sf_dir):
    """A backlog of files drained in batches of bounded bytes under one start."""
    root = scratch_path(spark, "admission")
    feed, out = os.path.join(root, "feed"), os.path.join(root, "trades")
    events = table(spark, sf_dir, "events")
    messages = feeds.trade_feed(events.repartitionByRange(8, "ts")).select(F.col("value").cast("string"))
    messages.write.text(feed)
    raw = read_value_files(spark, feed, max_bytes_per_trigger=1)  # less than a file: one file a batch
    clean = decode_trades(raw)
    write_parquet_stream(clean, out, root + "-checkpoint", S.TRADES_PARTITIONS, AVAILABLE_NOW).awaitTermination()
    return read_table(spark, out, contract=S.TRADES)


def q_accounts_stored_delete(spark, sf_dir):
    """The listing after a bulk delete that is stored as a new version of both tables."""
    c, info, bal = _accounts(spark, sf_dir)
    store = AccountStore(spark, scratch_path(spark, "accounts"))
    store.replace(info, bal)
    store.delete(feeds.delete_requests(c))
    return store.listing()


QUERIES: dict[str, Query] = {
    "trades_decode": q_trades_decode,
    "trades_side_notional": q_trades_side_notional,
    "tickers_clean": q_tickers_clean,
    "book_levels": q_book_levels,
    **{f"candles_{i}": _candles_query(i) for i in INTERVALS},
    "candles_fallback": q_candles_fallback,
    "candles_latest_n": q_candles_latest_n,
    "trade_stats": q_trade_stats,
    "trade_stats_30d": q_trade_stats_30d,
    "trade_stats_requested": q_trade_stats_requested,
    "symbols": q_symbols,
    "latest_trades": q_latest_trades,
    "latest_book": q_latest_book,
    "book_spread": q_book_spread,
    "accounts_list": q_accounts_list,
    "accounts_lookup": q_accounts_lookup,
    "accounts_bulk_delete": q_accounts_bulk_delete,
    "account_delete_outcome": q_account_delete_outcome,
    "account_delete_counts": q_account_delete_counts,
    "time_format": q_time_format,
    "json_publish": q_json_publish,
    "serving_contract": q_serving_contract,
    "tickers_serving_contract": q_tickers_serving_contract,
    "stream_parquet": q_stream_parquet,
    "stream_table_sink": q_stream_table_sink,
    "stream_chained_serving": q_stream_chained_serving,
    "stream_two_checkpoints": q_stream_two_checkpoints,
    "stream_plus_backfill": q_stream_plus_backfill,
    "served_stats_24h": q_served_stats_24h,
    "served_price_history": q_served_price_history,
    "candles_latest_20": q_candles_latest_20,
    "trades_one_symbol": q_trades_one_symbol,
    "latest_book_depth3": q_latest_book_depth3,
    "orderbook_requested": q_orderbook_requested,
    "orderbook_serving_contract": q_orderbook_serving_contract,
    "serving_rejects": q_serving_rejects,
    "account_delete_repeats": q_account_delete_repeats,
    "accounts_admin": q_accounts_admin,
    "latest_trades_2000": q_latest_trades_2000,
    "latest_trades_1500": q_latest_trades_1500,
    "served_latest_trades": q_served_latest_trades,
    "served_latest_book": q_served_latest_book,
    "served_symbols": q_served_symbols,
    "stream_compacted": q_stream_compacted,
    "stream_bad_messages": q_stream_bad_messages,
    "stream_damaged_feed": q_stream_damaged_feed,
    "stream_batch_counts": q_stream_batch_counts,
    "bad_tickers": q_bad_tickers,
    "book_rules": q_book_rules,
    "bad_books": q_bad_books,
    "stream_orderbook": q_stream_orderbook,
    "stream_tickers": q_stream_tickers,
    "stream_restart_files": q_stream_restart_files,
    "stream_restart_table": q_stream_restart_table,
    "stream_admission": q_stream_admission,
    "accounts_stored_delete": q_accounts_stored_delete,
}
