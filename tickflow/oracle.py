"""DuckDB SQL equivalents of ``tickflow.catalog.QUERIES`` (same names, same column names).

The feed rules of ``tickflow.sources.feeds`` are restated as CTEs over the driver's tables.  A
JSON round trip of a double through its text form gives the same double back, so the CTEs use
the numbers directly.  Epoch milliseconds truncate (``epoch_us // 1000``), as Spark's
``unix_millis`` does.
"""

from __future__ import annotations

from tickflow.functions.timecols import INTERVALS

_MS = "make_timestamp((epoch_us({c}) // 1000) * 1000)"

TRADES = f"""
trades AS (
  SELECT Symbol, TradeID, Price, Quantity, EventTime, TradeTime, IsBuyerMaker,
         CASE WHEN IsBuyerMaker THEN 'SELL' ELSE 'BUY' END AS Side,
         Price * Quantity AS TradeValue,
         CAST(year(TradeTime) AS INTEGER) AS Year, CAST(month(TradeTime) AS INTEGER) AS Month,
         CAST(day(TradeTime) AS INTEGER) AS Day, CAST(hour(TradeTime) AS INTEGER) AS Hour
  FROM (
    SELECT CASE event_type WHEN 'purchase' THEN 'BTCUSDT' WHEN 'click' THEN 'BNBBTC'
                           WHEN 'view' THEN 'ETHUSDT' WHEN 'signup' THEN 'SOLETH'
                           WHEN 'error' THEN 'XRPUSDT' END AS Symbol,
           event_id AS TradeID,
           value AS Price,
           TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS Quantity,
           {_MS.format(c="ts")} AS EventTime,
           {_MS.format(c="ts")} AS TradeTime,
           CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id % 2 = 0 END AS IsBuyerMaker
    FROM events) r
  WHERE Price > 0 AND Quantity > 0
)"""

TICKERS = f"""
tickers AS (
  SELECT *, CAST(year(event_time) AS INTEGER) AS Year, CAST(month(event_time) AS INTEGER) AS Month,
         CAST(day(event_time) AS INTEGER) AS Day
  FROM (
    SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS symbol, '1hTicker' AS event_type,
           {_MS.format(c="l_shipdate")} AS event_time,
           {_MS.format(c="l_shipdate")} AS open_time,
           make_timestamp((epoch_us(l_shipdate) // 1000 + 3600000) * 1000) AS close_time,
           l_extendedprice AS open_price,
           l_extendedprice * (1 + l_tax - 0.02) AS high_price,
           l_extendedprice * (1 - l_discount) AS low_price,
           l_extendedprice AS close_price,
           l_quantity AS volume,
           l_extendedprice * l_quantity AS quote_volume
    FROM lineitem) r
  WHERE symbol IS NOT NULL AND open_price > 0 AND close_price > 0 AND volume >= 0
    AND high_price >= low_price
)"""

BOOK = """
book AS (
  SELECT o_orderpriority AS symbol,
         make_timestamp((epoch_us(o_orderdate) // 1000 + o_orderkey) * 1000) AS event_time,
         CASE WHEN l_returnflag IN ('A', 'R') THEN 'bid' ELSE 'ask' END AS side,
         CAST(row_number() OVER (
           PARTITION BY o_orderkey, l_returnflag IN ('A', 'R')
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS level,
         l_extendedprice AS price, l_quantity AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_returnflag IN ('A', 'R', 'N') AND o_orderpriority IS NOT NULL
)"""

LATEST_BOOK = """
latest_book AS (
  SELECT b.* FROM book b
  JOIN (SELECT symbol, max(event_time) AS event_time FROM book GROUP BY symbol) m
    USING (symbol, event_time)
  WHERE level <= 10
)"""

ACCOUNTS = """
info AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username,
         CASE WHEN c_custkey = 0 THEN 'admin' END AS role
  FROM customer
),
balance AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_acctbal < 0 THEN 'x' ELSE CAST(c_acctbal AS VARCHAR) END AS usd,
         '1.0' AS btc, '0.0' AS reserved_usd, '0.0' AS reserved_btc
  FROM customer WHERE coalesce(c_mktsegment <> 'HOUSEHOLD', true)
),
absent AS (SELECT CAST(max(c_custkey) + 1 AS VARCHAR) AS user_id FROM customer),
delete_requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT '0' FROM customer WHERE c_custkey = 0
  UNION ALL SELECT user_id FROM absent
)"""

_ACCOUNT_COLS = """user_id, username, coalesce(role, 'user') AS role,
  coalesce(TRY_CAST(usd AS DOUBLE), 0.0) AS usd, coalesce(TRY_CAST(btc AS DOUBLE), 0.0) AS btc,
  coalesce(TRY_CAST(reserved_usd AS DOUBLE), 0.0) AS reserved_usd,
  coalesce(TRY_CAST(reserved_btc AS DOUBLE), 0.0) AS reserved_btc"""

OUTCOME = """
outcome AS (
  SELECT r.user_id, r.requests,
         (r.user_id <> '0' AND i.user_id IS NOT NULL) AS success,
         r.requests - CAST((r.user_id <> '0' AND i.user_id IS NOT NULL) AS BIGINT) AS failed,
         CASE WHEN r.user_id = '0' THEN 'admin_protected'
              WHEN i.user_id IS NOT NULL THEN 'deleted'
              ELSE 'not_found' END AS reason
  FROM (SELECT user_id, count(*) AS requests FROM delete_requests GROUP BY user_id) r
  LEFT JOIN (SELECT DISTINCT user_id FROM info) i USING (user_id)
)"""


def _round_quote(x: str) -> str:
    return (
        f"CASE WHEN symbol LIKE '%BTC' OR symbol LIKE '%ETH' THEN round({x}, 8) "
        f"ELSE round({x}, 2) END"
    )


def _candles(interval: str, where: str = "") -> str:
    width = INTERVALS.get(interval, INTERVALS["1m"])
    key = "{'t': TradeTime, 'i': TradeID}"
    return f"""
  SELECT symbol, '{interval}' AS "interval", "timestamp",
         {_round_quote('open')} AS open, {_round_quote('high')} AS high,
         {_round_quote('low')} AS low, {_round_quote('close')} AS close,
         {_round_quote('volume')} AS volume, trades
  FROM (
    SELECT Symbol AS symbol,
           make_timestamp(epoch_us(TradeTime) - (epoch_us(TradeTime) % {width})) AS "timestamp",
           arg_min(Price, {key}) AS open, max(Price) AS high, min(Price) AS low,
           arg_max(Price, {key}) AS close, sum(TradeValue) AS volume, count(*) AS trades
    FROM trades
    WHERE Symbol IS NOT NULL AND TradeTime IS NOT NULL {where}
    GROUP BY 1, 2) c"""


_LOOKBACK = "AND TradeTime >= (SELECT max(TradeTime) FROM trades) - INTERVAL {h} HOUR"


def _stats(hours: int) -> str:
    return f"""
  SELECT Symbol AS symbol, count(*) AS total_trades, round(sum(TradeValue), 2) AS total_volume,
         round(avg(Price), 2) AS avg_price, round(min(Price), 2) AS min_price,
         round(max(Price), 2) AS max_price, {hours} AS period_hours
  FROM trades
  WHERE Symbol IS NOT NULL {_LOOKBACK.format(h=hours)}
  GROUP BY Symbol"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SQL: dict[str, str] = {
    "trades_decode": _with(TRADES) + "SELECT * FROM trades",
    "trades_side_notional": _with(TRADES)
    + """SELECT Symbol AS symbol, Side AS side, count(*) AS trades,
       round(sum(TradeValue), 2) AS notional, round(sum(Quantity), 2) AS quantity
FROM trades WHERE Symbol IS NOT NULL GROUP BY 1, 2""",
    "tickers_clean": _with(TICKERS) + "SELECT * FROM tickers",
    "book_levels": _with(BOOK) + "SELECT * FROM book",
    **{f"candles_{i}": _with(TRADES) + _candles(i) for i in INTERVALS},
    "candles_fallback": _with(TRADES) + _candles("7m"),
    "candles_latest_n": _with(TRADES)
    + f"""SELECT symbol, "interval", "timestamp", open, high, low, close, volume, trades FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) AS rn
  FROM ({_candles('1m', _LOOKBACK.format(h=24))}) x) y
WHERE rn <= 100""",
    "trade_stats": _with(TRADES) + _stats(24),
    "trade_stats_30d": _with(TRADES) + _stats(720),
    "trade_stats_requested": _with(TRADES, TICKERS)
    + f"""SELECT q.symbol, CAST(coalesce(s.total_trades, 0) AS BIGINT) AS total_trades,
       coalesce(s.total_volume, 0.0) AS total_volume, s.avg_price, s.min_price, s.max_price,
       24 AS period_hours,
       CASE WHEN s.total_trades IS NULL THEN 'No data found' END AS message
FROM (SELECT DISTINCT Symbol AS symbol FROM trades WHERE Symbol IS NOT NULL
      UNION SELECT symbol FROM tickers) q
LEFT JOIN ({_stats(24)}) s USING (symbol)""",
    "symbols": _with(TRADES)
    + "SELECT DISTINCT Symbol AS symbol FROM trades WHERE Symbol IS NOT NULL ORDER BY 1",
    "latest_trades": _with(TRADES)
    + """SELECT * FROM (
  SELECT Symbol AS symbol,
         CAST(row_number() OVER (PARTITION BY Symbol ORDER BY TradeTime DESC, TradeID DESC) AS INTEGER) AS rank,
         TradeTime AS time, Price AS price, Quantity AS quantity, Side AS side, TradeValue AS value
  FROM trades WHERE Symbol IS NOT NULL) x
WHERE rank <= 10""",
    "latest_book": _with(BOOK, LATEST_BOOK) + "SELECT * FROM latest_book",
    "book_spread": _with(BOOK, LATEST_BOOK)
    + """SELECT symbol, event_time,
       CASE WHEN n_bids > 0 AND n_asks > 0 THEN best_ask - best_bid ELSE 0.0 END AS spread,
       best_bid, best_ask, n_bids, n_asks
FROM (
  SELECT symbol, event_time,
         max(price) FILTER (WHERE side = 'bid' AND level = 1) AS best_bid,
         max(price) FILTER (WHERE side = 'ask' AND level = 1) AS best_ask,
         CAST(count(*) FILTER (WHERE side = 'bid') AS INTEGER) AS n_bids,
         CAST(count(*) FILTER (WHERE side = 'ask') AS INTEGER) AS n_asks
  FROM latest_book GROUP BY symbol, event_time) x""",
    "accounts_list": _with(ACCOUNTS)
    + f"""SELECT {_ACCOUNT_COLS},
       (user_id = '0' OR coalesce(role = 'admin', false)) AS is_admin
FROM info LEFT JOIN balance USING (user_id)
WHERE TRY_CAST(user_id AS BIGINT) >= 1""",
    "accounts_lookup": _with(ACCOUNTS)
    + f"""SELECT {_ACCOUNT_COLS}
FROM (SELECT DISTINCT user_id FROM (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer
      UNION ALL SELECT user_id FROM absent) r WHERE user_id IS NOT NULL) q
JOIN info USING (user_id) JOIN balance USING (user_id)""",
    "accounts_bulk_delete": _with(ACCOUNTS)
    + f"""SELECT {_ACCOUNT_COLS}
FROM (SELECT * FROM info WHERE user_id NOT IN (SELECT user_id FROM delete_requests WHERE user_id <> '0')) i
LEFT JOIN (SELECT * FROM balance WHERE user_id NOT IN (SELECT user_id FROM delete_requests WHERE user_id <> '0')) b
USING (user_id)
WHERE TRY_CAST(user_id AS BIGINT) >= 1""",
    "account_delete_outcome": _with(ACCOUNTS, OUTCOME) + "SELECT * FROM outcome",
    "account_delete_counts": _with(ACCOUNTS, OUTCOME)
    + """SELECT CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS success_count,
       CAST(sum(failed) AS BIGINT) AS fail_count FROM outcome""",
    "time_format": _with(TRADES)
    + """SELECT TradeID,
       strftime(TradeTime, '%Y-%m-%dT%H:%M:%S') ||
         CASE WHEN epoch_us(TradeTime) % 1000000 = 0 THEN ''
              ELSE '.' || lpad(CAST(epoch_us(TradeTime) % 1000000 AS VARCHAR), 6, '0') END
         AS trade_time_iso,
       CASE WHEN epoch_us(EventTime) // 1000 <> 0
            THEN strftime(EventTime, '%Y-%m-%d %H:%M:%S.%g') END AS event_time_text
FROM trades""",
    "serving_contract": _with(TRADES)
    + """SELECT Symbol, TradeID, Price, Quantity, date_trunc('second', EventTime) AS EventTime,
       date_trunc('second', TradeTime) AS TradeTime,
       CAST(coalesce(CAST(IsBuyerMaker AS TINYINT), 0) AS TINYINT) AS IsBuyerMaker, Side,
       TradeValue, Year, Month, Day, Hour
FROM trades WHERE Symbol IS NOT NULL""",
    "tickers_serving_contract": _with(TICKERS)
    + """SELECT symbol, event_type, date_trunc('second', event_time) AS event_time,
       date_trunc('second', open_time) AS open_time, date_trunc('second', close_time) AS close_time,
       open_price, close_price, high_price, low_price, volume, quote_volume, Year, Month, Day
FROM tickers WHERE symbol IS NOT NULL""",
    # The wire JSON itself: prices travel as text, so both engines print the same characters;
    # a missing maker flag is left out of the object, as Spark's to_json does with NULL fields.
    "json_publish": """
WITH r AS (
  SELECT epoch_us(ts) // 1000 AS ms,
         CASE event_type WHEN 'purchase' THEN 'BTCUSDT' WHEN 'click' THEN 'BNBBTC'
                         WHEN 'view' THEN 'ETHUSDT' WHEN 'signup' THEN 'SOLETH'
                         WHEN 'error' THEN 'XRPUSDT' END AS s,
         event_id AS t, CAST(value AS VARCHAR) AS p, json_extract_string(props, '$.k') AS q,
         CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id % 2 = 0 END AS m
  FROM events)
SELECT CAST(CASE WHEN m IS NULL
         THEN json_object('e', 'trade', 'E', ms, 's', s, 't', t, 'p', p, 'q', q, 'T', ms)
         ELSE json_object('e', 'trade', 'E', ms, 's', s, 't', t, 'p', p, 'q', q, 'T', ms, 'm', m)
       END AS VARCHAR) AS value
FROM r""",
    "stream_parquet": _with(TRADES) + "SELECT * FROM trades",
    "stream_table_sink": _with(TRADES) + "SELECT * FROM trades",
}

# The chained stream serves exactly the rows of the serving contract.
SQL["stream_chained_serving"] = SQL["serving_contract"]
_TWICE = "SELECT * FROM trades UNION ALL SELECT * FROM trades"
SQL["stream_two_checkpoints"] = _with(TRADES) + _TWICE
SQL["stream_plus_backfill"] = _with(TRADES) + _TWICE
SQL["served_stats_24h"] = SQL["trade_stats"]
SQL["served_price_history"] = SQL["candles_latest_n"]
SQL["candles_latest_20"] = SQL["candles_latest_n"].replace("rn <= 100", "rn <= 20")
SQL["trades_one_symbol"] = _with(TRADES) + "SELECT * FROM trades WHERE Symbol = 'BTCUSDT'"
SQL["latest_book_depth3"] = _with(BOOK, LATEST_BOOK) + "SELECT * FROM latest_book WHERE level <= 3"
SQL["orderbook_requested"] = (
    _with(BOOK, LATEST_BOOK, TICKERS)
    + f"""SELECT q.symbol, s.event_time, s.spread, s.best_bid, s.best_ask,
       CASE WHEN s.symbol IS NULL THEN 'No orderbook data' END AS message
FROM (SELECT symbol FROM book UNION SELECT symbol FROM tickers) q
LEFT JOIN ({SQL["book_spread"].removeprefix(_with(BOOK, LATEST_BOOK))}) s ON q.symbol = s.symbol"""
)
SQL["orderbook_serving_contract"] = _with(BOOK) + "SELECT * FROM book"
SQL["serving_rejects"] = (
    _with(TRADES)
    + """SELECT concat_ws(', ', CASE WHEN IsBuyerMaker IS NULL OR Symbol IS NULL THEN 'Symbol' END,
         CASE WHEN Hour = 0 THEN 'TradeTime' END) AS reason, count(*) AS trades
FROM trades WHERE IsBuyerMaker IS NULL OR Symbol IS NULL OR Hour = 0 GROUP BY 1"""
)
SQL["account_delete_repeats"] = (
    _with(ACCOUNTS, OUTCOME.replace("count(*) AS requests", "2 * count(*) AS requests"))
    + "SELECT * FROM outcome"
)
SQL["accounts_admin"] = (
    _with(ACCOUNTS)
    + """SELECT user_id, coalesce(role, 'user') AS role,
       (user_id = '0' OR coalesce(role = 'admin', false)) AS is_admin FROM info"""
)
SQL["latest_trades_2000"] = SQL["latest_trades"].replace("rank <= 10", "rank <= 2000")
SQL["latest_trades_1500"] = SQL["latest_trades"].replace("rank <= 10", "rank <= 1500")
SQL["served_latest_trades"] = SQL["latest_trades"]
SQL["served_latest_book"] = SQL["latest_book"]
SQL["served_symbols"] = (
    _with(TRADES)
    + """SELECT Symbol AS symbol, CAST(count(*) + count(*) FILTER (WHERE Day <= 15) AS BIGINT) AS trades
FROM trades WHERE Symbol IS NOT NULL GROUP BY 1"""
)
for _name in ("stream_compacted", "stream_restart_files", "stream_restart_table", "stream_admission"):
    SQL[_name] = SQL["trades_decode"]
# The damaged feed: messages below a price of 10 are bad, by price; of the others those without a quantity.
_QUANTITY = "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)"
_DAMAGE = f"""
damaged AS (
  SELECT CASE WHEN value < 2 THEN 'no value' WHEN value < 4 THEN 'blank value'
              WHEN value < 8 THEN 'malformed JSON'
              ELSE concat_ws(', ', CASE WHEN value < 10 THEN 'price' END,
                                   CASE WHEN {_QUANTITY} <= 0 THEN 'quantity' END) END AS reason
  FROM events
)"""
SQL["stream_bad_messages"] = (
    _with(_DAMAGE) + "SELECT reason, count(*) AS messages FROM damaged WHERE reason <> '' GROUP BY 1"
)
SQL["stream_damaged_feed"] = _with(TRADES) + "SELECT * FROM trades WHERE Price >= 10"
SQL["stream_batch_counts"] = (
    _with(TRADES, _DAMAGE)
    + """, good AS (SELECT * FROM trades WHERE Price >= 10),
n AS (SELECT (SELECT count(*) FROM events) AS messages, (SELECT count(*) FROM good) AS trades,
             (SELECT count(*) FROM good WHERE Symbol IS NOT NULL) AS served,
             (SELECT count(*) FROM damaged WHERE reason <> '') AS bad)
SELECT * FROM (
  SELECT 'trades_history' AS output, messages AS rows_in, trades AS rows_out FROM n
  UNION ALL SELECT 'trades_serving', trades, served FROM n
  UNION ALL SELECT 'trades_rejects', trades, trades - served FROM n
  UNION ALL SELECT 'trades_messages', messages, bad FROM n) o
WHERE rows_in > 0"""
)
SQL["bad_tickers"] = """
SELECT concat_ws(', ', CASE WHEN NOT coalesce(open > 0, false) THEN 'open' END,
         CASE WHEN NOT coalesce(open > 0, false) THEN 'close' END,
         CASE WHEN NOT coalesce(l_quantity >= 0, false) THEN 'volume' END,
         CASE WHEN NOT coalesce(open * (1 + l_tax - 0.02) >= open * (1 - l_discount), false)
              THEN 'high below low' END) AS reason, count(*) AS messages
FROM (SELECT l_extendedprice AS open, * FROM lineitem) r GROUP BY 1 HAVING reason <> ''"""
SQL["book_rules"] = _with(BOOK.replace("WHERE l_returnflag", "WHERE o_orderstatus <> 'F' AND l_returnflag")) + "SELECT * FROM book"
SQL["bad_books"] = """
SELECT 'no level' AS reason, count(*) AS messages FROM orders
WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0"""
SQL["stream_orderbook"] = SQL["book_levels"]
SQL["stream_tickers"] = SQL["tickers_serving_contract"]
SQL["accounts_stored_delete"] = SQL["accounts_bulk_delete"]
