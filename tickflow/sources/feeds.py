"""Feeds and account hashes derived from the driver's tables (the S6 encode side).

The reference consumes exchange websockets; here the same wire shapes are produced from the
given tables with Spark, so every query's input grows with the tables.  The rules (also written
down in FIXTURES.md and mirrored in the DuckDB oracle):

- trades   <- ``events``: one trade per event; symbol by event type; price = value; quantity =
  ``props.k``; both times = epoch ms of ``ts``; maker = even user id, missing when the user id
  ends in 9.
- tickers  <- ``lineitem``: symbol 'S' + last digit of the supplier key; one 1-hour ticker per
  line (some have high < low and are rejected by the decoder).
- book     <- ``orders`` joined to ``lineitem``: one snapshot per order; bids are the lines with
  return flag A or R, asks the lines with N, ordered by (line number, part, supplier, price, qty).
- accounts <- ``customer``: id = custkey (text), admin = custkey 0; a balance hash for every
  customer outside the HOUSEHOLD segment, with an unparsable 'x' amount when the account balance
  is negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.functions.timecols import ts_to_ms
from tickflow.operators.publish import publish_json

# Event type -> trade symbol (covers BTC/ETH quotes, 8-digit rounding, and others).
EVENT_SYMBOLS = {
    "purchase": "BTCUSDT",
    "click": "BNBBTC",
    "view": "ETHUSDT",
    "signup": "SOLETH",
    "error": "XRPUSDT",
}
HOUR_MS = 3_600_000
# Account fixture rules.
UNFUNDED_SEGMENT = "HOUSEHOLD"
DELETE_SEGMENT = "AUTOMOBILE"


def _text(c: Column) -> Column:
    return c.cast("string")


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v))) if out is None else out.when(col == k, F.lit(v))
    return out


def trade_feed(events: DataFrame) -> DataFrame:
    ms = ts_to_ms("ts")
    maker = F.when(F.col("user_id") % 10 == 9, F.lit(None).cast("boolean")).otherwise(
        F.col("user_id") % 2 == 0
    )
    return publish_json(
        events,
        {
            "e": F.lit("trade"),
            "E": ms,
            "s": _case(F.col("event_type"), EVENT_SYMBOLS),
            "t": F.col("event_id"),
            "p": _text(F.col("value")),
            "q": F.get_json_object("props", "$.k"),
            "T": ms,
            "m": maker,
        },
    )


def ticker_feed(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    ms = ts_to_ms("l_shipdate")
    return publish_json(
        lineitem,
        {
            "e": F.lit("1hTicker"),
            "E": ms,
            "s": F.concat(F.lit("S"), _text(F.col("l_suppkey") % 10)),
            "O": ms,
            "C": ms + F.lit(HOUR_MS),
            "o": _text(price),
            "h": _text(price * (F.lit(1) + F.col("l_tax") - F.lit(0.02))),
            "l": _text(price * (F.lit(1) - F.col("l_discount"))),
            "c": _text(price),
            "v": _text(F.col("l_quantity")),
            "q": _text(price * F.col("l_quantity")),
        },
    )


def _levels(cond: Column) -> Column:
    lvl = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_extendedprice").alias("p"),
        F.col("l_quantity").alias("q"),
    )
    ordered = F.array_sort(F.collect_list(F.when(cond, lvl)))
    return F.transform(ordered, lambda x: F.array(_text(x["p"]), _text(x["q"])))


def damaged_trade_feed(events: DataFrame) -> DataFrame:
    """The trade feed in which messages are damaged by their price: below 2 there is no value, below 4 a blank one,
    below 6 the end is cut off, below 8 the text is no JSON, and below 10 the price is no number."""
    text = F.col("value").cast("string")
    price = F.get_json_object(text, "$.p").try_cast("double")
    damaged = (
        F.when(price < 2, F.lit(None).cast("string"))
        .when(price < 4, F.lit("  "))
        .when(price < 6, F.substring(text, F.lit(1), F.length(text) - 10))
        .when(price < 8, F.lit("no JSON"))
        .when(price < 10, F.regexp_replace(text, '"p":"[^"]*"', '"p":"n/a"'))
        .otherwise(text)
    )
    return trade_feed(events).select(damaged.alias("value"))


def book_feed_at_rest(orders: DataFrame, lineitem: DataFrame, emptied: Column | None = None) -> DataFrame:
    """The book feed of a stream of orders, whose lines are at rest: the lines' levels are gathered by order first
    (groups of one order's lines), so the stream only joins.  Orders that fulfil ``emptied`` get books without a level."""
    levels = lineitem.groupBy(F.col("l_orderkey")).agg(
        _levels(F.col("l_returnflag").isin("A", "R")).alias("b"),
        _levels(F.col("l_returnflag") == "N").alias("a"),
    )
    snap = orders.join(levels, F.col("o_orderkey") == F.col("l_orderkey"))
    no_level = F.array().cast("array<array<string>>")
    side = lambda c: F.col(c) if emptied is None else F.when(emptied, no_level).otherwise(F.col(c))
    return publish_json(
        snap,
        {
            "e": F.lit("depthUpdate"),
            "E": ts_to_ms("o_orderdate") + F.col("o_orderkey"),
            "s": F.col("o_orderpriority"),
            "b": side("b"),
            "a": side("a"),
        },
    )


def book_feed(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Join on the order key, then one snapshot per order.  The grouping key contains the join
    key, so the aggregate reuses the join's hash partitioning (no second shuffle); groups are
    bounded by the lines of one order."""
    o = orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    li = lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_returnflag",
    )
    snap = (
        o.join(li, o.o_orderkey == li.l_orderkey)
        .groupBy("o_orderkey", "o_orderpriority", "o_orderdate")
        .agg(
            _levels(F.col("l_returnflag").isin("A", "R")).alias("b"),
            _levels(F.col("l_returnflag") == "N").alias("a"),
        )
    )
    return publish_json(
        snap,
        {
            "e": F.lit("depthUpdate"),
            "E": ts_to_ms("o_orderdate") + F.col("o_orderkey"),
            "s": F.col("o_orderpriority"),
            "b": F.col("b"),
            "a": F.col("a"),
        },
    )


def account_info(customer: DataFrame) -> DataFrame:
    return customer.select(
        _text(F.col("c_custkey")).alias("user_id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") == 0, F.lit("admin")).alias("role"),
    )


def account_balance(customer: DataFrame) -> DataFrame:
    funded = customer.where(
        F.coalesce(F.col("c_mktsegment") != F.lit(UNFUNDED_SEGMENT), F.lit(True))
    )
    return funded.select(
        _text(F.col("c_custkey")).alias("user_id"),
        F.when(F.col("c_acctbal") < 0, F.lit("x")).otherwise(_text(F.col("c_acctbal"))).alias("usd"),
        F.lit("1.0").alias("btc"),
        F.lit("0.0").alias("reserved_usd"),
        F.lit("0.0").alias("reserved_btc"),
    )


def _absent_id(customer: DataFrame) -> DataFrame:
    return customer.agg(_text(F.max("c_custkey") + 1).alias("user_id"))


def lookup_requests(customer: DataFrame) -> DataFrame:
    """Every customer id, plus one id past the largest (not found)."""
    return customer.select(_text(F.col("c_custkey")).alias("user_id")).unionByName(
        _absent_id(customer)
    )


def delete_requests(customer: DataFrame) -> DataFrame:
    """Ticked rows: every AUTOMOBILE-segment account, the admin id and one absent id."""
    seg = customer.where(F.col("c_mktsegment") == F.lit(DELETE_SEGMENT)).select(
        _text(F.col("c_custkey")).alias("user_id")
    )
    admin = customer.where(F.col("c_custkey") == 0).select(F.lit("0").alias("user_id"))
    return seg.unionByName(admin).unionByName(_absent_id(customer))
