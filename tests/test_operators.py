"""Candles, stats, latest trades / book, time text: FIXTURES.md §2 edge cases."""

import datetime as dt
import re
import json

import pytest
from pyspark.sql import functions as F

from tickflow.functions.timecols import bucket_start, iso_text, ms_text
from tickflow.operators.candles import candles, latest_candles
from tickflow.operators.decode import decode_book, decode_trades
from tickflow.operators.latest import book_levels, latest_book, latest_trades
from tickflow.operators.stats import available_symbols, requested_stats, trade_stats
from tickflow.plans.inspect import plan_text

BASE_MS = 1704067200000  # 2024-01-01T00:00:00Z


def msg(t, ms, p, q="1", s="BTCUSDT", m=False):
    return json.dumps({"e": "trade", "E": ms, "s": s, "t": t, "p": str(p), "q": str(q),
                       "T": ms, "m": m})


@pytest.fixture()
def trades(values):
    def make(*msgs):
        return decode_trades(values(*msgs))

    return make


def test_time_tie_open_lower_id_close_higher_id(trades):
    t = trades(msg(2, BASE_MS, 20), msg(1, BASE_MS, 10), msg(3, BASE_MS + 5, 30),
               msg(4, BASE_MS + 5, 40))
    r = candles(t, "1m").collect()[0]
    assert (r.open, r.high, r.low, r.close, r.trades) == (10.0, 40.0, 10.0, 40.0, 4)
    assert r.volume == 100.0 and r.interval == "1m"


def test_buckets(spark):
    ts = dt.datetime(2024, 1, 1, 5, 37, 12)
    df = spark.createDataFrame([(ts,)], "t timestamp")
    got = df.select(
        *[bucket_start("t", i).alias(i) for i in ("1m", "5m", "15m", "1h", "4h", "1d", "7m")]
    ).collect()[0]
    assert got["4h"] == dt.datetime(2024, 1, 1, 4, 0)
    assert got["15m"] == dt.datetime(2024, 1, 1, 5, 30)
    assert got["5m"] == dt.datetime(2024, 1, 1, 5, 35)
    assert got["1d"] == dt.datetime(2024, 1, 1)
    assert got["7m"] == got["1m"] == dt.datetime(2024, 1, 1, 5, 37)


def test_pre_epoch_bucket_floors(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 30),)], "t timestamp")
    assert df.select(bucket_start("t", "1m")).first()[0] == dt.datetime(1969, 12, 31, 23, 59)


def test_unknown_interval_echoes_request(trades):
    r = candles(trades(msg(1, BASE_MS, 5)), "7m").first()
    assert r.interval == "7m" and r.timestamp == dt.datetime(2024, 1, 1)


def test_quote_rounding(trades):
    t = trades(msg(1, BASE_MS, "0.123456789", s="BNBBTC"), msg(2, BASE_MS, "1.23456", s="XUSDT"))
    got = {r.symbol: r.open for r in candles(t, "1m").collect()}
    assert got == {"BNBBTC": 0.12345679, "XUSDT": 1.23}


def test_lookback_edge_inclusive(trades):
    as_of = dt.datetime(2024, 1, 2)
    t = trades(msg(1, BASE_MS, 10), msg(2, BASE_MS - 1, 99), msg(3, BASE_MS + 86_400_000, 20))
    r = trade_stats(t, as_of=as_of, hours=24).collect()[0]
    assert r.total_trades == 2 and r.min_price == 10.0 and r.max_price == 20.0
    assert r.avg_price == 15.0 and r.period_hours == 24


def test_latest_candles_limit_newest_first(trades):
    t = trades(*[msg(i, BASE_MS + i * 60_000, i + 1) for i in range(10)])
    rows = latest_candles(t, "1m", limit=3, as_of=dt.datetime(2024, 1, 1, 0, 9), lookback_hours=24)
    got = [r.open for r in rows.orderBy(F.desc("timestamp")).collect()]
    assert got == [10.0, 9.0, 8.0]


def test_unknown_symbol_in_stats_gets_zeros(spark, trades):
    t = trades(msg(1, BASE_MS, 10))
    req = spark.createDataFrame([("BTCUSDT",), ("NOPE",)], "symbol string")
    got = {r.symbol: r for r in requested_stats(t, req, as_of=dt.datetime(2024, 1, 1, 1)).collect()}
    assert got["NOPE"].total_trades == 0 and got["NOPE"].total_volume == 0.0
    assert got["NOPE"].message == "No data found" and got["BTCUSDT"].message is None


def test_symbols_sorted_without_null(trades):
    t = trades(msg(1, BASE_MS, 1, s="B"), msg(2, BASE_MS, 1, s="A"),
               json.dumps({"t": 3, "p": "1", "q": "1", "T": BASE_MS}))
    assert [r.symbol for r in available_symbols(t).collect()] == ["A", "B"]


def test_latest_trades_order_and_ties(trades):
    t = trades(*[msg(i, BASE_MS + (i // 2) * 1000, i + 1) for i in range(12)])
    rows = latest_trades(t, n=3).orderBy("rank").collect()
    assert [r.price for r in rows] == [12.0, 11.0, 10.0]
    assert [r.rank for r in rows] == [1, 2, 3]


def book(E, b, a, s="BTCUSDT"):
    return json.dumps({"e": "depthUpdate", "E": E, "s": s, "b": b, "a": a})


def test_latest_book_depth_zip_and_spread(values):
    bids = [[str(100 - i), "1"] for i in range(12)]
    df = decode_book(values(book(1, [["1", "1"]], [["2", "1"]]), book(2, bids, [["101", "2"]])))
    r = latest_book(df).collect()[0]
    assert len(r.bids) == 10 and r.bids[0].price == 100.0
    assert r.spread == 1.0
    flat = book_levels(latest_book(df)).collect()
    assert len(flat) == 11 and max(x.level for x in flat) == 10


def test_unequal_arrays_zip_to_shortest(spark):
    df = spark.createDataFrame(
        [("X", dt.datetime(2024, 1, 1), [1.0, 2.0, 3.0], [5.0], [], [])],
        "symbol string, event_time timestamp, bid_prices array<double>, "
        "bid_quantities array<double>, ask_prices array<double>, ask_quantities array<double>",
    )
    r = latest_book(df).collect()[0]
    assert [(x.price, x.quantity) for x in r.bids] == [(1.0, 5.0)]
    assert r.asks == [] and r.spread == 0.0


def test_time_text(spark):
    df = spark.createDataFrame(
        [(0, dt.datetime(2024, 1, 1, 0, 0, 7)), (1700000000123, dt.datetime(2024, 1, 1, 0, 0, 7, 179000)),
         (None, None)],
        "ms long, t timestamp",
    )
    got = df.select(ms_text("ms").alias("a"), iso_text("t").alias("b")).collect()
    assert got[0].a is None and got[0].b == "2024-01-01T00:00:07"
    assert got[1].a == "2023-11-14 22:13:20.123" and got[1].b == "2024-01-01T00:00:07.179000"
    assert got[2].a is None and got[2].b is None


def test_candles_stay_in_hash_aggregate(trades):
    text = plan_text(candles(trades(msg(1, BASE_MS, 1)), "1h"))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_latest_trades_limit_before_shuffle(spark):
    """A symbol's earlier days are dropped by a join before its rows are dealt to a rank, at every n."""
    from conftest import SF_SMALL
    from tickflow import catalog

    for n in (10, 5000):
        text = plan_text(latest_trades(catalog.trades(spark, SF_SMALL), n), "simple")
        slots = re.search(r"Exchange hashpartitioning\(\w+#\d+, slot#", text)
        assert slots and "first_day" in text[slots.end() :] and "Join" in text[slots.end() :]
