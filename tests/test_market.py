"""The served questions over written history tables, with the reference's defaults."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tickflow import catalog
from tickflow import schemas as S
from tickflow.market import Market
from tickflow.operators.filters import latest_time
from tickflow.sources import feeds
from tickflow.streaming.sinks import write_history
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def market(spark):
    root = tempfile.mkdtemp()
    write_history(catalog.trades(spark, SF_SMALL), root + "/trades", S.TRADES_PARTITIONS)
    # the book is written flat (its fixture dates would make one folder per day and symbol)
    catalog.book(spark, SF_SMALL).write.parquet(root + "/orderbook")
    cust = catalog.table(spark, SF_SMALL, "customer")
    return Market(spark, root, (feeds.account_info(cust), feeds.account_balance(cust)))


def test_price_history_defaults(market):
    t = market.trades()
    as_of = t.select(F.max("TradeTime")).first()[0]
    df = market.price_history("BTCUSDT", as_of=as_of)
    rows = df.collect()
    assert 0 < len(rows) <= 100 and {r.symbol for r in rows} == {"BTCUSDT"}
    assert {r.interval for r in rows} == {"1m"}


def test_realtime_one_and_all(market):
    assert market.realtime("ETHUSDT").count() == 10
    assert market.realtime().count() == 50


def test_stats_unknown_symbol(market):
    as_of = latest_time(market.trades(), "TradeTime")
    got = {r.symbol: r for r in market.stats(["BTCUSDT", "NOPE"], as_of=as_of).collect()}
    assert got["NOPE"].total_trades == 0 and got["NOPE"].message == "No data found"
    assert got["BTCUSDT"].total_trades > 0


def test_orderbook_and_symbols(market):
    ob = market.orderbook("1-URGENT").collect()
    assert len(ob) == 1 and len(ob[0].bids) <= 10
    assert [r.symbol for r in market.symbols().collect()] == sorted(
        ["BNBBTC", "BTCUSDT", "ETHUSDT", "SOLETH", "XRPUSDT"]
    )


def test_users(market):
    assert market.users().count() > 0
    assert market.user(["1", "999999"]).count() <= 1
    info2, _, outcome, counts = market.delete_users(["0", "1", "999999"])
    c = counts.first()
    assert c.success_count + c.fail_count == 3
    assert info2.where(F.col("user_id") == "1").count() == 0


def test_orderbook_without_data(market):
    rows = {r.symbol: r for r in market.orderbook(["1-URGENT", "NOPE"]).collect()}
    assert rows["1-URGENT"].message is None and rows["1-URGENT"].bids is not None
    assert rows["NOPE"].message == "No orderbook data" and rows["NOPE"].bids is None
