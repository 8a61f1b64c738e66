"""Plan shape: column pruning, partition pruning, pushed filters, no Python evaluation."""

import datetime as dt
import tempfile

import pytest

from tickflow import catalog
from tickflow import schemas as S
from tickflow.operators.candles import candles
from tickflow.operators.latest import latest_trades
from tickflow.operators.stats import trade_stats
from tickflow.plans.inspect import plan_text
from tickflow.sources.serving import read_table
from tickflow.streaming.sinks import write_history
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def history(spark):
    path = tempfile.mkdtemp() + "/trades"
    write_history(catalog.trades(spark, SF_SMALL), path, S.TRADES_PARTITIONS, ("TradeTime",))
    return read_table(spark, path, S.TRADES)


def test_lookback_prunes_day_partitions(history):
    df = trade_stats(history, as_of=dt.datetime(2024, 1, 30), hours=24)
    text = plan_text(df)
    assert "PartitionFilters: [" in text and "make_date(Year" in text
    assert "PushedFilters: [IsNotNull(TradeTime), GreaterThanOrEqual(TradeTime" in text


def test_candles_read_only_needed_columns(history):
    text = plan_text(candles(history, "1h"))
    scan = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert scan and all("Quantity" not in s and "Side" not in s for s in scan), scan


def test_symbol_filter_prunes(history):
    text = plan_text(latest_trades(history, 10, symbols=["BTCUSDT"]))
    pf = [line for line in text.splitlines() if line.startswith("PartitionFilters")]
    assert pf and "Symbol" in pf[0] and "= BTCUSDT" in pf[0], pf


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_evaluation(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    text = plan_text(catalog.QUERIES[name](spark, SF_SMALL), "simple")
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_lookback_with_aware_as_of(history):
    aware = dt.datetime(2024, 1, 30, 1, 0, tzinfo=dt.timezone(dt.timedelta(hours=5)))
    naive = dt.datetime(2024, 1, 29, 20, 0)
    a = trade_stats(history, as_of=aware, hours=24).collect()
    b = trade_stats(history, as_of=naive, hours=24).collect()
    assert sorted(a) == sorted(b) and len(a) > 0


def test_latest_book_lookback_prunes(spark):
    from tickflow.operators.latest import latest_book

    path = tempfile.mkdtemp() + "/book"
    b = catalog.book(spark, SF_SMALL).where("symbol = '1-URGENT'")
    write_history(b, path, S.ORDERBOOK_PARTITIONS)
    hist = read_table(spark, path, S.ORDERBOOK)
    last = b.agg({"event_time": "max"}).first()[0]
    df = latest_book(hist, 10, as_of=last, lookback_hours=48)
    pf = [line for line in plan_text(df).splitlines() if line.startswith("PartitionFilters")]
    assert pf and "make_date" in pf[0], pf
    full = latest_book(hist, 10).first()
    assert df.first().event_time == full.event_time == last
