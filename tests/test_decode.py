"""Decoders: D1-D10, F1-F4 on hand-sized messages (FIXTURES.md §2)."""

import datetime as dt
import json
import math

from tickflow.operators.decode import decode_book, decode_tickers, decode_trades
from tickflow.plans.inspect import plan_text

GOOD = {
    "e": "trade", "E": 1700000000123, "s": "BTCUSDT", "t": 1, "p": "100.5", "q": "2",
    "T": 1700000000120, "m": True, "M": True,
}


def trade(**over):
    d = dict(GOOD)
    for k, v in over.items():
        if v is ...:
            d.pop(k, None)
        else:
            d[k] = v
    return json.dumps(d)


def test_good_trade(values):
    rows = decode_trades(values(trade())).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.Symbol == "BTCUSDT" and r.TradeID == 1
    assert r.Side == "SELL" and r.TradeValue == 201.0
    assert r.TradeTime == dt.datetime(2023, 11, 14, 22, 13, 20, 120000)
    assert r.EventTime == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert (r.Year, r.Month, r.Day, r.Hour) == (2023, 11, 14, 22)


def test_case_clashing_keys_are_kept_apart(values):
    # t (trade id) and T (trade time), m and M: each read from its exact-case key.
    r = decode_trades(values(trade(t=7, M=False))).collect()[0]
    assert r.TradeID == 7 and r.IsBuyerMaker is True


def test_maker_missing_is_buy(values):
    r = decode_trades(values(trade(m=...))).collect()[0]
    assert r.IsBuyerMaker is None and r.Side == "BUY"


def test_malformed_empty_null_give_no_row(values):
    assert decode_trades(values("not json", "", "  \t", None, "null", "[1]")).count() == 0


def test_bad_number_is_dropped_without_error(values):
    assert decode_trades(values(trade(p="abc"))).count() == 0


def test_nan_price_is_kept(values):
    rows = decode_trades(values(trade(p="NaN"))).collect()
    assert len(rows) == 1 and math.isnan(rows[0].Price)


def test_zero_quantity_dropped(values):
    assert decode_trades(values(trade(q="0"))).count() == 0


def test_missing_symbol_kept_in_trades(values):
    rows = decode_trades(values(trade(s=...))).collect()
    assert len(rows) == 1 and rows[0].Symbol is None


TICK = {"e": "1hTicker", "E": 1700000000000, "s": "S1", "O": 1700000000000,
        "C": 1700003600000, "o": "10", "h": "12", "l": "9", "c": "11", "v": "5", "q": "50"}


def ticker(**over):
    d = dict(TICK)
    for k, v in over.items():
        if v is ...:
            d.pop(k)
        else:
            d[k] = v
    return json.dumps(d)


def test_ticker_rules(values):
    df = values(
        ticker(),
        ticker(h="1", l="2"),  # high < low
        ticker(v="0"),  # volume 0 kept
        ticker(s=...),  # missing symbol
        ticker(o="0"),  # open not > 0
    )
    rows = decode_tickers(df).collect()
    assert len(rows) == 2
    r = rows[0]
    assert r.event_type == "1hTicker" and r.open_price == 10.0 and r.close_price == 11.0
    assert r.close_time - r.open_time == dt.timedelta(hours=1)
    assert {x.volume for x in rows} == {5.0, 0.0}


def book(b, a, s="BTCUSDT", E=1700000000000):
    d = {"e": "depthUpdate", "E": E, "b": b, "a": a}
    if s is not None:
        d["s"] = s
    return json.dumps(d)


def test_book_rules(values):
    df = values(
        book([["1", "2"]], []),  # one-sided: kept
        book([], []),  # empty: dropped
        book([["3"]], [["4", "5"]]),  # short level
        book([["1", "2"]], [["3", "4"]], s=None),  # no symbol: dropped
    )
    rows = sorted(decode_book(df).collect(), key=lambda r: len(r.ask_prices))
    assert len(rows) == 2
    assert rows[0].bid_prices == [1.0] and rows[0].ask_prices == []
    assert rows[1].bid_prices == [3.0] and rows[1].bid_quantities == [None]
    assert rows[1].ask_quantities == [5.0]


def test_book_bad_number_is_null(values):
    r = decode_book(values(book([["x", "1"]], []))).collect()[0]
    assert r.bid_prices == [None] and r.bid_quantities == [1.0]


def test_json_parsed_once_per_message(values):
    """The quality filters must not re-parse the message (see ``parse_feed``)."""
    for dec in (decode_trades, decode_tickers, decode_book):
        text = plan_text(dec(values(trade())), "simple")
        assert text.count("from_json(") == 1, text
