"""T1, T2 at any n: one plan, hot symbols, days searched back; A5 from the registry."""

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickflow import catalog
from tickflow import schemas as S
from tickflow.market import Market
from tickflow.operators.latest import latest_book, latest_trades
from tickflow.operators.ranking import SLOTS, newest
from tickflow.operators.stats import available_symbols
from tickflow.plans.inspect import plan_text
from tickflow.sources.files import layout_of, newest_days
from tickflow.sources.newest import search_back
from tickflow.streaming.registry import registry_path
from tickflow.streaming.sinks import write_history
from conftest import SF_SMALL

DAYS = [dt.date(2024, 1, d) for d in range(30, 0, -1)]


@pytest.fixture(scope="module", params=[S.DAY_PARTITIONS, S.TRADES_PARTITIONS], ids=["days", "symbols"])
def market(spark, request, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("market"))
    write_history(
        catalog.trades(spark, SF_SMALL), root + "/trades", request.param, registry=registry_path(root, "trades")
    )
    return Market(spark, root)


def days_read(df):
    return {r[0] for r in df.select(F.make_date("Year", "Month", "Day")).distinct().collect()}


def test_plan_is_the_same_at_every_n(spark):
    t = catalog.trades(spark, SF_SMALL)
    shapes = [re.findall(r"^\S*\s*\(\d+\) (\w+)", plan_text(latest_trades(t, n)), re.M) for n in (10, 1000, 5000)]
    assert shapes[0] == shapes[1] == shapes[2] and "Window" in str(shapes[0])


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_hot_symbol_and_ties(spark, n):
    """One symbol has most of the rows, many of them at one time, some without a time."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("S"), F.col("id") % 70)).otherwise(F.lit("HOT")).alias("Symbol"),
        F.when(F.col("id") % 977 != 0, F.timestamp_millis(F.lit(1_700_000_000_000) - F.floor(F.col("id") / 50) * 3_600_000)).alias("TradeTime"),
        F.col("id").alias("TradeID"),
    ).unionByName(spark.sql("SELECT CAST(NULL AS string) Symbol, current_timestamp() TradeTime, 1L TradeID"))
    got = newest(rows, "Symbol", "TradeTime", n, ("TradeID",)).collect()
    want = {}
    key = lambda r: (r.TradeTime is not None, r.TradeTime or dt.datetime.min, r.TradeID)
    for r in sorted(rows.where("Symbol IS NOT NULL").collect(), key=key, reverse=True):
        want.setdefault(r.Symbol, []).append(r.TradeID)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.Symbol, []).append(r.TradeID)
    assert found == {s: ids[:n] for s, ids in want.items()}


def test_no_task_gets_a_symbol_s_history(spark):
    """What reaches the last rank is bounded by slots and n, and what reaches the slots by the days that hold n rows."""
    n = 50
    rows = spark.range(200_000).select(
        F.lit("HOT").alias("Symbol"),
        F.timestamp_millis(F.lit(1_700_000_000_000) - F.col("id") * 600_000).alias("TradeTime"),
        F.col("id").alias("TradeID"),
    )
    from tickflow.operators.ranking import day_of, first_days

    first = first_days(rows, "Symbol", "TradeTime", n).first().first_day
    left = rows.where(day_of(rows, "TradeTime") >= F.lit(first)).count()
    assert n <= left <= n + 144  # a day has 144 of them
    slots = Counter(r[0] for r in rows.select(F.pmod(F.xxhash64("TradeTime", "TradeID"), F.lit(SLOTS))).collect())
    assert len(slots) == SLOTS and max(slots.values()) < 1.2 * 200_000 / SLOTS


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, d), d, 0, "x") for d in (1, 2, 3)], "k string, t timestamp, id int, slot int, first_day string")
    rows = newest(df, "k", "t", 2, ("id",)).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.slot, r.first_day) for r in rows] == [(3, 1, 0, "x"), (2, 2, 0, "x")]


def test_days_newest_first(spark, market):
    path = market.roots[0] + "/trades"
    layout = layout_of(spark, path)
    below = "Symbol" if layout[0] == "Symbol" else None
    assert list(newest_days(spark, [path], below)) == DAYS


def test_search_opens_few_days(market):
    t = market.trades()
    part = market.newest("trades", t, None, "Symbol", 3)
    days = days_read(part)
    assert days <= set(DAYS[:2]) and days  # about 66 rows a symbol and day at sf0.01, 7 here
    assert "PartitionFilters: [" in plan_text(part)
    got, want = market.realtime(limit=3), latest_trades(t, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_search_of_too_many_is_the_full_read(market):
    t = market.trades()
    assert days_read(market.newest("trades", t, None, "Symbol", 10**6)) == set(DAYS)
    got, want = market.realtime(limit=2000), latest_trades(t, 2000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_search_for_one_symbol_and_for_an_unknown_one(market):
    t = market.trades("BTCUSDT")
    assert len(days_read(market.newest("trades", t, "BTCUSDT", "Symbol", 5))) <= 3
    assert market.realtime("NOPE").count() == 0


def test_search_counts_rows_not_days(spark):
    """A symbol with fewer rows in the newest days takes the search further back."""
    rows = [("A", d, i) for d in range(1, 31) for i in range(10)] + [("B", 3, 0), ("B", 18, 1)]
    df = spark.createDataFrame([(s, 2024, 1, d, i) for s, d, i in rows], "Symbol string, Year int, Month int, Day int, i int")
    wanted = df.select("Symbol").distinct()
    part, day = search_back(df, iter(DAYS), "Symbol", 1, wanted)
    assert day == dt.date(2024, 1, 15) and part.where("Symbol = 'B'").count() >= 1
    part, day = search_back(df, iter(DAYS), "Symbol", 1, wanted.where("Symbol = 'A'"))
    assert day == dt.date(2024, 1, 30)
    part, day = search_back(df, iter(DAYS), "Symbol", 1, wanted.where("Symbol = 'A'"), at_least=dt.date(2024, 1, 27))
    assert day <= dt.date(2024, 1, 27)
    assert search_back(df, iter(DAYS), "Symbol", 3, wanted)[1] is None


def test_registry_is_the_full_scan(spark, market):
    full = available_symbols(market.trades()).collect()
    assert market.symbols().collect() == full and len(full) == 5
    text = plan_text(market.symbols())
    assert "/trades" not in text.replace("symbols/trades", "")  # no data file is listed


def test_registry_after_a_backfill_that_takes_a_symbol_away(spark, tmp_path):
    t = catalog.trades(spark, SF_SMALL)
    path, reg = str(tmp_path / "trades"), registry_path(str(tmp_path), "trades")
    write_history(t, path, S.DAY_PARTITIONS, registry=reg)
    write_history(t.where("Symbol = 'BTCUSDT'"), path, S.DAY_PARTITIONS, registry=reg)
    m = Market(spark, str(tmp_path))
    assert [tuple(r) for r in m.symbols().collect()] == [tuple(r) for r in available_symbols(m.trades()).collect()]
    counts = {r.day: r.n for r in m.registry().groupBy("day").agg(F.sum("rows").alias("n")).collect()}
    stored = {r.day: r.n for r in m.trades().groupBy(F.make_date("Year", "Month", "Day").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert counts == stored


def test_market_without_registry(spark, tmp_path):
    write_history(catalog.trades(spark, SF_SMALL), str(tmp_path / "trades"), S.DAY_PARTITIONS)
    m = Market(spark, str(tmp_path))
    assert m.registry() is None and m.symbols().count() == 5 and m.realtime(limit=4).count() == 20


def test_latest_book_over_days(spark, tmp_path):
    b = catalog.book(spark, SF_SMALL).where("Year = 1995")
    write_history(b, str(tmp_path / "orderbook"), S.DAY_PARTITIONS, registry=registry_path(str(tmp_path), "orderbook"), symbol_col="symbol")
    m = Market(spark, str(tmp_path))
    part = m.newest("orderbook", m.book(), None, "symbol", 1)
    assert 0 < len(days_read(part)) < 20
    assert sorted(map(str, m.orderbook().collect())) == sorted(map(str, latest_book(b).collect()))
