"""The store keeps every row; lookbacks don't depend on zones; bad messages don't stop a feed."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.timecols import calendar_columns, ms_to_ts
from tickflow.operators.decode import decode_trades
from tickflow.operators.filters import since
from tickflow.plans.session import shared_dir
from tickflow.sources.serving import read_table
from tickflow.streaming.fanout import start_feed
from tickflow.streaming.sinks import write_history, write_table_stream

BASE = {"e": "trade", "E": 1700000000123, "s": "0700", "t": 1, "p": "1.5", "q": "2", "T": 1700000000120, "m": True}


def message(**changes):
    return json.dumps(BASE | changes)


@pytest.fixture()
def feed(spark, tmp_path):
    path = str(tmp_path / "feed")
    os.mkdir(path)

    def add(name, *lines):
        with open(os.path.join(path, name), "w") as f:
            f.write("\n".join(lines))

    return path, add


def test_time_out_of_range_is_null(spark, values):
    rows = decode_trades(values(message(), message(t=2, T=2**63 - 1), message(t=3, E=-(2**62)))).collect()
    assert [(r.TradeTime is None, r.EventTime is None) for r in sorted(rows, key=lambda r: r.TradeID)] == [
        (False, False), (True, False), (False, True),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Ho_Chi_Minh"])
def test_lookback_in_any_zone(spark, monkeypatch, zone):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        end = 1_700_000_000_000
        df = spark.range(0, 8).select(ms_to_ts(F.lit(end) - F.col("id") * 1_800_000).alias("ts"))
        df = df.select("ts", *[c.alias(n) for n, c in calendar_columns("ts").items()])
        as_of = dt.datetime(2023, 11, 14, 22, 13, 20)
        for given in (as_of, as_of.isoformat(), as_of.replace(tzinfo=dt.UTC), F.timestamp_millis(F.lit(end))):
            for hours, n in ((0.5, 2), (1, 3), (1.9, 4)):
                assert since(df, "ts", given, hours).count() == n
        assert since(df.drop("Year"), "ts", as_of, 0.5).count() == 2
        first = df.orderBy(F.desc("ts")).first()
        assert (first.Year, first.Month, first.Day) == (2023, 11, 14)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        monkeypatch.undo()
        time.tzset()


def test_symbols_stay_text(spark, values, tmp_path):
    out = str(tmp_path / "history")
    write_history(decode_trades(values(message(), message(s="0005"))), out, S.TRADES_PARTITIONS)
    rows = read_table(spark, out, contract=S.TRADES).collect()
    assert sorted(r.Symbol for r in rows) == ["0005", "0700"]


def test_dict_trigger_serves(spark, feed, tmp_path):
    path, add = feed
    add("a", message(), message(t=2))
    raw = spark.readStream.text(path)
    for q in start_feed(raw, "trades", str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}):
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/serving/trades")).count() == 2


def test_backfill_into_a_stream_is_refused(spark, feed, values, tmp_path):
    path, add = feed
    add("a", message())
    raw = spark.readStream.text(path)
    for q in start_feed(raw, "trades", str(tmp_path / "out"), str(tmp_path / "cp"), "available_now"):
        q.awaitTermination()
    with pytest.raises(ValueError, match="stream"):
        write_history(decode_trades(values(message())), str(tmp_path / "out/history/trades"), S.TRADES_PARTITIONS)


def test_new_checkpoint_adds_rows_and_counts_are_told(spark, feed, tmp_path):
    path, add = feed
    add("a", message(), message(t=2), "junk", message(t=3, T=2**63 - 1))
    told = []
    for cp in ("one", "two"):
        clean = decode_trades(spark.readStream.text(path))
        write_table_stream(
            clean, str(tmp_path / "out"), str(tmp_path / cp), trigger="available_now",
            on_batch=lambda i, n: told.append((i, n)),
        ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 and told == [(0, 3), (0, 3)]


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_files_are_sorted(spark, tmp_path):
    """The order within files holds beside the order of folders that a partitioned write makes."""
    from conftest import SF_SMALL
    from tickflow import catalog
    from tickflow.streaming.sinks import table_batch_writer

    t = catalog.trades(spark, SF_SMALL).repartition(3)
    write_history(t, str(tmp_path / "h"), S.DAY_PARTITIONS, ("Symbol", "TradeTime"))
    table_batch_writer(str(tmp_path / "t"), S.DAY_PARTITIONS, ("Symbol", "TradeTime"))(t, 7)
    for name in ("h", "t"):
        for file in spark.read.parquet(str(tmp_path / name)).inputFiles()[:5]:
            rows = [tuple(r) for r in spark.read.parquet(file).select("Symbol", "TradeTime").collect()]
            assert len(rows) > 3 and rows == sorted(rows)
