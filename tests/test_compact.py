"""Closed days rewritten and handed over; each row once before, during and after."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickflow import catalog
from tickflow import schemas as S
from tickflow.operators.decode import decode_trades
from tickflow.sources import feeds
from tickflow.sources.files import Folder
from tickflow.streaming.compact import compact_days, handover, read_compacted
from tickflow.streaming.sinks import AVAILABLE_NOW, write_parquet_stream
from conftest import SF_SMALL

LAST = dt.date(2024, 1, 30)


def state(df):
    cols = [F.col(c).cast("string") for c in S.TRADES.fieldNames()]
    return df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()


@pytest.fixture()
def store(spark, tmp_path):
    """A streamed store and a function that streams more trades into it."""
    root, feed = str(tmp_path / "stream"), str(tmp_path / "feed")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    schema = events.schema

    def add(part):
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        write_parquet_stream(
            decode_trades(feeds.trade_feed(source)), root, str(tmp_path / "cp"), S.TRADES_PARTITIONS, AVAILABLE_NOW
        ).awaitTermination()

    # dealt by chance, so that every batch adds a file to every symbol and day
    add(events.repartition(3))
    return root, str(tmp_path / "closed"), add, events


def test_each_row_once(spark, store):
    root, target, add, events = store
    whole = state(catalog.trades(spark, SF_SMALL))
    assert state(read_compacted(spark, root, target, S.TRADES)) == whole
    assert compact_days(spark, root, target, S.TRADES, LAST, publish=False)  # stopped before the handover
    assert handover(spark, target) == {} and state(read_compacted(spark, root, target, S.TRADES)) == whole
    report = compact_days(spark, root, target, S.TRADES, LAST)
    assert len(report) == 29 and all(r.files_before >= 10 and r.files_after == 1 for r in report)
    assert set(handover(spark, target)) == {r.day for r in report} and LAST not in handover(spark, target)
    after = read_compacted(spark, root, target, S.TRADES)
    assert state(after) == whole
    assert sum("/closed/" in f for f in after.inputFiles()) >= 29
    # nothing to do: no new version
    assert compact_days(spark, root, target, S.TRADES, LAST) == []
    assert Folder(spark, target).names("_handover/*.json") == ["000000002.json"]


def test_late_files_are_read_and_then_taken_in(spark, store):
    root, target, add, events = store
    compact_days(spark, root, target, S.TRADES, LAST)
    late = events.where("day(ts) IN (3, 4, 30)")
    add(late.coalesce(1))
    both = state(catalog.trades(spark, SF_SMALL).unionByName(decode_trades(feeds.trade_feed(late))))
    assert state(read_compacted(spark, root, target, S.TRADES)) == both
    report = compact_days(spark, root, target, S.TRADES, LAST)
    assert [r.day.day for r in report] == [3, 4] and {h.version for h in handover(spark, target).values()} == {1, 2}
    assert state(read_compacted(spark, root, target, S.TRADES)) == both


def test_one_symbol(spark, store):
    root, target, add, events = store
    compact_days(spark, root, target, S.TRADES, LAST)
    got = read_compacted(spark, root, target, S.TRADES, ["BTCUSDT"])
    assert state(got) == state(catalog.trades(spark, SF_SMALL).where("Symbol = 'BTCUSDT'"))


def test_rows_are_sorted_in_their_files(spark, store):
    root, target, add, events = store
    compact_days(spark, root, target, S.TRADES, LAST)
    day = spark.read.parquet(f"{target}/data").where("Day = 7").select("Symbol", "TradeTime").collect()
    assert day == sorted(day) and len(day) > 5


def test_published_file_is_whole_or_absent(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    folder.publish("a/1.json", "{}")
    assert folder.read("a/1.json") == "{}"
    with pytest.raises(FileExistsError):
        folder.publish("a/1.json", "other")
    assert folder.read("a/1.json") == "{}"
