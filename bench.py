"""Benchmark: ingest (feed JSON -> decoded serving tables; symbol/day trade history) and the
market questions over the written tables, at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each timing is the median of ``$BENCH_RUNS`` warm runs (default 3), executed with the ``noop``
sink so that every row is computed and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickflow import schemas as S  # noqa: E402
from tickflow.operators.accounts import bulk_delete, list_accounts  # noqa: E402
from tickflow.operators.candles import candles, latest_candles  # noqa: E402
from tickflow.operators.decode import decode_book, decode_tickers, decode_trades  # noqa: E402
from tickflow.operators.filters import latest_time  # noqa: E402
from tickflow.operators.latest import latest_book, latest_trades  # noqa: E402
from tickflow.operators.stats import available_symbols, trade_stats  # noqa: E402
from tickflow.plans.session import build_session, scratch_path  # noqa: E402
from tickflow.sources import feeds  # noqa: E402
from tickflow.sources.serving import read_table  # noqa: E402
from tickflow.streaming.fanout import start_feed  # noqa: E402
from tickflow.streaming.sinks import AVAILABLE_NOW, write_history  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
STREAM_FILES = 20


def _sf(path: str) -> str:
    base = os.path.basename(os.path.normpath(path))
    return base[2:] if base.startswith("sf") else base


def timed(fn, runs=RUNS):
    fn()  # warm-up (JIT, file listing, codegen cache)
    ts = []
    for _ in range(runs):
        t = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t)
    return round(statistics.median(ts), 3)


def noop(df):
    return lambda: df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(
        f"local[{CPUS}]",
        app="tickflow-bench",
        shuffle_partitions=CPUS * 2,
        extra={"spark.driver.memory": "16g"},
    )
    tbl = lambda n: spark.read.parquet(os.path.join(SF_DIR, f"{n}.parquet"))
    root = scratch_path(spark, "bench")
    q, rows = {}, {}

    # --- ingest: wire JSON derived from the tables -> decoded -> serving tables ---------------
    # The source tables are split into CPUS partitions, as a topic with that many partitions
    # would be (the test files hold a single row group and would otherwise feed one task).
    src = lambda n: tbl(n).repartition(CPUS)
    ingest = {
        "trades": (decode_trades(feeds.trade_feed(src("events"))), ("TradeTime", "Symbol")),
        "tickers": (decode_tickers(feeds.ticker_feed(src("lineitem"))), ("event_time", "symbol")),
        "orderbook": (
            decode_book(feeds.book_feed(src("orders"), src("lineitem"))),
            ("event_time", "symbol"),
        ),
    }
    for name, (df, order) in ingest.items():
        path = os.path.join(root, name)

        def write(df=df, order=order, path=path):
            df.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)

        q[f"ingest_{name}"] = timed(write)
        rows[name] = spark.read.parquet(path).count()

    # Historical store in the symbol/day layout (S2), for trades: 5 symbols x 30 days.
    hist = os.path.join(root, "trades_history")
    clean = spark.read.parquet(os.path.join(root, "trades"))
    q["history_trades"] = timed(
        lambda: write_history(clean, hist, S.TRADES_PARTITIONS, ("TradeTime",), mode="overwrite")
    )

    # --- streaming: the trade feed as 20 time-ordered files (a feed arrives in time order), one
    # file per micro-batch: decode -> history (exactly-once file sink), then serving table
    # (contract) and rejects streamed from the history's committed files
    src_dir = os.path.join(root, "events_files")
    tbl("events").repartitionByRange(STREAM_FILES, "ts").write.mode("overwrite").parquet(src_dir)
    ev_schema = tbl("events").schema
    progress = {}

    def stream_run():
        out = scratch_path(spark, "bench-stream")
        raw = feeds.trade_feed(
            spark.readStream.schema(ev_schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
        )
        qs = start_feed(raw, "trades", out, out + "-cp", trigger=AVAILABLE_NOW)
        for qy in qs:
            qy.awaitTermination()
        progress["batches"] = [p["durationMs"]["triggerExecution"] for p in qs[0].recentProgress]

    q["stream_trades"] = timed(stream_run)
    batch_ms = sorted(progress.get("batches", [0]))
    stream_info = {
        "micro_batches": len(batch_ms),
        "median_batch_ms": batch_ms[len(batch_ms) // 2],
        "max_batch_ms": batch_ms[-1],
    }

    trades = read_table(spark, hist, S.TRADES)
    book = spark.read.parquet(os.path.join(root, "orderbook"))
    as_of = latest_time(trades, "TradeTime")

    # --- market questions over the written tables ---------------------------------------------
    for i in ("1m", "1h", "1d"):
        q[f"candles_{i}"] = timed(noop(candles(trades, i)))
    q["candles_latest_n"] = timed(noop(latest_candles(trades, "1m", 100, as_of, 24)))
    q["trade_stats"] = timed(noop(trade_stats(trades, as_of, 24)))
    q["trade_stats_30d"] = timed(noop(trade_stats(trades, as_of, 720)))
    q["latest_trades"] = timed(noop(latest_trades(trades, 10)))
    q["latest_book"] = timed(noop(latest_book(book, 10)))
    q["symbols"] = timed(noop(available_symbols(trades)))

    cust = tbl("customer")
    info, bal = feeds.account_info(cust), feeds.account_balance(cust)
    q["accounts_list"] = timed(noop(list_accounts(info, bal)))
    q["accounts_bulk_delete"] = timed(
        noop(list_accounts(*bulk_delete(info, bal, feeds.delete_requests(cust))))
    )

    total = round(sum(q.values()), 3)
    ingest_sec = sum(v for k, v in q.items() if k.startswith("ingest_"))
    out = {
        "metric": "total_query_sec",
        "value": total,
        "unit": "sec",
        "queries": q,
        "sf": _sf(SF_DIR),
        "cpus": CPUS,
        "runs": RUNS,
        "rows": rows,
        "ingest_rows_per_sec": round(sum(rows.values()) / ingest_sec) if ingest_sec else None,
        "stream": stream_info,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
