"""A6 for the operator of a stream: the rows of every micro-batch, in and out of each output.

Rows out are counted while they are written (``observe``), rows in are Spark's own count of the source; both arrive with the
query's progress, so no batch is read twice."""

from __future__ import annotations

import threading
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class BatchCount(NamedTuple):
    output: str
    run_id: str
    batch_id: int
    rows_in: int
    rows_out: int


def counted(df: DataFrame, output: str) -> DataFrame:
    """``df``, whose rows are counted under the name of an output."""
    return df.observe(output, F.count(F.lit(1)).alias("rows_out"))


class BatchCounts(StreamingQueryListener):
    """Records the counts of every batch of the session's streams that hold a ``counted`` output."""

    def __init__(self) -> None:
        self._counts: dict[tuple[str, str, int], BatchCount] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._news:
            for output, seen in p.observedMetrics.items():
                row = BatchCount(output, str(p.runId), p.batchId, p.numInputRows, seen.asDict().get("rows_out") or 0)
                self._counts[output, row.run_id, row.batch_id] = row

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def rows(self) -> list[BatchCount]:
        """All batches recorded, by output and batch; one without rows isn't listed."""
        with self._news:
            return sorted(c for c in self._counts.values() if c.rows_in or c.rows_out)

    def wait(self, *queries: StreamingQuery, timeout: float = 60.0) -> None:
        """Until the last news of queries that have ended is recorded; Spark delivers them a moment later."""
        until = time.monotonic() + timeout
        runs = {str(q.runId) for q in queries}
        with self._news:
            while not runs <= self._ended:
                if not self._news.wait(max(0.0, until - time.monotonic())):
                    raise TimeoutError("the streams' last counts didn't arrive")

    def dataframe(self, spark: SparkSession) -> DataFrame:
        schema = "output string, run_id string, batch_id long, rows_in long, rows_out long"
        return spark.createDataFrame([tuple(r) for r in self.rows()], schema)
