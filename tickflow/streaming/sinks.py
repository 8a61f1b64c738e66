"""Stream sinks (S2, S3, S4), triggers (S8) and append + checkpoint.

Every sink writes from the executors.  The table sink is replay-safe: a micro-batch is written
with dynamic partition overwrite into its own ``batch_id`` partition, so a batch re-run after a
failure (same id, same offsets from the checkpoint) replaces its earlier output instead of
adding to it.  Errors are not swallowed: a failed batch fails the query, which then restarts
from the checkpoint.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickflow.sources.files import Folder
from tickflow.streaming.registry import STREAMED, symbol_days, write_months

# Fixed value: default processing-time trigger of the live feeds.
PROCESSING_TIME = "2 seconds"
AVAILABLE_NOW = "available_now"
BATCH_COL = "batch_id"
WRITER_COL = "writer_id"


def trigger_options(trigger=None) -> dict:
    """``None`` -> every 2 s; ``'available_now'`` -> drain what is there and stop (tests,
    backfills); another string -> that processing interval; a dict is passed through."""
    if trigger is None:
        return {"processingTime": PROCESSING_TIME}
    if isinstance(trigger, dict):
        return trigger
    if trigger == AVAILABLE_NOW:
        return {"availableNow": True}
    return {"processingTime": trigger}


def start_stream(
    df: DataFrame, checkpoint: str, trigger=None, layout: Sequence[str] = (), body=None, **sink
) -> StreamingQuery:
    """Every streaming output: append mode, its own checkpoint (S9), a trigger (S8).  ``body`` is a
    ``foreachBatch`` function, or ``sink`` names a format and its options; ``layout`` are the
    partition columns of a file format."""
    out = df.writeStream.outputMode("append").trigger(**trigger_options(trigger))
    if body is not None:
        out = out.foreachBatch(body)
    else:
        out = out.format(sink.pop("format")).options(**sink)
    if layout:
        out = out.partitionBy(list(layout))
    return out.option("checkpointLocation", checkpoint).start()


def write_parquet_stream(
    df: DataFrame, path: str, checkpoint: str, layout: Sequence[str] = (), trigger=None
) -> StreamingQuery:
    """Hive-partitioned parquet; exactly-once through the sink's own log.

    A batch is rebalanced on its folders first, as in ``write_history``: a folder gets a file, or several if it is large,
    and not one from each task of the batch, whose product with the folders grows faster than the rows."""
    if layout:
        df = df.hint("rebalance", *layout)
    return start_stream(df, checkpoint, trigger, layout, format="parquet", path=path)


def write_console_stream(
    df: DataFrame, checkpoint: str, columns: Sequence[str] = (), trigger=None, shown: int = 20
) -> StreamingQuery:
    """S3: prints the columns (all if none are named) of each batch, untruncated.  ``shown`` limits
    the rows on the screen, as Spark does by default; it touches no stored row."""
    view = df.select(*columns) if columns else df
    return start_stream(view, checkpoint, trigger, format="console", truncate=False, numRows=shown)


def write_topic_stream(
    df: DataFrame, servers: str, topic: str, checkpoint: str, trigger=None
) -> StreamingQuery:
    """Publishes a ``value`` (and ``key``) column to a topic; needs the Kafka connector."""
    kafka = {"kafka.bootstrap.servers": servers, "topic": topic}
    return start_stream(df, checkpoint, trigger, format="kafka", **kafka)


def writer_of(df: DataFrame) -> str:
    """The streaming query that a micro-batch belongs to, by the id that its checkpoint keeps."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def table_batch_writer(
    path: str,
    partition_cols: Sequence[str] = (),
    sort_cols: Sequence[str] = (),
    fmt: str = "parquet",
    rebalance: bool = True,
    on_batch: Callable[[int, int], None] | None = None,
) -> Callable[..., None]:
    """S4 body for ``foreachBatch``: writes the batch by column name into ``partition_cols`` + the
    query's id + ``batch_id`` with dynamic partition overwrite.

    The query's id comes from its checkpoint: a batch that is run again replaces itself, and a query with a
    new checkpoint, whose batches count from 0 again, adds to the table.  An empty batch
    writes no partition (A6); ``on_batch`` gets the batch's number and its row count, counted while it is written.

    With partition columns and ``rebalance`` the batch is rebalanced on them first: one task per
    partition value, and AQE splits a hot value (one symbol with a third of the rows) over several
    tasks/files.  ``sort_cols`` orders rows within each file (the serving order, e.g. time then symbol), which
    keeps parquet min/max statistics tight for later pushed filters."""

    def write(batch_df: DataFrame, batch_id: int, writer: str | None = None) -> None:
        observed = Observation()
        out = batch_df.observe(observed, F.count(F.lit(1)).alias("n"))
        out = out.withColumn(WRITER_COL, F.lit(writer or writer_of(batch_df)))
        out = out.withColumn(BATCH_COL, F.lit(batch_id).cast("long"))
        if partition_cols and rebalance:
            out = out.hint("rebalance", *partition_cols)
        if sort_cols:  # by folder first, or else the write sorts by folder alone
            out = out.sortWithinPartitions(*partition_cols, WRITER_COL, BATCH_COL, *sort_cols)
        (
            out.write.format(fmt)
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_cols, WRITER_COL, BATCH_COL)
            .save(path)
        )
        if on_batch is not None:
            on_batch(batch_id, observed.get.get("n", 0))

    return write


def write_table_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_cols: Sequence[str] = (),
    sort_cols: Sequence[str] = (),
    trigger=None,
    on_batch: Callable[[int, int], None] | None = None,
) -> StreamingQuery:
    """Micro-batch table sink through ``foreachBatch``, always with a checkpoint."""
    body = table_batch_writer(path, partition_cols, sort_cols, on_batch=on_batch)
    return start_stream(df, checkpoint, trigger, body=lambda b, i: body(b, i))


def write_registry_stream(
    df: DataFrame, path: str, checkpoint: str, symbol_col: str, trigger=None
) -> StreamingQuery:
    """A5: one row for each symbol and day of a micro-batch, beside a streamed store."""
    write = table_batch_writer(os.path.join(path, STREAMED))
    return start_stream(df, checkpoint, trigger, body=lambda b, i: write(symbol_days(b, symbol_col).coalesce(1), i))


def write_history(
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str],
    sort_cols: Sequence[str] = (),
    mode: str = "overwrite",
    registry: str | None = None,
    symbol_col: str = "Symbol",
) -> None:
    """Batch write (backfill) into the hive-partitioned history store.

    The default replaces exactly the partitions present in ``df`` (dynamic partition overwrite)
    and leaves all others alone, so re-running a failed or repeated backfill of some days gives
    the same table instead of duplicate rows.  ``REBALANCE`` on the partition columns gathers
    each partition value into few files, and AQE splits skewed values instead of sending a hot
    symbol-day to a single task.  The symbols of the months written go to a ``registry``, if one is given."""
    if Folder(df.sparkSession, path).exists("_spark_metadata"):
        raise ValueError(
            f"{path} is written by a stream, whose log hides other files: write the backfill to a "
            "folder of its own and read both (read_table and Market take several)"
        )
    seen = Observation()
    out = df.observe(seen, F.collect_set(F.struct("Year", "Month")).alias("months")) if registry else df
    out = out.hint("rebalance", *partition_cols)
    if sort_cols:  # by folder first, or else the write sorts by folder alone
        out = out.sortWithinPartitions(*partition_cols, *sort_cols)
    (
        out.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols)
        .parquet(path)
    )
    if registry:
        months = [tuple(m) for m in seen.get["months"] if None not in tuple(m)]
        write_months(df.sparkSession.read.schema(df.schema).parquet(path), months, registry, symbol_col)
