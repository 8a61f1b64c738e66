"""S1 — stream sources that yield a ``value`` column for the decoders.

Kafka needs the ``spark-sql-kafka`` connector on the classpath (not in every image); any
DataFrame with a ``value`` column (string or binary) feeds the decoders, so file streams serve
for tests and backfills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_kafka_stream(
    spark: SparkSession,
    bootstrap_servers: str,
    topic: str,
    starting_offsets: str = "earliest",
    fail_on_data_loss: bool = False,
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Subscribe to ``topic``.  Without a checkpoint the query starts at ``starting_offsets``;
    with one it resumes from the committed offsets.  Lost offsets (retention) are skipped when
    ``fail_on_data_loss`` is false.  ``min_partitions`` splits topic partitions across more
    tasks than the topic has partitions; ``max_offsets_per_trigger`` bounds a micro-batch, so that a backlog is
    drained in batches of that size."""
    r = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", str(fail_on_data_loss).lower())
    )
    if min_partitions:
        r = r.option("minPartitions", str(min_partitions))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def read_value_files(
    spark: SparkSession,
    path: str,
    stream: bool = True,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Newline-delimited JSON messages as a ``value`` column (one message per line).  A micro-batch takes at most so
    many files, or files of so many bytes together (one file at least): the admission of a backlog."""
    if not stream:
        return spark.read.text(path)
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("a batch is bounded by files or by bytes, not by both")
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return r.load(path)
