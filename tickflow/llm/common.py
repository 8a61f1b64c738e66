"""Helpers shared by the operators: input columns, row mapping over Arrow batches, written tables,
word hashing.

Input rule of every operator: it selects the columns it reads and gives them names of its own, so
that extra columns of the input, whatever their names, neither clash nor pass through.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickflow.plans.session import scratch_path

#: Rows and bytes after which a batch of results goes back to Spark.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Session setting for the bytes of a batch that Spark sends to a worker, and its value here: several
#: copies of a batch are alive at once, in the JVM's buffers and in the worker.
SENT_CONF, SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only; a null text is the empty text."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col], F.lit("")).alias("text"),
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def origin(text: str) -> int:
    """A 64-bit digest of a text, the same as ``origin_of`` has for a column; with the id, it tells rows of equal ids
    apart."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def origin_of(text_col) -> Column:
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def same_row(df: DataFrame, id_col: str, text_col: str, other_id: str, other_origin: str) -> Column:
    """Whether a row of ``df`` is the one that another table knows by id (a null id equals a null id) and origin."""
    return df[id_col].cast("long").eqNullSafe(F.col(other_id)) & (origin_of(df[text_col]) == F.col(other_origin))


def keep_if(df: DataFrame, rows: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with all its columns: the rows that are (``left_semi``) or aren't (``left_anti``) among ``rows``, a table
    of ids and origins."""
    names = fresh(df, "id_"), fresh(df, "origin_")
    rows = rows.toDF(*names).distinct()
    return df.join(rows, same_row(df, id_col, text_col, *names), how)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, a lost executor
    costs nothing that was written, and the planner knows the table's size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables that ``written`` returned, once all that is made of them is written itself: a frame that still
    reads them, and a task of it that a lost executor repeats, would fail."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _size(row: tuple) -> int:
    return 16 + sum(len(v) if isinstance(v, (str, bytes, list)) else 8 for v in row)


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += _size(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def rows_of(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the batches, one Python row at a time."""
    for part in parts:
        columns = part.columns
        for i in range(part.num_rows):
            yield tuple(c[i].as_py() for c in columns)


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow`` in workers that import this package from where the driver did, in case
    it is not installed there (a cluster without a common path needs ``--py-files``).  Batches of
    more than ``SENT_BYTES`` are split; the session's setting is lowered for that."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])

    df.sparkSession.conf.set(SENT_CONF, SENT_BYTES)

    def run(parts):
        yield from fn(parts)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return df.mapInArrow(run, schema)


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: T.StructType | str
) -> DataFrame:
    """``fn`` turns the rows of a partition, streamed, into rows of ``schema``."""
    ddl = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(ddl)

    def run(parts):
        return batches(fn(rows_of(parts)), out)

    return map_batches(df, run, ddl)


#: Letters of scripts written without blanks between words: Thai, Lao, Myanmar, Khmer, kana, bopomofo, Han.
UNSPACED = re.compile(
    "[\u0e01-\u0e4f\u0e81-\u0ecf\u1000-\u103f\u1780-\u17d3\u3005-\u3007\u3041-\u312f\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
)


def letters(text: str) -> int:
    """Letters and digits of the text; one of a script without blanks counts as two."""
    n = sum(map(str.isalnum, text))
    return n if text.isascii() else n + len(UNSPACED.findall(text))


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


def words(text: str) -> list[bytes]:
    """Runs of other than the ASCII blanks (space, tab to carriage return), A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` words; the order of the words counts."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = mix(np.full(m, n, np.uint64))
    for j in range(n):
        h = mix(h * _ODD + hashes[j : j + m])
    return h


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle, a text
    without words has none."""
    h = word_hashes(words(text))
    return np.unique(ngram_hashes(h, min(n, len(h)))) if len(h) else h
