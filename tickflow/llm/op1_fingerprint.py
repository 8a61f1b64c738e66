"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides where a chunk ends: at block size ``2**k`` a byte
ends a chunk when the low ``k`` bits of the hash are zero.  Each chunk gives one character (6 bits
of its CRC), so an edit changes only the characters of the chunks that it touches.  The block size is the
smallest with at most ``CHUNKS`` chunk ends; a fingerprint holds the signatures at that block size and
the next two, so that texts of different lengths still have a block size in common.

``likeness`` compares at the smallest common block size by edit distance (insertions and
deletions): ``1 - distance / (length + length)``; 0 without a common block size or a common run of
``RUN`` characters (half of the shorter signature if that is less), 1 for equal fingerprints.

Defined cases: a null text is the empty text, whose fingerprint is ``1:::``, like itself alone.
Repeated ids are ordered by their text's hash; null ids come last in descending order.  In a table
of one row the next document is the row itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tickflow.llm.common import map_rows, mix, shuffle_parts, table, texts, written

CHUNKS = 63
WINDOW = 7
RUN = 5
LEVELS = 3
_BASE = np.uint64(0x100000001B3)
_ALL = W.Window.unboundedPreceding, W.Window.unboundedFollowing
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: bytes) -> np.ndarray:
    """For each byte the mixed polynomial hash of the window that ends there."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint64)
    padded[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    h = np.zeros(len(data), np.uint64)
    for j in range(WINDOW):
        h = h * _BASE + padded[j : j + len(data)]
    return mix(h)


def _ends(h: np.ndarray, k: int) -> np.ndarray:
    return np.flatnonzero((h & np.uint64((1 << k) - 1)) == 0)


def _signature(data: bytes, ends: list[int]) -> str:
    out, at = [], 0
    for end in [*ends, len(data) - 1]:
        if end >= at:
            out.append(_LETTERS[zlib.crc32(data[at : end + 1]) & 63])
            at = end + 1
    return "".join(out)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return "1:::"
    h = _rolling(data)
    k = max(0, (len(data) // CHUNKS).bit_length() - 2)
    ends = _ends(h, k)
    while k and len(ends) <= CHUNKS:
        finer = _ends(h, k - 1)
        if len(finer) > CHUNKS:
            break
        k, ends = k - 1, finer
    while len(ends) > CHUNKS and k < 63:
        k += 1
        ends = ends[(h[ends] & np.uint64((1 << k) - 1)) == 0]
    signatures = [_signature(data, ends.tolist())]
    for level in range(k + 1, k + LEVELS):
        ends = ends[(h[ends] & np.uint64((1 << min(level, 63)) - 1)) == 0]
        signatures.append(_signature(data, ends.tolist()))
    return f"{1 << k}:" + ":".join(signatures)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of ``a`` at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def likeness(f: str, g: str) -> float:
    if f == g:
        return 1.0
    (ka, *a), (kb, *b) = f.split(":"), g.split(":")
    ka, kb = int(ka).bit_length(), int(kb).bit_length()
    k = max(ka, kb)
    if k - ka >= LEVELS or k - kb >= LEVELS:
        return 0.0
    x, y = a[k - ka], b[k - kb]
    run = min(RUN, max(1, min(len(x), len(y)) // 2))
    if not x or not y or not any(x[i : i + run] in y for i in range(len(x) - run + 1)):
        return 0.0
    return 2.0 * _common(x, y) / (len(x) + len(y))


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by as many first ones of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row."""

    def run(rows):
        return ((i, fingerprint(t)) for i, t in rows)

    return map_rows(texts(df, id_col, text_col), run, "doc_id long, fingerprint string")


_PAIR = (
    T.StructType()
    .add("doc_id", "long")
    .add("n_chars", "long")
    .add("edited_sha256", "string")
    .add("fingerprint", "string")
    .add("edited_fingerprint", "string")
    .add("near_edited", "double")
    .add("near_next", "double")
)
_STEP = (
    T.StructType(list(_PAIR.fields))
    .add("part", "integer")
    .add("is_head", "boolean")
    .add("is_tail", "boolean")
    .add("text", "string")
)


def _compare(doc_id, text, fp, next_text, next_fp) -> tuple:
    new = edited(text, next_text)
    new_fp = fp if new == text else fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, fp, new_fp, likeness(fp, new_fp), likeness(fp, next_fp)


def _steps(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows in order, each held against the one after it.  The first and the last row of the
    partition also go out with their texts, for the pairs that span two partitions."""
    part, none = TaskContext.get().partitionId(), (None,) * (len(_PAIR) - 1)
    before = None
    for doc_id, text in rows:
        now = (doc_id, text, fingerprint(text))
        if before is None:
            yield (doc_id, *none, part, True, False, text)
        else:
            yield (*_compare(*before, text, now[2]), part, False, False, None)
        before = now
    if before is not None:
        yield (before[0], *none, part, False, True, before[1])


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document held against its edited text and the next document by descending id.

    One range shuffle of the texts; each task streams its sorted rows.  The pairs across
    partitions, one for each partition, are made from the written first and last rows."""
    docs = texts(df, id_col, text_col)
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(shuffle_parts(df.sparkSession), *order)
    steps = written(map_rows(dealt.sortWithinPartitions(*order), _steps, _STEP), "fingerprints")
    inner = steps.where(~F.col("is_head") & ~F.col("is_tail")).select(*_PAIR.names)

    # one row for each partition; a partition's last document is followed by the next one's first
    by_part = W.Window.orderBy("part")
    heads = steps.where("is_head").select("part", F.col("text").alias("next_text"))
    heads = heads.withColumn("n", F.row_number().over(by_part))
    tails = steps.where("is_tail").select("doc_id", "text", "part")
    tails = tails.withColumn("n", F.row_number().over(by_part))
    parts = F.count(F.lit(1)).over(by_part.rowsBetween(*_ALL))
    tails = tails.withColumn("n", F.col("n") % parts + 1)
    seams = tails.join(heads.drop("part"), "n").select("doc_id", "text", "next_text")

    def run(rows):
        return (_compare(i, t, fingerprint(t), n, fingerprint(n)) for i, t, n in rows)

    return inner.unionByName(map_rows(seams, run, _PAIR))


def query(spark, sf_dir) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
