"""Benchmark decontamination: size-partitioned MinHash containment search.

Items (short test texts) are looked for inside long documents.  Documents are partitioned by the size of
their shingle set: class b holds sets of up to 2**b / ``ROOM`` shingles.  In each class sets are sketched by
hashing shingles to 2**b coordinates, each of which keeps its least value, in ``ROUNDS`` independent rounds.  A larger
document gets more coordinates, so that a shingle of an item that is in the document is the least
of its coordinate with probability of at least exp(-1/ROOM) = 0.94 whatever the document's length;
an item sketched alike shares that coordinate.  Any shared coordinate makes a candidate: one
contained shingle is missed by all rounds with probability 0.06**4 = 1.4e-5, and an item
has several.  Candidates are verified by exact containment: the share of the item's shingles that
are in the document, ``percent`` or more.

A document without any shingle of any item shares no coordinate, as a coordinate's value tells its
shingle; a bitmap of the items' shingles passes over such documents before sketching.

Words are runs of letters, digits and underscores in lower case, shingles five words; an item of
fewer words is one shingle of all its words and is found as such in any document.

The benchmark is broadcast in blocks of about ``BLOCK`` items and ``BLOCK_BYTES`` of text, whichever makes more of them,
dealt by a hash, and all documents are held against each block, so that what is broadcast stays bounded (but for a single item
longer than that).

Defined cases: null and empty texts contain nothing and items without words are found nowhere;
repeated items and documents give a row each; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import map_rows, mix, ngram_hashes, origin, table, texts

N_WORDS = 5
PERCENT = 80
ROUNDS = 4
ROOM = 16
BLOCK, BLOCK_BYTES = 50_000, 32 << 20
_WORD = re.compile(r"\w+")
_BITS = 22


def hashes(text: str) -> np.ndarray:
    ws = _WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def coordinates(x: np.ndarray, bits: int, round_: int) -> np.ndarray:
    """The values kept by the coordinates of a set's sketch; a coordinate is the top ``bits``."""
    h = np.sort(mix(x + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    at = h >> np.uint64(64 - bits)
    return h[np.append(True, at[1:] != at[:-1])]


class Items:
    """A block of the benchmark, ready for search."""

    def __init__(self, rows: list[tuple[int | None, str]], n_words: int = N_WORDS):
        self.ids: list[int | None] = []
        self.sets: list[np.ndarray] = []
        of_width: dict[int, list[int]] = {}
        for item_id, text in rows:
            h = hashes(text)
            if len(h):
                width = min(n_words, len(h))
                of_width.setdefault(width, []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(np.unique(ngram_hashes(h, width)))
        self.of_width = of_width
        self.known = {w: np.zeros(1 << _BITS, bool) for w in of_width}
        for w, members in of_width.items():
            for k in members:
                self.known[w][(self.sets[k] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.sketched: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _sketches(self, width: int, bits: int, round_: int):
        """Values of the items' coordinates in order, and the items they are of."""
        key = (width, bits, round_)
        if key not in self.sketched:
            each = [coordinates(self.sets[k], bits, round_) for k in self.of_width[width]]
            owner = np.repeat(self.of_width[width], [len(c) for c in each])
            values = np.concatenate(each)
            order = np.argsort(values, kind="stable")
            self.sketched[key] = values[order], owner[order]
        return self.sketched[key]

    def search(self, h: np.ndarray, percent: int = PERCENT):
        """(item id, shared shingles, the item's shingles) of the items contained in a document of
        words with these hashes."""
        for width in sorted(self.of_width):
            x = ngram_hashes(h, width)
            if not self.known[width][(x >> np.uint64(64 - _BITS)).astype(np.int64)].any():
                continue
            x = np.unique(x)
            bits = max(1, (ROOM * len(x) - 1).bit_length())
            found: set[int] = set()
            for round_ in range(ROUNDS):
                values, owner = self._sketches(width, bits, round_)
                mine = coordinates(x, bits, round_)
                low = np.searchsorted(values, mine)
                high = np.searchsorted(values, mine, side="right")
                for i in np.flatnonzero(high > low).tolist():
                    found.update(owner[low[i] : high[i]].tolist())
            for k in sorted(found):
                shared = int(np.isin(self.sets[k], x, assume_unique=True).sum())
                if 100 * shared >= percent * len(self.sets[k]):
                    yield self.ids[k], shared, len(self.sets[k])


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
    origins: bool = False,
) -> DataFrame:
    """One row for each item in each document: ``doc_id``, ``item_id``, ``shared``, ``shingles``
    (the item's) and ``containment``; ``origins`` adds the digest of the document's text (``origin``)."""
    spark = df.sparkSession
    docs = texts(df, id_col, text_col)
    items = texts(benchmark, item_id_col, item_text_col)
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    schema = "doc_id long, origin long, item_id long, shared int, shingles int"

    def searched(block: int) -> DataFrame:
        key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
        rows = [tuple(r) for r in items.where(key == block).toLocalIterator()]
        sent = spark.sparkContext.broadcast(rows)

        def run(rows):
            index = Items(sent.value)
            for doc_id, text in rows:
                for item_id, shared, size in index.search(hashes(text), percent):
                    yield doc_id, origin(text), item_id, shared, size

        return map_rows(docs, run, schema)

    found = reduce(DataFrame.unionAll, map(searched, range(blocks)))
    found = found.withColumn("containment", F.col("shared") / F.col("shingles"))
    return found if origins else found.drop("origin")


def query(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(len(ws), 5) AS w FROM b WHERE len(ws) > 0),
i AS (SELECT item_id, w, unnest(list_distinct(list_transform(range(1, len(ws) - w + 2),
  lambda j: array_to_string(ws[j:j + w - 1], ' ')))) AS g FROM k),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
x AS (SELECT doc_id, w, unnest(list_distinct(list_transform(range(1, len(ws) - w + 2),
  lambda j: array_to_string(ws[j:j + w - 1], ' ')))) AS g FROM d, (SELECT DISTINCT w FROM k) WHERE len(ws) >= w),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM x JOIN i USING (w, g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, CAST(n.n AS INTEGER) AS shingles,
  shared / n.n AS containment
FROM s JOIN n USING (item_id) WHERE 100 * shared >= 80 * n.n
"""
