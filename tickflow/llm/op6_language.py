"""Language identification by rank-order profiles of character n-grams.

A profile lists a text's most frequent n-grams (1 to 3 letters, words padded with blanks) by rank.
A document is held against the profile of every language by the out-of-place distance: for each of
its n-grams the difference of the two ranks, or the largest one if the language's profile lacks
it.  The nearest language wins; the score is the distance's complement, 1 - distance / largest.

Profiles are learnt from a bounded sample of labelled rows: about ``SAMPLE`` documents a language, drawn
by a hash of the id over the whole table (all of a language that has fewer).  Counts add up over
the cluster and each language's ranking is cut to ``PROFILE`` n-grams, which bounds what is broadcast.

Defined cases: texts that are null, empty or without a letter get ``und`` with score 0; equal counts rank
by the n-gram, shorter ones first (in a language's profile those of three letters first) and equal distances go to the first language in order of name; without any
labelled row every document gets ``und``; null languages are not learnt; repeated rows count as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tickflow.llm.common import map_batches, map_rows, table, texts

PROFILE = 400
SAMPLE = 2000
UNKNOWN = "und"
_BITS = np.uint64(21)
_BLANK = np.zeros(1, np.uint64)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; a 0 stands for every character that isn't a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_letter()[points], points, 0).astype(np.uint64)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text in ascending order, packed 21 bits a letter, and their counts."""
    x = letters(text)
    if not x.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    x = np.concatenate([_BLANK, x, _BLANK])
    pairs = x[:-1] << _BITS | x[1:]
    triples = pairs[:-1] << _BITS | x[2:]
    found = [x[x > 0], pairs[(x[:-1] > 0) | (x[1:] > 0)], triples[x[1:-1] > 0]]
    # a blank is 0 and stands first or last: the three orders need marks of their own
    found = np.concatenate([f | np.uint64(n << 62) for n, f in enumerate(found)])
    return np.unique(found, return_counts=True)


def ranking(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, equal counts in order of the n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profile:
    """A language's n-grams by rank."""

    def __init__(self, ranked: list[int]):
        ranked = np.array(ranked, np.int64).view(np.uint64)
        self.place = np.argsort(ranked)
        self.keys = ranked[self.place]

    def distance(self, ranked: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(self.keys, ranked), len(self.keys) - 1)
        apart = np.abs(self.place[at] - np.arange(len(ranked)))
        return int(np.where(self.keys[at] == ranked, apart, PROFILE).sum())


def learn(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
) -> dict[str, list[int]]:
    """The ranked n-grams of each language, packed."""
    rows = df.select(
        F.coalesce(df[id_col].cast("string"), F.lit("")).alias("key"),
        df[lang_col].alias("lang"),
        F.coalesce(df[text_col], F.lit("")).alias("text"),
    ).where("lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rates = {r.lang: float(1 << 40) * sample / r.n for r in sizes.toLocalIterator()}  # a row a language
    if not rates:
        return {}
    # a share of each language's rows, by hash: the draw moves no text
    rate = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])[F.col("lang")]
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < rate)

    def count(rows):
        totals: dict[str, Counter] = {}
        for lang, text in rows:
            keys, n = grams(text)
            totals.setdefault(lang, Counter()).update(dict(zip(keys.view(np.int64).tolist(), n.tolist(), strict=True)))
        for lang, counts in totals.items():
            for g, n in counts.items():
                yield lang, g, n

    counts = map_rows(drawn.select("lang", "text"), count, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").toLocalIterator():  # PROFILE rows a language
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def predict(
    df: DataFrame,
    profiles: dict[str, list[int]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from the text alone."""
    by_lang = {lang: Profile(ranked) for lang, ranked in sorted(profiles.items())}

    def run(rows):
        return ((doc_id, *nearest(text, by_lang)) for doc_id, text in rows)

    return map_rows(
        texts(df, id_col, text_col), run, "doc_id long, lang_pred string, score double"
    )


def nearest(text: str, by_lang: dict[str, Profile]) -> tuple[str, float]:
    """The language of the nearest profile, and the score."""
    ranked = ranking(*grams(text))
    if not len(ranked) or not by_lang:
        return UNKNOWN, 0.0
    d, lang = min((p.distance(ranked), lang) for lang, p in by_lang.items())
    return lang, 1.0 - d / (PROFILE * len(ranked))


def identified(
    df: DataFrame, profiles: dict[str, list[int]], min_score: float, text_col: str = "text"
) -> DataFrame:
    """The rows of ``df``, with all its columns, in whose text a language is found with at least
    ``min_score``.  Each row is judged where it lies: nothing is shuffled."""
    by_lang = {lang: Profile(ranked) for lang, ranked in sorted(profiles.items())}
    at = df.columns.index(text_col)

    def run(parts):
        for part in parts:
            found = (nearest(t.as_py() or "", by_lang) for t in part.column(at))
            kept = [lang != UNKNOWN and score >= min_score for lang, score in found]
            yield part.filter(pa.array(kept, pa.bool_()))

    return map_batches(df, run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of the id's text modulo 3 is 1."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 3 == 1


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    found = predict(docs, profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
