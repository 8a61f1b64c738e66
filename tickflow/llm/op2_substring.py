"""Substring dedup: units of lines hashed, repeated units removed, offsets retained.

A unit is a sentence of at least ``MIN_WORDS`` words inside a line, or a run of shorter sentences
between such sentences or the line's ends, of ``MIN_WORDS`` words or ``MIN_LETTERS`` letters.  In scripts without
blanks between words a sentence, too, is measured by its letters, and ends at a full-width mark without a blank.  So a passage that stands in the middle of a line of another
document still meets its copies sentence by sentence.  Units are normalised (lower case,
white space collapsed) and digested to 128 bits; digests are grouped over the whole table and the
occurrence first in (doc_id, start) is kept.  What is under both, such as blank lines, is never removed.

Defined cases: null and empty texts have no units; a null id ranks after all others; rows that repeat
an id share its rank, so a unit that is first in one of them is first in each.  An empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import UNSPACED, letters, map_rows, origin, same_row, table, texts, written

MIN_WORDS = 5
#: Fewer words suffice with this many letters, of which those of scripts without blanks count twice.
MIN_LETTERS = 15
#: Where a sentence ends: at marks that white space follows, at full-width marks and the closing marks
#: behind them, or at the end of its line.
_END = re.compile(r"[.!?](?=\s)|[。！？｡]+[」』”’）】》〉]*|\n")


def units(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, length, words, digest) of every unit; start and length in code points, white space
    before and after a unit left out."""
    at, run_start, run_end, run_words = 0, 0, 0, []

    def enough(ws):
        return len(ws) >= MIN_WORDS or letters("".join(ws)) >= MIN_LETTERS

    ends = [m.end() for m in _END.finditer(text)]
    ends.append(len(text))
    for end in ends:
        sentence = text[at:end]
        ws = sentence.split()
        if len(ws) >= MIN_WORDS or not sentence.isascii() and UNSPACED.search(sentence) and enough(ws):
            if run_words and enough(run_words):
                yield run_start, run_end - run_start, len(run_words), _digest(run_words)
            run_words = []
            start = end - len(sentence.lstrip())
            yield start, len(sentence.strip()), len(ws), _digest(ws)
        elif ws:
            if not run_words:
                run_start = end - len(sentence.lstrip())
            run_end = at + len(sentence.rstrip())
            run_words += ws
        if sentence[-1:] == "\n" or end == len(text):
            if run_words and enough(run_words):
                yield run_start, run_end - run_start, len(run_words), _digest(run_words)
            run_words = []
        at = end


def _digest(ws: list[str]) -> bytes:
    # only the words are lower-cased: the lower case of some letters is longer, and offsets are the text's
    return xxhash.xxh3_128_digest(" ".join(ws).lower().encode("utf-8", "surrogatepass"))


def unit_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit; ``nth`` counts the equal units before it in its document."""

    def run(rows):
        for i, t in rows:
            seen: dict[bytes, int] = {}
            mark = origin(t)
            for start, length, n_words, digest in units(t):
                nth = seen[digest] = seen.get(digest, -1) + 1
                yield i, mark, start, length, n_words, nth, digest

    schema = "doc_id long, origin long, start int, length int, words int, nth int, digest binary"
    return map_rows(texts(df, id_col, text_col), run, schema)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each removed occurrence: ``doc_id``, ``start``, ``length`` (code points),
    ``words``, ``kept_doc_id`` (the document of the occurrence that stays), ``copies``, ``origin`` (of its text).

    The grouping combines before the shuffle, so a unit that is in every document costs one row a
    task; the join back has one row a digest on its small side, and adaptive execution splits the
    partitions of common digests on the other."""
    u = unit_rows(df, id_col, text_col)
    last = 2**63 - 1
    u = u.withColumn("rank", F.coalesce("doc_id", F.lit(last)))
    firsts = u.groupBy("digest").agg(
        F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("copies")
    )
    firsts = written(firsts.where("copies > 1"), "repeated-units")
    return (
        u.join(firsts, "digest")
        .where("rank <> first_rank or nth > 0")
        .select(
            "doc_id", "start", "length", "words",
            F.when(F.col("first_rank") != last, F.col("first_rank")).alias("kept_doc_id"),
            "copies", "origin",
        )
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (start, length); lines left blank by it go."""
    out, at = [], 0
    for start, length in sorted(spans):
        out.append(text[at:start])
        at = max(at, start + length)
    out.append(text[at:])
    had = text.split("\n")
    lines = "".join(out).split("\n")
    return "\n".join(x for x, y in zip(lines, had, strict=True) if x.strip() or not y.strip())


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: ``doc_id``, ``text`` without its repeated units and ``removed``, their
    (start, length, kept_doc_id) in the original text."""
    spans = (
        repeats(df, id_col, text_col)
        .groupBy(F.col("doc_id").alias("id_"), F.col("origin").alias("origin_"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "length", "kept_doc_id"))).alias("removed"))
    )
    docs = texts(df, id_col, text_col)
    both = docs.join(spans, same_row(docs, "doc_id", "text", "id_", "origin_"), "left").select("doc_id", "text", "removed")

    def run(rows):
        for i, t, removed in rows:
            spans = [(x["start"], x["length"]) for x in removed or []]
            yield i, cut(t, spans) if spans else t, removed or []

    schema = (
        "doc_id long, text string, "
        "removed array<struct<start:int,length:int,kept_doc_id:long>>"
    )
    return map_rows(both, run, schema)


def query(spark, sf_dir) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
