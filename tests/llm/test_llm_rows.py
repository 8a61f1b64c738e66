"""Rows that share an id, or have none, are told apart by their texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import tables  # noqa: F401
from tickflow.llm import common
from tickflow.llm import op2_substring as o2
from tickflow.llm import op9_templates as o9

DDL = "doc_id long, text string, lang string, source string, n_chars long"
COPY = "These words stand in a text that is there twice, so one of the two has to go at the end of it."
ITEM = "which of these nine words are the benchmark's own question"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DDL)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_origins_agree(spark):
    rows = ["", "a", "é😀" * 50, "x" * 1000, " \n"]
    df = spark.createDataFrame([(t,) for t in [*rows, None]], "t string")
    got = [r[0] for r in df.select(common.origin_of(F.col("t"))).collect()]
    assert got == [common.origin(t) for t in [*rows, ""]]


@pytest.mark.parametrize("id_", [None, 7])
def test_contaminated_row_goes_alone(spark, tables, id_):
    folder = tables(benchmark=[(1, ITEM)])
    rows = [(id_, f"before {ITEM} and after"), (id_, "a clean text of some words"), (id_, "another clean text"), (id_, None)]
    got = corpus_pipeline.decontaminate(spark, frame(spark, rows), folder)
    assert texts(got) == sorted(rows[1:], key=str)


def test_near_duplicate_goes_alone(spark, tables):
    rows = [(1, COPY), (7, COPY), (7, "This one is a text of its own, and nothing else is like it in any of its words."), (None, "x y")]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), tables())
    assert texts(got) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_units_are_cut_from_their_own_text(spark):
    rows = [(1, f"First. {COPY}"), (7, f"{COPY} Last."), (7, "A much shorter text, but of five words and more."), (None, f"Null one. {COPY}"),
            (None, "A text without an id that has nothing in common with others.")]
    got = {(r.doc_id, r.text) for r in o2.deduplicate(frame(spark, rows)).collect()}
    assert got == {rows[0], (7, " Last."), rows[2], (None, "Null one. "), rows[4]}


def test_lines_are_dropped_from_their_own_text(spark, tables):
    line = "This line is the same in all of the documents that have it"
    rows = [(i, f"{chr(97 + i) * 9} {chr(98 + i) * 9} is only here\n{line}") for i in range(8)]
    rows += [(3, f"{line}\nand then another text under the same id"), (3, "no such line in here at all\nnor in this one")]
    rows += [(None, f"{line}\n{chr(97 + i) * 5} {chr(99 + i) * 5} without an id") for i in range(12)]
    got = texts(corpus_pipeline.line_dedup(spark, frame(spark, rows), tables()))
    want = [(i, t if i == 0 else "\n".join(x for x in t.split("\n") if x != line)) for i, t in rows]
    assert got == sorted(want, key=str)


def test_stage_drops_from_few_documents(spark, tables):
    """A long line of 19 documents goes from all but the first."""
    line = "A footer of some length that the same site puts below each of its pages"
    rows = [(i, f"{chr(97 + i) * 9} {chr(98 + i) * 9} is only here\n{line}") for i in range(19)]
    got = texts(corpus_pipeline.line_dedup(spark, frame(spark, rows), tables()))
    assert sum(line in t for _, t in got) == 1


def test_leaf_gate_is_exact(spark):
    """Short lines of leaves that can't recur are passed over, others are found as without the gate."""
    rows = [(i, f"a b c\nd e {'f' * 30} {'g' * 10}\nown {chr(97 + i)}{chr(97 + i)} line of it") for i in range(7)]
    got = {(r.line, r.template, r.docs) for r in o9.recurring(frame(spark, rows), few_docs=5).collect()}
    assert got == {(1, f"d e {'f' * 30} {'g' * 10}", 7)}
