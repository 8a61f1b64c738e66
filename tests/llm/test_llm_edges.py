"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest


import corpus_pipeline
from llm_fixtures import small, tables  # noqa: F401
from tickflow.llm.queries import QUERIES

LONG = "lang " * 30_000 + "x" * 5000

DOCS = [
    (1, "One text of some words here, and more of them follow.", "en", "s", 10),
    (1, "One text of some words here, and more of them follow.", "en", "s", 10),
    (2, "One text of some words here, and more of them follow.", None, None, None),
    (3, "", "en", "s", 0),
    (4, None, "en", "s", None),
    (5, LONG, "fr", "s", len(LONG)),
    (6, "\n \t\n", "fr", "s", 3),
    (None, "One text of some words here, and more of them follow.", "en", "s", 10),
    (None, None, None, None, None),
    (7, "a", "de", "s", 1),
    (8, "12 34 §§ 😀 ", "de", "s", 9),
]
PAGE = "<html><body><nav>menu</nav><article><p>" + "A long text. " * 100 + "</p></article></body></html>"
PAGES = [
    (1, "http://a", PAGE), (1, "http://a", PAGE), (2, None, PAGE), (3, "http://b", None),
    (4, "", ""), (None, "http://c\r\nX: y", PAGE), (None, None, None), (5, "u", "<p>x"), (6, "v", "<" * 2000),
]
ITEMS = [(1, "text of some words here and more"), (1, "text of some words here and more"), (2, None),
         (3, ""), (None, "some words"), (4, "§ § §")]
TURNS = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "", ""), (None, 3, "user\n<|", "<\\|x"),
         (3, 1, "assistant", "<|im_end|>\n<"), (3, 0, "user", "x" * 5000), (None, None, None, None)]
ALL = {**QUERIES, "pipeline": corpus_pipeline.run}
ROWS = {"op7_html": len(PAGES), "op8_warc": len(PAGES)}
PER_DOC = ("op1_fingerprint", "op3_bpe", "op4_records", "op5_minhash", "op6_language", "op11_merkle", "op12_align")


@pytest.fixture(scope="module")
def edges(tables):
    return tables(extra=True, documents=DOCS, pages=PAGES, benchmark=ITEMS, conversations=TURNS)


@pytest.fixture(scope="module")
def empty(tables):
    return tables()


@pytest.mark.parametrize("name", ALL)
def test_edge_rows(spark, edges, name):
    rows = ALL[name](spark, edges).collect()
    if name in PER_DOC:
        assert len(rows) == len(DOCS)
    if name in ROWS:
        assert len(rows) == ROWS[name]


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, empty, name):
    df = ALL[name](spark, empty)
    own = [-1] if name == "op13_chat" else []  # the query's own conversation
    assert df.columns and [r.conv_id for r in df.collect()] == own


def test_minhash_edges(spark, edges):
    rows = [tuple(r) for r in QUERIES["op5_minhash"](spark, edges).collect()]
    by = {}
    for doc_id, n, component, kept in rows:
        by.setdefault(doc_id, []).append((n, component, kept))
    assert by[1] == [(8, 1, True)] * 2 and by[2] == [(8, 1, False)]
    assert by[3] == by[4] == by[6] == [(0, 3, True)] or by[3] == [(0, 3, True)]
    assert by[4] == [(0, 4, True)] and by[7] == [(1, 7, True)]
    assert sorted(by[None], key=str) == [(0, None, None), (8, 1, None)]


def test_contamination_edges(spark, edges):
    rows = sorted((r.doc_id or 0, r.item_id or 0) for r in QUERIES["op10_contamination"](spark, edges).collect())
    # the doubled item in the four copies (one doubled, one without id), the short one without id as well
    assert rows == sorted([(d, i) for d in (0, 1, 1, 2) for i in (0, 1, 1)])


def test_warc_edges(spark, edges):
    rows = QUERIES["op8_warc"](spark, edges).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert got[:3] == [(0, "response", None)] * 2 + [(1, "revisit", 2)]
    assert (2, "response", None) in got and (1, "revisit", 2) in got
    assert len({r.payload_digest for r in rows if r.page_id in (1, 2)}) == 1


def test_fingerprint_edges(spark, edges):
    rows = {r.doc_id: r for r in QUERIES["op1_fingerprint"](spark, edges).collect()}
    assert rows[3].fingerprint == "1:::" and rows[4].fingerprint == "1:::"
    assert rows[2].fingerprint == rows[1].fingerprint and rows[2].near_next == 1.0


def test_pipeline_keeps_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edges)
        assert docs.columns == columns


def test_bpe_round_trip_edges(spark, edges):
    """One worker for both gives the rows of encoding and decoding apart."""
    from tickflow.llm import op3_bpe
    from tickflow.llm.common import table

    docs = table(spark, edges, "documents")
    apart = op3_bpe.digests(op3_bpe.decode(op3_bpe.encode(docs)))
    once = op3_bpe.digests(op3_bpe.round_trip(docs))
    assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
