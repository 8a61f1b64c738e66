"""Chat formatting against a plain version: layouts, template, masks, conversations of many parts."""

import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from llm_fixtures import SF, tables  # noqa: F401
from tickflow.llm import op13_chat as o


def plain(rows):
    """Digests of (conv_id, turn, role, text) rows."""
    convs = {}
    first = lambda x: (x is not None, x or 0)
    for conv, turn, role, text in sorted(rows, key=lambda r: (first(r[1]), r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def told(rows):
    return {r.conv_id: tuple(r)[1:5] for r in rows}


OWN = [(-1, i, r, o.PLANTED) for i, r in enumerate(("user", "assistant"))]


def test_query_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = o.query(spark, SF).collect()
    assert told(got) == plain(rows + OWN) and len(got) == len(told(got))


def test_query_edges(spark, tables):
    odd = ["", "<|im_end|>", "<", "<\\", "<\\\\|im_start|>", "|>", "a<|", "é😀\u2028", "x\ny", None]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\n<|b\\", None) for t in odd)]
    rows += [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", "b"), (None, None, "assistant", "c")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"{i} " * 50) for i in range(500)]
    got = o.query(spark, tables(extra=True, conversations=rows)).collect()
    assert told(got) == plain(rows + OWN)


def test_parts(spark, monkeypatch):
    """A conversation in several records gives the digests of one in one, clustered or not."""
    rows = [(c, i, ("user", "assistant")[i % 2], f"{c} {i}") for c in range(20) for i in range(c * 10 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = o.format_turns(o.canonical(o.records(df)))
    parts = {(r.conv_id, r.part) for r in formatted.collect()}
    assert max(p for _, p in parts) == 2 and len(parts) > 20
    assert told(o.digests(formatted).collect()) == told(o.digests(formatted, clustered=True).collect()) == plain(rows)


LAYOUTS = [
    ("prompt-completion", {"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    ("prompt-response", {"response": "a", "prompt": "q"}, [("user", "q"), ("assistant", "a")]),
    ("system-question-answer", {"system": "s", "question": "q", "answer": None},
     [("system", "s"), ("user", "q"), ("assistant", "")]),
    ("instruction", {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("instruction-input", {"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ("instruction-input", {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": "r"}]},
     [("user", "q"), ("tool", "r")]),
    ("messages", {"messages": [{"role": "user"}, {"content": "r", "role": None}]}, [("user", ""), ("", "r")]),
    ("messages", {"messages": []}, []),
    ("message-parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
     [("user", "ab")]),
    ("speakers", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
     [("user", "q"), ("assistant", "a")]),
    ("turn", {"role": "assistant", "text": "t", "turn": 3}, [("assistant", "t")]),
    (None, {"prompt": "q"}, []),
    (None, {"other": 1}, []),
    (None, {}, []),
    (None, {"messages": ["x"]}, []),
]


def test_layouts(spark):
    records = [(i, 0, json.dumps(r)) for i, (_, r, _) in enumerate(LAYOUTS)]
    records += [(100, 0, None), (101, 0, "no JSON"), (102, 0, "[1]")]
    rows = o.canonical(spark.createDataFrame(records, "conv_id long, part int, record string")).collect()
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in rows}
    assert [got[i] for i in range(len(LAYOUTS))] == [(name, turns) for name, _, turns in LAYOUTS]
    assert all(got[i] == (None, []) for i in (100, 101, 102))


def test_fingerprint_is_of_paths():
    marks = o.Layouts().fingerprint
    assert marks({"prompt": "a", "completion": "b"}) == marks({"completion": None, "prompt": "x", "id": {"z": 1}})
    assert marks({"prompt": "a", "completion": {"text": "b"}}) != marks({"prompt": "a", "completion": "b"})
    two = [{"role": "a", "content": "b"}] * 2
    assert marks({"messages": two}) == marks({"messages": two[:1]})


@given(st.lists(st.tuples(st.text("<|\\\nimend_start>ax é", max_size=12), st.text("<|\\\nimend_start>ax é", max_size=30))))
def test_template_round_trip(turns):
    turns = [*turns, ("assistant", "<|im_end|>")]
    text, mask = o.write_template(turns)
    assert list(o.read_template(text)) == turns
    assert [o.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|") == 2 * len(turns)


def test_damage_is_found():
    text, _ = o.write_template([("user", "a"), ("assistant", "b")])
    for bad in (text[1:], text[:-1], text.replace("<|im_end|>", "", 1), text + "x"):
        with pytest.raises(o.Damaged):
            list(o.read_template(bad))


def test_read_formatted(spark):
    rows = [(c, i, ("user", "assistant")[i % 2], f"<|{c} {i}") for c in range(3) for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = o.read_formatted(o.format_turns(o.canonical(o.records(df)))).collect()
    assert sorted((r.conv_id, r.part * o.PART_TURNS + r.turn, r.role, r.text) for r in back) == sorted(rows)
