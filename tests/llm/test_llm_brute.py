"""Operators against plain versions over whole small tables."""

import base64
import collections
import gzip
import hashlib
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from llm_fixtures import small, tables  # noqa: F401
from oracle_compare import compare, duck
from tickflow.llm import (
    common,
    op1_fingerprint as o1,
    op2_substring as o2,
    op3_bpe as o3,
    op4_records as o4,
    op5_minhash as o5,
    op6_language as o6,
    op7_html as o7,
    op8_warc as o8,
    op9_templates as o9,
    op10_contamination as o10,
)
from tickflow.llm.common import shingles, words
from tickflow.llm.components import components
from tickflow.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    r = compare(QUERIES[name](spark, SF), duck(SF), SQL[name])
    assert r["exact"], r


# --- 1 fingerprints -----------------------------------------------------------------------------
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_edit_distance(a, b):
    assert o1._common(a, b) == lcs(a, b)


@settings(max_examples=200)
@given(st.text(max_size=300))
def test_fingerprint_plain(text):
    """Chunk by chunk, byte by byte."""
    size, *found = o1.fingerprint(text).split(":")
    data = text.encode("utf-8", "surrogatepass")
    for level, signature in enumerate(found):
        k, out, at = int(size).bit_length() - 1 + level, "", 0
        for i in range(len(data)):
            window = [0] * max(0, o1.WINDOW - 1 - i) + list(data[max(0, i - o1.WINDOW + 1) : i + 1])
            h = 0
            for b in window:
                h = (h * int(o1._BASE) + b) % 2**64
            h = int(o1.mix(np.array([h], np.uint64))[0])
            if h % (1 << k) == 0 or i == len(data) - 1:
                out += o1._LETTERS[zlib.crc32(data[at : i + 1]) & 63]
                at = i + 1
        assert signature == out
        assert len(out) <= o1.CHUNKS + 1


def test_fingerprint_query(spark, small):
    docs = sorted(small, reverse=True)
    want = {}
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        f, g = o1.fingerprint(t), o1.fingerprint(new)
        sha = hashlib.sha256(new.encode()).hexdigest()
        want[i] = (i, len(t), sha, f, g, o1.likeness(f, g), o1.likeness(f, o1.fingerprint(n)))
    got = {r.doc_id: tuple(r) for r in QUERIES["op1_fingerprint"](spark, SF).collect()}
    assert got == want


def test_likeness_tells_edits(small):
    # texts that repeat a word or two over and over have few chunks to tell
    long = [(i, t) for i, t in small if len(t) > 400 and len(set(t.split())) > 0.3 * len(t.split())]
    pairs = list(zip(long, long[1:]))
    f = {i: o1.fingerprint(t) for i, t in long}
    near = [o1.likeness(f[i], o1.fingerprint(o1.edited(t, n))) for (i, t), (_, n) in pairs]
    far = [o1.likeness(f[i], f[j]) for (i, t), (j, n) in pairs if not set(t.split("\n")) & set(n.split("\n"))]
    assert min(near) > 0.15 and np.mean(near) > 0.5 and np.mean(np.array(far) > 0.15) < 0.05


# --- 2 substrings -------------------------------------------------------------------------------
def test_units_offsets():
    text = "Short. Very short.\n  The first sentence is long enough. No. Yes it is.  Another one of five words!\nlast"
    found = [(text[s : s + n], w) for s, n, w, _ in o2.units(text)]
    assert found == [
        ("The first sentence is long enough.", 6),
        ("Another one of five words!", 5),
    ]


def test_repeats_plain(spark, small):
    seen, want = {}, collections.Counter()
    counts = collections.Counter(d for _, t in small for *_, d in o2.units(t))
    for i, t in sorted(small):
        for s, n, w, d in o2.units(t):
            if d in seen:
                want[(i, s, n, w, seen[d], counts[d])] += 1
            else:
                seen[d] = i
    got = collections.Counter(tuple(r)[:6] for r in QUERIES["op2_substring"](spark, SF).collect())
    assert got == want and len(want) > 20


def test_passage_inside_lines(spark):
    passage = "The river ran fast past the old mill. It had done so for a hundred years! Nobody in the town remembered why."
    docs = [(1, f"a b c and {passage} d e f"), (2, f"other words come {passage}"), (3, "clean text of its own kind here.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in o2.deduplicate(df).collect()}
    assert got[1].text == docs[0][1] and got[3].text == docs[2][1] and not got[3].removed
    assert "hundred years" not in got[2].text and "remembered" not in got[2].text
    assert all(docs[1][1][r.start : r.start + r.length] in passage for r in got[2].removed)


# --- 3 and 4 tokens -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=o3.PATTERN, mergeable_ranks=o3.load_ranks(o3.RANKS), special_tokens={}
    )


#: Characters that Unicode assigns later differ between the libraries' tables.
ASSIGNED = st.text(st.characters(exclude_categories=("Cn", "Cs")), max_size=6)
PIECES = st.sampled_from(["the", " ", "  ", "\n", "\t", "'s", "'", "été", "x1", "12", "...", "%%%", "日本", "\x1c", "é", "İ", "Σ", "A", "ﬁ", "😀", "\xa0"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES | ASSIGNED, max_size=12))
def test_bpe_as_library(library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    [ids] = o3.Encoder().encode([text])
    assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(text)


def test_bpe_long_word(library):
    for word in ("ab" * 3000, "xyzw" * 50 + "aaaaab" * 40, "é" * 200):
        assert o3.merge(word.encode(), o3.load_ranks(o3.RANKS)) == library.encode_ordinary(word)


def test_bpe_query(spark, small, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_bpe"](spark, SF).collect()}
    for i, t in small:
        ids = library.encode_ordinary(t)
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i] == (len(ids), sha, hashlib.sha256(t.encode()).hexdigest())


def test_bpe_higher_order(spark, small, library):
    text = " ".join(t for _, t in small[:3]) + " 12 ... été\n\n aaaaaaa"
    found = sorted(set(re.findall(r" ?\w+", text)))[:150] + ["aaaaaaa", " ababab"]
    df = spark.createDataFrame([(w,) for w in found], "word string")
    rows = o3.encode_words(df).withColumn("bytes", o3.decode_ids("ids")).collect()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.word), r.word
        assert bytes(r.bytes) == r.word.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES | ASSIGNED, max_size=12))
def test_words_as_tokenizer(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    e = o4.worker_encoder(o4.TOKENIZER)
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.encode([text]) == [struct.pack(f"<{len(want)}I", *want)]


def test_crc32c():
    assert o4.crc32c([b"123456789", b"\0" * 32, bytes(range(32))]).tolist() == [0xE3069283, 0x8A9136AA, 0x46DD794E]
    table = o4._byte_table().tolist()
    for m in (b"abcd", b"x" * 64, b"y" * 65, bytes(range(256)) * 41):
        r = 0xFFFFFFFF
        for b in m:
            r = table[(r ^ b) & 255] ^ r >> 8
        assert o4.crc32c([b"1234", m])[1] == r ^ 0xFFFFFFFF


def test_records_query(spark, small):
    e = o4.worker_encoder(o4.TOKENIZER)
    want, start = {}, 0
    for i, t in sorted(small):
        ids = e.tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_records"](spark, SF).collect()}
    assert got == want


def test_records_index_in_few_files(spark, tmp_path):
    """Many files of records, of which each stands in one file of the index, whole and in order."""
    before, n = spark.conf.get("spark.sql.shuffle.partitions"), 24 * spark.sparkContext.defaultParallelism
    rows = [(i if i % 7 else None, f"text {i} " * (i % 5)) for i in range(4 * n)]
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        index = o4.write_records(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [pq.read_table(f).to_pylist() for f in (tmp_path / "index").glob("*.parquet")]
    places = [[(r["part"], r["offset"]) for r in part] for part in parts]
    files = [{r["file"] for r in part} for part in parts]
    assert len(parts) <= n // 8 and places == [sorted(p) for p in places]
    assert sum(map(len, files)) == len(set().union(*files)) > 2 * len(parts)
    assert sum(map(len, parts)) == index.count() == o4.read_records(index, str(tmp_path)).count() == 4 * n


def test_records_width():
    for ids in ([], [2], [65535, 1], [65536, 1, 2]):
        data = np.array(ids, "<u4").tobytes()
        packed = o4.pack(-5, data)
        assert o4.unpack(packed) == (-5, data) and packed[8] == (4 if max(ids, default=0) > 65535 else 2)


def test_records_damage():
    frame = o4._frames([b"12345678abcd"])[0]
    assert o4.unframe([frame]) == [b"12345678abcd"]
    for i in range(len(frame)):
        with pytest.raises(o4.Damaged):
            o4.unframe([frame[:i] + bytes([frame[i] ^ 1]) + frame[i + 1 :]])


# --- 5 near duplicates --------------------------------------------------------------------------
def plain_components(docs, n, percent=80):
    sets = {i: set(shingles(t or "", n).tolist()) for i, t in docs}
    at = collections.defaultdict(set)
    for i, s in sets.items():
        for g in s:
            at[g].add(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j in {k for g in s for k in at[g] if k < i}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_near_duplicates_chain(spark):
    """Chains and forests of edits: every neighbour links, the ends don't."""
    rng = np.random.default_rng(7)
    docs, n = [], 0
    for length in (8, 12, 40, 120, 400):
        for _ in range(6):
            ws = [f"w{x}" for x in rng.integers(0, 10**6, length)]
            for _ in range(8):
                docs.append((n, " ".join(ws)))
                n += 1
                ws[int(rng.integers(length))] = f"v{rng.integers(10**6)}"
                if rng.random() < 0.5:
                    ws[int(rng.integers(length))] = f"v{rng.integers(10**6)}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words_ in (4, 5):
        got = {r.doc_id: r.component_id for r in o5.near_duplicates(df, n_words=words_).collect()}
        assert got == plain_components(docs, words_)


def test_near_duplicates_hub(spark):
    """Copies that link with an original or with each other, and many that just don't."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    docs = []
    for n in range(400):
        ws = list(base)
        for i in rng.integers(0, 150, int(rng.integers(0, 9))):
            ws[i] = f"v{rng.integers(10**6)}"
        docs.append((n, " ".join(ws)))
    docs.append((1000, " ".join(base)))
    want = plain_components(docs, 4)
    assert 50 < len(set(want.values())) < 350
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in o5.near_duplicates(df, n_words=4).collect()}
    assert got == want


def test_near_duplicates_full_star(spark, monkeypatch):
    """Classes with more pairs than a group takes are dealt to several groups, and keep all their links."""
    monkeypatch.setattr(o5, "STAR", 20)
    rng = np.random.default_rng(13)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    docs = [(1000, " ".join(base))]
    for n in range(300):
        ws = list(base)
        for i in rng.integers(0, 150, int(rng.integers(0, 9))):
            ws[i] = f"v{rng.integers(10**6)}"
        docs.append((n, " ".join(ws)))
    full = []

    def written(df, name):
        out = common.written(df, name)
        if name == "full-classes":
            full.append(out.count())
        return out

    monkeypatch.setattr(o5, "written", written)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in o5.near_duplicates(df, n_words=4).collect()}
    assert got == plain_components(docs, 4)
    assert full[0] > 0  # of the stars


def test_near_duplicates_leave_what_is_read(spark, tmp_path, monkeypatch):
    """Of the tables written on the way, those stay that the result reads, and it can be read again."""
    monkeypatch.setattr(common, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    found = o5.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left <= {"sketches", "classes", "labels", "least-ids"}
    assert found.count() == found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_words_are_ascii_runs():
    assert words("A\x0bB\x1cÉ\xa0x\n\tÇa") == ["a".encode(), "b\x1cÉ\xa0x".encode(), "Ça".encode()]


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n in (3, 30, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n // 3] = rng.integers(0, 2**63, n // 3).astype(np.uint64)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = o5.sketches([a, b], 2000)
        assert (s != np.iinfo(np.uint64).max).all()
        assert abs((s[0] == s[1]).mean() - j) < 0.06


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame([(struct.pack(">q", a), struct.pack(">q", b)) for a, b in pairs], "a binary, b binary")
    got = {struct.unpack(">q", r.node)[0]: struct.unpack(">q", r.label)[0] for r in components(df).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: v for k, v in label.items() if k in got} == got


# --- 6 language ---------------------------------------------------------------------------------
def test_language_accuracy(spark):
    docs = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op6_language"](spark, docs).collect()}
    rows = spark.read.parquet(f"{docs}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in held}
    right = [got[r.doc_id].lang_pred == r.lang for r in held if r.lang and any(map(str.isalpha, r.text))]
    assert np.mean(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_language_grams(text):
    s = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    found = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g[1] != "\0" if n == 3 else g.strip("\0"):
                found[g] += 1
    return found


def test_language_plain(spark):
    """The whole query: profiles, ranks, distances, ties and scores."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    totals = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            totals[r.lang].update(plain_language_grams(r.text or ""))
    assert max(collections.Counter(r.lang for r in rows).values()) <= o6.SAMPLE  # all of them are learnt
    places = {
        lang: {g: i for i, g in enumerate(sorted(n, key=lambda g: (-n[g], len(g) % 3, g))[: o6.PROFILE])}
        for lang, n in totals.items()
    }
    want = {}
    for r in rows:
        n = plain_language_grams(r.text or "")
        ranked = sorted(n, key=lambda g: (-n[g], len(g), g))[: o6.PROFILE]
        pred, score = "und", 0.0
        if ranked:
            far = {
                lang: sum(abs(at[g] - i) if g in at else o6.PROFILE for i, g in enumerate(ranked))
                for lang, at in places.items()
            }
            pred = min(far, key=lambda lang: (far[lang], lang))
            score = 1.0 - far[pred] / (o6.PROFILE * len(ranked))
        want[r.doc_id] = (zlib.crc32(str(r.doc_id).encode()) % 3 == 1, pred, score)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in QUERIES["op6_language"](spark, SF).collect()}
    assert got == want


def test_grams_plain():
    text = "Ab, cab\U00010400 ß1x"
    want = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        p = [0, *map(ord, word), 0]
        want.update(p[1:-1])
        want.update((1 << 62) | a << 21 | b for a, b in zip(p, p[1:]))
        want.update((2 << 62) | a << 42 | b << 21 | c for a, b, c in zip(p, p[1:], p[2:]))
    keys, counts = o6.grams(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == {k % 2**64: n for k, n in want.items()}


def test_distance_plain():
    p = o6.Profile([5, 9, 7])
    assert p.distance(np.array([9, 5, 8], np.uint64)) == 1 + 1 + o6.PROFILE


# --- 7 and 8 pages ------------------------------------------------------------------------------
BODY = "This is the body of the article, and it says a good deal about rivers &amp; hills."


def page(*parts):
    return "<!doctype html><html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


JUNK = [
    "<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<header><h2>Site</h2></header>",
    '<div class="cookie-notice">We use cookies and a long notice stands here for all to read, twice.</div>',
    '<div class="ad"><div>Buy this now</div> and that, it is cheap and very good for everybody here.</div>',
    '<aside><p>Related things of which a longer text speaks to fill the side bar with words.</p></aside>',
    '<form><label>Mail</label><input name=x><button>Go</button></form>', "<script>if (a < b) { x('<p>no</p>') }</script>",
    "<style>p > a {}</style>", '<section id="comments"><p>First! I think that this is a very good article, thank you so much.</p></section>',
    "<footer>&copy; Site. All of the rights are reserved, as ever, and nobody may copy it.</footer>", "<!-- <p>hidden</p> -->",
]


@pytest.mark.parametrize("tag", ["article", "main", "div", 'div class="content"'])
def test_page_structure(tag):
    name = tag.split()[0]
    text = f"<h1>Title here</h1><p>{BODY}</p><p>Yes.</p><p>{BODY}\n  More <b>bold</b><br>text</p><ul><li>One</li><li>Two</li></ul>"
    got = o7.main_text(page(*JUNK[:5], f"<{tag}>{text}</{name}>", *JUNK[5:]))
    plain = BODY.replace("&amp;", "&")
    assert got == f"Title here\n{plain}\nYes.\n{plain} More bold text\nOne\nTwo"


@pytest.mark.parametrize("junk", JUNK)
def test_page_junk_inside(junk):
    got = o7.main_text(page(f"<article><p>{BODY}</p>{junk}<p>{BODY}</p></article>"))
    plain = BODY.replace("&amp;", "&")
    if junk.startswith("<header"):
        assert got == f"{plain}\nSite\n{plain}"
    else:
        assert got == f"{plain}\n{plain}"


def test_pages_plain(spark):
    """The pages of the tables: the blocks of the article element."""
    import html as h

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op7_html"](spark, SF).collect()}
    for r in pages:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_warc_reader_strict():
    import io

    one = o8.record(1, "http://a/é x", b"payload", None, "2024-01-01T00:00:00Z")
    two = o8.record(2, None, b"payload", 1, "2024-01-01T00:00:00Z")
    found = [o8.parse(m) for m in o8.members(io.BytesIO(one + two))]
    assert [o8.payload_of(*f) for f in found] == [(7, hashlib.sha1(b"payload").hexdigest())] * 2
    assert found[1][0]["WARC-Refers-To"] == "<urn:page:1>" and gzip.decompress(one + two).count(b"WARC/1.1") == 2
    for bad in (one[:-5], one[:40] + b"\0\0" + one[42:]):
        with pytest.raises(o8.Damaged):
            list(o8.members(io.BytesIO(bad)))
    plain = gzip.decompress(one)
    for bad in (plain.replace(b"payload\r", b"paYload\r"), plain[:-1], plain.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(o8.Damaged):
            o8.payload_of(*o8.parse(bad))
    digest = base64.b32encode(hashlib.sha1(b"payload").digest())
    assert b"sha1:" + digest in plain


# --- 9 templates --------------------------------------------------------------------------------
def plain_templates(docs, min_docs, few_docs=None):
    """(doc_id, line, template, docs) of the lines dropped, by sets of texts: every line's moulds from the finest to
    the coarsest, and of those that recur the finest that has at least half of a coarser one's documents."""
    least = min(min_docs, few_docs or min_docs)
    recurs = lambda n, text: n >= min_docs or (n >= least and n * o9.letters(text) >= min_docs * o9.FEW_LETTERS)
    leaves = collections.defaultdict(list)
    for i, t in docs:
        for n, tokens, leaf in o9.masked_lines(t):
            leaves[leaf].append((i, t, n, tuple(tokens)))
    out = set()
    for rows in leaves.values():
        origins = collections.defaultdict(set)  # texts of each distinct line
        for _, t, _, tokens in rows:
            origins[tokens].add(t)
        at = collections.Counter()  # a line in n texts counts n for its tokens
        for tokens, texts in origins.items():
            at.update({x: len(texts) for x in enumerate(tokens)})
        moulds = {}
        for tokens in origins:
            counts = [at[x] if at[x] >= least else 0 for x in enumerate(tokens)]
            found = []
            if sum(map(bool, counts)) < o9.SHARE * len(tokens):
                found.append((tokens, False))
            else:
                for level in sorted({c for c in counts if c} | {1}):
                    held = [c >= level for c in counts]
                    if level > 1 and (sum(held) < o9.SHARE * len(tokens) or all(held)):
                        continue
                    text = tuple(t if h else o9.VARIABLE for t, h in zip(tokens, held))
                    if level == 1 or text != found[-1][0] or len(found) == 1:
                        found.append((text, any(held[o9.LEADING :])))
            moulds[tokens] = found
        members = collections.defaultdict(list)
        for i, t, n, tokens in rows:
            for step, (text, _) in enumerate(moulds[tokens]):
                members[bool(step), text].append((i, t))
        for i, t, n, tokens in rows:
            able = []
            for step, (text, tail) in enumerate(moulds[tokens]):
                who = members[bool(step), text]
                size = len({t for _, t in who})
                if recurs(size, " ".join(text)):
                    able.append((size, min(i for i, _ in who), text, tail))
            if able:
                best = able[0]
                for x in able[1:]:
                    if x[3] and best[0] < o9.SHARE * x[0]:
                        best = x
                if i != best[1]:
                    out.add((i, n, " ".join(best[2]), best[0]))
    return out


def test_templates_plain(spark, small):
    names = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Fritz", "Gerd", "Hans"]
    docs = [(i, t) for i, t in small]
    docs += [(10_000 + i, f"own line {i} of this text\nPosted by {n} on day {i} of May\nAll rights are reserved here.") for i, n in enumerate(names)]
    docs += [(20_000 + i, "a copy of one single text\nwith two lines that recur") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r)[:4] for r in o9.recurring(df, min_docs=5).collect()}
    assert got == plain_templates(docs, 5)
    few = {tuple(r)[:4] for r in o9.recurring(df, few_docs=o9.FEW_DOCS).collect()}
    assert few == plain_templates(docs, o9.MIN_DOCS, o9.FEW_DOCS) and few != got
    assert (10_001, 1, "Posted by <*> on day <*> of May", 8) in got
    assert not any(i == 10_000 and n == 1 for i, n, *_ in got) and not any(i >= 20_000 for i, *_ in got)


def test_drop_lines(spark):
    df = spark.createDataFrame([(1, "a b c\nboiler plate line\n\nd", "x"), (2, "boiler plate line\ne", "y"), (3, None, "z")], "doc_id long, text string, _x string")
    gone = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, line int")
    got = {r.doc_id: r.text for r in o9.drop_lines(df, gone).collect()}
    assert got == {1: "a b c\n\nd", 2: "e", 3: None}
    got = {r.doc_id: r.text for r in o9.drop_lines(df, gone, most=0.5).collect()}
    assert got == {1: "a b c\n\nd", 2: "boiler plate line\ne", 3: None}


# --- 10 contamination ---------------------------------------------------------------------------
def test_contamination_planted(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**7)}"
    items = [(k, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for k in range(80)]
    docs, want = [], set()
    for i in range(200):
        ws = [word() for _ in range(int(rng.integers(5, 4000)))]
        k, text = items[int(rng.integers(80))]
        if i % 2:
            at = int(rng.integers(len(ws)))
            ws[at:at] = text.upper().split()
        docs.append((i, ", ".join(ws)))
    for i, t in docs:
        ws = re.findall(r"\w+", t.lower())
        grams = {n: {tuple(ws[j : j + n]) for j in range(len(ws) - n + 1)} for n in range(1, 6)}
        for k, text in items:
            it = text.split()
            n = min(5, len(it))
            own = {tuple(it[j : j + n]) for j in range(len(it) - n + 1)}
            if 100 * len(own & grams[n]) >= 80 * len(own):
                want.add((i, k))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in o10.contaminated(a, b).collect()}
    assert got == want and len(want) >= 100


# --- the pipeline -------------------------------------------------------------------------------
def test_pipeline_plain(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    language = corpus_pipeline.language(spark, docs, sf)
    kept = {r.doc_id for r in language.collect()}
    letters = {i for i, r in rows.items() if any(unicodedata.category(c).startswith("L") for c in r.text)}
    assert kept <= letters and len(kept) >= 0.99 * len(letters)

    cut = corpus_pipeline.line_dedup(spark, language, sf)
    texts = {r.doc_id: r.text for r in cut.collect()}
    gone = collections.defaultdict(set)
    for i, n, _, _ in plain_templates([(i, rows[i].text) for i in kept], o9.MIN_DOCS, o9.FEW_DOCS):
        gone[i].add(n)
    for i in kept:
        old = rows[i].text.split("\n")
        new = "\n".join(x for n, x in enumerate(old) if n not in gone[i])
        assert texts[i] == (new if new.strip() else rows[i].text)

    near = corpus_pipeline.near_dedup(spark, cut, sf)
    left = {r.doc_id for r in near.collect()}
    assert left == {i for i, c in plain_components(list(texts.items()), 5).items() if i == c}

    clean = {r.doc_id for r in corpus_pipeline.decontaminate(spark, near, sf).collect()}
    items = [(r.item_id, re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for i in left:
        ws = re.findall(r"\w+", texts[i].lower())
        grams = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)}
        own = [{tuple(it[j : j + 5]) for j in range(len(it) - 4)} for _, it in items]
        if not any(100 * len(g & grams) >= 80 * len(g) for g in own):
            want.add(i)
    assert clean == want

    done = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(done) == clean
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in done.items())
