"""The Merkle manifest against hashlib, and the midstates against whole hashes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import tickflow.llm.op11_merkle as o
from llm_fixtures import SF, tables  # noqa: F401


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(docs):
    """Rows of the query for (doc_id, source, lang, n_chars, text) rows."""
    written = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha("".join(map(written, d)))
    low = lambda s: None if s is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
            out.append(nodes)
        return out

    trees = {}
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))):
        trees.setdefault(d[2], []).append(d)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: levels([leaf(d) for d in trees[k]]) for k in order}
    top = levels([own[k][-1][0] for k in order])
    for number, k in enumerate(order):
        for i, d in enumerate(trees[k]):
            path = []
            for at, tree in ((i, own[k]), (number, top)):
                for nodes in tree[:-1]:
                    path.append((at % 8, nodes[at // 8 * 8 : at // 8 * 8 + 8]))
                    at //= 8
            same = d[0] is None or zlib.crc32(str(d[0]).encode()) % 3
            digest = leaf(d if same else (*d[:4], low(d[4])))
            for slot, run in path:
                digest = sha("".join([*run[:slot], digest, *run[slot + 1 :]]))
            proof = sha("".join(x for slot, run in path for j, x in enumerate(run) if j != slot))
            root = top[-1][0]
            yield d[0], leaf(d), own[k][-1][0], root, proof, digest, digest == root


def test_constants():
    assert [hex(x) for x in o.INITIAL[:2].tolist()] == ["0x6a09e667", "0xbb67ae85"]
    assert [hex(int(x)) for x in o.ROUND[:2]] == ["0x428a2f98", "0x71374491"]


def test_midstates():
    """Every slot's state, resumed, gives the hash of all children with that child replaced."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(20)]
    level = o.Level(o.from_bytes(digests), np.zeros(20, int))
    texts = [d.hex() for d in digests]
    want = [sha("".join(texts[i : i + 8])) for i in (0, 8, 16)]
    assert [d.hex() for d in o.to_bytes(level.above)] == want
    new = [hashlib.sha256(b"new" + d).digest() for d in digests]
    got = o.to_bytes(level.fold(np.arange(20), o.from_bytes(new)))
    for i in range(20):
        run = texts[i // 8 * 8 : i // 8 * 8 + 8]
        run[i % 8] = new[i].hex()
        assert got[i].hex() == sha("".join(run))


def test_fold_reads_no_left_sibling():
    """Left siblings changed after the states were retained change nothing; right ones do."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(8)]
    level = o.Level(o.from_bytes(digests), np.zeros(8, int))
    new = o.from_bytes([b"\7" * 32])
    before = o.to_bytes(level.fold(np.array([4]), new))
    level.blocks[:, :4] = 0
    assert o.to_bytes(level.fold(np.array([4]), new)) == before
    level.blocks[:, 5] = 0
    assert o.to_bytes(level.fold(np.array([4]), new)) != before


DOCS = [(1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "Abc"), (1, "t", "en", 3, "XYZ"), (None, None, None, None, None),
        (None, "s", "en", 0, ""), (2, "s", None, 5, "É😀 Q"), (3, "", "", 0, None), (4, "s", "ä", 1, "Z" * 100_000)]


@pytest.mark.parametrize("levels", [o.LEVELS, 2, 1])
def test_query_plain(spark, tables, levels):
    """Also with small chunks, so that trees take several steps."""
    rng = random.Random(levels)
    docs = [(i, rng.choice("ab"), rng.choice(["en"] * 6 + ["fr", "de", None]), i, f"Text {i}") for i in range(10, 700)]
    docs += DOCS + [(900 + i, "s", f"lang {i:03d}", 0, "") for i in range(75)]
    folder = tables(extra=True, documents=[(d[0], d[4], d[2], d[1], d[3]) for d in docs])
    got = [tuple(r) for r in o.query(spark, folder, levels).collect()]
    assert sorted(got, key=str) == sorted(plain(docs), key=str)


def test_query_sql(spark):
    from oracle_compare import compare, duck

    assert compare(o.query(spark, SF), duck(SF), o.SQL)["exact"]
