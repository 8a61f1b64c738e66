"""Merkle manifest of a dataset with a tree of SHA-256 midstates.

A leaf is the hash of a row's fields, each as its byte count and value.  The leaves of a tree (a language),
ascending by id, are hashed eight at a time until one node remains; the trees' roots, in order, make a last tree
in the same way.  Digests are hashed as 64 hexadecimal characters, which are exactly one block of
SHA-256: a parent retains, before each child's slot, the hash state of the children to its left.  To fold
a changed leaf to the root, the state of its slot is resumed with the replacement and the right siblings
only, level by level; left siblings aren't read again.

Plan: the leaves' digests are dealt in ranges of (tree, id) and numbered within each tree from the counts of
trees by partition.  Chunks of ``FANOUT ** LEVELS`` leaves are hashed to one node in one task; those
nodes are the leaves of the next step, until each tree is one node.  Paths come back the same way: a chunk gets the path
above it and gives each of its members the path through the chunk.  No step holds more than a chunk, and
no tree passes through one task, whatever share of the rows a language has.

Defined cases: null fields are ``-`` (a null language is a tree of its own, the first); empty texts are ``0:``;
null ids come first; rows of one id are ordered by their digests, repeated rows are leaves of their own; extra
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from tickflow.llm.common import map_batches, shuffle_parts, table, written

FANOUT = 8
#: Levels that one task hashes: chunks of 4096 leaves.
LEVELS = 4
#: Nodes whose chunks are hashed together, so that many small trees cost no more than one large one.
TOGETHER = 8192


# --- SHA-256 over many states at once -----------------------------------------------------------
def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= n else (low, mid - 1)
    return low


#: The first 32 bits of the fractional parts of the square roots of the first 8 primes and of the cube roots of the
#: first 64.
INITIAL = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 words x n) after one more block (16 words x n) each."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        s0 = _turned(a, 7) ^ _turned(a, 18) ^ (a >> np.uint32(3))
        s1 = _turned(b, 17) ^ _turned(b, 19) ^ (b >> np.uint32(10))
        w.append(w[i - 16] + s0 + w[i - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t1 = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        t2 = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (c & (a ^ b)))
        a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_block(words: np.ndarray) -> np.ndarray:
    """Digests (8 words x n) as blocks (16 words x n) of their hexadecimal characters."""
    out = np.empty((16, words.shape[1]), np.uint32)
    for half, shift in ((0, 28), (1, 12)):
        w = np.zeros_like(words)
        for k in range(4):
            w = (w << np.uint32(8)) | _HEX[(words >> np.uint32(shift - 4 * k)) & np.uint32(15)]
        out[half::2] = w
    return out


@lru_cache(maxsize=16)
def _padding(blocks: int) -> np.ndarray:
    """The last block of a message of whole blocks."""
    out = np.zeros(16, np.uint32)
    out[0], out[15] = 0x80000000, blocks * 512
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return compress(state, np.stack([_padding(int(n)) for n in range(FANOUT + 1)], axis=1)[:, blocks])


def from_bytes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32)


def to_bytes(words: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(words.T.astype(">u4")).tobytes()
    return [flat[i : i + 32] for i in range(0, len(flat), 32)]


# --- a forest of small trees --------------------------------------------------------------------
class Level:
    """One level of all trees: the children, and the parents' retained states before each slot."""

    def __init__(self, words: np.ndarray, tree: np.ndarray):
        n = words.shape[1]
        begins = np.r_[True, tree[1:] != tree[:-1]] if n else np.empty(0, bool)
        first = np.flatnonzero(begins)
        place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        self.words, self.blocks = words, as_block(words)
        self.slot = place % FANOUT
        self.first = np.flatnonzero(self.slot == 0)
        self.count = np.diff(np.r_[self.first, n])
        self.parent = np.repeat(np.arange(len(self.first)), self.count)
        self.tree = tree[self.first]
        state = np.repeat(INITIAL[:, None], len(self.first), axis=1)
        self.states = np.empty((FANOUT, 8, len(self.first)), np.uint32)
        for slot in range(FANOUT):
            self.states[slot] = state
            on = np.flatnonzero(self.count > slot)
            if len(on):
                state[:, on] = compress(state[:, on], self.blocks[:, self.first[on] + slot])
        self.above = finish(state, self.count)

    def fold(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The parents' digests if the children ``at`` were ``words``: their slots' states, resumed."""
        parent, slot = self.parent[at], self.slot[at]
        state = compress(self.states[slot, :, parent].T, as_block(words))
        for right in range(1, FANOUT):
            on = np.flatnonzero((slot < right) & (self.count[parent] > right))
            if len(on):
                state[:, on] = compress(state[:, on], self.blocks[:, self.first[parent[on]] + right])
        return finish(state, self.count[parent])


def height(n: np.ndarray, levels: int) -> np.ndarray:
    """Levels above the leaves of a chunk, by the leaves of its whole tree; at most ``levels``."""
    return np.searchsorted(FANOUT ** np.arange(levels), n)


class Forest:
    """The chunks of some trees: ``chunk`` numbers each leaf's chunk, ``leaves`` counts the leaves of
    its whole tree."""

    def __init__(self, words: np.ndarray, chunk: np.ndarray, leaves: np.ndarray, levels: int = LEVELS):
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.empty(0, int)
        self.names = np.arange(len(first))
        chunk = np.repeat(self.names, np.diff(np.r_[first, len(chunk)]))
        self.of, self.heights = chunk, height(leaves[first], levels)
        self.roots = np.empty((8, len(first)), np.uint32)
        self.levels: list[Level] = []
        #: For each level, the node of it above each leaf; -1 past the chunk's own root.
        self.above: list[np.ndarray] = []
        node, tree = np.arange(words.shape[1]), chunk
        for depth in range(levels + 1):
            ends = self.heights[tree] == depth
            self.roots[:, tree[ends]] = words[:, ends]
            goes = np.flatnonzero(~ends)
            place = np.full(len(tree), -1)
            place[goes] = np.arange(len(goes))
            node = np.where(node >= 0, place[node], -1)
            if not len(goes):
                break
            level = Level(words[:, goes], tree[goes])
            self.levels.append(level)
            self.above.append(node)
            node = np.where(node >= 0, level.parent[node], -1)
            words, tree = level.above, level.tree

    def siblings(self, leaf: int) -> Iterator[tuple[int, list[bytes], bytes]]:
        """For each level above a leaf: its slot, all children of its parent but itself, the slot's state."""
        for level, above, texts, states in zip(self.levels, self.above, self._hex(), self._saved(), strict=True):
            at = above[leaf]
            if at < 0:
                return
            parent, slot = level.parent[at], int(level.slot[at])
            first = level.first[parent]
            others = texts[first : first + level.count[parent]]
            yield slot, others[:slot] + others[slot + 1 :], states[slot][parent]

    def _hex(self):
        if not hasattr(self, "texts"):
            self.texts = [[d.hex().encode() for d in to_bytes(v.words)] for v in self.levels]
        return self.texts

    def _saved(self):
        if not hasattr(self, "kept"):
            self.kept = [[to_bytes(s) for s in v.states] for v in self.levels]
        return self.kept


# --- DataFrames ---------------------------------------------------------------------------------
def field(c: Column) -> Column:
    """A field as it goes into a leaf: byte count, colon and value; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest (binary) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def number(nodes: DataFrame, *order: str) -> DataFrame:
    """The rows with their number ``idx`` within ``tree``, by ``order``, and the tree's size ``n``.

    Equal rows of a tree are dealt by their place in the input, so that no value fills a partition."""
    spread = written(nodes.withColumn("tie", F.monotonically_increasing_id()), "merkle-digests")
    keys = [F.asc_nulls_first(c) for c in ("tree", *order, "tie")]
    dealt = spread.repartitionByRange(shuffle_parts(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33)
    spans = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    whole = W.Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    spans = spans.select(
        "tree",
        "part",
        (F.coalesce(F.sum("k").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("k").over(whole).alias("n"),
    )
    named = placed.withColumn("part", part)
    return named.join(spans, ["tree", "part"]).select(
        *nodes.columns, (F.col("at") + F.col("shift")).alias("idx"), "n"
    )


_PATH = "array<struct<slot:int,state:binary,siblings:binary>>"
#: Columns of members and of paths on their way to a chunk's task.
_ROWS = {
    "tree": "string", "chunk": "long", "idx": "long", "n": "long", "digest": "binary", "doc_id": "long",
    "replaced": "binary", "path": _PATH, "roots": "array<binary>",
}


def _chunked(members: DataFrame, levels: int, paths: DataFrame | None = None) -> DataFrame:
    """Members by chunk, in order; a chunk's ``paths`` row, if given, stands before them (``idx`` -1)."""
    have = {c: F.col(c) for c in members.columns}
    have["chunk"] = F.floor(F.col("idx") / FANOUT**levels).cast("long")
    fill = lambda have: [have.get(c, F.lit(None)).cast(t).alias(c) for c, t in _ROWS.items()]
    rows = members.select(*fill(have))
    if paths is not None:
        have = {c: F.col(c) for c in paths.columns} | {"chunk": F.col("idx"), "idx": F.lit(-1)}
        rows = rows.unionByName(paths.select(*fill(have)))
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")


def _groups(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[list], dict]]:
    """Whole chunks, together ``TOGETHER`` nodes: the members' columns, and the rows of paths by chunk."""
    held: list[pa.RecordBatch] = []
    size = 0
    last = None
    for part in parts:
        keys = list(zip(part["tree"].to_pylist(), part["chunk"].to_pylist(), strict=True))
        cut = 0
        if held and keys and keys[0] != last and size >= TOGETHER:
            yield _columns(held)
            held, size = [], 0
        if size + len(keys) >= TOGETHER and keys and keys[0] != keys[-1]:
            # up to the last chunk's beginning, which may go on in the next batch
            cut = len(keys) - 1
            while keys[cut - 1] == keys[-1]:
                cut -= 1
            yield _columns([*held, part.slice(0, cut)])
            held, size = [], 0
        held.append(part.slice(cut))
        size += len(keys) - cut
        last = keys[-1] if keys else last
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]):
    whole = pa.Table.from_batches(parts)
    rows = {c: whole[c].to_pylist() for c in ("tree", "chunk", "idx", "n", "digest", "doc_id", "replaced")}
    marks = [i for i, x in enumerate(rows["idx"]) if x < 0]
    paths = {}
    for i in marks:
        paths[rows["tree"][i], rows["chunk"][i]] = (whole["path"][i].as_py() or [], whole["roots"][i].as_py() or [])
    if marks:
        gone = set(marks)
        rows = {c: [x for i, x in enumerate(v) if i not in gone] for c, v in rows.items()}
    return rows, paths


def _forest(rows: dict, levels: int) -> tuple[Forest, list[tuple]]:
    keys = list(zip(rows["tree"], rows["chunk"], strict=True))
    names: dict[tuple, int] = {}
    chunk = np.array([names.setdefault(k, len(names)) for k in keys], np.int64)
    return Forest(from_bytes(rows["digest"]), chunk, np.array(rows["n"], np.int64), levels), list(names)


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    ddl = T._parse_datatype_string(schema)
    out = to_arrow_schema(ddl)

    def run(parts):
        for rows, paths in _groups(parts):
            if rows["idx"]:
                columns = fn(rows, paths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )

    return map_batches(df, run, ddl)


def climb(members: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row a chunk: ``tree``, its number ``idx`` among ``n`` chunks, and ``digest``, the chunk's root."""

    def run(rows, _):
        forest, names = _forest(rows, levels)
        sizes = dict(zip(zip(rows["tree"], rows["chunk"], strict=True), rows["n"], strict=True))
        counts = [-(-sizes[k] // FANOUT**levels) for k in names]
        return [t for t, _ in names], [c for _, c in names], counts, to_bytes(forest.roots)

    return _mapped(_chunked(members, levels), run, "tree string, idx long, n long, digest binary")


def descend(members: DataFrame, paths: DataFrame | None, levels: int = LEVELS) -> DataFrame:
    """``tree``, ``idx``, ``path`` and ``roots`` of every member: the way through its chunk, then the way on from the
    chunk (``paths``)."""

    def run(rows, paths):
        forest, names = _forest(rows, levels)
        out = []
        for i, name in enumerate(forest.of.tolist()):
            above, roots = paths.get(names[name], ([], []))
            own = [{"slot": s, "state": st, "siblings": b"".join(sib)} for s, sib, st in forest.siblings(i)]
            out.append((own + above, roots))
        return rows["tree"], rows["idx"], [p for p, _ in out], [r for _, r in out]

    return _mapped(_chunked(members, levels, paths), run, f"tree string, idx long, path {_PATH}, roots array<binary>")


def resume(path: list[dict], words: np.ndarray) -> np.ndarray:
    """Folds digests that all stand under one node along that node's path."""
    n = words.shape[1]
    for step in path:
        siblings, slot = step["siblings"], step["slot"]
        state = compress(np.repeat(from_bytes([step["state"]]), n, axis=1), as_block(words))
        rest = siblings[64 * slot :]
        for at in range(0, len(rest), 64):
            block = np.frombuffer(rest[at : at + 64], ">u4").astype(np.uint32)
            state = compress(state, np.repeat(block[:, None], n, axis=1))
        words = finish(state, np.full(n, len(siblings) // 64 + 1))
    return words


_FOLDED = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def fold(members: DataFrame, paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every leaf's proof and the root that its replacement (``replaced``) folds to."""

    def run(rows, paths):
        forest, names = _forest(rows, levels)
        words = from_bytes(rows["replaced"])
        ids = np.arange(words.shape[1])
        for level, above in zip(forest.levels, forest.above, strict=True):
            on = ids[above >= 0]
            words[:, on] = level.fold(above[on], words[:, on])
        folded: list[bytes] = [b""] * len(ids)
        for name in range(len(names)):
            on = np.arange(*np.searchsorted(forest.of, [name, name + 1]))
            for i, d in zip(on.tolist(), to_bytes(resume(paths[names[name]][0], words[:, on])), strict=True):
                folded[i] = d
        proofs = []
        for i, name in enumerate(forest.of.tolist()):
            h = hashlib.sha256()
            for _, siblings, _ in forest.siblings(i):
                h.update(b"".join(siblings))
            for step in paths[names[name]][0]:
                h.update(step["siblings"])
            proofs.append(h.hexdigest())
        subroots, roots = zip(*[paths[names[k]][1] for k in forest.of.tolist()], strict=True)
        shown = lambda ds: [d.hex() for d in ds]
        same = [a == b for a, b in zip(folded, roots, strict=True)]
        return rows["doc_id"], shown(rows["digest"]), shown(subroots), shown(roots), proofs, shown(folded), same

    return _mapped(_chunked(members, levels, paths), run, _FOLDED)


def _levels_up(members: DataFrame, levels: int) -> list[DataFrame]:
    """The members, the chunks' roots, their chunks' roots and so on until each tree is one node."""
    steps = [members]
    largest = members.agg(F.max("n")).first()[0] or 0
    while True:
        steps.append(written(climb(steps[-1], levels), "merkle-nodes"))
        largest = -(-largest // FANOUT**levels)
        if largest <= 1:
            return steps


def verify(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """From ``tree`` (its name, in the order of names), ``doc_id``, ``digest`` and ``replaced`` (binary): every leaf's
    digest, root of its tree, root, digest of its proof, the root that the replacement folds to, and whether
    that is the root."""
    members = written(number(leaves, "doc_id", "digest", "replaced"), "merkle-leaves")
    steps = _levels_up(members, levels)
    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = _levels_up(written(number(subroots, "name"), "merkle-trees"), levels)
    root = tops[-1].select("digest").scalar()
    path = None
    for step in reversed(tops[:-1]):
        path = written(descend(step, path, levels), "merkle-paths")
    # a tree's root and the way from it: what the chunks of the last step go on with
    named = tops[0].join(path.drop("roots"), ["tree", "idx"])
    path = named.select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.array("digest", root).alias("roots")
    )
    for step in reversed(steps[1:-1]):
        path = written(descend(step, path, levels), "merkle-paths")
    return fold(members, path, levels)


def tree_name(c: Column) -> Column:
    """A tree's name that is never null and sorts as the value does, bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def query(spark, sf_dir, levels: int = LEVELS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"], docs["lang"], docs["n_chars"], docs["text"]
    )
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = given.select(
        tree_name(F.col("lang")).alias("tree"),
        "doc_id",
        leaf(*plain, F.col("text")).alias("digest"),
        F.when(tampered, leaf(*plain, lowered)).alias("replaced"),
    )
    return verify(leaves.withColumn("replaced", F.coalesce("replaced", "digest")), levels)


# --- the same in DuckDB's SQL: lists of digests, level by level -------------------------------
#: Levels that the SQL looks at; 8 to this power are the leaves a tree can have there.
_SQL_LEVELS = 8


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_tree(name: str, source: str) -> str:
    """A table with the lists ``l0`` to ``l8`` of each tree's levels, NULL above its root, and ``top``."""
    out = [f"{name}0 AS ({source})"]
    for k in range(1, _SQL_LEVELS + 1):
        up = (
            f"list_transform(range(0, len(l{k - 1}), 8), "
            f"lambda i: sha256(array_to_string(l{k - 1}[i + 1 : i + 8], '')))"
        )
        out.append(f"{name}{k} AS (SELECT *, CASE WHEN len(l{k - 1}) > 1 THEN {up} END AS l{k} FROM {name}{k - 1})")
    tops = ", ".join(f"l{k}[1]" for k in range(_SQL_LEVELS, -1, -1))
    out.append(f"{name} AS (SELECT *, coalesce({tops}) AS top FROM {name}{_SQL_LEVELS})")
    return ",\n".join(out)


def _sql_way(name: str, source: str, lists: str, at: str) -> str:
    """``source`` with ``proof`` and ``folded`` carried on along the levels of ``lists``, from the place ``at``."""
    out, last = [], source
    for k in range(_SQL_LEVELS):
        place = f"({at} // {8**k})"
        run = f"{lists}.l{k}[{place} // 8 * 8 + 1 : {place} // 8 * 8 + 8]"
        left, right = f"{run}[1 : {place} % 8]", f"{run}[{place} % 8 + 2 : 8]"
        texts = [f"array_to_string({x}, '')" for x in (left, right)]
        out.append(
            f"{name}{k} AS (SELECT s.* REPLACE (CASE WHEN len({lists}.l{k}) > 1 "
            f"THEN proof || {texts[0]} || {texts[1]} ELSE proof END AS proof, "
            f"CASE WHEN len({lists}.l{k}) > 1 THEN sha256({texts[0]} || folded || {texts[1]}) ELSE folded END AS folded) "
            f"FROM {last} s JOIN {lists} USING (tree_no))"
        )
        last = f"{name}{k}"
    return ",\n".join(out)


_SQL_LEAF = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_SQL_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])))"""
SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bytes),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_SQL_LEAF.format(text="text")}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_SQL_CRC} % 3 = 0
              THEN sha256({_SQL_LEAF.format(text=_SQL_LOW)}) ELSE sha256({_SQL_LEAF.format(text="text")}) END AS folded
  FROM documents, crc_table),
names AS (SELECT tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS tree_no FROM (SELECT DISTINCT tree FROM leaves)),
placed AS (
  SELECT leaves.*, tree_no, row_number() OVER (PARTITION BY tree_no ORDER BY doc_id NULLS FIRST, leaf, folded) - 1 AS idx,
         '' AS proof
  FROM leaves JOIN names USING (tree)),
{_sql_tree("t", "SELECT tree_no, list(leaf ORDER BY idx) AS l0 FROM placed GROUP BY tree_no")},
{_sql_tree("u", "SELECT list(top ORDER BY tree_no) AS l0 FROM t")},
upper AS (SELECT t.tree_no, u.* FROM t, u),
{_sql_way("w", "placed", "t", "idx")},
{_sql_way("v", f"w{_SQL_LEVELS - 1}", "upper", "s.tree_no")}
SELECT doc_id, leaf, t.top AS subroot, upper.top AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = upper.top AS verified
FROM v{_SQL_LEVELS - 1} JOIN t USING (tree_no) JOIN upper USING (tree_no)
"""
