"""Byte-level BPE by ranked merges, and decoding.

Encoding folds the ranked merges over the bytes of distinct words: a text is cut into words, each
distinct word is merged once a task (pair of lowest rank first, the leftmost of equals) and the ids
are put together by word.  Decoding looks the ids up in the table of binary pieces and concatenates.

``encode`` runs the fold in Arrow batches; ``round_trip`` decodes them in the same worker.  ``encode_words`` and ``decode_ids`` are the same fold
and the same concatenation in Spark's higher-order functions over a literal rank map; they are exact but
too slow for whole tables (figures in the README), so they serve small vocabularies and the tests.

Words are the matches of the tokenizer's pattern.  A text is first cut before each single blank that
follows a non-blank: a match never reaches over such a place, so pieces cut there encode apart.

Defined cases: null and empty texts give no ids and decode to no bytes; repeated rows and null ids
pass through; characters that Unicode has assigned only lately may be cut as the ``regex`` module's tables
say, not tiktoken's; an id outside the table raises an error on decoding; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import BATCH_ROWS, map_batches, rows_of, table, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bound of the words that a Python worker remembers between texts.
MEMORY = 200_000
#: Characters of text whose new words are merged together.
TOGETHER = 1 << 20
_RUNS = re.compile(r"\s[ ]")
_NONE = 1 << 62
#: Marks after which a word's last letter ends a match; the apostrophe may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold: merges the pair of lowest rank, leftmost of equals, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != _NONE:
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], _NONE)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], _NONE)
    return [ranks[p] for p in parts]


@lru_cache(maxsize=2)
def _pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id of each byte, and of each pair of pieces that make a piece together: keys, ids."""
    ranks = load_ranks(path)
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    pairs = {
        ranks[p[:i]] << 32 | ranks[p[i:]]: r
        for p, r in ranks.items()
        for i in range(1, len(p))
        if p[:i] in ranks and p[i:] in ranks
    }
    keys = np.array(sorted(pairs), np.int64)
    return of_byte, keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def merge_all(words: list[bytes], path: str = RANKS) -> list[list[int]]:
    """``merge`` of many words at once."""
    return [np.frombuffer(ids, np.int32).tolist() for ids in merge_packed(words, path)]


def merge_packed(words: list[bytes], path: str = RANKS) -> list[bytes]:
    """The ids of many words as native 32-bit integers: in each round every word joins its pair of lowest rank, the
    leftmost of equals.  A rank is the id of the joined piece."""
    ranks = load_ranks(path)
    out = [b""] * len(words)
    pack = struct.Struct("=i").pack
    todo = []
    for i, w in enumerate(words):
        if (r := ranks.get(w)) is not None:
            out[i] = pack(r)
        elif len(w) > 64:
            out[i] = np.array(merge(w, ranks), np.int32).tobytes()
        elif w:
            todo.append(i)
    if not todo:
        return out
    of_byte, keys, made = _pair_table(path)

    def joined(left, right):
        k = left << 32 | right
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, made[at], _NONE >> 32)

    todo = np.array(todo)
    sizes = np.array([len(words[i]) for i in todo])
    ids = of_byte[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    rank = np.append(joined(ids[:-1], ids[1:]), _NONE >> 32)
    rank[np.cumsum(sizes) - 1] = _NONE >> 32
    while True:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        low = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
        at, low = low & 0xFFFFFFFF, low >> 32
        live = low < _NONE >> 32
        if not live.all():
            done = np.flatnonzero(~live)
            whole = ids.astype(np.int32).tobytes()
            for k, i, j in zip(todo[done].tolist(), (4 * starts[done]).tolist(), (4 * ends[done]).tolist(), strict=True):
                out[k] = whole[i:j]
            if not live.any():
                return out
        ids[at[live]] = low[live]
        keep = np.repeat(live, sizes)
        keep[at[live] + 1] = False
        moved = np.cumsum(keep) - 1
        todo, sizes, at = todo[live], sizes[live] - 1, moved[at[live]]
        ids, rank = ids[keep], rank[keep]
        last = np.cumsum(sizes) - 1
        ends_here = np.zeros(len(ids), bool)
        ends_here[last] = True
        after = np.minimum(at + 1, len(ids) - 1)
        rank[at] = np.where(ends_here[at], _NONE >> 32, joined(ids[at], ids[after]))
        first = last - sizes + 1
        inner = at[at > first]
        rank[inner - 1] = joined(ids[inner - 1], ids[inner])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same order of merges by a heap over a linked list: n log n for words of any length."""
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if 0 <= i and j < n and (r := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, last = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != last:
            continue
        alive[j] = False
        end[i], after[i] = last, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; remembers the ids of the words it has met, in two generations of ``MEMORY`` words together."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        self.path = path
        self.find = regex.compile(pattern).findall
        self.held: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _matches(self, part: str) -> list[str]:
        if part.isalpha() or part[:1] == " " and part[1:].isalpha():
            return [part]
        return self.find(part)

    def _learn(self, words: set[str]) -> None:
        """Remembers words; a word's letters and the marks after them are remembered apart."""
        split, whole = [], []
        for w in words:
            core = w.rstrip(MARKS)
            if len(core) < len(w) and core[-1:].isalpha():
                split.append((w, core, w[len(core) :]))
            else:
                whole.append(w)
        cores, old = self.cores, self.old[1]
        parts = set(whole)
        parts.update([c for _, c, _ in split], [t for _, _, t in split])
        parts.difference_update(cores)
        known = {p: ids for p in parts if (ids := old.get(p)) is not None}
        cores.update(known)
        new = [p for p in parts if p not in known]
        matches = [self._matches(p) for p in new]
        ids = merge_packed([m.encode("utf-8", "surrogatepass") for ms in matches for m in ms], self.path)
        at = 0
        for p, ms in zip(new, matches, strict=True):
            n = len(ms)
            cores[p] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n
        held = self.held
        held.update([(w, cores[w]) for w in whole])
        held.update([(w, cores[c] + cores[t]) for w, c, t in split])

    def _cuts(self, text: str) -> list[str]:
        if _RUNS.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit integers."""
        if len(self.held) > MEMORY // 2:
            self.old = self.held, self.cores
            self.held, self.cores = {}, {}
        held, old, cuts = self.held, self.old[0], [self._cuts(t) for t in texts]
        new = set().union(*cuts).difference(held)
        if new:
            known = {w: ids for w in new if (ids := old.get(w)) is not None}
            held.update(known)
            self._learn(new.difference(known))
        return [b"".join([held[w] for w in c]) for c in cuts]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for a Python worker, so that its memory of words serves task after task."""
    return Encoder(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = pa.schema([*_ENCODED, ("bytes", pa.binary())])


def _encoding(ranks_path: str):
    def flush(doc_ids, ids):
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends), values)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], schema=_ENCODED)

    def run(parts):
        encoder, doc_ids, held, size = worker_encoder(ranks_path), [], [], 0
        for doc_id, text in rows_of(parts):
            doc_ids.append(doc_id)
            held.append(text)
            size += len(text)
            if size >= TOGETHER or len(held) >= BATCH_ROWS:
                yield flush(doc_ids, encoder.encode(held))
                doc_ids, held, size = [], [], 0
        if held:
            yield flush(doc_ids, encoder.encode(held))

    return run


@lru_cache(maxsize=1)
def _pieces(path: str) -> tuple[pa.Array, np.ndarray]:
    """The piece of each id, null where there is none, and the pieces' lengths."""
    ranks = load_ranks(path)
    by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        by_id[i] = piece
    return pa.array(by_id, pa.binary()), np.array([len(p or b"") for p in by_id], np.int64)


def concatenated(lists: pa.ListArray, path: str = RANKS) -> pa.Array:
    """The bytes of each list of ids: all pieces are taken at once, and their bytes cut where a list ends."""
    pieces, sizes = _pieces(path)
    flat = lists.flatten()
    taken = pieces.take(flat)
    if taken.null_count:
        raise ValueError("an id without a piece")
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(sizes[flat.to_numpy()])][np.r_[0, np.cumsum(counts)]]
    data = pa.py_buffer(b"") if not len(flat) else taken.buffers()[2]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), data])


def _decoding(ranks_path: str):
    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, BATCH_ROWS // 4):
                piece = part.slice(at, BATCH_ROWS // 4)
                ids = piece.column(1).cast(_DECODED.field(1).type)
                yield pa.RecordBatch.from_arrays([piece.column(0), ids, concatenated(ids, ranks_path)], schema=_DECODED)

    return run


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS
) -> DataFrame:
    """``doc_id`` and ``ids`` of every row; no shuffle."""
    return map_batches(texts(df, id_col, text_col), _encoding(ranks_path), "doc_id long, ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """``doc_id``, ``ids`` and ``bytes``: the pieces of the ids, concatenated."""
    picked = df.select("doc_id", F.col(ids_col).alias("ids"))
    return map_batches(picked, _decoding(ranks_path), "doc_id long, ids array<int>, bytes binary")


def round_trip(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS
) -> DataFrame:
    """The rows of ``decode(encode(df))``, both done by one worker, one batch of ids after the other."""
    encoding, decoding = _encoding(ranks_path), _decoding(ranks_path)

    def run(parts):
        return decoding(encoding(parts))

    return map_batches(texts(df, id_col, text_col), run, "doc_id long, ids array<int>, bytes binary")


def digests(df: DataFrame) -> DataFrame:
    """From ``decode``'s rows: counts and digests of the ids and of the decoded bytes."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )


# --- the same fold in higher-order functions ----------------------------------------------------
_SLOTS = 1 << 16


def _rank_literal(ranks_path: str) -> Column:
    """The rank map as one constant: an array of small maps, one for each slot of the key's CRC,
    since a look-up in a Spark map goes over all of its keys.  Keys are hexadecimal."""
    slots: list[dict[str, int]] = [{} for _ in range(_SLOTS)]
    for piece, rank in load_ranks(ranks_path).items():
        key = piece.hex().upper()
        slots[zlib.crc32(key.encode()) % _SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def encode_words(df: DataFrame, word_col: str = "word", ranks_path: str = RANKS) -> DataFrame:
    """The input's rows with ``ids``: each word, one match of the pattern, folded on its own."""
    slots = _rank_literal(ranks_path)
    none = F.lit(2**31 - 1)

    def rank(key):
        return F.try_element_at(F.get(slots, F.crc32(key.cast("binary")) % _SLOTS), key)

    def merged(state, _):
        # pieces stand as <6C><6F>; every pair of lowest rank is joined in one replacement
        parts = F.split(F.substring(state, F.lit(2), F.length(state) - 2), "><")
        pairs = F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda right, i: F.struct(
                F.coalesce(rank(F.concat(F.get(parts, i), right)), none).alias("rank"),
                F.get(parts, i).alias("left"),
                right.alias("right"),
            ),
        )
        low = F.array_min(pairs)
        old = F.concat(F.lit("<"), low["left"], F.lit("><"), low["right"], F.lit(">"))
        new = F.concat(F.lit("<"), low["left"], low["right"], F.lit(">"))
        return F.when(low["rank"] < none, F.replace(state, old, new)).otherwise(state)

    word = F.col(word_col)
    state = F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "<$1>")
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
    last = F.aggregate(steps, state, merged)
    parts = F.split(F.substring(last, F.lit(2), F.length(last) - 2), "><")
    return df.withColumn(
        "ids", F.when(F.length(word) > 0, F.transform(parts, rank)).otherwise(F.array().cast("array<int>"))
    )


def decode_ids(ids: Column | str, ranks_path: str = RANKS) -> Column:
    """The bytes of an array of ids: binary pieces looked up in a literal array, concatenated."""
    by_id = {i: piece.hex() for piece, i in load_ranks(ranks_path).items()}
    pieces = F.from_json(
        F.lit(json.dumps([by_id.get(i, "") for i in range(max(by_id) + 1)])), "array<string>"
    )
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def query(spark, sf_dir) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))
