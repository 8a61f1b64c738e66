"""Alignment of two tokenizers' ids by whitespace-token anchors.

Both tokenizers encode the whole text.  Their tokens are byte ranges of the same bytes (a space and the text).  An
anchor is an offset where both have a token that begins with a space, and so where the tokens before it
share their end; anchors cut a document into windows of token ids, a word or so each.  The alignment of a window
depends on its ids alone and is remembered by them.  Within a window, offsets where tokens of both end part it into
groups, and the tokens whose ranges overlap are linked.

Counts: how many documents hold a pair of ids linked.  Documents are taken in blocks of ``BLOCK_BYTES`` of text; a block's
distinct pairs are numbered, so that what is summed is a block's pairs and not each document's links.  A pair's count and
whether it is the highest of its first id goes back to the blocks that hold the pair, where its number stands for it in
the documents.  A row is a document or a pair: neither a worker nor a row holds the documents of a block.

Defined cases: null and empty texts, and texts whose bytes a tokenizer changes (such as U+2581), have no tokens and
link nothing; repeated rows and null ids are documents of their own; extra columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickflow.llm.common import map_batches, map_rows, rows_of, table, texts, written

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text whose documents are scored together, and of text that is encoded at once.
BLOCK_BYTES, BATCH_BYTES = 8 << 20, 256 << 10
#: Rows of a block's pairs that go to Spark at once.
PAIR_ROWS = 10_000
#: Windows that a worker remembers, in two generations of so many each, and ids of the longest one remembered.
MEMORY, LONGEST = 100_000, 24
SPACE = "▁"


class ByteLevel:
    """A byte-level BPE from its ranks, by tiktoken: the ids of the tokenizers library's file of the same vocabulary, at a
    fourth of the time.  There are no special tokens; their strings in a text are plain text."""

    def __init__(self, path: str = BYTE_LEVEL, pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece

    def encode(self, batch: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in batch]


class Pieces:
    """A sentencepiece model with byte fallback; it adds the space itself."""

    def __init__(self, path: str = PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes = [
            bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i)
            else b"" if m.is_control(i) or m.is_unknown(i)
            else m.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(m.get_piece_size())
        ]

    def encode(self, batch: list[str]) -> list[list[int]]:
        return self.model.encode(batch, num_threads=1)


#: A window's groups as text (``a1,a2|b1;a3|b2``), and its links as pairs of ids, packed, 64 bits each.
Window = tuple[bytes, bytes]


@dataclass
class Alignment:
    a: list[int]
    b: list[int]
    windows: list[Window]

    def groups(self) -> bytes:
        return b";".join([text for text, _ in self.windows])

    def ends(self) -> list[tuple[int, int]]:
        """Where each group ends in both lists of ids."""
        sizes = [[len(ids.split(b",")) for ids in g.split(b"|")] for g in self.groups().split(b";")]
        return list(zip(accumulate(i for i, _ in sizes), accumulate(j for _, j in sizes), strict=True))

    def links(self) -> np.ndarray:
        return np.frombuffer(b"".join([links for _, links in self.windows]), np.int64)


#: Between the ids of both tokenizers in a window's key.
_BAR = -1


class Aligner:
    def __init__(self, a=None, b=None):
        self.a, self.b = a or ByteLevel(), b or Pieces()
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.spaced = [np.array([x[:1] == b" " for x in t.bytes]) for t in (self.a, self.b)]
        # an id as text with what follows it: within a group, and at the end of its half
        ends = [(range(len(t.bytes)), s) for t, s in zip((self.a, self.b), (b"|", b";"), strict=True)]
        self.shown = [str(i).encode() + mark for ids, end in ends for mark in (b",", end) for i in ids]
        self.shown_sizes = np.array([len(x) for x in self.shown], np.int64)
        self.new: dict[bytes, Window] = {}
        self.old: dict[bytes, Window] = {}

    def align(self, batch: list[str]) -> list[Alignment | None]:
        """An alignment for each text; None where a tokenizer's tokens aren't the text's bytes."""
        ids = list(zip(self.a.encode(batch), self.b.encode(batch), strict=True))
        good = [i for i, text in enumerate(batch) if text and self._faithful(text, *ids[i])]
        out: list[Alignment | None] = [None] * len(batch)
        if not good:
            return out
        a, b = [self._flat([ids[i][side] for i in good]) for side in (0, 1)]
        first_a, first_b = self._anchored(a, b)
        windows = self._windows(a, b, first_a, first_b)
        begins = np.searchsorted(first_a, np.cumsum([0, *(len(ids[i][0]) for i in good)])).tolist()
        for i, begin, end in zip(good, begins, begins[1:], strict=False):
            out[i] = Alignment(*ids[i], windows[begin:end])
        return out

    def _faithful(self, text: str, a: list[int], b: list[int]) -> bool:
        want = b" " + text.encode("utf-8", "surrogatepass")
        return all(b"".join([t.bytes[i] for i in ids]) == want for t, ids in ((self.a, a), (self.b, b)))

    @staticmethod
    def _flat(lists: list[list[int]]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))

    def _anchored(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens at the anchors.  The texts stand one after the other in the same bytes for both tokenizers;
        each begins with a space, and so with an anchor."""
        starts = [np.cumsum(sizes[ids]) - sizes[ids] for ids, sizes in zip((a, b), self.sizes, strict=True)]
        marked = [at[spaced[ids]] for at, spaced, ids in zip(starts, self.spaced, (a, b), strict=True)]
        anchors = np.intersect1d(*marked, assume_unique=True)
        return np.searchsorted(starts[0], anchors), np.searchsorted(starts[1], anchors)

    def _windows(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[Window]:
        """The windows, taken from memory by their ids: those of ``a``, a bar, those of ``b``."""
        n = len(first_a)
        count_a, count_b = np.diff(np.r_[first_a, len(a)]), np.diff(np.r_[first_b, len(b)])
        of_a, of_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        keyed = np.full(len(a) + len(b) + n, _BAR, np.int32)
        keyed[np.arange(len(a)) + first_b[of_a] + of_a] = a
        keyed[np.arange(len(b)) + (first_a + count_a)[of_b] + of_b + 1] = b
        raw = keyed.tobytes()
        at = (4 * np.r_[first_a + first_b + np.arange(n), len(keyed)]).tolist()
        keys = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        found = list(map(self.new.get, keys))
        missing = {keys[i] for i, w in enumerate(found) if w is None}
        if missing:
            known = {k: w for k in missing if (w := self.old.get(k)) is not None}
            known |= self.solve([k for k in missing if k not in known])
            found = [known[k] if w is None else w for k, w in zip(keys, found, strict=True)]
            if len(self.new) + len(known) > MEMORY:
                self.new, self.old = {}, self.new
            self.new.update((k, w) for k, w in known.items() if len(k) <= 4 * LONGEST)
        return found

    def solve(self, keys: list[bytes]) -> dict[bytes, Window]:
        """The windows of some keys, all at once.  Laid one after the other, their tokens are ranges of the same bytes;
        where tokens of both end, a group ends; between two neighbouring ends of either, one pair overlaps."""
        if not keys:
            return {}
        keyed = np.frombuffer(b"".join(keys), np.int32)
        sizes = np.array([len(k) // 4 for k in keys])
        of = np.repeat(np.arange(len(keys)), sizes)
        bars = np.flatnonzero(keyed == _BAR)
        place = np.arange(len(keyed))
        in_a, in_b = place < bars[of], place > bars[of]
        a, b, of_a = keyed[in_a], keyed[in_b], of[in_a]
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        each = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, each), np.searchsorted(ends_b, each)
        links = (a[at_a].astype(np.int64) << 32 | b[at_b]).tobytes()
        link_ends = (8 * np.cumsum(np.bincount(of_a[at_a], minlength=len(keys)))).tolist()
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        closes_a, closes_b = both[group_a] == ends_a, both[group_b] == ends_b
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        shown = np.concatenate([a + closes_a * n_a, 2 * n_a + b + closes_b * n_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = shown[order]
        text = b"".join([self.shown[i] for i in shown.tolist()])
        done = np.cumsum(self.shown_sizes[shown])
        text_ends = done[np.cumsum(sizes - 1) - 1].tolist()  # a window's tokens are its ids without the bar
        out, begin, first = {}, 0, 0
        for key, end, last in zip(keys, text_ends, link_ends, strict=True):
            out[key] = text[begin : end - 1], links[first:last]
            begin, first = end, last
        return out


@lru_cache(maxsize=1)
def worker_aligner() -> Aligner:
    """One aligner for a Python worker, so that its memory of windows serves task after task."""
    return Aligner()


def _aligned(rows) -> Iterator[list[tuple[int | None, int, Alignment | None]]]:
    """Ids, lengths and alignments of rows of (id, text), in the lists that are encoded at once."""
    held, size, aligner, most = [], 0, worker_aligner(), min(BATCH_BYTES, BLOCK_BYTES)

    def flush():
        found = aligner.align([t for _, t in held])
        return [(key, len(text), f) for (key, text), f in zip(held, found, strict=True)]

    for row in rows:
        held.append(row)
        size += len(row[1]) + 64
        if size >= most:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, both lists of ids, and for each group the ends of its tokens in them; no shuffle."""

    def run(rows):
        for doc_id, _, found in chain.from_iterable(_aligned(rows)):
            if found is None:
                yield doc_id, [], [], []
            else:
                yield doc_id, found.a, found.b, [{"a_end": i, "b_end": j} for i, j in found.ends()]

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int>>"
    return map_rows(texts(df, id_col, text_col), run, schema)


#: A row is a document, with the places of its pairs in its block and how many times it holds each, or a pair of the
#: block, at its place, with the number of the block's ``docs`` that hold it.  None is longer than a document.
_BLOCK = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places array<int>, times array<int>, place int, pair long, docs long"
)


class Places:
    """The distinct pairs of a block, numbered as they come, and how many of its documents hold each."""

    def __init__(self):
        #: Sorted, and the place of each.
        self.pairs, self.places = np.empty(0, np.int64), np.empty(0, np.int32)
        #: By place.
        self.docs = np.empty(0, np.int64)

    def take(self, held: np.ndarray) -> np.ndarray:
        """The places of pairs that are given once for each document that holds them."""
        distinct, which = np.unique(held, return_inverse=True)
        new = np.setdiff1d(distinct, self.pairs, assume_unique=True)
        n, at = len(self.pairs), np.searchsorted(self.pairs, new)
        self.places = np.insert(self.places, at, np.arange(n, n + len(new), dtype=np.int32))
        self.pairs = np.insert(self.pairs, at, new)
        places = self.places[np.searchsorted(self.pairs, distinct)][which]
        self.docs = np.bincount(places, minlength=len(self.pairs)) + np.r_[self.docs, np.zeros(len(new), np.int64)]
        return places

    def by_place(self) -> np.ndarray:
        return self.pairs[np.argsort(self.places)]


def _told(found: Alignment | None) -> tuple[int, int, int, int, str]:
    """Counts of ids, groups and links, and the groups' digest."""
    if found is None:
        return 0, 0, 0, 0, ""
    told, links = found.groups(), found.links()
    return len(found.a), len(found.b), told.count(b";") + 1, len(links), hashlib.sha256(told).hexdigest()


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``_BLOCK``.  Documents go back to Spark as they are aligned; a worker keeps its block's pairs only."""
    ddl = T._parse_datatype_string(_BLOCK)
    schema = to_arrow_schema(ddl)

    def batch(n: int, **columns) -> pa.RecordBatch:
        def column(f: pa.Field) -> pa.Array:
            c = columns.get(f.name)
            return pa.nulls(n, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type)

        return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)

    def documents(block: int, rows: list, known: Places) -> pa.RecordBatch:
        ids, _, found = zip(*rows, strict=True)
        none = np.empty(0, np.int64)
        held = [np.unique(f.links() if f else none, return_counts=True) for f in found]
        places = known.take(np.concatenate([pairs for pairs, _ in held]))
        times = np.concatenate([t for _, t in held]).astype(np.int32)
        ends = np.cumsum([0, *(len(pairs) for pairs, _ in held)], dtype=np.int32)
        names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        told = dict(zip(names, zip(*map(_told, found), strict=True), strict=True))
        lists = {
            k: pa.ListArray.from_arrays(ends, v, type=schema.field(k).type)
            for k, v in (("places", places), ("times", times))
        }
        return batch(len(ids), block=np.full(len(ids), block), doc_id=ids, **told, **lists)

    def pairs(block: int, known: Places) -> Iterator[pa.RecordBatch]:
        found = known.by_place()
        for begin in range(0, len(found), PAIR_ROWS):
            end = min(begin + PAIR_ROWS, len(found))
            yield batch(
                end - begin,
                block=np.full(end - begin, block),
                place=np.arange(begin, end),
                pair=found[begin:end],
                docs=known.docs[begin:end],
            )

    def run(parts):
        block, size, known = TaskContext.get().partitionId() << 32, 0, Places()
        for rows in _aligned(rows_of(parts)):
            yield documents(block, rows, known)
            size += sum(length + 64 for _, length, _ in rows)
            if size >= BLOCK_BYTES:
                yield from pairs(block, known)
                block, size, known = block + 1, 0, Places()
        yield from pairs(block, known)

    return map_batches(texts(df, id_col, text_col), run, ddl)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it) and ``best``: no pair of its first id stands in more."""
    held = found.where("pair is not null")
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


_SCORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def score(found: DataFrame) -> DataFrame:
    """The documents of ``blocks``' rows, each with the sums over its links.  A block's pairs, in the order of their
    places, stream past before its documents."""
    counts = written(pair_counts(found), "align-pairs")
    told = found.where("pair is not null").select("block", "place", "pair").join(counts, "pair").drop("pair")
    docs = found.where("pair is null").drop("place", "pair", "docs")
    # not null lists: Arrow's writer goes over all that have piled up, for each row anew
    none = F.array().cast("array<int>")
    told = told.withColumns({"places": none, "times": none})
    both = docs.unionByName(told, allowMissingColumns=True).repartition("block")

    def run(parts):
        block, worth = None, []
        for part in parts:
            of = part.column("block").to_numpy()
            is_pair = part.column("place").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (is_pair[1:] != is_pair[:-1])) + 1
            for begin, end in pairwise([0, *cuts.tolist(), len(of)]):
                if begin == end:
                    continue
                if of[begin] != block:
                    block, worth = of[begin], [np.empty((2, 0), np.int64)]
                here = part.slice(begin, end - begin)
                if is_pair[begin]:
                    worth.append(np.stack([here.column("best").cast(pa.int64()), here.column("n")]))
                else:
                    worth = [np.concatenate(worth, axis=1)]
                    yield _scored(here, worth[0])

    ordered = both.sortWithinPartitions("block", F.asc_nulls_last("place"))
    return map_batches(ordered, run, T._parse_datatype_string(_SCORED))


def _scored(docs: pa.RecordBatch, worth: np.ndarray) -> pa.RecordBatch:
    """``worth``: for each place, whether the pair is the best of its first id, and its count."""
    places, times = (docs.column(c).flatten().to_numpy() for c in ("places", "times"))
    ends = docs.column("places").offsets.to_numpy()
    ends = ends - ends[0]
    sums = {}
    for name, of_pair in zip(("n_best", "count_sum"), worth, strict=True):
        total = np.r_[0, np.cumsum(times * of_pair[places])]
        sums[name] = pa.array(total[ends[1:]] - total[ends[:-1]])
    names = [c.split()[0] for c in _SCORED.split(", ")]
    return pa.RecordBatch.from_arrays([sums[c] if c in sums else docs.column(c) for c in names], names=names)


def query(spark, sf_dir) -> DataFrame:
    return score(written(blocks(table(spark, sf_dir, "documents")), "align-blocks"))
