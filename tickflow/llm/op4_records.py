"""Token ids in length-delimited binary records, with a separate offset index.

A record is the length of its data (unsigned 64-bit), the masked CRC-32C of those eight bytes, the
data and the data's masked CRC-32C (unsigned 32-bit each), all little-endian.  The data are the document's id (signed 64-bit), a byte with the
width of its token ids, two or four bytes by the largest of them, and the ids (unsigned).  Files are written in ascending doc_id order, one for each range of ids; the
index is a Parquet table with file, offset, length and token counts of every record, so that a
reader can fetch records in any order.  The index has fewer files than the data: one for about eight of them.  Reading
verifies lengths and checksums and raises on damage.

A task writes its file under a name of its own and the index names only files of tasks that
succeeded: a retried task leaves an unused file and no wrong record.

Defined cases: null and empty texts hold the end id alone; null ids come last and are stored as the
smallest integer; rows that repeat an id are ordered by their text's hash; an empty table gives an
empty index.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tickflow.llm.common import map_rows, shuffle_parts, table, texts
from tickflow.plans.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
MEMORY = 400_000
#: Characters of them: entries alone are no bound, for in a script without blanks a word is a line.
MEMORY_CHARACTERS = 4_000_000
#: Marks that end a word's last letter; not the apostrophe, which may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
NULL_ID = -(2**63)
#: Fixed values of the format: the Castagnoli polynomial (reflected) and the mask's constant.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_BLOCK = 64


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


# --- checksums ----------------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache(maxsize=1)
def _block_tables() -> np.ndarray:
    """[d][b]: what byte b adds to the register when d more bytes follow it."""
    out = np.empty((_BLOCK, 256), np.uint32)
    out[0] = t = _byte_table()
    for d in range(1, _BLOCK):
        out[d] = t[out[d - 1] & 0xFF] ^ (out[d - 1] >> 8)
    return out


@lru_cache(maxsize=64)
def _shift_tables(power: int) -> np.ndarray:
    """[i][b]: byte i of the register moved on by ``_BLOCK * 2**power`` zero bytes."""
    if power:
        half = _shift_tables(power - 1)
        return np.stack([_shift(half[i], half) for i in range(4)])
    out, t = np.empty((4, 256), np.uint32), _byte_table()
    for i in range(4):
        r = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        for _ in range(_BLOCK):
            r = t[r & 0xFF] ^ (r >> 8)
        out[i] = r
    return out


def _shift(r: np.ndarray, tables: np.ndarray) -> np.ndarray:
    a, b, c, d = tables
    return a[r & 0xFF] ^ b[(r >> 8) & 0xFF] ^ c[(r >> 16) & 0xFF] ^ d[r >> 24]


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of messages of at least four bytes each, all at once.

    Each message is padded in front to whole blocks (leading zeros leave a register of zero as it is; the initial
    register of ones equals inverting the first four bytes).  Blocks are summed column by column
    and moved to the message's end by powers of two."""
    lengths = np.array([len(m) for m in messages], np.int64)
    blocks = -(-lengths // _BLOCK)
    ends = np.cumsum(blocks) * _BLOCK
    flat = np.zeros(int(ends[-1]), np.uint8)
    for m, end in zip(messages, ends.tolist(), strict=True):
        flat[end - len(m) : end] = np.frombuffer(m, np.uint8)
    first = ends - lengths
    for j in range(4):
        flat[first + j] ^= 0xFF
    rows, tables = flat.reshape(-1, _BLOCK), _block_tables()
    r = np.zeros(len(rows), np.uint32)
    for j in range(_BLOCK):
        r ^= tables[_BLOCK - 1 - j][rows[:, j]]
    starts = np.cumsum(blocks) - blocks
    left = np.repeat(starts + blocks, blocks) - np.arange(len(rows)) - 1
    for power in range(int(left.max()).bit_length()):
        on = np.flatnonzero((left >> power) & 1)
        r[on] = _shift(r[on], _shift_tables(power))
    return np.bitwise_xor.reduceat(r, starts) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


# --- encoding -----------------------------------------------------------------------------------
#: A character above Latin-1 and the first block of more Latin letters, within which lower case stays; the dotted capital
#: I, whose lower case has a combining dot, is one too.
_OTHER = re.compile("[\u0130\u0180-\U0010ffff]")


def _latin_pieces() -> re.Pattern:
    """The tokenizer's pattern, for texts in lower case without a character of ``_OTHER``."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x180)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letter, number, space = kinds["L"], kinds["N"], "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


class Encoder:
    """The tokenizers library over distinct words, with the ids of a plain call over the whole text.

    A text in Latin script is its own normal form once in lower case; it is cut into the tokenizer's pieces.  Others
    are cut into words between blanks and line ends, which the tokenizer drops and no token spans, and these between the
    word and the marks after it, if the word's normal form ends in a letter (a dotted capital I's ends in a
    combining dot, which stands in one piece with the marks).  A text that may hold a special token's string is
    encoded whole.

    Remembers pieces and words in two generations of ``MEMORY`` or ``MEMORY_CHARACTERS`` together."""

    def __init__(self, path: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        #: The file's model behind nothing but the blanks between pieces that are cut and normal already.
        self.cut = Tokenizer(t.model)
        self.cut.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        added = t.get_added_tokens_decoder().values()
        #: What every special token's string begins with.
        self.special = os.path.commonprefix([a.content for a in added]) or "\0"
        self.find = _latin_pieces().findall
        suffix = t.model.end_of_word_suffix
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.ends_piece = np.array([n.endswith(suffix) for n in names])
        self.held: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.ends_in_letter: dict[str, bool] = {}
        #: Characters that the present generation has learned.
        self.learned = 0

    def _learn_pieces(self, pieces: set[str]) -> None:
        """Remembers pieces: all new ones are one text, in which every piece ends with a token that ends a word."""
        old = self.old[1]
        known = {p: ids for p in pieces if (ids := old.get(p)) is not None}
        self.parts.update(known)
        new = [p for p in pieces if p not in known]
        if not new:
            return
        ids = np.array(self.cut.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = [0, *(4 * (np.flatnonzero(self.ends_piece[ids]) + 1)).tolist()]
        flat = ids.tobytes()
        self.parts.update(zip(new, [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)], strict=True))

    def _encode(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        ids = [e.ids for e in found]
        flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids))).tobytes()
        ends = [4 * n for n in accumulate(map(len, ids))]
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _parts_at(self, letter: str) -> bool:
        """Whether marks after this letter are a piece of their own."""
        if letter not in self.ends_in_letter:
            normal = self.tokenizer.normalizer.normalize_str(letter) if self.tokenizer.normalizer else letter
            self.ends_in_letter[letter] = letter.isalpha() and normal[-1:].isalpha()
        return self.ends_in_letter[letter]

    def _learn(self, words: set[str]) -> None:
        """Remembers words, all new parts of which are encoded together."""
        split, whole = [], []
        for w in words:
            core = w.rstrip(MARKS)
            if core and self._parts_at(core[-1]):
                split.append((w, core.lower() if core.isascii() else core, w[len(core) :]))
            else:
                whole.append(w)
        parts, old = self.parts, self.old[1]
        asked = set(whole)
        asked.update([c for _, c, _ in split], [t for _, _, t in split])
        asked.difference_update(parts)
        known = {p: ids for p in asked if (ids := old.get(p)) is not None}
        parts.update(known)
        new = [p for p in asked if p not in known]
        parts.update(zip(new, self._encode(new), strict=True))
        self.held.update([(w, parts[w]) for w in whole])
        self.held.update([(w, parts[c] + parts[t]) for w, c, t in split])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.held) + len(self.parts) > MEMORY // 2 or self.learned > MEMORY_CHARACTERS // 2:
            self.old = self.held, self.parts
            self.held, self.parts = {"": b""}, {"": b""}
            self.learned = 0
        pieces, words, whole = {}, {}, {}
        for i, text in enumerate(texts):
            if self.special in text:
                whole[i] = text
            elif _OTHER.search(text):
                words[i] = text.replace("\n", " ").split(" ")
            else:
                pieces[i] = self.find(text.lower())
        have = self.parts.get
        missing = {p for c in pieces.values() for p, ids in zip(c, map(have, c), strict=True) if ids is None}
        self._learn_pieces(missing)
        new = set().union(*words.values()).difference(self.held)
        known = {w: ids for w in new if (ids := self.old[0].get(w)) is not None}
        self.held.update(known)
        self._learn(new.difference(known))
        self.learned += sum(map(len, missing)) + sum(map(len, new))
        out = dict(zip(whole, self._encode(list(whole.values())), strict=True))
        for cuts, ids in ((pieces, self.parts), (words, self.held)):
            out.update((i, b"".join(map(ids.__getitem__, c))) for i, c in cuts.items())
        return [out[i] for i in range(len(texts))]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for a Python worker, so that its memory of words serves task after task."""
    return Encoder(path)


# --- writing and reading ------------------------------------------------------------------------
_INDEX = "doc_id long, part int, file string, offset long, length long, start_in_file long, n_tokens long"
_GROUP = 4 << 20
#: Files of records to a file of the index.
_INDEXED = 8
#: Characters of text whose new words are encoded together.
_TOGETHER = 1 << 20


_HEAD, _HEAD_BYTES = "<qB", 9


def pack(key: int, ids: bytes) -> bytes:
    """A record's data from an id and token ids of 32 bits."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        return struct.pack(_HEAD, key, 4) + ids
    return struct.pack(_HEAD, key, 2) + wide.astype("<u2").tobytes()


def unpack(data: bytes) -> tuple[int, bytes]:
    """The inverse of ``pack``."""
    key, width = struct.unpack_from(_HEAD, data)
    return key, np.frombuffer(data, f"<u{width}", offset=_HEAD_BYTES).astype("<u4").tobytes()


def _frames(data: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(d)) for d in data]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(data))
    return [
        n + struct.pack("<I", h) + d + struct.pack("<I", b)
        for n, h, d, b in zip(lengths, heads.tolist(), data, bodies.tolist(), strict=True)
    ]


def write_records(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str = TOKENIZER,
    end_id: int = END_ID,
) -> DataFrame:
    """Writes ``folder/data`` and ``folder/index``; returns the index."""
    docs = texts(df, id_col, text_col)
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    n = shuffle_parts(df.sparkSession)
    dealt = docs.repartitionByRange(n, *order)
    dealt = dealt.sortWithinPartitions(*order)
    end = struct.pack("<I", end_id)

    def groups(rows) -> Iterator[list[tuple[int | None, bytes]]]:
        encoder, held, size = worker_encoder(tokenizer_path), [], 0

        def packed():
            ids = encoder.encode([text for _, text in held])
            return [(i, pack(NULL_ID if i is None else i, x + end)) for (i, _), x in zip(held, ids, strict=True)]

        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= _TOGETHER:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    def run(rows):
        part = TaskContext.get().partitionId()
        name = f"data/{part:06d}-{uuid.uuid4().hex}.records"
        system, root = open_folder(folder)
        out, offset, start = None, 0, 0
        for group in groups(rows):
            if out is None:
                system.create_dir(f"{root}/data", recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
            data = [d for _, d in group]
            for (doc_id, d), frame in zip(group, _frames(data), strict=True):
                out.write(frame)
                n = (len(d) - _HEAD_BYTES) // d[8]
                yield doc_id, part, name, offset, len(frame), start, n
                offset, start = offset + len(frame), start + n
        if out is not None:
            out.close()

    # by file, in its order: a reader opens each once; a task that is run again writes a file of another name, but deals
    # its rows out as before.  Never fewer files than keep the session's cores busy reading; coalesce holds their number
    # where a session raises that of the dealing.
    files = max(min(n, 2 * df.sparkSession.sparkContext.defaultParallelism), -(-n // _INDEXED))
    index = map_rows(dealt, run, _INDEX).repartition(files, "part").sortWithinPartitions("part", "offset")
    index.coalesce(files).write.parquet(f"{folder}/index")
    return read_index(df.sparkSession, folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


class Damaged(ValueError):
    """A record whose length, checksum or id isn't what the index or the frame says."""


def unframe(frames: list[bytes]) -> list[bytes]:
    for f in frames:
        if len(f) < 16 or struct.unpack_from("<Q", f)[0] != len(f) - 16:
            raise Damaged("length")
    data = [f[12:-4] for f in frames]
    heads = [struct.unpack_from("<I", f, 8)[0] for f in frames]
    bodies = [struct.unpack_from("<I", f, len(f) - 4)[0] for f in frames]
    if masked(crc32c([f[:8] for f in frames])).tolist() != heads:
        raise Damaged("checksum of a length")
    if masked(crc32c(data)).tolist() != bodies:
        raise Damaged("checksum of a record")
    return data


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``part``, ``start_in_file`` and ``ids`` (32-bit integers, little-endian binary) of
    the index rows given, in any order, fetched by offset and verified."""

    def groups(rows):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += row[4]
            if size >= _GROUP:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(rows):
        system, root = open_folder(folder)
        name, f = None, None
        for group in groups(rows):
            frames = []
            for _, _, file, offset, length, *_ in group:
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, system.open_input_file(f"{root}/{file}")
                frames.append(f.read_at(length, offset))
            for (doc_id, part, _, _, _, start, n), d in zip(group, unframe(frames), strict=True):
                key, ids = unpack(d)
                if key != (NULL_ID if doc_id is None else doc_id) or len(ids) != 4 * n:
                    raise Damaged("the index names another record")
                yield doc_id, part, start, ids
        if f is not None:
            f.close()

    return map_rows(index, run, "doc_id long, part int, start_in_file long, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """``part`` and the ids in all files before it; one row for each file."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def query(spark, sf_dir) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    index = write_records(table(spark, sf_dir, "documents"), folder)

    found = read_records(index, folder).select(
        "doc_id",
        "part",
        "start_in_file",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return found.join(starts(index), "part").select(
        "doc_id",
        (F.col("before") + F.col("start_in_file")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
