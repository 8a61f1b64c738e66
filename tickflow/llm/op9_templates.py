"""Line dedup by a log-template tree: recurring templates across documents are dropped.

A tree of fixed depth sends a line to a leaf by its number of tokens and its ``LEADING`` first tokens;
tokens with a digit count as the variable ``<*>`` from the start.  In a leaf a token stays constant at its
place if it stands there in at least ``min_docs`` documents, and becomes ``<*>`` otherwise: fields
that vary from line to line are generalised, whatever their order of arrival, and no leaf has
to be held in one place.  A line of which less than ``SHARE`` is constant is its own template.

In a large table the values of a field reach ``min_docs`` too.  So a line has coarser moulds
besides: its rarest constant tokens become variable one count after the other, as long as ``SHARE`` of
the line stays constant.  A mould depends on the order of the counts, not on their size, so a table
that grows has the templates it had.  Of the moulds that recur in ``min_docs`` documents the finest
is the line's template, and gives way to a coarser one, with a constant behind the leading tokens, of
whose documents it has less than ``SHARE``: the token that tells them apart is a field's value
there.  Recurring templates are dropped; the document with the smallest id keeps its lines, so
nothing leaves the corpus altogether.

With ``few_docs`` a template recurs in that many documents already, if the letters of its constants, counted
once for each document, are ``FEW_LETTERS`` for each of ``min_docs``: the fewer the documents, the
longer the line has to be, which spares clean text.

Documents with exactly equal texts count once, as copies of one document don't make a template.

Only leaves with ``min_docs`` documents are looked into: first leaves are counted (eight bytes a
line), then the lines of the frequent ones are fetched: a bitmap of fixed size keeps most others
out of the shuffle, a join all of them.  Places are counted over distinct lines, which travel as digests.

In scripts without blanks between words every letter is a token.

Defined cases: null and empty texts have no lines; lines under ``MIN_TOKENS`` tokens, and in scripts without
blanks under ``MIN_LETTERS`` letters, are never templates; a null id ranks after all others; rows that repeat an id are one document for keeping,
and one for counting if their texts are equal; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import (
    UNSPACED,
    fresh,
    letters,
    map_rows,
    origin,
    origin_of,
    same_row,
    table,
    texts,
    written,
)

LEADING = 2
MIN_DOCS = 20
#: Long templates are dropped from so many documents up: those of ``MIN_DOCS * FEW_LETTERS`` letters in all.
FEW_DOCS = 5
FEW_LETTERS = 8
MIN_TOKENS = 3
#: Of a line in a script without blanks, in which a letter is a token and counts as two letters.
MIN_LETTERS = 12
SHARE = 0.5
VARIABLE = "<*>"
#: Bits of the map of frequent leaves; bounds what is broadcast (2 MB).
SLOTS = 1 << 24
#: Lines of which a task remembers that it gave their text; a text given again is combined before the shuffle.
REMEMBERED = 200_000
_DIGIT = re.compile(r"\d")


def masked_lines(text: str):
    """(number, masked line, leaf) of each line; the leaf is a signed 64-bit digest."""
    for number, line in enumerate(text.split("\n")):
        tokens = line.split()
        if not line.isascii() and UNSPACED.search(line):
            tokens = UNSPACED.sub(r" \g<0> ", line).split()
            if len(tokens) < MIN_TOKENS or letters(line) < MIN_LETTERS:
                continue
        if len(tokens) >= MIN_TOKENS:
            if _DIGIT.search(line):
                tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
            key = f"{len(tokens)} {' '.join(tokens[:LEADING])}"
            yield number, tokens, _digest(key)


def recurring(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    few_docs: int | None = None,
) -> DataFrame:
    """One row for each line that is dropped: ``doc_id``, ``line`` (number from 0), ``template``,
    ``docs`` (distinct documents that hold the template), ``origin`` (digest of the document's text)."""
    docs = texts(df, id_col, text_col)
    least = min(min_docs, few_docs or min_docs)

    def recur(n: str):
        few = F.col(n) * F.col("letters") >= min_docs * FEW_LETTERS
        return (F.col(n) >= min_docs) | ((F.col(n) >= least) & few)

    def leaves(rows):
        for _, t in rows:
            longest: dict[int, int] = {}
            for _, tokens, leaf in masked_lines(t):
                longest[leaf] = max(longest.get(leaf, 0), _most_letters(tokens))
            yield from longest.items()

    # no template of a leaf has more documents than the leaf, or more letters than its longest line
    counted = map_rows(docs, leaves, "leaf long, letters int").groupBy("leaf")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.max("letters").alias("letters"))
    frequent = written(counted.where(recur("n")).select("leaf"), "leaves")
    marks = df.sparkSession.sparkContext.broadcast(_marks(frequent))

    def likely(rows):
        marked = marks.value
        for doc_id, t in rows:
            for number, tokens, leaf in masked_lines(t):
                if marked[(leaf & (SLOTS - 1)) >> 3] >> (leaf & 7) & 1:
                    text = " ".join(tokens)
                    yield doc_id, t, number, leaf, _digest(text), text

    def occurrences(rows):
        last = mark = None
        for doc_id, t, number, leaf, form, _ in likely(rows):
            if t is not last:
                last, mark = t, origin(t)
            yield doc_id, mark, number, leaf, form

    def forms(rows):
        seen: set[tuple[int, int]] = set()
        for *_, leaf, form, text in likely(rows):
            if (leaf, form) not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((leaf, form))
                yield leaf, form, text

    # a distinct line is known by its leaf and its digest; occurrences move as digests, and a line's text once
    schema = "doc_id long, origin long, line int, leaf long, form long"
    lines = written(map_rows(docs, occurrences, schema).join(frequent, "leaf"), "lines")
    keys = ["leaf", "form"]
    origins = lines.select(*keys, "origin").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    distinct = map_rows(docs, forms, "leaf long, form long, text string").groupBy(*keys).agg(F.first("text").alias("text"))
    distinct = written(distinct.join(origins, keys), "distinct-lines")
    tokens = distinct.select(*keys, "n", F.posexplode(F.split("text", " ")).alias("place", "token"))
    cells = tokens.select(*keys, "n", "place", F.xxhash64("leaf", "place", "token").alias("cell"))
    constant = cells.groupBy("cell").agg(F.sum("n").alias("docs")).where(F.col("docs") >= least)
    held = cells.select(*keys, "place", "cell").join(constant, "cell")
    held = held.groupBy(*keys).agg(F.collect_list(F.struct("place", "docs")).alias("held"))  # of one line

    def generalise(rows):
        for leaf, form, n, text, held in rows:
            counts = {x["place"]: x["docs"] for x in held or ()}
            for step, (template, tail) in enumerate(moulds(text.split(" "), counts)):
                key = f"{leaf} {template}" if not step else f"{leaf}  {template}"
                yield leaf, form, n, step, _digest(key), letters(template), template, tail

    schema = "leaf long, form long, n long, step int, mould long, letters int, template string, tail boolean"
    steps = distinct.join(held, keys, "left").select(*keys, "n", "text", "held")
    steps = written(map_rows(steps, generalise, schema), "moulds")
    # lines with copies in one document count more than once here, so this only spares the join lines
    able = steps.groupBy("mould", "letters").agg(F.sum("n").alias("most")).where(recur("most"))
    steps = written(steps.drop("n").join(able.select("mould"), "mould"), "likely-moulds")
    last = 2**63 - 1
    placed = lines.select("doc_id", "origin", *keys).join(steps.select(*keys, "mould"), keys)
    known = (
        placed.groupBy("mould", "origin")
        .agg(F.min(F.coalesce("doc_id", F.lit(last))).alias("least"))
        .groupBy("mould")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("least").alias("first"))
        .where(F.col("docs") >= least)
    )
    known = written(known, "recurring")
    found = steps.join(known, "mould").where(recur("docs")).groupBy(*keys)
    found = found.agg(F.sort_array(F.collect_list(F.struct("step", "docs", "first", "tail", "template"))).alias("found"))

    def choose(rows):
        for leaf, form, found in rows:
            best = found[0]
            for x in found[1:]:
                if x["tail"] and best["docs"] < SHARE * x["docs"]:
                    best = x
            yield leaf, form, best["docs"], best["first"], best["template"]

    schema = "leaf long, form long, docs long, first long, template string"
    chosen = written(map_rows(found, choose, schema), "templates")
    return (
        lines.join(chosen, keys)
        .where(F.coalesce("doc_id", F.lit(last)) != F.col("first"))
        .select("doc_id", "line", "template", "docs", "origin")
    )


def moulds(tokens: list[str], counts: dict[int, int]):
    """(template, whether a token behind the leading ones is constant) of a line, from the finest mould to
    the coarsest; ``counts`` has the documents of the tokens that are constant in the finest.  The
    first is its own, for all lines with the same tokens in ``counts``; each of the others is for all lines
    that have its constant tokens and else only rarer ones."""

    def mould(least):
        held = [counts.get(i, 0) >= least for i in range(len(tokens))]
        text = " ".join(t if h else VARIABLE for t, h in zip(tokens, held, strict=True))
        return text, any(held[LEADING:])

    if len(counts) < SHARE * len(tokens):
        yield " ".join(tokens), False
        return
    yield mould(1)
    ranked = sorted(counts.values(), reverse=True)
    for least in sorted(set(ranked)):
        held = sum(n >= least for n in ranked)
        if held < SHARE * len(tokens):
            return
        if held < len(tokens):
            yield mould(least)


def _most_letters(tokens: list[str]) -> int:
    """No less than the letters of any template of the tokens."""
    text = "".join(tokens)
    return len(text) if text.isascii() or not UNSPACED.search(text) else 2 * len(text)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _marks(leaves: DataFrame) -> bytes:
    """A bitmap of ``SLOTS`` bits, in which the slots of the leaves are set: a fixed size at any scale.  A
    line whose slot isn't set is in none of the leaves; the join with the leaves sorts out the rest."""
    slot = F.col("leaf").bitwiseAND(F.lit(SLOTS - 1))
    byte, bit = F.shiftright(slot, 3).cast("int"), slot.bitwiseAND(F.lit(7)).cast("int")
    slots = leaves.select(byte.alias("byte"), bit.alias("bit"))
    set_ = slots.groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits"))
    found, out = set_.toArrow(), np.zeros(SLOTS // 8, np.uint8)  # a row a byte at most
    out[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def drop_lines(
    df: DataFrame,
    dropped: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: float = 1.0,
    empty: bool = True,
) -> DataFrame:
    """``df`` with the lines of ``dropped`` cut from its texts; other columns stay as they are.  A
    document of whose words more than ``most`` stand in such lines is a copy rather than a page with
    boilerplate, and stays whole; without ``empty``, so does one of which nothing would be left."""
    id_, mark, lines = fresh(df, "id_"), fresh(df, "origin_"), fresh(df, "lines_")
    if "origin" not in dropped.columns:  # told by ids alone
        own = df.select(df[id_col].cast("long").alias(id_), origin_of(df[text_col]).alias("origin")).distinct()
        dropped = dropped.join(own, dropped["doc_id"].eqNullSafe(F.col(id_)))
    numbers = dropped.groupBy("doc_id", "origin").agg(F.collect_set("line")).toDF(id_, mark, lines)
    both = df.join(numbers, same_row(df, id_col, text_col, id_, mark), "left")
    cut = F.array_join(
        F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n"
    )
    whole = F.col(lines).isNull()
    if most < 1:

        def size(c):
            return F.size(F.split(F.trim(c), r"\s+"))

        whole |= (size(cut) < (1 - most) * size(F.col(text_col))) | (F.trim(cut) == "")
    if not empty:
        whole |= ~cut.rlike(r"\S")
    kept = F.when(whole, F.col(text_col)).otherwise(cut)
    return both.select(*[kept.alias(c) if c == text_col else F.col(c) for c in df.columns])


def query(spark, sf_dir) -> DataFrame:
    return recurring(table(spark, sf_dir, "documents"), few_docs=FEW_DOCS)
