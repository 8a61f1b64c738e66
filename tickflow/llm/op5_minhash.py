"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: ``T`` coordinates, filled in rounds.  In round i < T every shingle is hashed to one
coordinate and a value i + u, u in [0, 1); the coordinate keeps its least value.  Coordinates still
empty after T rounds are filled in rounds T to 2T - 1, where round T + j sends all shingles to
coordinate j.  So every coordinate fills, equal coordinates estimate the Jaccard similarity without bias and
the estimate concentrates as if the coordinates were independent.

Bands: ``BANDS`` of ``ROWS`` coordinates.  Sets with Jaccard 0.8 share none of 40 bands of 5 with
probability (1 - 0.8**5)**40 = 1e-7.

Work is done on classes of equal shingle sets, so exact copies cost one row each and no pairs.  Pairs of
classes are verified on their full sets, in two steps, so that no group of copies is expanded into
all its pairs.

1. Stars: every class is held against one class of each bucket it is in, the one whose buckets are
   fullest, which is the likely original of a group of edited copies.  Links give components.
2. Buckets where classes of different components meet may still hide a link.  The classes
   in them are joined on the rarest shingles of their sets: in any order of all shingles, two sets with enough overlap
   share a shingle among the first of each, at places that leave room for the overlap (prefix and
   position filter, both exact).  Rarest first, edits that are a class's own fill its prefix
   and find no partner.  Links inside a component change nothing and aren't looked for.

So no link between classes that share a band is lost.

Counts by bucket, class or shingle are written before they are joined back: a small table is then broadcast, and
where it isn't, both sides of the join are plain shuffles, of which AQE can split a key that holds many rows (an
aggregate that feeds the join directly would bind all rows of a key to one task).  Tables that no later step reads are removed.

Defined cases: null and empty texts, and texts without words, have the empty set and link with
nothing; rows that repeat an id and a text are in one class; a null id is a document whose
component is that of its class (null if alone) and which is never kept in favour of another; rows that
repeat an id with other texts are of the classes of their texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import discard, map_rows, mix, origin, shingles, table, texts, written
from tickflow.llm.components import components

BANDS, ROWS = 40, 5
T = BANDS * ROWS
#: Documents whose sketches are filled together.
_TOGETHER = 256
#: Members of a star that are held against one copy of its centre.
STAR = 128
#: Counters of shingles; bounds what is broadcast (four bytes each).
SLOTS = 1 << 21
#: Bits of the map of rows whose texts are fetched; bounds what is broadcast (2 MB).
MARKS = 1 << 24


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of ``t`` 64-bit values for each non-empty set of 64-bit shingles."""
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    open_ = np.arange(len(sets))
    for i in range(2 * t):
        owner = np.repeat(open_, [len(sets[k]) for k in open_])
        x = np.concatenate([sets[k] for k in open_])
        h = mix(x + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # the round stands above the hashed fraction, so that an earlier round's value is less
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        at = (mix(h) % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, owner * t + at, value)
        full = (out[open_] != np.iinfo(np.uint64).max).all(axis=1)
        open_ = open_[~full]
        if not len(open_):
            break
    return out


def bands(sketch: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """A row of band keys for each sketch; a key holds the band's number and all its values."""
    parts = sketch.reshape(len(sketch), n_bands, -1)
    keys = mix(np.broadcast_to(np.arange(n_bands, dtype=np.uint64), parts.shape[:2]).copy())
    for j in range(parts.shape[2]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def _row(doc_id: int | None, text: str) -> bytes:
    """Digest of a row: equal for rows that repeat both id and text."""
    return xxhash.xxh3_128_digest(f"{doc_id} {text}".encode("utf-8", "surrogatepass"))


def _place(row: bytes) -> int:
    return int.from_bytes(row[:4], "little") & (MARKS - 1)


def _marks(rows: DataFrame) -> bytes:
    """A bitmap of ``MARKS`` bits, a fixed size at any scale, in which the places of the rows are set."""

    def places(found):
        bits = np.zeros(MARKS // 8, np.uint8)
        for (row,) in found:
            bits[_place(row) >> 3] |= 1 << (_place(row) & 7)
        full = np.flatnonzero(bits)
        return zip(full.tolist(), bits[full].tolist(), strict=True)

    marked = map_rows(rows, places, "byte int, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    found, out = marked.toArrow(), np.zeros(MARKS // 8, np.uint8)  # a row a byte at most
    out[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def class_texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the documents whose row digests ``wanted`` (``node``, ``row``) has.  Rows
    whose place in the bitmap isn't set stay out of the shuffle; the join sorts out the rest."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted.select("row")))

    def likely(rows):
        marked = marks.value
        for doc_id, text in rows:
            row = _row(doc_id, text)
            if marked[_place(row) >> 3] >> (_place(row) & 7) & 1:
                yield row, text

    found = map_rows(docs, likely, "row binary, text string").dropDuplicates(["row"])
    return found.join(wanted, "row").select("node", "text")


def _set_rows(n_words: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def flush(ids, held):
            full = [s for s in held if len(s)]
            keys = iter(bands(sketches(full)).tolist() if full else ())
            for (doc_id, mark, row), s in zip(ids, held, strict=True):
                if len(s):
                    yield doc_id, mark, row, len(s), xxhash.xxh3_128_digest(s.tobytes()), next(keys)
                else:
                    yield doc_id, mark, row, 0, None, None

        ids, held, size = [], [], 0
        for doc_id, text in rows:
            ids.append((doc_id, origin(text), _row(doc_id, text)))
            held.append(shingles(text, n_words))
            size += len(held[-1])
            if len(held) >= _TOGETHER or size >= 1 << 18:
                yield from flush(ids, held)
                ids, held, size = [], [], 0
        yield from flush(ids, held)

    return run


def _holds(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (small + large - shared)


def verified(pairs: DataFrame, class_texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of classes whose full sets are similar enough, as a written table.

    Each class is shipped beside its partner: pairs are grouped by ``a`` in groups of about ``STAR``, the text of
    ``a`` goes to each of its groups once and stands first there, and the others stream past it.  Only classes of
    more pairs than that are counted out and joined back."""
    full = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STAR)
    full = written(full, "full-classes")
    groups = F.coalesce((F.col("n") / STAR).cast("long"), F.lit(1))
    sized = pairs.join(full, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), groups).alias("salt"))
    sized = written(sized, "candidates")
    centres = sized.select("a", "salt").distinct().join(
        class_texts.withColumnRenamed("node", "a"), "a"
    ).select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    members = sized.join(class_texts.withColumnRenamed("node", "b"), "b").select(
        "a", "salt", "b", "text"
    )
    dealt = centres.union(members).repartition("a", "salt")
    dealt = dealt.sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(rows):
        centre = None
        for a, _, b, text in rows:
            s = shingles(text, n_words)
            if b is None:
                centre = s
            elif _holds(centre, s, percent):
                yield a, b

    links = written(map_rows(dealt, run, "a binary, b binary"), "links")
    discard(full, sized)
    return links


def _counts(class_texts: DataFrame, n_words: int) -> np.ndarray:
    """In how many sets the shingles of each of ``SLOTS`` slots are: an array of that size."""

    def run(rows):
        n = np.zeros(SLOTS, np.int64)
        for _, _, text in rows:
            np.add.at(n, _slots(shingles(text, n_words)), 1)
        full = np.flatnonzero(n)
        return zip(full.tolist(), n[full].tolist(), strict=True)

    counts = map_rows(class_texts, run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found, out = counts.toArrow(), np.zeros(SLOTS, np.uint32)  # a row a slot
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return out


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix_pairs(class_texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of classes with different labels that may be similar enough, as a written table: all that
    are, and few others.  ``class_texts`` has ``node``, ``label`` and ``text``.

    Shingles are ordered by how many sets they are in, as counted by slot: shingles that meet in a
    slot only make the order less sharp.  For each shingle its most frequent label stands on one side of
    the join only, so that a large component isn't paired with itself."""
    counts = class_texts.sparkSession.sparkContext.broadcast(_counts(class_texts, n_words))

    def run(rows):
        for node, label, text in rows:
            s = shingles(text, n_words)
            order = np.lexsort((s, counts.value[_slots(s)]))
            first = order[: len(s) - -(-percent * len(s) // 100) + 1]
            for place, x in enumerate(s[first].view(np.int64).tolist()):
                yield x, node, label, place, len(s)

    schema = "shingle long, node binary, label binary, place int, size int"
    prefixes = written(map_rows(class_texts.select("node", "label", "text"), run, schema), "prefixes")
    labels = prefixes.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", "label"))["label"].alias("top")
    met = labels.groupBy("shingle").agg(top, F.count(F.lit(1)).alias("labels")).where("labels > 1")
    met = written(met.drop("labels"), "met-shingles")
    rows = written(prefixes.join(met, "shingle"), "met-prefixes")
    x, y = rows.where("label <> top").alias("x"), rows.alias("y")
    room = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    enough = (100 + percent) * room >= percent * (F.col("x.size") + F.col("y.size"))
    once = (F.col("y.label") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
    differ = F.col("x.label") != F.col("y.label")
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & differ & once & enough)
    found = pairs.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    found = written(found, "cross-pairs")
    discard(prefixes, met, rows)
    return found


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    percent: int = 80,
    origins: bool = False,
) -> DataFrame:
    """Every document with ``n_shingles``, ``component_id`` (the least id that links reach) and
    ``kept`` (whether that is its own); ``origins`` adds the digest of its text (``origin``)."""
    docs = texts(df, id_col, text_col)
    schema = "doc_id long, origin long, row binary, n_shingles long, node binary, bands array<long>"
    sets = written(map_rows(docs, _set_rows(n_words), schema), "sketches")
    # the bands of a class are those of any of its documents, and any one's text will do
    classes = sets.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("bands").alias("bands")
    )
    classes = written(classes, "classes")
    keys = classes.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, "bucket-sizes")
    shared = written(keys.join(sizes, "key"), "buckets")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heaviest = F.max(F.struct("weight", "node"))["node"]
    centres = shared.join(weights, "node").groupBy("key").agg(heaviest.alias("a"))
    centres = written(centres, "centres")
    stars = shared.select("key", F.col("node").alias("b")).join(centres, "key")
    stars = written(stars.where("a <> b").select("a", "b").distinct(), "stars")

    # the text of one document for each class that shares a bucket
    wanted = classes.select("node", "row").join(shared.select("node").distinct(), "node")
    wanted = written(wanted, "wanted-classes")
    class_texts = written(class_texts_of(docs, wanted), "class-texts")
    links = verified(stars, class_texts, n_words, percent)
    discard(sizes, centres, stars, wanted)
    labels = components(links)

    # buckets where classes of different components meet
    labelled = shared.select("key", "node").join(labels, "node", "left")
    labelled = labelled.select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = written(mixed.where("x <> y").select("key"), "mixed-buckets")
    open_ = labelled.join(mixed, "key").select("node", "label").distinct()
    open_texts = written(open_.join(class_texts, "node"), "mixed-classes")
    cross = prefix_pairs(open_texts, n_words, percent)
    more = verified(cross, class_texts, n_words, percent)
    if not more.isEmpty():
        bound = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
        labels = components(bound.union(more))
    discard(shared, class_texts, links, mixed, open_texts, cross, more)

    of_class = classes.join(labels, "node", "left").select(
        "node", "least", F.coalesce("label", "node").alias("label")
    )
    of_label = written(of_class.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    found = of_class.join(of_label, "label").select("node", "component_id")
    out = sets.join(found, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
        *(["origin"] if origins else []),
    )


def query(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=4)


#: All pairs of documents that share a shingle, counted; components by recursion.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
  FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN m ON m.node = n.doc_id
"""
