"""How filters interact: which of them removes what, in every order.

Five filters judge whole texts. Four look at one text; the fifth drops exact
copies. Copies are found behind a counting Bloom prepass: every task sketches
its own texts, the sketches are merged segment by segment, and a text with a
counter below two is unique for certain. Only the rest shuffles, as full text,
for the smallest id. Every document then is a mask of five bits, and every
order of the filters is a sum over at most 32 mask counts of a part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.bytescan import small_batches, text_buffer
from crewlens.llm.common import materialize

FILTERS = "ABCDE"
COPIES = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]

#: counters a row gets in the sketch, and counters that one text touches
CELLS_PER_ROW, PROBES = 16, 3
#: counters of one segment (a segment's bitmap is an eighth of that in bytes)
SEGMENT_CELLS = 1 << 16
#: rows of flags that a task sketches before it sends what it has
SKETCH_ROWS = 1 << 20
#: bitmaps are broadcast up to this size; beyond it they are joined by segment
BROADCAST_BYTES = 256 << 20
#: copies of each bitmap in that join, so that one hot text spreads over tasks
SALTS = 16

_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that start no code point
_PLAIN = bytes(b for b in range(256) if chr(b) not in "#$%&*|")
_PIECE = 4 << 20


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time (a piece ends at white space)."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end].split()
        at = end


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a whole text (UTF-8) fails."""
    n, seen = 0, set()
    for words in _words(raw):
        n += len(words)
        seen.update(words)
    capitals = len(raw.translate(None, _NOT_UPPER))
    points = len(raw.translate(None, _FOLLOWING))
    fails = (n < 100, 100 * len(seen) < 80 * n, 100 * capitals > 10 * points, bool(raw.translate(None, _PLAIN)))
    return sum(1 << i for i, bad in enumerate(fails) if bad)


def _keyed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id``, ``part``, ``k`` (SHA-256 of the text) and ``text``, null texts empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("k"), text.alias("text"))


def _judged(keyed: DataFrame) -> DataFrame:
    """``id``, ``part``, ``k`` and ``mask`` of A to D, one row per document."""
    schema = T.StructType([*keyed.schema.fields[:3], T.StructField("mask", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in small_batches(whole, 3)):
            buf, offs = text_buffer(batch.column(3))
            edges = offs.tolist()
            masks = [text_mask(buf[a:z].tobytes()) for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks, pa.int32())], names=schema.fieldNames())

    return keyed.mapInArrow(judge, schema)


# -- the counting Bloom sketch -------------------------------------------------
# Counters saturate at two, so a sketch is two sets of cells: touched, and
# touched more than once. All cells of a text lie in one segment; the segment
# and the cells come from two mixes of its digest.


def _placed(rows: DataFrame, segments: int, digest: Callable[[Column], Column]) -> DataFrame:
    """``rows`` (with ``k``) plus ``segment`` and the text's cells in it, ``c0`` and on."""
    h = digest(F.col("k"))
    mixed = F.xxhash64(h, F.lit(2))
    cells = {f"c{i}": F.shiftrightunsigned(mixed, 16 * i).bitwiseAND(SEGMENT_CELLS - 1).cast("int") for i in range(PROBES)}
    return rows.withColumns({"segment": F.pmod(F.xxhash64(h, F.lit(1)), F.lit(segments)), **cells})


def sketch_rows(batches: Iterator[pa.RecordBatch], flush_rows: int = SKETCH_ROWS) -> Iterator[pa.RecordBatch]:
    """(segment, c0, c1, ...) rows to sparse sketches, one per segment: all touched cells, and those touched more often."""

    def send(kept: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(kept), return_counts=True)
        segment, low = cells // SEGMENT_CELLS, (cells % SEGMENT_CELLS).astype(np.uint16)
        cut = np.flatnonzero(np.diff(segment, prepend=-1))
        spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(cells)]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(segment[cut], pa.int64()), pa.array([low[a:z].tobytes() for a, z in spans], pa.binary()),
                pa.array([low[a:z][counts[a:z] > 1].tobytes() for a, z in spans], pa.binary()),
            ],
            names=["segment", "seen", "more"],
        )

    kept: list[np.ndarray] = []
    have = 0
    for batch in batches:
        base = batch.column(0).to_numpy() * SEGMENT_CELLS
        own = np.sort(np.stack([base + batch.column(i + 1).to_numpy() for i in range(PROBES)], 1), 1)
        fresh = np.ones(own.shape, bool)
        fresh[:, 1:] = own[:, 1:] != own[:, :-1]  # a text counts once in a cell
        kept.append(own[fresh])
        have += batch.num_rows
        if have >= flush_rows:
            yield send(kept)
            kept, have = [], 0
    if have:
        yield send(kept)


def merge_sketches(segment: tuple, sketches: pa.Table) -> pa.Table:
    """The cells of a segment with a counter of two or more, as 64-bit words; no row if there is none."""
    seen, twice = np.zeros(SEGMENT_CELLS, bool), np.zeros(SEGMENT_CELLS, bool)
    for once, more in zip(sketches["seen"], sketches["more"]):
        cells = np.frombuffer(once.as_buffer(), np.uint16)
        twice[cells[seen[cells]]] = True
        seen[cells] = True
        twice[np.frombuffer(more.as_buffer(), np.uint16)] = True
    words = [np.packbits(twice, bitorder="little").view("<i8").tolist()] if twice.any() else []
    return pa.table({"segment": pa.array([segment[0].as_py()] * len(words), pa.int64()), "words": pa.array(words, pa.list_(pa.int64()))})


class RepeatSketch:
    """The merged counting Bloom sketch of a table's texts.

    A text that occurs twice is never cleared; about one unique text in 150 is
    not cleared either. The sketch grows with the rows (16 counters each).
    """

    def __init__(self, rows: DataFrame, digest: Callable[[Column], Column] = F.xxhash64, broadcast_bytes: int = BROADCAST_BYTES):
        self.digest = digest
        self.segments = max(1, math.ceil(rows.count() * CELLS_PER_ROW / SEGMENT_CELLS))
        placed = _placed(rows.select("k"), self.segments, digest).drop("k")
        sketches = placed.mapInArrow(sketch_rows, "segment long, seen binary, more binary")
        merged = sketches.groupBy("segment").applyInArrow(merge_sketches, "segment long, words array<long>")
        self.bitmaps = materialize(merged, "audit-sketch")
        self.small = self.segments * SEGMENT_CELLS // 8 <= broadcast_bytes

    def mark(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``k`` and ``id``) plus ``maybe``: false only if the text is unique for certain.

        The bitmaps are broadcast up to the bound. Beyond it ``rows`` are
        shuffled by (segment, hash of the id), each bitmap repeated per salt,
        so that a text that a third of the rows share spreads over tasks.
        """
        placed = _placed(rows, self.segments, self.digest)
        if self.small:
            joined = placed.join(F.broadcast(self.bitmaps), "segment", "left")
        else:
            salts = self.bitmaps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = placed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salts, ["segment", "_salt"], "left")
        bits = [F.getbit(F.element_at("words", F.shiftright(f"c{i}", 6) + 1), F.col(f"c{i}").bitwiseAND(63)) for i in range(PROBES)]
        maybe = F.coalesce(sum(bits[1:], bits[0]) == PROBES, F.lit(False))
        return joined.select(*[F.col(c) for c in rows.columns], maybe.alias("maybe"))


def flag_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    digest: Callable[[Column], Column] = F.xxhash64,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``id``, ``part`` and ``mask`` of every document: one bit per failed filter, A lowest.

    A: under 100 words; B: under 80 % of the words distinct; C: over 10 % of the
    code points are A-Z; D: one of ``#$%&*|``; E: the whole text equals that of
    a smaller id. Null texts are empty, a null part is the empty string. A null
    id is smaller than none and no id is smaller than it, so E never holds for
    it. Rows that share the smallest id of their text all pass E. Repeated rows
    are judged and counted one by one; other columns are ignored whatever their
    names; an empty table gives no rows. Very long texts are read some
    megabytes at a time.

    Texts are grouped by themselves; the way back to their rows is their
    SHA-256 with the id, so no hot text is a join key. ``digest`` only places
    texts in the sketch: a bad one clears fewer texts and changes no result.
    """
    keyed = _keyed(docs, id_col, text_col, part_col)
    flags = materialize(_judged(keyed), "audit-flags")
    sketch = RepeatSketch(flags, digest, broadcast_bytes)
    marked = sketch.mark(flags)
    suspects = sketch.mark(keyed.select("id", "k", "text")).where("maybe")
    firsts = suspects.groupBy("k", "text").agg(F.min("id").alias("first")).where("first IS NOT NULL").select("k", "first")
    first = firsts.select(F.col("k").alias("_k"), F.col("first").alias("_first"))
    joined = marked.join(first, (marked["k"] == first["_k"]) & (marked["id"] == first["_first"]), "left")
    copy = F.col("maybe") & F.col("id").isNotNull() & F.col("_first").isNull()
    return joined.select("id", "part", F.when(copy, F.col("mask") + COPIES).otherwise(F.col("mask")).alias("mask"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents, and those that ``labels`` calls quality=1 or toxic=1.

    An id that labels name several times counts as good or toxic if any row
    says so; null ids and null labels say nothing; labels of unknown ids are
    not used.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    joined = flags.join(said, flags["id"] == said["_id"], "left")
    return joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_good")).alias("good"), F.count_if(F.col("_toxic")).alias("toxic")
    )


def audit_orders(counts: DataFrame) -> DataFrame:
    """Every order and step of every part, from additive mask counts: at most 32 rows a part.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails the step's
    filter, gone before), ``unique_fails`` (fails that filter alone),
    ``good_lost`` and ``toxic_lost`` among the removed, ``shapley`` (removals by
    the step's filter summed over all 120 orders).
    """
    cell = F.struct("mask", "n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))
    order = F.element_at(F.split(F.lit(",".join(ORDERS)), ","), F.floor(F.col("i") / len(FILTERS)).cast("int") + 1)
    rows = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * len(FILTERS) - 1))))
    rows = rows.withColumn("filter_order", order).withColumn("step", F.pmod("i", F.lit(len(FILTERS))) + 1)
    bits = [F.pow(F.lit(2), F.ascii(F.substring("filter_order", i + 1, 1)) - ord("A")) for i in range(len(FILTERS))]
    rows = rows.withColumn("own", F.element_at(F.array(*bits), F.col("step")).cast("int"))
    rows = rows.withColumn("before", sum((F.when(F.col("step") > i + 1, b).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).cast("int"))

    def total(column: str, holds: Callable[[Column], Column], weigh: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        def add(acc: Column, c: Column) -> Column:
            return acc + F.when(holds(c["mask"]), c[column] * weigh(c["mask"])).otherwise(F.lit(0)).cast("long")

        return F.aggregate("cells", F.lit(0).cast("long"), add)

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # of a document's j failing filters each comes first in 120 / j orders
        total("n", fails, lambda m: F.lit(len(ORDERS)) / F.bit_count(m)).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, **named) -> DataFrame:
    """``audit_orders`` over the masks of all ``docs``; ``named`` goes to ``flag_documents``."""
    return audit_orders(mask_counts(flag_documents(docs, **named), labels))
