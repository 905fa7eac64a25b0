"""Removal of long repeated strings with a logarithmic family of suffix arrays.

A string of ``match`` bytes that starts at two places is to go, wherever it is.
Suffixes are indexed at sampled places only: every window of ``match`` bytes
picks one *anchor* inside it, the place of the least hash of eight bytes, which
depends on the window alone, so equal windows have the same anchor at the same
offset. An anchor serves a run of windows. Its suffix is told by two digests:
of its *core*, the bytes that all such windows share from the anchor on, and of
the *whole*, all bytes of its run. The suffix array of a batch is the list of
its anchors sorted by (core, whole): suffixes with a long common beginning
stand together, which is all that a scan for long matches asks of the order.

Documents come in batches. The arrays of a batch are merge-scanned against
each level of the index, bucket by bucket, and levels of equal size merge, so
an entry is rewritten a logarithmic number of times. A scan finds

* one core with one whole at several places: all windows of the run repeat;
* one core with several wholes (the edge of a repeated passage): the run is
  cut into runs of eight windows and these into single windows, each compared
  the same way in a shuffle of its own.

Tasks send a (core, whole) once and the index keeps two wholes of a core at
most, so a passage that a third of all documents share is one entry a task.
"""

from __future__ import annotations

import glob
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.bytescan import small_batches, text_buffer
from crewlens.llm.common import local_view, scratch_path

MATCH_BYTES = 400
#: batches that one call deals its documents into
BATCHES = 4
#: windows of a run in the second comparison; the third takes single windows
NARROW = 8
#: bytes of text whose entries make up one bucket
BUCKET_BYTES = 32 << 20
#: bytes of a long text that are looked at together, and bytes of text whose entries a task keeps before it sends them
PIECE_BYTES, FLUSH_BYTES = 2 << 20, 32 << 20

# what is settled for the place of an entry: all its windows repeat; its windows are compared in narrower runs
_ALL, _EACH = 1, 2

#: a run of windows ``at`` .. ``at`` + ``n`` - 1 of a document, ``lead`` bytes before its anchor
_ENTRY = np.dtype([
    ("core", "<u8"), ("whole", "<u8"), ("part", "<i4"), ("doc", "<i4"), ("at", "<i4"), ("n", "<i4"), ("lead", "<i4"), ("state", "u1"),
])
_PLACE = [name for name in _ENTRY.names if name not in ("core", "whole", "part")]
_HIT = np.dtype([(name, _ENTRY[name]) for name in _PLACE])


def packed(rows: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def unpacked(raw, kind: np.dtype) -> np.ndarray:
    n = len(raw) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        out[name] = np.frombuffer(raw, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


# -- anchors and entries -------------------------------------------------------
def reach_of(match: int) -> int:
    """How many places from its start a window looks for its anchor (anchors are about half of that apart)."""
    if match < 16:
        raise ValueError("matches under 16 bytes are not supported")
    return match // 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    whole = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    whole[: len(values)] = values
    rows = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_of(buf: np.ndarray, reach: int) -> np.ndarray:
    """The anchor of every place: where the least hash of eight bytes stands among ``reach`` places (the first of equals)."""
    n = len(buf) - 7
    if n < reach:
        return np.zeros(0, np.int64)
    word = np.empty(n, np.uint64)
    for i in range(8):
        part = word[i::8]
        part[:] = np.frombuffer(buf[i : i + 8 * len(part)].tobytes(), "<u8")
    word *= np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    word &= np.uint64(0xFFFFFFFF00000000)
    word |= np.arange(n, dtype=np.uint64)
    return (sliding_least(word, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchored_runs(buf: np.ndarray, offs: np.ndarray, match: int) -> np.ndarray:
    """Rows (text, anchor, first, last): runs of windows inside one text with one anchor, as places in the text.

    A text longer than a piece is taken in pieces that overlap by a window; a
    run that a piece cuts is two runs, which only sends it to the narrower
    comparison.
    """
    out, reach, at, n_texts = [], reach_of(match), 0, len(offs) - 1
    while at < n_texts:
        upto = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE_BYTES, "right")) - 1)
        begin, end = int(offs[at]), int(offs[upto])
        for start in range(begin, end, PIECE_BYTES) if upto == at + 1 else [begin]:
            stop = min(end, start + PIECE_BYTES + match - 1) if upto == at + 1 else end
            n = stop - start - match + 1
            if n <= 0:
                continue
            anchor = anchor_of(buf[start:stop], reach)[:n]
            # the last match - 1 places of a text start no window
            edges = offs[at + 1 : upto + 1] - start
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, np.clip(np.maximum(edges - match + 1, offs[at:upto] - start), 0, n), 1)
            np.add.at(step, np.clip(edges, 0, n), -1)
            keep = np.flatnonzero(np.cumsum(step[:n]) <= 0)
            if not len(keep):
                continue
            key = anchor[keep]
            cut = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(keep, prepend=-2) != 1))
            last = keep[np.append(cut[1:], len(keep)) - 1]
            row = np.searchsorted(offs, keep[cut] + start, "right") - 1
            out.append(np.stack([row, key[cut] + start - offs[row], keep[cut] + start - offs[row], last + start - offs[row]], 1))
        at = upto
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def narrowed(runs: np.ndarray, width: int) -> np.ndarray:
    """The runs cut where the distance to the anchor passes a multiple of ``width``."""
    lead_first, lead_last = runs[:, 1] - runs[:, 2], runs[:, 1] - runs[:, 3]
    high, low = lead_first // width, lead_last // width
    count = high - low + 1
    which = np.repeat(np.arange(len(runs)), count)
    slot = high[which] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    anchor = runs[which, 1]
    first = anchor - np.minimum(lead_first[which], slot * width + width - 1)
    last = anchor - np.maximum(lead_last[which], slot * width)
    return np.stack([runs[which, 0], anchor, first, last], 1)


def entries_of(raw: memoryview, offs: np.ndarray, runs: np.ndarray, match: int, width: int, part: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries of ``runs``, each at most ``width`` windows and in one slot of that many distances to the anchor.

    All windows of a slot share match - width + 1 bytes: the core. Both digests
    together are 128 bits, and rows count as equal only if both are.
    """
    out = np.zeros(len(runs), _ENTRY)
    base = offs[runs[:, 0]]
    lead, n = runs[:, 1] - runs[:, 2], runs[:, 3] - runs[:, 2] + 1
    core = base + runs[:, 1] - (lead // width) * width
    first, digest, size = base + runs[:, 2], hashlib.blake2b, match - width + 1
    cores = [digest(raw[a : a + size], digest_size=8).digest() for a in core.tolist()]
    wholes = [
        digest(raw[a : a + k + match - 1], digest_size=8, salt=b"%d,%d" % (k, d)).digest()
        for a, k, d in zip(first.tolist(), n.tolist(), lead.tolist())
    ]
    out["core"], out["whole"] = np.frombuffer(b"".join(cores), "<u8"), np.frombuffer(b"".join(wholes), "<u8")
    out["part"], out["doc"] = part[runs[:, 0]], doc[runs[:, 0]]
    out["at"], out["n"], out["lead"] = runs[:, 2], n, lead
    return out


# -- sorted arrays and their scans ---------------------------------------------
def in_order(entries: np.ndarray) -> np.ndarray:
    return np.lexsort((entries["whole"], entries["core"]))


def _firsts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new core begins, and where a new (core, whole)."""
    core = np.ones(len(entries), bool)
    core[1:] = entries["core"][1:] != entries["core"][:-1]
    whole = core.copy()
    whole[1:] |= entries["whole"][1:] != entries["whole"][:-1]
    return core, whole


def scan(entries: np.ndarray) -> np.ndarray:
    """Sorted entries of all arrays in hand: their new states."""
    state = entries["state"].copy()
    if not len(entries):
        return state
    new_core, new_whole = _firsts(entries)
    pair, group = np.cumsum(new_whole) - 1, np.cumsum(new_core) - 1
    several = (np.bincount(pair) > 1)[pair]
    mixed = (np.bincount(group, weights=new_whole) > 1)[group]
    # one place speaks for its whole in the narrower comparison
    spoken = (np.bitwise_or.reduceat(state, np.flatnonzero(new_whole)) & _EACH > 0)[pair]
    state[several] |= _ALL
    state[mixed & new_whole & ~spoken] |= _EACH
    return state


def thinned(entries: np.ndarray) -> np.ndarray:
    """Sorted, scanned entries as an array keeps them: a whole once, and two wholes of a core at most.

    A third whole is compared in narrower runs by now, and whatever comes to
    its core later will be: no match is lost.
    """
    if not len(entries):
        return entries
    _, new_whole = _firsts(entries)
    kept = entries[new_whole].copy()
    kept["state"] = np.bitwise_or.reduceat(entries["state"], np.flatnonzero(new_whole))
    return kept[np.arange(len(kept)) - np.searchsorted(kept["core"], kept["core"]) < 2]


def news(entries: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, places) of the entries whose state a scan has changed; the state says what is new."""
    fresh = state & ~entries["state"]
    at = np.flatnonzero(fresh)
    at = at[np.argsort(entries["part"][at], kind="stable")]
    for rows in np.split(at, np.flatnonzero(np.diff(entries["part"][at])) + 1) if len(at) else []:
        hits = np.empty(len(rows), _HIT)
        for name in _PLACE:
            hits[name] = entries[name][rows]
        hits["state"] = fresh[rows]
        yield int(entries["part"][rows[0]]), packed(hits)


# -- the index -----------------------------------------------------------------
_SENT = "bucket int, part int, payload binary"  # an array (part is null) or places of a part that are settled


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "part", "payload"],
    )


def _arrays(stored: DataFrame, match: int, width: int, buckets: int, sidecar: str | None) -> DataFrame:
    """Each task's sorted entries by bucket, and what it has settled by itself (under a negative bucket for each part).

    ``sidecar`` names the runs to take; without it all runs of all texts are.
    """

    def send(kept: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(kept)
        entries = entries[in_order(entries)]
        state = scan(entries)
        rows = [(-1 - part, part, places) for part, places in news(entries, state)]
        entries["state"] = state
        entries = thinned(entries)
        bucket = (entries["core"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows += [(b, None, packed(entries[order[edges[b] : edges[b + 1]]])) for b in np.unique(bucket).tolist()]
        return _sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, have, places = [], 0, Sidecar(sidecar)
        for batch in (b for whole in batches for b in small_batches(whole, 3)):
            buf, offs = text_buffer(batch.column(3))
            part, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            runs = anchored_runs(buf, offs, match) if sidecar is None else places.runs(part, doc, _EACH)
            if len(runs):
                kept.append(entries_of(memoryview(buf), offs, narrowed(runs, width), match, width, part, doc))
            have += len(buf)
            if have >= FLUSH_BYTES and kept:
                yield send(kept)
                kept, have = [], 0
        if kept:
            yield send(kept)

    return stored.select("part", "doc", "id", "text").mapInArrow(run, _SENT)


def _level(path: str, bucket: int) -> np.ndarray:
    """One bucket of a stored level."""
    found = [np.zeros(0, _ENTRY)]
    for file in sorted(glob.glob(f"{local_view(path)}/bucket={bucket}/*.parquet")):
        rows = pq.read_table(file, columns=["part", "payload"], partitioning=None)
        for part, payload in zip(rows["part"].to_pylist(), rows["payload"]):
            if part is None:
                found.append(unpacked(payload.as_buffer(), _ENTRY))
    return np.concatenate(found)


def _merged(sent: DataFrame, buckets: int, levels: list[str], merging: list[str], keep: bool) -> DataFrame:
    """Per bucket: the sent arrays merge-scanned against ``levels``; settled places, and the level made of them and ``merging``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, out = key[0].as_py(), []
        if bucket < 0:
            return pa.Table.from_batches([_sent([(-1, part, places) for part, places in zip(rows["part"].to_pylist(), rows["payload"].to_pylist())])])
        old = [_level(path, bucket) for path in levels]
        new = [unpacked(x.as_buffer(), _ENTRY) for x in rows["payload"]]
        entries = np.concatenate([*old, *new])
        stays = np.concatenate([np.full(len(x), path not in merging) for path, x in zip(levels, old)] + [np.zeros(sum(map(len, new)), bool)])
        order = in_order(entries)  # stable: an older level's place comes first
        entries, stays = entries[order], stays[order]
        state = scan(entries)
        out += [(bucket, part, places) for part, places in news(entries, state)]
        if keep:
            entries["state"] = state
            out.append((bucket, None, packed(thinned(entries[~stays]))))
        return pa.Table.from_batches([_sent(out)])

    # every bucket takes part, also one that only a level holds
    every = sent.sparkSession.range(buckets).selectExpr("CAST(id AS int) AS bucket", "CAST(NULL AS int) AS part", "X'' AS payload")
    return sent.unionByName(every).groupBy("bucket").applyInArrow(run, _SENT)


class SuffixIndex:
    """A logarithmic family of suffix arrays in the shared folder: at most one level of each size.

    ``add`` takes the next batch of stored texts and keeps what became known of
    its places and of older ones. Workers read the levels as files, so the
    shared folder must be a mounted one (``file:`` or a plain path).
    """

    def __init__(self, spark: SparkSession, match: int, buckets: int):
        self.spark, self.match, self.buckets = spark, match, buckets
        self.levels: list[tuple[int, str]] = []  # (batches in it, path), largest first
        self.settled: list[str] = []

    def add(self, stored: DataFrame) -> None:
        size, merging = 1, []
        for held, path in reversed(self.levels):
            if held != size:
                break
            merging.append(path)
            size += held
        path = scratch_path(self.spark, "suffix-level")
        local_view(path)
        sent = _arrays(stored, self.match, reach_of(self.match), self.buckets, None)
        merged = _merged(sent, self.buckets, [p for _, p in self.levels], merging, True)
        merged.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        self.levels = [x for x in self.levels if x[1] not in merging] + [(size, path)]
        self.settled.append(path)

    def places(self) -> DataFrame:
        """(``part``, ``payload``): all places settled so far."""
        return _settled(self.spark, self.settled)


def _settled(spark: SparkSession, paths: list[str]) -> DataFrame:
    each = [spark.read.schema(_SENT).parquet(path).where("part IS NOT NULL").select("part", "payload") for path in paths]
    return reduce(DataFrame.unionByName, each)


def _sidecar(places: DataFrame) -> str:
    """Settled places as one folder per part, which tasks that read the part open; returns its path."""
    path = scratch_path(places.sparkSession, "suffix-places")
    places.repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


class Sidecar:
    """Settled places of the parts that a task reads, one part at a time."""

    def __init__(self, path: str | None):
        self.path, self.part, self.hits = path, None, np.zeros(0, _HIT)

    def _of(self, part: int) -> np.ndarray:
        if part != self.part:
            found = [np.zeros(0, _HIT)]
            for file in sorted(glob.glob(f"{local_view(self.path)}/part={part}/*.parquet")):
                found += [unpacked(x.as_buffer(), _HIT) for x in pq.read_table(file, columns=["payload"], partitioning=None)["payload"]]
            hits = np.unique(np.concatenate(found))  # sorted by document; a place that was settled twice counts once
            self.part, self.hits = part, hits
        return self.hits

    def runs(self, part: np.ndarray, doc: np.ndarray, state: int) -> np.ndarray:
        """Rows (row, anchor, first, last) of the given documents' places whose state has ``state``."""
        out = []
        for p in np.unique(part).tolist():
            hits = self._of(p)
            hits = hits[hits["state"] & state > 0]
            rows = np.flatnonzero(part == p)
            rows = rows[np.argsort(doc[rows], kind="stable")]
            a, z = np.searchsorted(hits["doc"], doc[rows], "left"), np.searchsorted(hits["doc"], doc[rows], "right")
            row = np.repeat(rows, z - a)
            at = np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a) + np.arange(len(row))
            h = hits[at]
            out.append(np.stack([row, h["at"] + h["lead"], h["at"], h["at"] + h["n"] - 1], 1).astype(np.int64))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)


# -- documents -----------------------------------------------------------------
def _stored(docs: DataFrame, id_col: str, text_col: str, batches: int) -> str:
    """The texts written once, each with the part that wrote it, its number there and its batch."""
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc", T.IntegerType()),
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("batch", T.IntegerType()),
    ])

    def number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, have = TaskContext.get().partitionId(), 0
        for batch in rows:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(np.arange(have, have + n, dtype=np.int32)), *batch.columns,
                    pa.array(np.full(n, part % batches, np.int32)),
                ],
                names=schema.fieldNames(),
            )
            have += n

    path = scratch_path(docs.sparkSession, "suffix-texts")
    plain = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    plain.mapInArrow(number, schema).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    return path


def removed_spans(first: np.ndarray, last: np.ndarray, match: int) -> np.ndarray:
    """Maximal (start, end) of the bytes that windows ``first`` .. ``last`` cover; touching ones are one."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + match)
    cut = np.ones(len(start), bool)
    cut[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(cut)
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1]], 1)


def _cleaned(stored: DataFrame, sidecar: str, match: int, with_text: bool) -> DataFrame:
    fields = [stored.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*fields, T.StructField("kept", T.BinaryType())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Sidecar(sidecar)
        for batch in (b for whole in batches for b in small_batches(whole, 3)):
            buf, offs = text_buffer(batch.column(3))
            runs = places.runs(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _ALL)
            edges = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
            rows = []
            for i in range(batch.num_rows):
                own = runs[edges[i] : edges[i + 1]]
                spans = removed_spans(own[:, 2], own[:, 3], match)
                raw, digest, at, kept = memoryview(buf)[offs[i] : offs[i + 1]], hashlib.sha256(), 0, []
                for a, z in [*spans.tolist(), (len(raw), len(raw))]:
                    digest.update(raw[at:a])
                    if with_text:
                        kept.append(bytes(raw[at:a]))
                    at = z
                gone = int((spans[:, 1] - spans[:, 0]).sum())
                rows.append((len(raw), gone, len(spans), digest.hexdigest(), b"".join(kept)))
            columns = [batch.column(2), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([r[4] for r in rows], pa.binary())] if with_text else []), names=schema.fieldNames())

    return stored.select("part", "doc", "id", "text").mapInArrow(run, schema)


def remove_long_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    match: int = MATCH_BYTES,
    batches: int = BATCHES,
    bucket_bytes: int = BUCKET_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """Every document without the bytes that a string of ``match`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes; matches lie inside one document, but the other place
    may be in the same document, overlapping too. Strings are judged on the
    input, not on what is left. Columns: the id under its name, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` (hex, of
    the remaining bytes) and, ``with_text``, ``kept`` (binary: a cut may split
    a character).

    Null texts are empty; texts under ``match`` bytes keep all; of equal texts
    from ``match`` bytes on nothing is left, repeated rows and rows with equal
    or null ids included; very long texts are taken in pieces. Other columns
    are ignored whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = _stored(docs, id_col, text_col, batches)
    schema = f"part int, doc int, id {docs.schema[id_col].dataType.simpleString()}, text string, batch int"
    stored = spark.read.schema(schema).parquet(path)
    size = stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    index = SuffixIndex(spark, match, buckets)
    for b in range(batches):
        index.add(stored.where(F.col("batch") == b))
    settled, sidecar = list(index.settled), _sidecar(index.places())
    for width in (min(NARROW, reach_of(match)), 1):
        sent = _arrays(stored, match, width, buckets, sidecar)
        found = scratch_path(spark, "suffix-narrow")
        _merged(sent, buckets, [], [], False).write.option("compression", "zstd").parquet(found)
        settled.append(found)
        sidecar = _sidecar(_settled(spark, [found]))
    every = _sidecar(_settled(spark, settled))
    return _cleaned(stored, every, match, with_text).withColumnRenamed("id", id_col)
