"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the codewords of two perfect Golay codes of length 23 on 46 of
the 64 fingerprint bits. Every 23-bit word lies within 3 bits of exactly one
codeword, so each fingerprint has one home anchor (a pair of codewords). If two
fingerprints differ in at most ``d`` bits, the second lies within the covering
radius plus ``d`` of the first one's home, with the excess over the radius
summed over both codes at most ``d``. Each distinct fingerprint is therefore
copied to every such anchor (61 on average for d = 2) and compared there with
the fingerprints at home; the whole 64 bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.common import connected_components, free_name, materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42

_CODE_BITS, _RADIUS = 23, 3
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_SHINGLES_AT_ONCE = 1 << 18
_BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.float64)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text (0 if it has no word)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = [s - 1 for s in starts[size:]]
    counts, digest = np.zeros(64), xxhash.xxh64_digest
    for a in range(0, len(ends), _SHINGLES_AT_ONCE):
        z = min(a + _SHINGLES_AT_ONCE, len(ends))
        raw = b"".join([digest(line[s:e], seed) for s, e in zip(starts[a:z], ends[a:z])])
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        for k in range(8):  # digests are big-endian: byte 7 holds bits 0 to 7
            counts[8 * k : 8 * k + 8] += np.bincount(parts[:, 7 - k], minlength=256) @ _BYTE_BITS
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(ends)).tolist()))


def fingerprint_column(text, shingle: int = SHINGLE_WORDS, seed: int = SEED):
    """The fingerprint of a string column as a (signed) long column."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return of(text)


@lru_cache(maxsize=4)
def _cosets(excess: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(syndrome of each byte at each of 3 places, patterns by excess and syndrome).

    The patterns of excess t are the words of weight 3 + t (up to 3 for t = 0),
    listed by syndrome and padded with -1.
    """
    def remainder(word: int) -> int:
        for b in range(_CODE_BITS - 1, 10, -1):
            if word >> b & 1:
                word ^= _GENERATOR << (b - 11)
        return word

    unit = [remainder(1 << b) for b in range(_CODE_BITS)]
    places = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * place + b < _CODE_BITS:
                    places[place, value] ^= unit[8 * place + b]
    tables = []
    for t in range(excess + 1):
        rows: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(_RADIUS + 1) if t == 0 else (_RADIUS + t,):
            for bits in combinations(range(_CODE_BITS), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= unit[b]
                rows[syndrome].append(sum(1 << b for b in bits))
        wide = max(map(len, rows))
        tables.append(np.array([r + [-1] * (wide - len(r)) for r in rows], np.int64))
    return places, tables


def _near_codewords(word: np.ndarray, excess: int) -> list[np.ndarray]:
    """By excess t: codewords at distance radius + t (t = 0: within the radius), -1 where none."""
    places, tables = _cosets(excess)
    syndrome = places[0][word & 255] ^ places[1][word >> 8 & 255] ^ places[2][word >> 16]
    return [np.where((p := table[syndrome]) < 0, -1, word[:, None] ^ p) for table in tables]


def anchors(fingerprints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: every anchor within radius plus ``max_bits``; 0 bits gives the home alone."""
    low = (fingerprints & ((1 << _CODE_BITS) - 1)).astype(np.int64)
    high = (fingerprints >> _CODE_BITS & ((1 << _CODE_BITS) - 1)).astype(np.int64)
    left, right = _near_codewords(low, max_bits), _near_codewords(high, max_bits)
    rows, keys = [], []
    for i in range(max_bits + 1):
        for j in range(max_bits + 1 - i):
            a, b = left[i][:, :, None], right[j][:, None, :]
            row, x, y = np.nonzero((a >= 0) & (b >= 0))
            rows.append(row)
            keys.append(left[i][row, x] | right[j][row, y] << _CODE_BITS)
    return np.concatenate(rows), np.concatenate(keys)


def _dealt(distinct: DataFrame, max_bits: int, name: str) -> DataFrame:
    """(``anchor``, ``name``) for each distinct fingerprint and each of its anchors."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048]
                row, key = anchors(part, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["anchor", name])

    return distinct.select("fp").mapInArrow(deal, f"anchor long, {name} long")


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (``src`` < ``dst``) of distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    A fingerprint has at most 64 * 63 / 2 + 64 others within 2 bits, so the
    links stay proportional to the fingerprints whatever the copies.

    Spark does not see that the copies are some 61 times the fingerprints and
    would broadcast either side by the size of ``distinct``: the join is told to merge.
    """
    home, copies = _dealt(distinct, 0, "src"), _dealt(distinct, max_bits, "dst")
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)
    return home.hint("merge").join(copies, "anchor").where(near).select("src", "dst")


def group_fingerprints(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(``fp``, ``root``) for every distinct ``fp`` of ``rows``: equal roots are linked, directly or through others."""
    distinct = materialize(rows.select("fp").distinct(), "fingerprints")
    parts = connected_components(fingerprint_links(distinct, max_bits))
    parts = parts.select(F.col("id").alias("fp"), F.col("component").alias("_component"))
    return distinct.join(parts, "fp", "left").select("fp", F.coalesce("_component", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits. Null and empty texts have fingerprint zero and
    link like any other; repeated rows each give a row; a null id is never a
    component's id unless all its rows have none. Other columns are ignored, an
    empty table gives no rows. Exact copies meet as one fingerprint, so a group
    of any size costs one row in the comparison.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col).cast("string"), shingle).alias("fp"))
    rows = materialize(rows, "simhash")
    roots = materialize(group_fingerprints(rows, max_bits), "roots")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("_id"))
    named = roots.join(least, "fp").groupBy("root").agg(F.min("_id").alias("component_id"))
    # fp -> component, at one row per distinct fingerprint, then to the rows
    return rows.join(roots.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (null ids last).

    All columns stay as they are, whatever their names.
    """
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    held = docs.withColumn(fp, fingerprint_column(F.col(text_col).cast("string"), shingle))
    held = materialize(held.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    rows = held.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    roots = group_fingerprints(rows, max_bits)
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    first = rows.groupBy("fp").agg(F.min(rank).alias("first"))
    kept = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return held.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
