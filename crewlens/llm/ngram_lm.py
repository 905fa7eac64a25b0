"""Interpolated modified Kneser-Ney word model of order two or three.

Counting is a shuffle of pre-aggregated, sorted blocks per order: words by hash,
then pairs of word numbers, then triples as a pair number and a word number.
Each bucket of a shuffle is merged by one task, which
writes its part of the model to the shared folder as sorted arrays: word
hashes with their counts, and scrambled pair and triple keys with theirs. Bucket numbers
follow the corpus size, so a task's part stays bounded while the model grows
with the input. Workers map the arrays into memory and look up sorted batches
of keys; the model is never sent to the driver, which sees one line per bucket.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.bytescan import hashed_words, small_batches
from crewlens.llm.common import local_view, scratch_path

#: Corpus bytes behind one bucket of the model.
BUCKET_BYTES = 16 << 20
#: Tokens that a task gathers before it sorts and passes them on.
FLUSH_TOKENS = 2_000_000

# no word has these hashes: they are not hashes of word bytes
END = np.uint64(0xE0D0_0000_0000_0001)
START = np.uint64(0x57A7_0000_0000_0001)


def trained_on(id_col: Column) -> Column:
    """crc32 of the id as text, mod 7, is not 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


# -- arrays in rows and files -----------------------------------------------
def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers as bytes of the narrowest type, named by the first byte."""
    top = int(values.max()) if len(values) else 0
    code = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    return code.encode() + values.astype(code).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, chr(raw[0]), offset=1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return int(keys[0]).to_bytes(8, "little") + _pack(np.diff(keys))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    steps = _unpack(raw[8:]).astype(np.uint64)
    out = np.zeros(len(steps) + 1, np.uint64)
    np.cumsum(steps, out=out[1:])
    return out + np.uint64(int.from_bytes(raw[:8], "little"))


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Written aside and renamed: a repeated task replaces its own file as a whole."""
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        f.write(np.ascontiguousarray(values).tobytes())
    os.replace(aside, f"{folder}/{name}")


def _map(folder: str, name: str, kind) -> np.ndarray:
    path = f"{folder}/{name}"
    if not os.path.exists(path) or os.path.getsize(path) == 0:
        return np.zeros(0, kind)
    return np.memmap(path, kind, "r")


def _merge(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Equal keys once, sorted, with the sums of their values."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first], *(np.add.reduceat(np.concatenate(v).astype(np.int64)[order], first) for v in values))


def _buckets(keys: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Bucket of each key: equal ranges of the leading bits."""
    lead = keys >> np.uint64(max(0, bits - 31))
    return (lead * np.uint64(count) >> np.uint64(min(31, bits))).astype(np.int64)


def _slices(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    yield from zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)])


@dataclass(frozen=True)
class _Scramble:
    """A bijection of 0 .. 2^bits - 1, so that keys fill the buckets evenly."""

    bits: int

    _ODD, _ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    @property
    def _mask(self):
        return np.uint64((1 << self.bits) - 1)

    @property
    def _shift(self):
        return np.uint64((self.bits + 1) // 2)

    def of(self, x: np.ndarray) -> np.ndarray:
        x = x * np.uint64(self._ODD) & self._mask
        x = x ^ (x >> self._shift)
        return x * np.uint64(self._ODD2) & self._mask

    def back(self, x: np.ndarray) -> np.ndarray:
        x = x * np.uint64(pow(self._ODD2, -1, 1 << 64)) & self._mask
        x = x ^ (x >> self._shift)
        return x * np.uint64(pow(self._ODD, -1, 1 << 64)) & self._mask


def token_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hash before each, tokens per row): words and one end per row; START precedes a row."""
    hashes, counts = hashed_words(column)
    stop = np.cumsum(counts + 1) - 1
    tokens = np.full(len(hashes) + len(counts), END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[stop] = False
    tokens[inside] = hashes
    before = np.roll(tokens, 1)
    before[stop - counts] = START
    return tokens, before, counts + 1


# -- the model ---------------------------------------------------------------
@dataclass(frozen=True)
class Shape:
    """What the driver knows of a model."""

    folder: str
    buckets: int
    first: tuple[int, ...]  # number of the first word of each bucket, and the end
    tokens: int
    words: int  # distinct training tokens, the end included
    documents: int
    order: int = 2
    pair_first: tuple[int, ...] = (0,)  # number of the first pair of each bucket, and the end
    pair_types: int = 0
    top_discounts: tuple[float, ...] = (0.0,) * 3  # of triple counts 1, 2, 3+
    discounts: tuple[float, ...] = (0.0,) * 3  # of pair counts; at order 3 of their continuation counts
    low_discounts: tuple[float, ...] = (0.0,) * 3  # of continuation counts
    low_rest: float = 1.0  # mass that unigram discounts free

    @property
    def scramble(self) -> _Scramble:
        return _Scramble(max(2, (max(1, self.first[-1]) ** 2 - 1).bit_length()))

    @property
    def triple_scramble(self) -> _Scramble:
        return _Scramble(max(2, (max(1, self.pair_first[-1] * self.first[-1]) - 1).bit_length()))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3+ from counts of counts.

    Where a small corpus leaves a count of counts empty, 0.5, 1 and 1.5 stand in.
    """
    if not n1 or not n2 or not n3 or not n4:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(i + 1)) for i, d in enumerate(raw))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


class _Keys:
    """Sorted 64-bit keys of a bucket: the low 32 bits of each, and where each run of equal leading bits begins."""

    @staticmethod
    def save(folder: str, name: str, keys: np.ndarray) -> None:
        base = int(keys[0])
        span = keys - np.uint64(base)
        shift = min(32, max(0, int(span[-1]).bit_length() - (len(keys) // 16).bit_length()))
        runs = span >> np.uint64(shift)
        _save(folder, name, span.astype(np.uint32))
        _save(folder, f"{name}-runs", np.searchsorted(runs, np.arange(int(runs[-1]) + 2, dtype=np.uint64)).astype(np.uint32))
        _save(folder, f"{name}-head", np.array([base, shift], np.uint64))

    def __init__(self, folder: str, name: str):
        self.low, self.runs = _map(folder, name, np.uint32), _map(folder, f"{name}-runs", np.uint32)
        self.base, self.shift = (int(x) for x in _map(folder, f"{name}-head", np.uint64)) if len(self.low) else (0, 0)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where unknown: all keys halve their runs together."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.low):
            return out
        span = keys - np.uint64(self.base)  # a smaller key wraps round to past the end
        run = span >> np.uint64(self.shift)
        inside = np.flatnonzero(run < np.uint64(len(self.runs) - 1))
        run, want = run[inside].astype(np.int64), span[inside].astype(np.uint32)
        at, end = self.runs[run].astype(np.int64), self.runs[run + 1].astype(np.int64)
        stop = end.copy()
        for _ in range(int((end - at).max(initial=0)).bit_length()):
            middle = (at + end) >> 1
            less = (at < end) & (self.low[np.minimum(middle, len(self.low) - 1)] < want)
            end = np.where(less, end, np.minimum(middle, end))
            at = np.where(less, middle + 1, at)
        hit = np.flatnonzero(at < stop)
        hit = hit[self.low[at[hit]] == want[hit]]
        out[inside[hit]] = at[hit]
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The keys at the given places."""
        run = (np.searchsorted(self.runs, places, "right") - 1).astype(np.uint64)
        high = run << np.uint64(self.shift) >> np.uint64(32) << np.uint64(32)
        return (high | self.low[places].astype(np.uint64)) + np.uint64(self.base)


class _Counts:
    """Counts of a bucket: a byte each, those from 255 on aside with their places."""

    @staticmethod
    def save(folder: str, name: str, counts: np.ndarray) -> None:
        _save(folder, name, np.minimum(counts, 255).astype(np.uint8))
        large = np.flatnonzero(counts >= 255)
        _save(folder, f"{name}-often", np.stack([large, counts[large]], axis=1))

    def __init__(self, folder: str, name: str):
        self.small, self.often = _map(folder, name, np.uint8), _map(folder, f"{name}-often", np.int64).reshape(-1, 2)

    def at(self, places: np.ndarray) -> np.ndarray:
        out = self.small[places].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.often[np.searchsorted(self.often[:, 0], places[large]), 1]
        return out


#: Stages of a model on disk: words; pairs and their counts; contexts too; triples too.
WORDS, PAIRS, CONTEXTS = 1, 2, 3


class Tables:
    """The mapped arrays of a model; words and pairs are numbered by their place in key order."""

    def __init__(self, shape: Shape, stage: int = CONTEXTS):
        self.shape, f = shape, shape.folder
        parts = range(shape.buckets)
        self.word = [_map(f, f"word-{b}", np.uint64) for b in parts]
        self.count = [_map(f, f"count-{b}", np.int64) for b in parts]
        if stage >= PAIRS:
            self.pair = [_Keys(f, f"pair-{b}") for b in parts]
            self.times = [_Counts(f, f"times-{b}") for b in parts]
        if stage >= CONTEXTS:
            self.context = [_map(f, f"context-{b}", np.uint32) for b in parts]
            self.mass = [_map(f, f"mass-{b}", np.int64) for b in parts]
        if stage >= CONTEXTS and shape.order > 2:
            self.adjusted = [_Counts(f, f"adjusted-{b}") for b in parts]
            self.follow = [[_Counts(f, f"follow{k}-{b}") for b in parts] for k in (1, 2, 3)]
            self.triple = [_Keys(f, f"triple-{b}") for b in parts]
            self.triple_times = [_Counts(f, f"triple-times-{b}") for b in parts]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for b, s, e in _slices(_buckets(hashes, 64, self.shape.buckets)):
            keys = self.word[b]
            at = np.searchsorted(keys, hashes[s:e])
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == hashes[s:e][hit]]
            out[s + hit] = at[hit] + self.shape.first[b]
        return out

    def of_words(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, [continuations, followers seen once, twice, more often], mass of the followers) of sorted word numbers."""
        count, context, mass = np.zeros(len(numbers), np.int64), np.zeros((len(numbers), 4), np.int64), np.zeros(len(numbers), np.int64)
        bucket = np.searchsorted(np.array(self.shape.first), numbers, "right") - 1
        for b, s, e in _slices(bucket):
            at = numbers[s:e] - self.shape.first[b]
            count[s:e] = self.count[b][at]
            context[s:e] = self.context[b].reshape(-1, 4)[at]
            mass[s:e] = self.mass[b][at]
        return count, context, mass

    def pair_numbers(self, keys: np.ndarray) -> np.ndarray:
        """Pair numbers of sorted scrambled pair keys, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        for b, s, e in _slices(_buckets(keys, self.shape.scramble.bits, self.shape.buckets)):
            at = self.pair[b].find(keys[s:e])
            out[s:e] = np.where(at < 0, -1, at + self.shape.pair_first[b])
        return out

    def pair_words(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, second) word numbers of sorted pair numbers."""
        key = np.zeros(len(numbers), np.uint64)
        for b, s, e in self._pair_slices(numbers):
            key[s:e] = self.pair[b].at(numbers[s:e] - self.shape.pair_first[b])
        plain, n_words = self.shape.scramble.back(key), np.uint64(self.shape.first[-1])
        return plain // n_words, plain % n_words

    def _pair_slices(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        return _slices(np.searchsorted(np.array(self.shape.pair_first), numbers, "right") - 1)

    def of_pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, count the pair level uses, [followers seen once, twice, more often]) of sorted pair numbers, 0 for -1."""
        count, used, follow = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64), np.zeros((len(numbers), 3), np.int64)
        known = np.flatnonzero(numbers >= 0)
        for b, s, e in self._pair_slices(numbers[known]):
            rows = known[s:e]
            at = numbers[rows] - self.shape.pair_first[b]
            count[rows] = used[rows] = self.times[b].at(at)
            if self.shape.order > 2:
                used[rows] = self.adjusted[b].at(at)
                for k in range(3):
                    follow[rows, k] = self.follow[k][b].at(at)
        return count, used, follow

    def of_triples(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted scrambled triple keys, 0 where unknown."""
        out = np.zeros(len(keys), np.int64)
        for b, s, e in _slices(_buckets(keys, self.shape.triple_scramble.bits, self.shape.buckets)):
            at = self.triple[b].find(keys[s:e])
            hit = np.flatnonzero(at >= 0)
            out[s + hit] = self.triple_times[b].at(at[hit])
        return out


@lru_cache(maxsize=2)
def _tables(shape: Shape, stage: int) -> Tables:
    return Tables(shape, stage)


def _gathered(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted keys, counts) of every few million tokens."""
    held, size = [], 0
    for batch in (b for whole in batches for b in small_batches(whole, 0)):
        held.append(keys_of(batch.column(0)))
        size += len(held[-1])
        if size >= FLUSH_TOKENS:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def _rows_by_bucket(keys: np.ndarray, values: list[np.ndarray], buckets: np.ndarray) -> pa.RecordBatch:
    cut = [*_slices(buckets)]
    columns = [pa.array([b for b, _, _ in cut], pa.int32()), pa.array([_pack_sorted(keys[s:e]) for _, s, e in cut], pa.binary())]
    for v in values:
        columns.append(pa.array([_pack(v[s:e]) for _, s, e in cut], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", *[f"v{i}" for i in range(len(values))]])


def fit(docs: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, order: int = 2) -> Shape:
    """Count ``docs`` (every row is learnt) and write the model of ``order`` 2 or 3 to the shared folder."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, math.ceil(total / bucket_bytes))
    folder = local_view(scratch_path(spark, "ngram"))
    os.makedirs(folder)

    def words(batches):
        def tokens(column):
            hashes, _, sizes = token_pairs(column)
            return np.concatenate([hashes, np.full(len(sizes), START, np.uint64)])

        for keys, n in _gathered(batches, tokens):
            yield _rows_by_bucket(keys, [n], _buckets(keys, 64, count))

    def merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        key, n = _merge([_unpack_sorted(k) for k in pdf["keys"]], [_unpack(v) for v in pdf["v0"]])
        _save(folder, f"word-{bucket}", key)
        _save(folder, f"count-{bucket}", n)
        starts = int(n[key == START].sum())
        return pd.DataFrame({"bucket": [bucket], "size": [len(key)], "tokens": [int(n.sum()) - starts], "starts": [starts]})

    parts = texts.mapInArrow(words, "bucket int, keys binary, v0 binary").groupBy("bucket")
    rows = parts.applyInPandas(merge_words, "bucket int, size long, tokens long, starts long").collect()  # a line per bucket
    sizes = np.zeros(count, np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["size"]
    documents = sum(r["starts"] for r in rows)
    first = (0, *np.cumsum(sizes).tolist())
    shape = Shape(folder, count, first, sum(r["tokens"] for r in rows), first[-1] - bool(documents), documents, order)
    if not documents:
        return shape
    if first[-1] ** 2 >= 1 << 63:
        raise ValueError("more distinct words than pair keys can number")
    shape = _fit_pairs(texts, shape)
    if order > 2 and shape.pair_first[-1] * first[-1] >= 1 << 63:
        raise ValueError("more distinct pairs and words than triple keys can number")
    blocks = _count_triples(texts, shape) if order > 2 else _pair_contexts(texts, shape)
    return _fit_contexts(blocks, shape)


_BLOCK = "bucket int, kind int, keys binary, v0 binary, v1 binary, v2 binary, v3 binary"
#: Kinds of blocks: followers and predecessors by number, counts of counts of pairs and of triples, a mark that visits a bucket.
FOLLOWERS, PRECEDED, PAIR_COUNTS, TRIPLE_COUNTS, VISIT = range(5)


def _block_rows(found: list[tuple]) -> pd.DataFrame:
    """A row per (bucket, kind, packed keys, packed values)."""
    rows = [(b, kind, keys, *values, *[b""] * (4 - len(values))) for b, kind, keys, values in found]
    return pd.DataFrame(rows, columns=["bucket", "kind", "keys", "v0", "v1", "v2", "v3"]).astype({"bucket": np.int32, "kind": np.int32})


def _cut_blocks(kind: int, keys: np.ndarray, values: list[np.ndarray], ends: np.ndarray) -> list[tuple]:
    """Sorted numbers and their values, a block for each bucket; ``ends`` are the buckets' ends."""
    cut = _slices(np.searchsorted(ends, keys.astype(np.int64), "right"))
    return [(b, kind, _pack_sorted(keys[s:e]), [_pack(v[s:e]) for v in values]) for b, s, e in cut]


def _merged_blocks(pdf: pd.DataFrame, kind: int, n_values: int) -> tuple[np.ndarray, ...]:
    part = pdf[pdf["kind"] == kind]
    if not len(part):
        return tuple(np.zeros(0, np.int64) for _ in range(n_values + 1))
    key, *values = _merge([_unpack_sorted(k) for k in part["keys"]], *[[_unpack(v) for v in part[f"v{i}"]] for i in range(n_values)])
    return (key.astype(np.int64), *values)


def _by_times(n: np.ndarray) -> list[np.ndarray]:
    one, two = (n == 1).astype(np.int64), (n == 2).astype(np.int64)
    return [one, two, 1 - one - two]


def _sum_counts(pdf: pd.DataFrame, kind: int) -> np.ndarray:
    return np.sum([np.zeros(4, np.int64), *[_unpack(v).astype(np.int64) for v in pdf["v0"][pdf["kind"] == kind]]], axis=0)


def _context_blocks(shape: Shape, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> list[tuple]:
    """What distinct pairs with the counts ``n`` say of their words."""
    ends = np.array(shape.first[1:])
    followers, preceded = _merge([left], *[[v] for v in _by_times(n)], [n]), _merge([right], [np.ones(len(right), np.int64)])
    return [
        (-1, PAIR_COUNTS, b"", [_pack(np.array(_counts_of_counts(n)))]),
        *_cut_blocks(FOLLOWERS, followers[0], [*followers[1:]], ends), *_cut_blocks(PRECEDED, preceded[0], [preceded[1]], ends),
    ]


def _pair_keys(shape: Shape, table: Tables, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scrambled pair key, token number) of tokens that are all known."""
    known, inverse = np.unique(np.concatenate([tokens, before]), return_inverse=True)
    number = table.numbers(known).astype(np.uint64)[inverse]
    return shape.scramble.of(number[len(tokens) :] * np.uint64(shape.first[-1]) + number[: len(tokens)]), number[: len(tokens)]


def _fit_pairs(texts: DataFrame, shape: Shape) -> Shape:
    """Write the distinct pairs and their counts; the shape with the pairs' numbering."""
    scramble, count, folder = shape.scramble, shape.buckets, shape.folder

    def pairs(batches):
        table = _tables(shape, WORDS)

        def keys(column):
            tokens, before, _ = token_pairs(column)
            return _pair_keys(shape, table, tokens, before)[0]

        for found, n in _gathered(batches, keys):
            yield _rows_by_bucket(found, [n], _buckets(found, scramble.bits, count))

    def merge_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        key, n = _merge([_unpack_sorted(k) for k in pdf["keys"]], [_unpack(v) for v in pdf["v0"]])
        _Keys.save(folder, f"pair-{bucket}", key)
        _Counts.save(folder, f"times-{bucket}", n)
        return pd.DataFrame({"bucket": [bucket], "size": [len(key)]})

    parts = texts.mapInArrow(pairs, "bucket int, keys binary, v0 binary").groupBy("bucket")
    sizes = np.zeros(count, np.int64)
    for r in parts.applyInPandas(merge_pairs, "bucket int, size long").collect():  # a line per bucket
        sizes[r["bucket"]] = r["size"]
    return replace(shape, pair_first=(0, *np.cumsum(sizes).tolist()))


def _every_bucket(texts: DataFrame, shape: Shape) -> DataFrame:
    empty = [F.lit(b"").alias(c) for c in ("keys", "v0", "v1", "v2", "v3")]
    return texts.sparkSession.range(shape.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(VISIT).alias("kind"), *empty)


def _pair_contexts(texts: DataFrame, shape: Shape) -> DataFrame:
    """Order 2: the stored pairs' blocks, bucket by bucket."""

    def contexts(pdf: pd.DataFrame) -> pd.DataFrame:
        table, bucket = _tables(shape, PAIRS), int(pdf["bucket"].iloc[0])
        at = np.arange(shape.pair_first[bucket + 1] - shape.pair_first[bucket])
        if not len(at):
            return _block_rows([])
        left, right = table.pair_words(at + shape.pair_first[bucket])
        return _block_rows(_context_blocks(shape, left, right, table.times[bucket].at(at)))

    return _every_bucket(texts, shape).groupBy("bucket").applyInPandas(contexts, _BLOCK)


def _count_triples(texts: DataFrame, shape: Shape) -> DataFrame:
    """Order 3: write the triples, what follows each pair and the pairs' continuation counts; the blocks of the latter."""
    scramble, count, n_words, folder = shape.triple_scramble, shape.buckets, np.uint64(shape.first[-1]), shape.folder
    ends = np.array(shape.pair_first[1:])

    def triples(batches):
        table = _tables(shape, PAIRS)

        def keys(column):
            tokens, before, sizes = token_pairs(column)
            pair, number = _pair_keys(shape, table, tokens, before)
            known, inverse = np.unique(pair, return_inverse=True)
            pair = table.pair_numbers(known).astype(np.uint64)[inverse]
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(sizes) - sizes] = False
            inner = np.flatnonzero(inner)
            return scramble.of(pair[inner - 1] * n_words + number[inner])

        for found, n in _gathered(batches, keys):
            yield _rows_by_bucket(found, [n], _buckets(found, scramble.bits, count))

    def merge_triples(pdf: pd.DataFrame) -> pd.DataFrame:
        table, bucket = _tables(shape, PAIRS), int(pdf["bucket"].iloc[0])
        key, n = _merge([_unpack_sorted(k) for k in pdf["keys"]], [_unpack(v) for v in pdf["v0"]])
        _Keys.save(folder, f"triple-{bucket}", key)
        _Counts.save(folder, f"triple-times-{bucket}", n)
        plain = scramble.back(key)
        left, inverse = np.unique(plain // n_words, return_inverse=True)
        followers = [np.bincount(inverse, v, len(left)).astype(np.int64) for v in _by_times(n)]
        middle = table.pair_words(left.astype(np.int64))[1][inverse]
        right, preceded = np.unique(shape.scramble.of(middle * n_words + plain % n_words), return_counts=True)
        return _block_rows([
            (-1, TRIPLE_COUNTS, b"", [_pack(np.array(_counts_of_counts(n)))]),
            *_cut_blocks(FOLLOWERS, left, followers, ends),
            *_cut_blocks(PRECEDED, table.pair_numbers(right).astype(np.uint64), [preceded], ends),
        ])

    def merge_adjusted(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            return _block_rows([(-1, TRIPLE_COUNTS, b"", [_pack(_sum_counts(pdf, TRIPLE_COUNTS))])])
        table, start = _tables(shape, PAIRS), shape.pair_first[bucket]
        at = np.arange(shape.pair_first[bucket + 1] - start)
        if not len(at):
            return _block_rows([])
        key, *followers = _merged_blocks(pdf, FOLLOWERS, 3)
        for k, found in enumerate(followers):
            values = np.zeros(len(at), np.int64)
            values[key - start] = found
            _Counts.save(folder, f"follow{k + 1}-{bucket}", values)
        key, preceded = _merged_blocks(pdf, PRECEDED, 1)
        left, right = table.pair_words(at + start)
        # nothing stands before START: its pairs keep their own counts
        first = left.astype(np.int64) == table.numbers(np.array([START]))[0]
        n = np.where(first, table.times[bucket].at(at), 0)
        n[key - start] = preceded
        _Counts.save(folder, f"adjusted-{bucket}", n)
        return _block_rows(_context_blocks(shape, left, right, n))

    counted = texts.mapInArrow(triples, "bucket int, keys binary, v0 binary").groupBy("bucket").applyInPandas(merge_triples, _BLOCK)
    return counted.union(_every_bucket(texts, shape)).groupBy("bucket").applyInPandas(merge_adjusted, _BLOCK)


def _fit_contexts(blocks: DataFrame, shape: Shape) -> Shape:
    """Write what the driver's shape and the word level need; the whole shape."""
    folder = shape.folder

    def merge_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:  # counts of counts, one line per bucket and kind
            found = [(kind, 0, _sum_counts(pdf, kind).tolist()) for kind in (PAIR_COUNTS, TRIPLE_COUNTS)]
            return pd.DataFrame(found, columns=["kind", "types", "n"])
        start = shape.first[bucket]
        size = shape.first[bucket + 1] - start
        table, mass = np.zeros((size, 4), np.uint32), np.zeros(size, np.int64)
        key, *followers, sums = _merged_blocks(pdf, FOLLOWERS, 4)
        table[key - start, 1:] = np.stack(followers, axis=1)
        mass[key - start] = sums
        key, preceded = _merged_blocks(pdf, PRECEDED, 1)
        table[key - start, 0] = preceded
        _save(folder, f"context-{bucket}", table)
        _save(folder, f"mass-{bucket}", mass)
        follows = table[:, 0].astype(np.int64)
        return pd.DataFrame({"kind": [FOLLOWERS], "types": [int(follows.sum())], "n": [_counts_of_counts(follows) + [int((follows >= 3).sum())]]})

    rows = blocks.groupBy("bucket").applyInPandas(merge_contexts, "kind int, types long, n array<long>").collect()  # a line per bucket
    pairs, triples = (next(r["n"] for r in rows if r["kind"] == kind) for kind in (PAIR_COUNTS, TRIPLE_COUNTS))
    low = np.sum([r["n"] for r in rows if r["kind"] == FOLLOWERS], axis=0)
    types = sum(r["types"] for r in rows)
    low_discounts = discounts(*low[:4].tolist())
    rest = float(np.dot(low_discounts, [low[0], low[1], low[4]]) / types)
    known = asdict(shape) | {
        "pair_types": types, "top_discounts": discounts(*triples), "discounts": discounts(*pairs), "low_discounts": low_discounts, "low_rest": rest,
    }
    with open(f"{folder}/shape.json", "w") as f:
        json.dump(known, f)
    return Shape(**known)


def score_tokens(
    shape: Shape, tokens: np.ndarray, before: np.ndarray, first: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, add-one log10 probability, model log10 probability) of each token after the one before it.

    ``first`` marks the tokens that begin a text. At order 3 every other token
    also has the context of the token in front of it; without ``first`` none has.
    """
    known, inverse = np.unique(np.concatenate([tokens, before]), return_inverse=True)
    vocabulary = shape.words + 1
    if not shape.documents:
        flat = np.full(len(tokens), -math.log10(vocabulary))
        return np.zeros(len(tokens), bool), flat, flat
    table = _tables(shape, CONTEXTS)
    number = table.numbers(known)
    has = np.flatnonzero(number >= 0)
    count, context, mass = np.zeros(len(known), np.int64), np.zeros((len(known), 4), np.int64), np.zeros(len(known), np.int64)
    count[has], context[has], mass[has] = table.of_words(number[has])
    start_at = known == START
    word_count = np.where(start_at, 0, count)
    base = np.log10((word_count + 1) / (shape.tokens + vocabulary))

    def discounted(n, d):
        return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)

    low = discounted(context[:, 0], shape.low_discounts) / shape.pair_types + shape.low_rest / vocabulary
    freed = context[:, 1:] @ np.array(shape.discounts)
    t, b = inverse[: len(tokens)], inverse[len(tokens) :]
    p = low[t].copy()
    after = np.flatnonzero(mass[b] > 0)
    n_words = np.uint64(shape.first[-1])
    both = np.flatnonzero((number[b] >= 0) & (number[t] >= 0))
    pair, where = np.unique(shape.scramble.of(number[b[both]].astype(np.uint64) * n_words + number[t[both]].astype(np.uint64)), return_inverse=True)
    pair = table.pair_numbers(pair)
    pair_count, pair_used, follow = table.of_pairs(pair)
    at = np.full(len(tokens), len(pair), np.int64)  # place of each token's pair; the last place is that of no pair
    at[both] = where
    pair, pair_count, pair_used = np.append(pair, -1), np.append(pair_count, 0), np.append(pair_used, 0)
    p[after] = (discounted(pair_used[at[after]], shape.discounts) + freed[b[after]] * p[after]) / mass[b[after]]
    if shape.order > 2 and first is not None:
        inner = np.flatnonzero(~first)
        inner = inner[pair_count[at[inner - 1]] > 0]  # the pair in front was seen
        top = inner[number[t[inner]] >= 0]
        triple, where = np.unique(
            shape.triple_scramble.of(pair[at[top - 1]].astype(np.uint64) * n_words + number[t[top]].astype(np.uint64)), return_inverse=True
        )
        times = np.zeros(len(tokens), np.int64)
        times[top] = table.of_triples(triple)[where]
        front = at[inner - 1]
        p[inner] = (discounted(times[inner], shape.top_discounts) + (follow @ np.array(shape.top_discounts))[front] * p[inner]) / pair_count[front]
    return word_count[t] > 0, base[t], np.log10(p)


def score_documents(docs: DataFrame, shape: Shape, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("perplexity", T.DoubleType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 2):
                tokens, before, sizes = token_pairs(batch.column(2))
                cut = np.cumsum(sizes) - sizes
                first = np.zeros(len(tokens), bool)
                first[cut] = True
                known, base, model = score_tokens(shape, tokens, before, first)
                total = np.add.reduceat(model, cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), cut)),
                        pa.array(np.full(len(batch), shape.tokens, np.int64)), pa.array(np.add.reduceat(base, cut)),
                        pa.array(total), pa.array(10 ** (-total / sizes)),
                    ],
                    names=schema.fieldNames(),
                )

    rows = docs.select(F.col(id_col).alias("_id"), (~trained_on(F.col(id_col))).alias("_held"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(score, schema)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Learn from the documents that ``trained_on`` marks and score all of them.

    Words are lower-cased (A-Z) runs without white space; one end token closes
    a text and counts as a token. ``score`` is the model's log10 probability of
    the whole text, ``base_score`` the add-one unigram one. At ``order`` 3 a
    token's context is the two tokens before it, with the pair level counted by
    distinct predecessors (pairs that begin a text by their own counts). A null text is
    empty (one end token); a null id is learnt from; repeated rows count each
    time; other columns are ignored; an empty table gives no rows. If nothing
    can be learnt every token gets probability 1 / (distinct + 1).
    """
    shape = fit(docs.where(trained_on(F.col(id_col))), text_col, order=order)
    return score_documents(docs, shape, id_col, text_col)
