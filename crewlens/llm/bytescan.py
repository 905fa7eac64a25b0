"""Whole Arrow text columns scanned as one byte buffer with numpy.

Words are found and hashed without a Python object per word, so a task's cost
is a few array passes over its bytes. Work goes in blocks of bounded size that
are cut at white space, so neither a large batch nor one very long text makes
the temporaries grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
#: Spans over so many bytes have a hash of their own.
LONG_SPAN = 48

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# one random odd 64-bit weight per byte value, from a fixed seed
_WEIGHT = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span.

    Short spans come from one running sum over the buffer, a polynomial modulo
    2^64, whose collisions need long regular strings; spans over ``LONG_SPAN``
    bytes are hashed one by one with XXH3.
    """
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_WEIGHT[buf] * _power_table(_BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(_INVERSE, n + 1)[starts]
    out = mix64(h + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        spans = zip(starts[long].tolist(), ends[long].tolist())
        out[long] = np.array([xxhash.xxh3_64_intdigest(raw[a:z], seed=len(_WEIGHT)) for a, z in spans], np.uint64)
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, raw, data = column.buffers()
    offs = np.frombuffer(raw, np.int64, len(column) + 1 + column.offset)[column.offset :]
    if data is None or len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def small_batches(batch: pa.RecordBatch, text_at: int, limit: int = 2 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text each (a longer text is a run alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // limit
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cut, cut[1:]):
        yield batch.slice(a, z - a)


def blocks(buf: np.ndarray, rows: np.ndarray | None = None, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes; each cut stands before a space or line feed
    that follows a printable ASCII byte and precedes one, or at the start of one
    of ``rows`` where a script has no such spaces."""
    at, n = 0, len(buf)
    while at < n:
        end = at + size
        while end < n:
            part = buf[max(at + 1, end - 65536) : end + 1]
            ink = (part > 0x20) & (part < 0x7F)
            fit = np.flatnonzero(((part[1:-1] == 0x20) | (part[1:-1] == 0x0A)) & ink[:-2] & ink[2:])
            if len(fit):
                end = max(at + 1, end - 65536) + 1 + int(fit[-1])
                break
            row = 0 if rows is None else int(rows[np.searchsorted(rows, end, "right") - 1])
            if row > at:
                end = row
                break
            end += min(size, 65536)
        end = min(end, n)
        yield at, end
        at = end


def word_spans(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+`` runs; a run also ends where a document starts."""
    ink = np.zeros(len(buf) + 2, bool)
    ink[1:-1] = ~SPACE[buf]
    starts, ends = ink[1:] & ~ink[:-1], ink[:-1] & ~ink[1:]
    inner = doc_starts[(doc_starts > 0) & (doc_starts < len(buf))]
    joint = inner[ink[inner] & ink[inner + 1]]
    starts[joint] = True
    ends[joint] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hash of every lower-cased (A-Z) word in order, and
    the number of words of each row."""
    buf, offs = text_buffer(column)
    hashes, counts = [], np.zeros(len(offs) - 1, np.int64)
    for a, z in blocks(buf, offs):
        part = LOWER[buf[a:z]]
        first = np.searchsorted(offs, a, "left")
        last = np.searchsorted(offs, z, "left")
        starts, ends = word_spans(part, offs[first:last] - a)
        hashes.append(span_hashes(part, starts, ends))
        row = np.searchsorted(offs, starts + a, "right") - 1
        counts += np.bincount(row, minlength=len(counts))[: len(counts)]
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts
