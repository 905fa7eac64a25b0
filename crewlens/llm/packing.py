"""Packing by power-of-two decomposition.

A document of n token ids is cut into pieces of ``max_length`` and then the
binary digits of the rest, longest first, so every piece length is a power of
two. Pieces of equal length form a bucket; each piece is a training sequence of
its own, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.bytescan import small_batches
from crewlens.llm.common import materialize
from crewlens.llm.tokenize import WORD_BPE, Vocabulary, encoder, with_end

MAX_LENGTH = 4096
END_ID = 2
#: Rows of the (bucket, partition) table that may be broadcast, some 30 bytes each.
BROADCAST_SLICES = 500_000


def binary_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Piece lengths of a document of ``n`` ids, longest first."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: Vocabulary = WORD_BPE,
    vocab_path: str | None = None,
    end_id: int = END_ID,
    max_length: int = MAX_LENGTH,
    with_ids: bool = True,
    memo_pieces: int | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``bucket`` (the length's power of two) and, unless
    ``with_ids`` is false, ``ids``.

    Sequences are numbered 0, 1, 2 ... over the whole table, longest bucket
    first, so a bucket is one range of numbers. Documents are encoded in place
    and never shuffled; the numbers come from counts per input partition.

    A null text counts as empty (a single piece: the end id); a null id stays
    null; every repeated row is packed as a document of its own; columns other
    than id and text are ignored; an empty table gives no rows. Texts of any
    length are encoded whole, in blocks. ``memo_pieces`` bounds what a worker
    keeps between batches (memory only, no effect on the rows).
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    id_type = docs.schema[id_col].dataType
    fields = [
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("bucket", T.IntegerType()), T.StructField("_part", T.IntegerType()),
        T.StructField("_nth", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, vocab_path, memo_pieces)
        part = TaskContext.get().partitionId()
        seen = [0] * max_length.bit_length()
        for batch in (b for whole in batches for b in small_batches(whole, 1)):
            ids, lengths = with_end(*enc.encode(batch.column(1)), end_id)
            raw = memoryview(ids.astype("<u4")).cast("B")
            row, start, length, crc, bucket, nth = [], [], [], [], [], []
            at = 0
            for i, n in enumerate(lengths.tolist()):
                first = at
                for size in binary_lengths(n, max_length):
                    b = size.bit_length() - 1
                    row.append(i)
                    start.append(at - first)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    bucket.append(b)
                    nth.append(seen[b])
                    seen[b] += 1
                    at += size
            rows = np.array(row, np.int64)
            cols = [
                batch.column(0).take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(lengths[rows], pa.int64()), pa.array(bucket, pa.int32()),
                pa.array(np.full(len(rows), part), pa.int32()), pa.array(nth, pa.int64()),
            ]
            if with_ids:
                edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    pieces = materialize(source.mapInArrow(cut, T.StructType(fields)), "pieces")
    # where each (bucket, partition) starts: one row per bucket and input partition
    slices = pieces.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = slices.groupBy("bucket").agg(F.sum("_n").alias("_size"))
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    bases = sizes.select("bucket", F.coalesce(F.sum("_size").over(longer), F.lit(0)).alias("_base"))
    starts = slices.join(bases, "bucket").select("bucket", "_part", (F.col("_before") + F.col("_base")).alias("_from"))
    if slices.count() <= BROADCAST_SLICES:  # the ids then stay where they are; beyond it they are shuffled by slice
        starts = F.broadcast(starts)
    return pieces.join(starts, ["bucket", "_part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_from") + F.col("_nth")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "bucket", *(["ids"] if with_ids else []),
    )
