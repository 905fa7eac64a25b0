"""Token-id files: Parquet list columns in ascending document order.

Token ids are dictionary-encoded (a vocabulary fits in one dictionary page);
document ids, lengths and starts are delta-encoded. Row groups and pages are
kept small and Parquet's page indexes are written, so a reader can fetch the
metadata columns alone, or the ids of a few documents, without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.bytescan import small_batches
from crewlens.llm.tokenize import BYTE_BPE, Vocabulary, encoder, with_end

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

METADATA = ["doc_id", "part", "part_start", "n_tokens"]


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: Vocabulary = BYTE_BPE,
    vocab_path: str | None = None,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode whole texts and write ``path``: one row per document in ascending id order.

    Columns: ``doc_id``, ``part`` (files in ascending order), ``part_start``
    (ids before the document in its part), ``n_tokens`` (with the end id) and
    ``ids``. Documents are range-partitioned by (id, hash of the text, row), so
    one id that many rows share still spreads; rows with equal ids are ordered
    by the hash of their text. Null ids come first, null texts are empty,
    repeated rows are kept, other columns are ignored, an empty table writes
    files without rows.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, vocab_path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in (b for whole in batches for b in small_batches(whole, 1)):
            ids, lengths = with_end(*enc.encode(batch.column(1)), end_id)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(len(lengths), part), pa.int32()),
                    pa.array(edges[:-1] + before, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)),
                ],
                names=schema.fieldNames(),
            )
            before += int(edges[-1])

    order = ["_id", "_hash", "_row"]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    source = source.withColumn("_hash", F.xxhash64("_text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    writer = ordered.mapInArrow(encode, schema).write.option("compression", "zstd")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    for name in METADATA:  # integers without a dictionary are delta-encoded by version 2 writers
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.option("parquet.dictionary.page.size", 1 << 20).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(``part``, ``base``): ids in all parts before; one row per part."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` of every document, without reading token pages."""
    return _placed(spark.read.parquet(path).select(*METADATA), spark, path).select("doc_id", "start", "n_tokens")


def read_documents(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids``; with ``doc_ids`` only pages that may hold them are read."""
    rows = spark.read.parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return _placed(rows, spark, path).select("doc_id", "start", "n_tokens", "ids")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    joined = rows.join(part_starts(spark, path), "part")
    return joined.withColumn("start", (F.col("base") + F.col("part_start")).cast("long"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, computed from the files' ids."""
    stored = spark.read.parquet(path)
    id_type = stored.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            edges = ids.offsets.to_numpy().tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(edges, edges[1:])]
            lengths = [z - a for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.fieldNames(),
            )

    rows = stored.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(digest, schema)
    return _placed(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
