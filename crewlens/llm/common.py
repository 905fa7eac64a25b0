"""Shared pieces of the training-data operators: tables, written intermediates,
dense numbering and connected components, all as Spark jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset folder, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name; Spark takes names that differ in case as one."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def local_view(path: str) -> str:
    """The shared folder as a path that ``open`` and ``mmap`` understand.

    Workers can map files only from a mounted file system; any other scheme is
    refused here rather than failing later inside a task.
    """
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return path
    raise ValueError(f"memory-mapped models need a mounted shared folder, got {path}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what was written survives lost executors, and partition
    or row numbers taken while writing stay as they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_parts(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Range-partition by ``keys`` into the session's shuffle partitions (AQE may merge neighbours)."""
    return df.repartitionByRange(*keys)


def dense_index(df: DataFrame, group: str, order: Sequence[str], out: str, name: str) -> DataFrame:
    """``df`` plus ``out``: 0, 1, 2 ... within each ``group`` in ``order``, without a task per group.

    Rows are range-partitioned by (group, order) and written once, each with
    its partition number. Rows are numbered inside (partition, group) only;
    the offset of a slice is a running sum over one row per (partition, group).
    A group of any size is spread over as many partitions as it fills.
    """
    spread = range_parts(df, [F.col(group), *[F.col(c) for c in order]]).withColumn("_part", F.spark_partition_id())
    parts = materialize(spread, name)
    local = Window.partitionBy("_part", group).orderBy(*order)
    numbered = parts.withColumn("_local", F.row_number().over(local) - 1)
    slices = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    joined = numbered.join(offsets, numbered[group].eqNullSafe(offsets["_g"]) & (numbered["_part"] == offsets["_p"]))
    return joined.withColumn(out, (F.col("_base") + F.col("_local")).cast("long")).drop(
        "_g", "_p", "_base", "_local", "_part"
    )


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has long columns ``src``, ``dst``. Returns (``id``, ``component``)
    for every vertex with an edge to another vertex; ``component`` is the
    smallest id reachable. Each round is two shuffles with map-side minima; a
    hub's edges are split by AQE in the join, never gathered in one task.
    Rounds are written to the shared folder. Empty input gives no rows.
    """
    cur = edges.where(F.col("src") != F.col("dst"))
    cur = materialize(cur.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u moves to the smallest of u's neighbourhood
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v"))
        # small-star: every smaller neighbour of u, and u, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen = cur.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (seen["n"], seen["h"]) == mark:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                cur.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).distinct()
        mark = (seen["n"], seen["h"])
    raise RuntimeError("components did not settle")
