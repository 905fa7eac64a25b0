"""Next value within a key in order (``lead`` over a key) without a hot-key task.

Deriving ``end_date`` of a history row from the next ``start_date`` of the
same person is ``lead() over (partition by person order by start)``; a plain
window sorts each key inside one task. Here ``lead`` runs inside (key, slice),
where ``slice`` is a coarser form of the order (the day or month of a
timestamp), and the last row of a slice takes the first value of the key's
next slice, found over one row per (key, slice). One lazy plan for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.session import written_once


def neighbour_in_group(df: DataFrame, key: str, order: Sequence[str], value: str, out: str, slice: Column, back: bool = False) -> DataFrame:
    """``df`` plus ``out`` = ``value`` of the next (``back``: previous) row of the same ``key``, null at the end.

    ``slice`` must not decrease along ``order`` within a key.
    """
    order = list(order)
    step = F.lag if back else F.lead
    rows = df.withColumn("_slice", slice)
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    rows = rows.withColumn("_near", step(value).over(inside)).withColumn("_edge", step(F.lit(1)).over(inside).isNull())
    pick = F.max_by if back else F.min_by
    ends = df.withColumn("_slice", slice).groupBy(key, "_slice").agg(pick(value, F.struct(*[F.col(c) for c in order])).alias("_end"))
    across = ends.select(
        F.col(key).alias("_k"), F.col("_slice").alias("_s"), step("_end").over(Window.partitionBy(key).orderBy("_slice")).alias("_far"),
    )
    # only the edge row of a slice looks across
    match = F.col("_edge") & rows[key].eqNullSafe(across["_k"]) & rows["_slice"].eqNullSafe(across["_s"])
    joined = rows.join(across, match, "left")
    return joined.withColumn(out, F.when(F.col("_edge"), F.col("_far")).otherwise(F.col("_near"))).select(*df.columns, out)


def next_in_group(df: DataFrame, key: str, order: Sequence[str], value: str, out: str, slice: Column) -> DataFrame:
    """``neighbour_in_group``, forward."""
    return neighbour_in_group(df, key, order, value, out, slice)


def numbered(df: DataFrame, order: str, tie: str, out: str) -> DataFrame:
    """``df`` plus ``out`` = 1, 2, 3 ... by (``order``, ``tie``), without a task for all rows.

    Rows are range-partitioned by the order itself (by its sampled quantiles, so
    an outlier moves nothing) and written once, each with its partition; they are
    numbered inside their partition, and a running total over one row per
    partition places the partitions.
    """
    spread = df.repartitionByRange(F.col(order), F.col(tie)).withColumn("_part", F.spark_partition_id())
    rows = written_once(spread, "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order, tie))
    return rows.withColumn("_in", inside).join(starts, "_part").withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).select(*df.columns, out)
