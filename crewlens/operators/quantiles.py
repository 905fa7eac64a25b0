"""Exact linear-interpolated quantiles (A11, A13, A20, A30, F6), in two scans whatever the size.

Spark's ``percentile`` keeps a value -> count map per group and merges it in
one task, and a window over a group sorts it there. Here every rank is
bracketed first and then selected inside its bracket:

1. one pass of ``percentile_approx`` gives, for every group, its size and a few
   order statistics of known rank error around each probability: a lower and an
   upper value that enclose the wanted ranks ``floor((n-1)p)`` and
   ``ceil((n-1)p)`` for certain (an open end where a group is too small);
2. a second pass counts rows per value inside the brackets, and per gap between
   them, with map-side combine: a value that most rows share is one row per
   task. A running total over a group's gaps and bracket values, about a
   thousandth of its rows, places the ranks exactly. A rank outside its bracket
   would raise; it is never guessed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: its rank error is at most rows / ACCURACY, four times that is allowed for.
ACCURACY = 10_000


def _brackets(sketch: Column, size: Column, p: float, grid: Sequence[float], accuracy: int) -> tuple[Column, Column]:
    """(lower, upper) value around the ranks of ``p``; ``sketch`` holds the order statistics at ``grid``."""
    below, above = F.floor((size - 1) * F.lit(p)), F.ceil((size - 1) * F.lit(p))
    error = 4 / accuracy
    lower = [F.when((F.lit(g + error) * size + 1) <= below, sketch[i]) for i, g in enumerate(grid) if g < p]
    upper = [F.when((F.lit(g - error) * size - 1) >= above + 1, sketch[i]) for i, g in enumerate(grid) if g > p]
    # both pass over nulls: what is not safe does not count
    return F.greatest(*lower, F.lit(float("-inf")), F.lit(float("-inf"))), F.least(*upper, F.lit(float("inf")), F.lit(float("inf")))


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with the exact quantile for each probability.

    Rows with a null value or a null group key are left out (pandas
    ``groupby`` semantics, N2).
    """
    groups, probs = list(groups), [float(p) for p in probs]
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for g in groups:
        keep = keep & F.col(g).isNotNull()
    rows = df.where(keep).select(*groups, F.col(value).cast("double").alias("_v"))

    # 1. brackets, one row per group: order statistics near each probability, and some farther off for smaller groups
    grid = sorted({round(min(1.0, max(0.0, p + s * w)), 12) for p in probs for w in (8 / accuracy, 1 / 32) for s in (-1, 1)} - set(probs))
    sketch = F.percentile_approx("_v", F.array(*[F.lit(g) for g in grid]), F.lit(accuracy))
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"), sketch.alias("_s"))
    ends = []
    for i, p in enumerate(probs):
        low, high = _brackets(F.col("_s"), F.col("_size"), p, grid, accuracy)
        ends += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    brackets = sizes.select(*groups, *ends)
    # without groups the brackets are one row; with groups AQE broadcasts them once their size is known
    placed = rows.join(brackets, groups) if groups else rows.crossJoin(F.broadcast(brackets))

    # 2. rows per value inside a bracket, and per gap after the brackets that begin at or before the value
    v = F.col("_v")
    begun = [v >= F.col(f"_lo{i}") for i in range(len(probs))]
    gap = reduce(lambda a, b: a + b, [F.when(b, 1).otherwise(0) for b in begun])
    inside = reduce(lambda a, b: a | b, [b & (v <= F.col(f"_hi{i}")) for i, b in enumerate(begun)])
    counts = placed.select(*groups, gap.alias("_gap"), F.when(inside, v).alias("_v")).groupBy(*groups, "_gap", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    # values of a gap's brackets stand before what lies beyond them, which has no value
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = over.orderBy("_gap", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_size", F.sum("_c").over(over))
    begin, last = F.col("_end") - F.col("_c"), F.col("_size") - 1
    picked = []
    for p, name in zip(probs, names):
        h = last * F.lit(p)
        sides = []
        for f in (F.floor, F.ceil):
            rank = f(h).cast("long")
            here = (rank >= begin) & (rank < F.col("_end"))
            sides.append(F.max(F.when(here, F.coalesce(v, F.raise_error(F.lit("a rank lies outside its bracket"))))))
        share = F.max(h - F.floor(h))
        picked.append((sides[0] + share * (sides[1] - sides[0])).alias(name))
    out = counts.groupBy(*groups).agg(*picked)
    return out if groups else out.where(F.col(names[0]).isNotNull())
