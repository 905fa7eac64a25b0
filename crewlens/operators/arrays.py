"""Element-wise statistics over an array column, without a row per element.

A person's attributes are one array. Sums over it are vector aggregates (Spark
ML's ``Summarizer``: map-side partial sums, one buffer per group), so the rows
that shuffle are one per task and group, not one per person and attribute. The
finished statistics, one row per group, are turned into (idx, value) rows by an
unpivot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_rows(df: DataFrame, keep: Sequence[str], values: str, n: int, out: str) -> DataFrame:
    """``keep``, ``idx`` (1 .. ``n``) and ``out``, the element of the array ``values`` at ``idx``.

    ``df`` has one row per group; elements are placed by an unpivot.
    """
    if not n:
        return df.selectExpr(*keep, "0 AS idx", f"CAST(NULL AS double) AS {out}").limit(0)
    names = [f"_{i + 1}" for i in range(n)]
    wide = df.selectExpr(*keep, *[f"get({values}, {i}) AS _{i + 1}" for i in range(n)])
    long = wide.unpivot(list(keep), names, "_i", out)
    return long.selectExpr(*keep, "CAST(substring(_i, 2) AS int) AS idx", out)


def array_mean(values: str | Column) -> Column:
    """Aggregate: element-wise mean of an array column (all rows of one length, no null elements)."""
    return vector_to_array(Summarizer.mean(array_to_vector(values)))


def array_correlations(df: DataFrame, groups: Sequence[str], values: str, y: str, n: int, out: str = "r") -> DataFrame:
    """Pearson r of every element of ``values`` with ``y``: ``groups``, ``idx``, ``out``, ``n``.

    Rows have ``n`` non-null elements and a ``y``. A group without spread on
    either side gives null, as N8. One pass and one row per group and task.
    """
    x = array_to_vector(values)
    xy = array_to_vector(F.transform(values, lambda v: v * F.col(y)))
    keys = list(groups) or ["_all"]
    src = df if groups else df.withColumn("_all", F.lit(0))
    sums = src.groupBy(*keys).agg(
        Summarizer.metrics("mean", "variance").summary(x).alias("_x"), Summarizer.mean(xy).alias("_xy"),
        F.avg(y).alias("_y"), F.stddev_pop(y).alias("_sy"), F.count(F.lit(1)).alias("n"),
    )
    spread = F.transform(vector_to_array("_x.variance"), lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n")) * F.col("_sy"))
    shared = F.zip_with(vector_to_array("_xy"), "_mx", lambda p, m: p - m * F.col("_y"))
    parts = sums.withColumn("_mx", vector_to_array("_x.mean"))
    parts = parts.select(*groups, "n", F.zip_with(shared, spread, lambda c, s: c / F.nullif(s, F.lit(0.0))).alias("_r"))
    return element_rows(parts, [*groups, "n"], "_r", n, out).select(*groups, "idx", out, "n")


def gram_matrix(df: DataFrame, features: Sequence[Column], values: str | None, y: str) -> dict:
    """Second moments of (features, elements of ``values``, ``y``) in one vector aggregate.

    Returns ``n``, ``means`` and ``products``: the means of all columns, and of
    the upper triangle of their products row by row. Only these numbers reach
    the driver: their count is fixed by the columns, not by the rows. Empty
    input gives ``n`` = 0.
    """
    row = F.array(*[c.cast("double") for c in features])
    row = F.concat(row, F.col(values)) if values else row
    z = df.select(F.concat(row, F.array(F.col(y).cast("double"))).alias("z"), F.lit(0).alias("_all"))
    products = F.flatten(F.transform("z", lambda a, i: F.transform(F.slice("z", i + 1, F.size("z") - i), lambda b: a * b)))
    got = z.groupBy("_all").agg(
        F.count(F.lit(1)).alias("n"), array_mean("z").alias("means"), array_mean(products).alias("products")
    ).first()
    return {"n": 0, "means": [], "products": []} if got is None else got.asDict()
