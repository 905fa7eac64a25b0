"""Generic DataFrame operators used by the pipelines (P, F, A, W, O, U, R ids of SURVEY §2).

Design rules applied here:

* keep-first / keep-last / arg-max are ``min_by`` / ``max_by`` aggregates:
  partial aggregation runs map-side, so a key holding a third of the rows
  never has to be sorted inside one task the way a per-key window would;
* zero-filled cross-tabs pivot over an explicit, bounded list of column
  values (never a cross join of key sets);
* "share of partition total" joins a small per-partition total back instead
  of an unbounded window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.functions.stats import rounded

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# -- projection (P1-P8, P12) -------------------------------------------------
def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drop every column whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def cols_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """The column group selected by prefix, in schema order."""
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def rename_literals(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply literal substring replacements to every column name, in order."""
    names = []
    for c in df.columns:
        for old, new in pairs:
            c = c.replace(old, new)
        names.append(c)
    return df.toDF(*names)


def move_first(df: DataFrame, col: str) -> DataFrame:
    """Move ``col`` to the front (no-op when absent)."""
    if col not in df.columns:
        return df
    return df.select(col, *[c for c in df.columns if c != col])


def with_fallback(df: DataFrame, col: str, fallback: Column) -> DataFrame:
    """Add ``col`` from a fallback expression when the schema lacks it."""
    return df if col in df.columns else df.withColumn(col, fallback)


def presence_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``notna -> 0/1`` flags for the named source columns."""
    return df.select(
        "*", *[F.col(src).isNotNull().cast("int").alias(flag) for flag, src in flags.items() if src in df.columns]
    )


# -- window-like operators (W1-W3, W5) ----------------------------------------
def keep_by(df: DataFrame, keys: Sequence[str], order: Column, last: bool) -> DataFrame:
    """One row per key, the one with the highest (``last``) or lowest order.

    Implemented as ``max_by``/``min_by`` of the whole row: a partial aggregate
    per map task, so hot keys are pre-reduced before the shuffle.
    """
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in payload])
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def ranked(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """O3: all rows with their 1-based rank by ``order``.

    For tables of one row per area, attribute or period: the single window
    partition holds as many rows as there are such names.
    """
    from pyspark.sql import Window

    return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def top_k(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per partition by ``order`` with their 1-based rank.

    Used on already-aggregated tables (one row per group and item), so each
    window partition holds a bounded number of rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# -- aggregations (A4, A5, A19-A24) ---------------------------------------
def share_within(df: DataFrame, part: Sequence[str], n_col: str = "n", out: str = "pct") -> DataFrame:
    """``n / sum(n) over (partition by part) * 100`` via a joined per-partition total."""
    tot = df.groupBy(*part).agg(F.sum(n_col).alias("_tot")) if part else df.agg(F.sum(n_col).alias("_tot"))
    joined = df.join(tot, list(part)) if part else attach_one_row(df, tot)
    return joined.withColumn(out, rounded(F.col(n_col) * 100.0 / F.nullif(F.col("_tot"), F.lit(0)))).drop("_tot")


def value_counts(df: DataFrame, cols: Sequence[str], dropna: bool = True) -> DataFrame:
    """A4: counts per value (null bucket kept unless ``dropna``)."""
    src = df
    if dropna:
        for c in cols:
            src = src.where(F.col(c).isNotNull())
    return src.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def crosstab_zero_fill(
    df: DataFrame, row: Sequence[str], col: str, values: Sequence | None, n_col: str = "n"
) -> DataFrame:
    """Long cross-tab with zero cells for every row key x column value.

    Pivoting over a bounded value list (fixed, or the column's distinct values
    found by Spark's pivot) makes the zero cells without a cross join; the
    unpivot brings the table back to long form.
    """
    g = df.groupBy(*row)
    counts = (g.pivot(col, list(values)) if values is not None else g.pivot(col)).agg(F.count(F.lit(1)))
    names = [c for c in counts.columns if c not in row]
    if not names:  # empty input: no column values to pivot on
        return df.select(*row, F.col(col).cast("string").alias(col), F.lit(0).cast("long").alias(n_col)).limit(0)
    filled = counts.na.fill(0, subset=names)
    return filled.unpivot(list(row), names, col, n_col).withColumn(n_col, F.col(n_col).cast("long"))


def null_profile(df: DataFrame, table: str | None = None) -> DataFrame:
    """Null count and % per column, only columns with nulls. One pass."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns
    ]
    wide = df.agg(*aggs)
    long = wide.unpivot(["__rows"], list(df.columns), "coluna", "nulos")
    out = long.where(F.col("nulos") > 0).select(
        "coluna",
        F.col("nulos").cast("long").alias("nulos"),
        rounded(F.col("nulos") * 100.0 / F.nullif(F.col("__rows"), F.lit(0))).alias("pct_nulos"),
    )
    return out.withColumn("tabela", F.lit(table)) if table else out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75 %, max per numeric column.

    Columns are unpivoted to ``(coluna, valor)`` so one group-by computes every
    column's moments; the quartiles come from the distributed exact-quantile
    operator (``summary()`` would use approximate percentiles, ``percentile``
    would hold every distinct value of a column in one task).
    """
    from crewlens.operators.quantiles import exact_quantiles

    cols = list(cols or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "coluna", "valor")
    moments = long.groupBy("coluna").agg(
        F.count("valor").alias("count"),
        rounded(F.avg("valor")).alias("mean"),
        rounded(F.stddev_samp("valor")).alias("std"),
        rounded(F.min("valor")).alias("min"),
        rounded(F.max("valor")).alias("max"),
    )
    q = exact_quantiles(long, ["coluna"], "valor", [0.25, 0.5, 0.75], ["_p25", "_p50", "_p75"])
    return moments.join(q, "coluna", "left").select(
        "coluna", "count", "mean", "std", "min",
        rounded("_p25").alias("p25"), rounded("_p50").alias("p50"), rounded("_p75").alias("p75"), "max",
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows minus distinct rows on ``keys`` (all columns when None), as a one-row table.

    Grouping treats nulls as one value, matching pandas ``duplicated``; the
    per-key counts are partial-aggregated, then summed in a second aggregate.
    """
    src = df.select(*keys) if keys else df
    per_key = src.groupBy(*src.columns).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("linhas"),
        F.count(F.lit(1)).alias("distintos"),
    ).select("linhas", "distintos", (F.col("linhas") - F.col("distintos")).alias("duplicados"))


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate) to every row.

    ``one_row`` comes from an ungrouped ``agg``, so its size is exactly one row
    whatever the input size: broadcasting it is always safe.
    """
    return df.crossJoin(F.broadcast(one_row))


def duplicated_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once (``keep=False``).

    A partial-aggregated key count plus a semi-join: skewed keys are pre-reduced
    map-side and AQE splits a hot key on the probe side of the join.
    """
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return df.join(dup, [df[k].eqNullSafe(dup[k]) for k in keys], "left_semi")


def key_overlap(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Presence flags of each distinct key across tables (full outer join)."""
    out = None
    for name, df in sets.items():
        s = df.select(F.col(key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(f"in_{name}", F.lit(1))
        out = s if out is None else out.join(s, key, "full")
    return out.na.fill(0, subset=[f"in_{n}" for n in sets])


# -- reshape (R1-R3) -------------------------------------------------------
def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Wide -> long, nulls kept (``DataFrame.unpivot`` keeps them)."""
    return df.unpivot(list(ids), list(values), var, val)


def unstack(df: DataFrame, row: Sequence[str], col: str, values: Iterable | None, agg: Column) -> DataFrame:
    """R2: long -> wide over an explicit value list (or the column's distinct values)."""
    g = df.groupBy(*row)
    return (g.pivot(col, list(values)) if values is not None else g.pivot(col)).agg(agg)
