"""Statistics as aggregate / column expressions.

All of these are built-in Spark aggregates composed so that degenerate
groups give NULL instead of raising under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output doubles are rounded to this many places wherever two engines might
# sum in a different order (last-bit noise); binning always uses raw values.
DISPLAY_SCALE = 6


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pearson(x, y) -> Column:
    """Pearson r over rows where both sides are non-null.

    ``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI; the
    covariance form with ``nullif`` returns NULL for n < 2 or zero variance.
    """
    x, y = _c(x), _c(y)
    both_x = F.when(y.isNotNull(), x)
    both_y = F.when(x.isNotNull(), y)
    denom = F.stddev_pop(both_x) * F.stddev_pop(both_y)
    return F.covar_pop(x, y) / F.nullif(denom, F.lit(0.0))


def rounded(col, scale: int = DISPLAY_SCALE) -> Column:
    return F.round(_c(col), scale)


def cut3(x, e0, e1, e2, e3, labels: tuple[str, str, str]) -> Column:
    """``pd.cut(x, [e0,e1,e2,e3], include_lowest=True)``.

    Right-closed bins, the first one also closed on the left; values outside
    the edges (and nulls) get NULL. Equal inner edges leave a band empty.
    """
    x = _c(x)
    e0, e1, e2, e3 = (F.lit(e) if not isinstance(e, Column) else e for e in (e0, e1, e2, e3))
    return (
        F.when((x >= e0) & (x <= e1), F.lit(labels[0]))
        .when((x > e1) & (x <= e2), F.lit(labels[1]))
        .when((x > e2) & (x <= e3), F.lit(labels[2]))
    )


def quantile_cuts(df: DataFrame, col: str, probs=(0.33, 0.66), names=("q33", "q66")) -> DataFrame:
    """One-row table of exact linear-interpolated quantiles.

    Computed by the size-checked exact operator (no value map of the whole
    population in one task). The result is one row, safe to broadcast; an
    empty input gives one row of nulls, like an ungrouped aggregate.
    """
    from crewlens.operators.quantiles import exact_quantiles

    return _one_row(exact_quantiles(df, [], col, list(probs), list(names)), names)


def _one_row(q: DataFrame, names) -> DataFrame:
    """Exactly one row: the quantiles, or nulls when the input was empty."""
    return q.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def zscore_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row mean / population std per column (sklearn ``StandardScaler``)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_zscore(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """z = (x - mean) / std with std 0 treated as 1; stats joined as one broadcast row."""
    # one-row global aggregate: broadcast size is fixed
    joined = df.crossJoin(F.broadcast(stats))
    out = [F.col(c) for c in df.columns if c not in cols]
    for c in cols:
        scale = F.coalesce(F.nullif(F.col(f"{c}__std"), F.lit(0.0)), F.lit(1.0))
        out.append(((F.col(c) - F.col(f"{c}__mean")) / scale).alias(c))
    return joined.select(*out)


def strength_words(r) -> Column:
    """Correlation wording (|r| >= .4 strong, >= .2 moderate, else weak; sign)."""
    r = _c(r)
    force = F.when(F.abs(r) >= 0.4, F.lit("forte")).when(F.abs(r) >= 0.2, F.lit("moderada")).otherwise(F.lit("fraca"))
    direction = F.when(r > 0, F.lit("positiva")).otherwise(F.lit("negativa"))
    return F.when(r.isNotNull(), F.concat_ws(" ", force, direction))


def trend_class(diff) -> Column:
    """Last - first > 0 growing, = 0 stable, < 0 declining."""
    d = _c(diff)
    return (
        F.when(d > 0, F.lit("Crescente"))
        .when(d == 0, F.lit("Estável"))
        .when(d < 0, F.lit("Decrescente"))
    )
