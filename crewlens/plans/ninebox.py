"""9-box talent matrix family (D7, D8, D9, D21; A24, A13, X15-X17, F5, O2).

Shape of every plan here: the population (>= 2 evaluations, potential known)
is one join of people with the per-person performance summary; the tercile
cuts are a one-row exact-percentile aggregate cross-joined as a broadcast
(J11), so banding is a narrow projection and the only shuffles are the
person-key join and the final small group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.functions import labels as L
from crewlens.functions.stats import cut3, quantile_cuts, rounded
from crewlens.operators.arrays import array_mean, element_rows
from crewlens.operators.core import attach_one_row, value_counts
from crewlens.plans.people import PeopleModel

MIN_EVALUATIONS = 2


def population(m: PeopleModel, *extra_cols: str, restrict: DataFrame | None = None) -> DataFrame:
    """people with >= 2 scored periods and a potential score.

    ``restrict`` is an optional key set (semi-join), e.g. people with all
    attributes complete for the profile view (D9), which recomputes terciles
    on that smaller population exactly like the reference.
    """
    df = m.base("potencial_bruto", "perf_media", "n_avaliacoes", *extra_cols).where(
        (F.col("n_avaliacoes") >= MIN_EVALUATIONS) & F.col("potencial_bruto").isNotNull()
    )
    if restrict is not None:
        df = df.join(restrict, "cpf", "left_semi")
    return df


def banded(m: PeopleModel, *extra_cols: str, restrict: DataFrame | None = None) -> DataFrame:
    """Population with q33/q66 cuts, performance band, potential band and quadrant."""
    pop = population(m, *extra_cols, restrict=restrict)
    cuts = quantile_cuts(pop, "potencial_bruto", L.POT_PROBS, ("q33", "q66"))
    e = L.PERF_EDGES
    return (
        attach_one_row(pop, cuts)
        .withColumn("perf_cat", cut3("perf_media", e[0], e[1], e[2], e[3], L.PERF_LABELS))
        .withColumn(
            "pot_cat", cut3("potencial_bruto", L.POT_LOW, F.col("q33"), F.col("q66"), L.POT_HIGH, L.POT_LABELS)
        )
        .withColumn("quadrante", L.quadrant_of("pot_cat", "perf_cat"))
    )


def matrix(m: PeopleModel) -> DataFrame:
    """Counts and % of total for all nine cells (zero-filled), with the rank product."""
    spark = m.people_raw.sparkSession
    counts = (
        banded(m)
        .where(F.col("pot_cat").isNotNull() & F.col("perf_cat").isNotNull())
        .groupBy("pot_cat", "perf_cat")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dim = L.quadrant_dim(spark)
    # 9 rows at most on each side: the grid join and the total are tiny, so the
    # total is a window over the 9-row grid (no second pass over the population)
    from pyspark.sql import Window

    grid = dim.join(F.broadcast(counts), ["pot_cat", "perf_cat"], "left").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0).cast("long"))
    )
    total = F.sum("n").over(Window.partitionBy())
    return grid.select(
        "pot_cat", "perf_cat", "quadrante", "n",
        rounded(F.col("n") * 100.0 / F.nullif(total, F.lit(0))).alias("pct"),
        "valor",
    )


def listing(m: PeopleModel, quadrants: tuple[str, ...] = ()) -> DataFrame:
    """One row per person of the population with bands and quadrant,
    of the chosen ``quadrants`` if any are given (F11).

    ``ordem`` carries the fixed listing order of the quadrant (O2); the
    reference sorts by it and then by performance descending.
    """
    b = banded(m, "nome_completo", "area")
    if quadrants:
        b = b.where(F.col("quadrante").isin(*quadrants))
    out = b.select(
        "cpf", "nome_completo", "area",
        rounded("potencial_bruto").alias("potencial_bruto"),
        rounded("perf_media").alias("perf_media"),
        "pot_cat", "perf_cat", "quadrante",
        L.order_rank("quadrante", L.QUADRANT_ORDER).alias("ordem"), F.col("perf_media").alias("_raw"),
    )
    # O2: distributed sort on raw values (range shuffle); unmapped quadrants (rank 0) last
    return out.orderBy(F.col("ordem") == 0, "ordem", F.col("_raw").desc(), "cpf").drop("_raw")


def quadrant_counts(m: PeopleModel) -> DataFrame:
    """A4 over quadrants (value counts of the listing, 'N/A' kept)."""
    return value_counts(banded(m), ["quadrante"], dropna=False)


def profile(m: PeopleModel) -> DataFrame:
    """Mean of each attribute per quadrant, terciles recomputed on the
    complete-attribute population (A26 on long form)."""
    b = banded(m, restrict=m.attrs_complete()).select("cpf", "quadrante")
    means = m.complete_vectors().join(b, "cpf").groupBy("quadrante").agg(array_mean("attrs").alias("_m"), F.count(F.lit(1)).alias("n"))
    rows = element_rows(means, ["quadrante", "n"], "_m", m.n_attributes(), "media")
    return rows.select("quadrante", "idx", rounded("media").alias("media"), "n")


def profile_wide(m: PeopleModel) -> DataFrame:
    """The profile transposed, one row per attribute, one column per quadrant
    (pivot over the fixed quadrant order)."""
    return profile(m).groupBy("idx").pivot("quadrante", list(L.QUADRANT_ORDER)).agg(F.first("media"))


def moves(m: PeopleModel) -> tuple[DataFrame, DataFrame]:
    """Promotable (high potential, low/middle performance) and at-risk lists."""
    b = banded(m, "nome_completo", "area")
    cols = [
        "cpf", "nome_completo", "area",
        rounded("potencial_bruto").alias("potencial_bruto"),
        rounded("perf_media").alias("perf_media"),
    ]
    promotable = (
        b.where((F.col("pot_cat") == "Alto") & F.col("perf_cat").isin(*L.PROMOTABLE_PERF))
        .select(*cols, F.col("potencial_bruto").alias("_raw"))
        .orderBy(F.col("_raw").desc(), "cpf").drop("_raw")
    )
    at_risk = (
        b.where((F.col("pot_cat") == "Baixo") & (F.col("perf_cat") == "Baixa"))
        .select(*cols, F.col("perf_media").alias("_raw"))
        .orderBy("_raw", "cpf").drop("_raw")
    )
    return promotable, at_risk


def kpi_moves(m: PeopleModel) -> DataFrame:
    """D22 part: under-allocated (pot > q66 & perf < 2.0) and at-risk (pot <= q33 & perf < 1.5) counts."""
    p, f = F.col("potencial_bruto"), F.col("perf_media")
    return banded(m).agg(
        F.count(F.when((p > F.col("q66")) & (f < L.KPI_UNDERALLOCATED_PERF), 1)).alias("subalocados"),
        F.count(F.when((p <= F.col("q33")) & (f < L.KPI_AT_RISK_PERF), 1)).alias("em_risco"),
        F.count(F.lit(1)).alias("populacao"),
    )
