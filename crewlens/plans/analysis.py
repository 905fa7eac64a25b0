"""Analyses over the people model.

All questions that the reference answers with a Python loop over periods,
areas or attribute columns are one group-by over the long form here: one
shuffle per question instead of one pass per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewlens.functions import labels as L
from crewlens.functions.stats import pearson, quantile_cuts, rounded, strength_words, trend_class
from crewlens.operators.arrays import array_correlations
from crewlens.operators.core import attach_one_row, crosstab_zero_fill, ranked, share_within, top_k, unstack, value_counts
from crewlens.operators.quantiles import exact_quantiles
from crewlens.plans.people import ASSESSMENT_COLUMNS, PeopleModel, period_column
from crewlens.session import written_once

# Analyses that need a minimum number of rows (F9, F10) -- fixed values.
MIN_ROWS_AREA_CORR = 5          # areas with fewer complete rows are skipped
MIN_ROWS_ATTR_TABLE = 10        # attribute table must have more rows than this
MIN_ROWS_PERIOD_MEAN = 10       # periods with more scores than this enter the delta
MIN_ROWS_TRAJECTORY_POINT = 5   # trajectory curve points need this many scores
TOP_ATTRIBUTES = 3


def period_label(ano="ano", semestre="semestre"):
    """``2018-1º`` label from (year, half)."""
    return F.format_string("%d-%dº", F.col(ano), F.col(semestre))


def period_key(ano="ano", semestre="semestre"):
    """O1: chronological sort key of a half-year."""
    return F.col(ano) * 10 + F.col(semestre)


def people_count(m: PeopleModel) -> DataFrame:
    return m.people.agg(F.count(F.lit(1)).alias("total"))


# ---- D3 coverage -----------------------------------------------------------
def coverage_by_period(m: PeopleModel) -> DataFrame:
    """A1/A2/O1: people scored per period and % of all people; mean coverage."""
    per = m.perf_area.where(F.col("score").isNotNull()).groupBy("ano", "semestre").agg(
        F.count(F.lit(1)).alias("n")
    )
    withtot = attach_one_row(per, people_count(m)).withColumn(
        "_pct", F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0))
    )
    mean_cov = withtot.agg(F.avg("_pct").alias("_mean"))
    return attach_one_row(withtot, mean_cov).select(
        "ano", "semestre", period_label().alias("label"), "n",
        rounded("_pct").alias("pct"), rounded("_mean").alias("pct_media"),
    )


def coverage_by_dimension(m: PeopleModel) -> DataFrame:
    """Available n and % per dimension (potential, complete attributes, each assessment)."""
    complete = m.attrs_complete().withColumn("_complete", F.lit(1))
    p = m.people.join(complete, "cpf", "left")
    dims = {"Potencial Bruto": "potencial_bruto", "Atributos (completos)": "_complete"}
    dims.update({label: col for label, col in ASSESSMENT_COLUMNS.items()})
    wide = p.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(k) for k, c in dims.items()])
    long = wide.unpivot(["total"], list(dims), "dimensao", "n")
    return long.select(
        "dimensao", F.col("n").cast("long").alias("n"),
        rounded(F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("pct"),
    )


def unevaluated_people(m: PeopleModel) -> DataFrame:
    """People without any performance score (anti-join), as counts."""
    scored = m.perf.where(F.col("score").isNotNull()).select("cpf")
    p = m.people.select("cpf")
    none = p.join(scored, "cpf", "left_anti")
    return attach_one_row(
        people_count(m), none.agg(F.count(F.lit(1)).alias("sem_avaliacao"))
    ).select("total", (F.col("total") - F.col("sem_avaliacao")).alias("com_avaliacao"), "sem_avaliacao")


def low_coverage(m: PeopleModel) -> DataFrame:
    """Warning when the first period covers under 15 % of the people."""
    cov = coverage_by_period(m)
    first = cov.agg(F.min_by(F.struct("label", "pct"), period_key()).alias("f"))
    return first.select(
        F.col("f.label").alias("label"), F.col("f.pct").alias("pct"),
        (F.col("f.pct") < L.FIRST_PERIOD_WARN_SHARE * 100).alias("alerta"),
    )


# ---- D4 distribution -------------------------------------------------------
def score_distribution(m: PeopleModel) -> DataFrame:
    """A3: value counts of the score per period."""
    return m.perf_area.where(F.col("score").isNotNull()).groupBy("ano", "semestre", "score").agg(
        F.count(F.lit(1)).alias("n")
    )


def score_share(m: PeopleModel) -> DataFrame:
    """Share of each score within its period (sums to 100 per period)."""
    return share_within(score_distribution(m), ["ano", "semestre"])


# ---- D5 area x period --------------------------------------------------------
def area_period_count(m: PeopleModel) -> DataFrame:
    """Scored people per area x period, zero cells kept (pivot over the period list)."""
    src = m.perf_area.where(F.col("score").isNotNull() & F.col("area").isNotNull()).select(
        "area", period_label().alias("periodo")
    )
    return crosstab_zero_fill(src, ["area"], "periodo", None, "n")


def area_period_mean(m: PeopleModel) -> DataFrame:
    """Mean score per area x period."""
    return (
        m.perf_area.where(F.col("area").isNotNull())
        .groupBy("area", "ano", "semestre")
        .agg(rounded(F.avg("score")).alias("media"), F.count("score").alias("n"))
    )


def period_pivot(m: PeopleModel) -> DataFrame:
    """R2: the wide ``perf_<half>_<year>`` layout, one row per person with any score."""
    # scores as doubles: a period without a score is a missing value (NaN in the
    # reference's wide frame)
    return unstack(m.perf.withColumn("_c", period_column()), ["cpf"], "_c", m.period_columns(), F.first("score").cast("double"))


def period_delta(m: PeopleModel) -> DataFrame:
    """First -> last period mean among periods with more than 10 scores."""
    per = (
        m.perf_area.groupBy("ano", "semestre")
        .agg(F.avg("score").alias("media"), F.count("score").alias("n"))
        .where(F.col("n") > MIN_ROWS_PERIOD_MEAN)
    )
    k = period_key()
    agg = per.agg(
        F.min_by(F.struct(period_label().alias("l"), "media"), k).alias("f"),
        F.max_by(F.struct(period_label().alias("l"), "media"), k).alias("t"),
    )
    return agg.select(
        F.col("f.l").alias("primeiro"), F.col("t.l").alias("ultimo"),
        rounded("f.media").alias("media_primeiro"), rounded("t.media").alias("media_ultimo"),
        rounded(F.col("t.media") - F.col("f.media")).alias("delta"),
    )


# ---- D6 / D10-D12 relations --------------------------------------------------
def potential_fit(m: PeopleModel) -> DataFrame:
    """R, n, slope and intercept of performance on potential (complete cases with area)."""
    b = m.base("potencial_bruto", "perf_media", "area").dropna(subset=["potencial_bruto", "perf_media", "area"])
    x, y = F.col("potencial_bruto"), F.col("perf_media")
    return b.agg(
        rounded(pearson(x, y)).alias("r"), F.count(F.lit(1)).alias("n"),
        rounded(F.regr_slope(y, x)).alias("slope"), rounded(F.regr_intercept(y, x)).alias("intercept"),
        F.min("potencial_bruto").alias("x_min"), F.max("potencial_bruto").alias("x_max"),
    )


def complete_cases(m: PeopleModel, with_area: bool) -> DataFrame:
    """One row per person with performance [, area] and the whole attribute array."""
    cols = ("perf_media", "area") if with_area else ("perf_media",)
    return m.base(*cols).dropna(subset=list(cols)).join(m.complete_vectors(), "cpf")


def attr_correlations(m: PeopleModel, with_area: bool) -> DataFrame:
    """R of each attribute with performance [per area], by array moments (no row per attribute)."""
    return array_correlations(complete_cases(m, with_area), ["area"] if with_area else [], "attrs", "perf_media", m.n_attributes(), "_r")


def attr_corr_by_area(m: PeopleModel) -> DataFrame:
    """Pearson r of each attribute with performance per area."""
    return attr_correlations(m, True).select("area", "idx", rounded("_r").alias("r"), "n")


def attr_corr_global(m: PeopleModel) -> DataFrame:
    """Pearson r of each attribute with performance; rank 1 = strongest positive."""
    corr = attr_correlations(m, False)
    return ranked(corr, [F.col("_r").desc_nulls_last(), F.col("idx")]).select("idx", rounded("_r").alias("r"), "n", "rank")


def assessment_corr(m: PeopleModel) -> DataFrame:
    """R of each assessment with performance over complete cases of all four."""
    cols = list(ASSESSMENT_COLUMNS.values())
    b = m.base(*cols, "perf_media").dropna(subset=cols + ["perf_media"])
    long = b.unpivot(["cpf", "perf_media"], cols, "_col", "valor")
    label = F.create_map(*[x for k, v in ASSESSMENT_COLUMNS.items() for x in (F.lit(v), F.lit(k))])
    out = long.groupBy("_col").agg(pearson("valor", "perf_media").alias("_r"), F.count(F.lit(1)).alias("n"))
    return out.select(
        label[F.col("_col")].alias("assessment"), rounded("_r").alias("r"), "n",
        strength_words("_r").alias("associacao"),
    )


def duration_vs_score(m: PeopleModel, cut_for: dict[str, float] | None = None, default_cut: float = 0.95) -> DataFrame:
    """Duration (minutes) vs score per assessment, trimmed at a percentile.

    The cut is computed per assessment *after* the ``> 0`` filter, then joined
    back (one row per assessment).
    """
    cut_for = cut_for or {"click": 0.90}
    s = m.sessions.select(
        "assessment", "score",
        (F.timestamp_diff("MICROSECOND", F.col("inicio"), F.col("fim")) / 6e7).alias("dur"),
    ).dropna(subset=["dur", "score"]).where(F.col("dur") > 0)
    probs = sorted({default_cut, *cut_for.values()})
    # durations are continuous: exact quantiles by distributed selection
    qs = exact_quantiles(s, ["assessment"], "dur", probs, [f"_q{i}" for i in range(len(probs))])
    corte = F.col(f"_q{probs.index(default_cut)}")
    for k, v in cut_for.items():
        corte = F.when(F.col("assessment") == k, F.col(f"_q{probs.index(v)}")).otherwise(corte)
    cuts = qs.select("assessment", corte.alias("corte"))
    kept = s.join(cuts, "assessment").where(F.col("dur") <= F.col("corte"))
    med = exact_quantiles(kept, ["assessment"], "dur", [0.5], ["_med"])
    stats = kept.groupBy("assessment").agg(
        F.first("corte").alias("_corte"),
        pearson("dur", "score").alias("_r"), F.count(F.lit(1)).alias("n"),
        F.regr_slope("score", "dur").alias("_slope"),
        F.regr_intercept("score", "dur").alias("_icpt"),
    )
    return stats.join(med, "assessment").select(
        "assessment", rounded("_corte").alias("corte"), rounded("_r").alias("r"), "n",
        rounded("_slope").alias("slope"), rounded("_icpt").alias("intercept"), rounded("_med").alias("mediana_dur"),
    )


def top_attrs_by_area(m: PeopleModel) -> DataFrame:
    """Top-3 attributes (by r) per area with >= 5 complete rows."""
    corr = attr_correlations(m, True)
    total = F.sum(F.when(F.col("idx") == 1, F.col("n"))).over(Window.partitionBy())  # areas x attributes rows
    # the block runs only when the complete attribute table has > 10 rows
    corr = corr.withColumn("_total", total).where(
        (F.col("n") >= MIN_ROWS_AREA_CORR) & (F.col("_total") > MIN_ROWS_ATTR_TABLE)
    )
    top = top_k(corr, ["area"], [F.col("_r").desc_nulls_last(), F.col("idx")], TOP_ATTRIBUTES, "rank")
    return m.named(top).select("area", "rank", "idx", "atributo", rounded("_r").alias("r"))


def hiring_hint(m: PeopleModel) -> DataFrame:
    """Per area the top attributes with r as one text, and the hiring hint."""
    best = top_attrs_by_area(m).groupBy("area").agg(F.array_sort(F.collect_list(F.struct("rank", "atributo", "r"))).alias("t"))
    shown = F.array_join(F.transform("t", lambda a: F.format_string("%s (r=%.2f)", a["atributo"], a["r"])), ", ")
    names = F.array_join(F.transform(F.slice("t", 1, 2), lambda a: a["atributo"]), " e ")
    return best.select(
        "area", shown.alias("atributos"),
        F.concat(F.lit("Priorizar candidatos com alto score em "), names).alias("recomendacao"),
    )


# ---- D13 / D14 culture ---------------------------------------------------------
def culture_by_area(m: PeopleModel) -> DataFrame:
    """Median culture score per area, rank by median desc, overall median."""
    b = m.base("cultura_pontuacao", "area").where(F.col("cultura_pontuacao").isNotNull())
    overall = quantile_cuts(b, "cultura_pontuacao", (0.5,), ("_geral",))
    per = exact_quantiles(b, ["area"], "cultura_pontuacao", [0.5], ["_med"])
    order = ranked(per, [F.col("_med").desc(), F.col("area")], "ordem")
    return attach_one_row(order, overall).select(
        "area", rounded("_med").alias("mediana"), rounded("_geral").alias("mediana_geral"), "ordem"
    )


def culture_mix(m: PeopleModel) -> DataFrame:
    """% of each culture band within each area, fixed band order, zero cells kept
    for bands present anywhere."""
    b = m.base("cultura_classificacao", "area").dropna(subset=["cultura_classificacao", "area"])
    grid = crosstab_zero_fill(b, ["area"], "cultura_classificacao", L.CULTURE_BANDS, "n")
    present = b.select("cultura_classificacao").distinct()
    grid = grid.join(present, "cultura_classificacao", "left_semi")
    return share_within(grid, ["area"]).select(
        "area", F.col("cultura_classificacao").alias("classe"), "n", "pct",
        L.order_rank("cultura_classificacao", L.CULTURE_BANDS).alias("ordem_classe"),
    )


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Q1, median, Q3, 1.5 IQR whiskers (most extreme values inside), min, max.

    The (group, value) table is written once: quartiles and whiskers scan it four times."""
    df = written_once(df.select(group, value), "box")
    ext = df.groupBy(group).agg(F.min(value).alias("minimo"), F.max(value).alias("maximo"))
    quart = exact_quantiles(df, [group], value, [0.25, 0.5, 0.75], ["q1", "mediana", "q3"]).join(ext, group)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    # one row per group on the right side: AQE broadcasts it once its size is known
    whisk = df.join(quart, group).groupBy(group).agg(
        F.min(F.when(v >= lo, v)).alias("bigode_inf"), F.max(F.when(v <= hi, v)).alias("bigode_sup")
    )
    return quart.join(whisk, group).select(
        group, rounded("q1").alias("q1"), rounded("mediana").alias("mediana"), rounded("q3").alias("q3"),
        "bigode_inf", "bigode_sup", "minimo", "maximo",
    )


def culture_box(m: PeopleModel) -> DataFrame:
    """Box-plot numbers of the culture score per area."""
    b = m.base("cultura_pontuacao", "area").dropna(subset=["cultura_pontuacao", "area"])
    return box_stats(b, "area", "cultura_pontuacao")


def culture_band_counts(m: PeopleModel) -> DataFrame:
    """A4 (D14): distribution of culture bands in fixed order (present bands only)."""
    b = m.merged.where(F.col("cultura_classificacao").isin(*L.CULTURE_BANDS))
    return b.groupBy(F.col("cultura_classificacao").alias("classe")).agg(F.count(F.lit(1)).alias("n")).select(
        "classe", "n", L.order_rank("classe", L.CULTURE_BANDS).alias("ordem")
    )


def perf_by_band(m: PeopleModel) -> DataFrame:
    """Mean, sample std and n of performance per culture band."""
    b = m.base("cultura_classificacao", "perf_media").dropna(subset=["cultura_classificacao", "perf_media"])
    b = b.where(F.col("cultura_classificacao").isin(*L.CULTURE_BANDS))
    return b.groupBy(F.col("cultura_classificacao").alias("classe")).agg(
        rounded(F.avg("perf_media")).alias("media"), rounded(F.stddev_samp("perf_media")).alias("dp"),
        F.count(F.lit(1)).alias("n"),
    ).select("classe", "media", "dp", "n", L.order_rank("classe", L.CULTURE_BANDS).alias("ordem"))


def perf_box_by_band(m: PeopleModel) -> DataFrame:
    """Box-plot numbers of performance per culture band."""
    b = m.base("cultura_classificacao", "perf_media").dropna(subset=["cultura_classificacao", "perf_media"])
    return box_stats(b.withColumnRenamed("cultura_classificacao", "classe"), "classe", "perf_media")


def low_band_share(m: PeopleModel) -> DataFrame:
    """% of people in the low culture bands among those classified."""
    c = F.col("cultura_classificacao")
    return m.merged.where(c.isNotNull()).agg(
        F.count(F.lit(1)).alias("classificados"),
        F.count(F.when(c.isin(*L.CULTURE_LOW_BANDS), 1)).alias("baixos"),
    ).select("classificados", "baixos", rounded(F.col("baixos") * 100.0 / F.nullif(F.col("classificados"), F.lit(0))).alias("pct"))


# ---- D18 trajectories -----------------------------------------------------------
def trajectories(m: PeopleModel) -> DataFrame:
    """First and last non-null score (chronological) of people with >= 2 scores."""
    k = period_key()
    s = m.perf.join(m.people.select("cpf"), "cpf").where(F.col("score").isNotNull())
    per = s.groupBy("cpf").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("score", k).alias("primeiro"), F.max_by("score", k).alias("ultimo")
    ).where(F.col("n") >= 2)
    return per.select("cpf", "primeiro", "ultimo", trend_class(F.col("ultimo") - F.col("primeiro")).alias("trajetoria"))


def trajectory_mix(m: PeopleModel) -> DataFrame:
    """Counts and % of each trajectory class."""
    return share_within(value_counts(trajectories(m), ["trajetoria"]), [])


def trajectory_curve(m: PeopleModel) -> DataFrame:
    """Mean score per class and period, points with >= 5 scores."""
    t = trajectories(m).select("cpf", "trajetoria")
    return (
        m.perf.join(t, "cpf")
        .groupBy("trajetoria", "ano", "semestre")
        .agg(rounded(F.avg("score")).alias("media"), F.count("score").alias("n"))
        .where(F.col("n") >= MIN_ROWS_TRAJECTORY_POINT)
    )


# ---- D23 person record ------------------------------------------------------------
def person_record(m: PeopleModel, cpf=None) -> DataFrame:
    """One record per person (or the chosen one): area, potential, band,
    chronological score series and mean, assessments, attribute values.

    The per-person lists are bounded by the number of periods and attributes."""
    p = m.merged
    if cpf is not None:
        p = p.where(F.col("cpf") == cpf)
    series = m.perf.where(F.col("score").isNotNull()).groupBy("cpf").agg(
        F.array_sort(F.collect_list(F.struct("ano", "semestre", "score"))).alias("_s"),
        F.avg("score").alias("_m"),
    )
    serie = F.array_join(
        F.transform("_s", lambda e: F.format_string("%d-%dº:%d", e["ano"], e["semestre"], e["score"])), " | "
    )
    attrs = m.attrs.where(F.exists("attrs", lambda v: v.isNotNull()))
    written = F.transform("attrs", lambda v, i: F.when(v.isNotNull(), F.format_string("%d:%.6f", i + 1, v)))
    atributos = F.array_join(F.array_compact(written), " | ")
    return (
        p.join(series, "cpf", "left")
        .join(attrs, "cpf", "left")
        .select(
            "cpf", "nome_completo", "area", "potencial_bruto", "cultura_classificacao",
            "raciocinio", "social", "motivacional", "cultura_pontuacao",
            serie.alias("serie"), rounded("_m").alias("perf_media"), atributos.alias("atributos"),
        )
    )


# ---- D22 KPIs ------------------------------------------------------------------
def score_mode(m: PeopleModel) -> DataFrame:
    """Modal score over all stacked scores (smallest of ties) and its share."""
    counts = value_counts(m.perf.join(m.people.select("cpf"), "cpf"), ["score"])  # one row per distinct score
    best = F.min_by("score", F.struct((-F.col("n")).alias("n"), F.col("score").alias("s")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(
        best.alias("score_modal"), rounded(F.max("n") * 100.0 / F.nullif(total, F.lit(0))).alias("pct_modal"),
        total.alias("n"),
    )


def area_mean_of_means(m: PeopleModel) -> DataFrame:
    """Unweighted mean over periods of the per-period area means; rank best first."""
    per = m.perf_area.where(F.col("area").isNotNull()).groupBy("area", "ano", "semestre").agg(
        F.avg("score").alias("_m")
    )
    by_area = per.where(F.col("_m").isNotNull()).groupBy("area").agg(F.avg("_m").alias("_mm"))
    return ranked(by_area, [F.col("_mm").desc(), F.col("area")])


def area_mean_rank(m: PeopleModel) -> DataFrame:
    """A28 for display: the mean rounded, ranked on the raw value."""
    return area_mean_of_means(m).select("area", rounded("_mm").alias("media"), "rank")


def area_best_worst(m: PeopleModel) -> DataFrame:
    """Best and worst area by mean of means (ties -> first name)."""
    a = area_mean_of_means(m)
    return a.agg(
        F.min_by("area", F.struct((-F.col("_mm")).alias("v"), F.col("area").alias("a"))).alias("melhor_area"),
        F.min_by("area", F.struct(F.col("_mm").alias("v"), F.col("area").alias("a"))).alias("pior_area"),
    )


def area_share(m: PeopleModel) -> DataFrame:
    """Share of all people (with or without an area) per area, total share of the
    two largest areas, and the under-5 % flag."""
    counts = m.base("area").where(F.col("area").isNotNull()).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    shared = attach_one_row(ranked(counts, [F.col("n").desc(), F.col("area")]), people_count(m))
    share = F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0))
    two = shared.where(F.col("rank") <= 2).agg(F.sum(share).alias("_two"))
    return attach_one_row(shared, two).select(
        "area", "n", rounded(share).alias("pct"), "rank", (share < 5).alias("abaixo_5pct"),
        rounded("_two").alias("pct_duas_maiores"),
    )


def headline_kpis(m: PeopleModel) -> DataFrame:
    """One row of headline numbers.

    Parts that share an input share its pass: one aggregate over people, one
    small table of score counts by area and period, the two quantile plans and
    the attribute correlations.
    """
    from crewlens.plans import ninebox

    assess = list(ASSESSMENT_COLUMNS.values())
    b = m.base("potencial_bruto", "cultura_classificacao", "perf_media", "n_avaliacoes", *assess)
    band, complete = F.col("cultura_classificacao"), F.col("perf_media").isNotNull()
    for c in assess:
        complete = complete & F.col(c).isNotNull()
    r_of = [
        F.struct(rounded(pearson(F.when(complete, F.col(c)), "perf_media")).alias("r"), F.lit(label).alias("assessment"))
        for label, c in ASSESSMENT_COLUMNS.items()
    ]
    low = F.count(F.when(band.isin(*L.CULTURE_LOW_BANDS), 1)) * 100.0 / F.nullif(F.count(band), F.lit(0))
    core = b.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("n_avaliacoes") > 0, 1)).alias("com_avaliacao"),
        rounded(pearson("potencial_bruto", "perf_media")).alias("r_potencial"),
        rounded(pearson("cultura_pontuacao", "perf_media")).alias("r_cultura"),
        rounded(low).alias("pct_cultura_baixa"),
        F.array_max(F.filter(F.array(*r_of), lambda x: x["r"].isNotNull())).alias("_best"),
    ).select(
        "total", "com_avaliacao", "r_potencial", "r_cultura", "pct_cultura_baixa",
        rounded(F.col("com_avaliacao") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("pct_avaliados"),
        F.col("_best.assessment").alias("assessment_top"), F.col("_best.r").alias("r_assessment_top"),
    )
    med = quantile_cuts(b, "cultura_pontuacao", (0.5,), ("_med",)).select(rounded("_med").alias("mediana_cultura"))
    top = attr_corr_global(m).where(F.col("rank") == 1).agg(F.max("idx").alias("atributo_top"), F.max("r").alias("r_atributo_top"))
    # one row per area, period and score
    counts = m.perf_area.where(F.col("score").isNotNull()).groupBy("area", "ano", "semestre", "score").agg(
        F.count(F.lit(1)).alias("n")
    )
    out = attach_one_row(attach_one_row(core, med), top)
    for part in (_score_mode(counts), _best_worst(counts), _delta(counts)):
        out = attach_one_row(out, part)
    return attach_one_row(out, ninebox.kpi_moves(m).select("subalocados", "em_risco"))


def _score_mode(counts: DataFrame) -> DataFrame:
    by = counts.groupBy("score").agg(F.sum("n").alias("n"))
    return by.agg(
        F.min_by("score", F.struct((-F.col("n")).alias("n"), F.col("score").alias("s"))).alias("score_modal"),
        rounded(F.max("n") * 100.0 / F.nullif(F.sum("n"), F.lit(0))).alias("pct_modal"),
    )


def _mean(n: str = "n"):
    return F.sum(F.col("score") * F.col(n)) / F.sum(n)


def _best_worst(counts: DataFrame) -> DataFrame:
    means = counts.where(F.col("area").isNotNull()).groupBy("area", "ano", "semestre").agg(_mean().alias("_m"))
    by_area = means.groupBy("area").agg(F.avg("_m").alias("_mm"))
    return by_area.agg(
        F.min_by("area", F.struct((-F.col("_mm")).alias("v"), F.col("area").alias("a"))).alias("melhor_area"),
        F.min_by("area", F.struct(F.col("_mm").alias("v"), F.col("area").alias("a"))).alias("pior_area"),
    )


def _delta(counts: DataFrame) -> DataFrame:
    per = counts.groupBy("ano", "semestre").agg(_mean().alias("media"), F.sum("n").alias("n")).where(
        F.col("n") > MIN_ROWS_PERIOD_MEAN
    )
    ends = per.agg(
        F.min_by(F.struct(period_label().alias("l"), "media"), period_key()).alias("f"),
        F.max_by(F.struct(period_label().alias("l"), "media"), period_key()).alias("t"),
    )
    return ends.select(
        rounded(F.col("t.media") - F.col("f.media")).alias("delta"),
        F.col("f.l").alias("primeiro_periodo"), F.col("t.l").alias("ultimo_periodo"),
    )
