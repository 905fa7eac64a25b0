"""Coverage, distribution, relations, culture, trajectories, KPIs."""

from __future__ import annotations

from crewlens.catalog import model, register
from crewlens.oracle.ctes import PERIOD_YEARS, CTES, sql_pearson, with_ctes
from crewlens.plans import analysis as A


def pct(n: str, total: str) -> str:
    return f"round(CAST({n} AS double) * 100 / nullif({total}, 0), 6)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


LABEL = "printf('%d-%dº', ano, semestre)"

CTES.update(
    {
        "people_total": ("SELECT count(*) AS total FROM people", ("people",)),
        "cov": (
            f"""SELECT ano, semestre, {LABEL} AS label, n, CAST(n AS double) * 100 / nullif(total, 0) AS _pct
FROM (SELECT ano, semestre, count(*) AS n FROM perf_area WHERE score IS NOT NULL GROUP BY 1, 2), people_total""",
            ("perf_area", "people_total"),
        ),
        "apl_area": (
            """SELECT a.cpf, a.idx, a.value, b.perf_media, b.area FROM attributes_long a JOIN base b ON a.cpf = b.cpf
WHERE b.perf_media IS NOT NULL AND b.area IS NOT NULL AND a.cpf IN (SELECT cpf FROM attrs_complete)""",
            ("attributes_long", "base", "attrs_complete"),
        ),
        "apl": (
            """SELECT a.cpf, a.idx, a.value, b.perf_media FROM attributes_long a JOIN base b ON a.cpf = b.cpf
WHERE b.perf_media IS NOT NULL AND a.cpf IN (SELECT cpf FROM attrs_complete)""",
            ("attributes_long", "base", "attrs_complete"),
        ),
        "scored": (
            "SELECT l.* FROM perf_long l JOIN people p ON l.cpf = p.cpf WHERE l.score IS NOT NULL",
            ("perf_long", "people"),
        ),
        "traj": (
            """SELECT cpf, arg_min(score, ano * 10 + semestre) AS primeiro, arg_max(score, ano * 10 + semestre) AS ultimo
FROM scored GROUP BY cpf HAVING count(*) >= 2""",
            ("scored",),
        ),
        "traj_class": (
            """SELECT cpf, primeiro, ultimo, CASE WHEN ultimo - primeiro > 0 THEN 'Crescente'
  WHEN ultimo - primeiro = 0 THEN 'Estável' WHEN ultimo - primeiro < 0 THEN 'Decrescente' END AS trajetoria FROM traj""",
            ("traj",),
        ),
        "mode_row": (
            """SELECT score AS score_modal FROM scored GROUP BY score ORDER BY count(*) DESC, score LIMIT 1""",
            ("scored",),
        ),
        "score_mode_q": (
            f"""SELECT any_value(score_modal) AS score_modal,
  {r6("avg(CAST(score = score_modal AS double)) * 100")} AS pct_modal, count(*) AS n
FROM scored, mode_row""",
            ("scored", "mode_row"),
        ),
        "area_mm": (
            """SELECT area, avg(m) AS _mm FROM (
  SELECT area, ano, semestre, avg(score) AS m FROM perf_area WHERE area IS NOT NULL GROUP BY 1, 2, 3
) WHERE m IS NOT NULL GROUP BY area""",
            ("perf_area",),
        ),
        "per_delta": (
            f"""SELECT arg_min({LABEL}, ano * 10 + semestre) AS primeiro, arg_max({LABEL}, ano * 10 + semestre) AS ultimo,
  arg_min(media, ano * 10 + semestre) AS mf, arg_max(media, ano * 10 + semestre) AS ml
FROM (SELECT ano, semestre, avg(score) AS media, count(score) AS n FROM perf_area GROUP BY 1, 2) WHERE n > 10""",
            ("perf_area",),
        ),
        "low_band": (
            f"""SELECT count(*) AS classificados,
  count(CASE WHEN cultura_classificacao IN ('Baixo', 'Medio-Baixo', 'Muito-Baixo') THEN 1 END) AS baixos
FROM people WHERE cultura_classificacao IS NOT NULL""",
            ("people",),
        ),
        "culture_order": (
            """SELECT * FROM (VALUES ('Muito-Baixo', 1), ('Baixo', 2), ('Medio-Baixo', 3), ('Medio', 4),
  ('Medio-Alto', 5), ('Alto', 6), ('Muito-Alto', 7)) t(classe, ordem)""",
            (),
        ),
    }
)


def box_sql(src: str, group: str, value: str) -> str:
    return f"""SELECT * FROM (WITH q AS (
  SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS mediana,
    quantile_cont({value}, 0.75) AS q3, min({value}) AS minimo, max({value}) AS maximo
  FROM {src} GROUP BY 1)
SELECT q.{group}, round(q1, 6) AS q1, round(mediana, 6) AS mediana, round(q3, 6) AS q3,
  min(CASE WHEN s.{value} >= q1 - 1.5 * (q3 - q1) THEN s.{value} END) AS bigode_inf,
  max(CASE WHEN s.{value} <= q3 + 1.5 * (q3 - q1) THEN s.{value} END) AS bigode_sup,
  any_value(minimo) AS minimo, any_value(maximo) AS maximo
FROM {src} s JOIN q ON s.{group} = q.{group} GROUP BY q.{group}, q1, mediana, q3)"""


@register(
    "coverage_by_period",
    with_ctes(
        f"SELECT ano, semestre, label, n, {r6('_pct')} AS pct, {r6('avg(_pct) OVER ()')} AS pct_media FROM cov",
        "cov",
    ),
)
def coverage_by_period(spark, sf_dir):
    return A.coverage_by_period(model(spark, sf_dir))


_DIMS = [
    ("Potencial Bruto", "potencial_bruto"),
    ("Atributos (completos)", "c.cpf"),
    ("Raciocínio", "raciocinio"),
    ("Social", "social"),
    ("Motivacional", "motivacional"),
    ("Cultura", "cultura_pontuacao"),
]


@register(
    "coverage_by_dimension",
    with_ctes(
        "\nUNION ALL\n".join(
            f"SELECT '{label}' AS dimensao, count({col}) AS n, {pct(f'count({col})', 'count(*)')} AS pct "
            f"FROM people p LEFT JOIN attrs_complete c ON p.cpf = c.cpf"
            for label, col in _DIMS
        ),
        "people", "attrs_complete",
    ),
)
def coverage_by_dimension(spark, sf_dir):
    return A.coverage_by_dimension(model(spark, sf_dir))


@register(
    "unevaluated_people",
    with_ctes(
        """SELECT total, total - sem AS com_avaliacao, sem AS sem_avaliacao FROM people_total,
  (SELECT count(*) AS sem FROM people p WHERE NOT EXISTS (
     SELECT 1 FROM perf_long l WHERE l.cpf = p.cpf AND l.score IS NOT NULL))""",
        "people_total", "perf_long",
    ),
)
def unevaluated_people(spark, sf_dir):
    return A.unevaluated_people(model(spark, sf_dir))


@register(
    "low_coverage",
    with_ctes(
        f"""SELECT arg_min(label, ano * 10 + semestre) AS label, arg_min({r6('_pct')}, ano * 10 + semestre) AS pct,
  arg_min({r6('_pct')}, ano * 10 + semestre) < 15.0 AS alerta FROM cov""",
        "cov",
    ),
)
def low_coverage(spark, sf_dir):
    return A.low_coverage(model(spark, sf_dir))


_DIST = "SELECT ano, semestre, score, count(*) AS n FROM perf_area WHERE score IS NOT NULL GROUP BY 1, 2, 3"


@register("score_distribution", with_ctes(_DIST, "perf_area"))
def score_distribution(spark, sf_dir):
    return A.score_distribution(model(spark, sf_dir))


@register(
    "score_share",
    with_ctes(
        f"SELECT ano, semestre, score, n, {pct('n', 'sum(n) OVER (PARTITION BY ano, semestre)')} AS pct FROM ({_DIST})",
        "perf_area",
    ),
)
def score_share(spark, sf_dir):
    return A.score_share(model(spark, sf_dir))


@register(
    "area_period_count",
    with_ctes(
        f"""SELECT a.area, p.periodo, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT area FROM src) a CROSS JOIN (SELECT DISTINCT periodo FROM src) p
LEFT JOIN (SELECT area, periodo, count(*) AS n FROM src GROUP BY 1, 2) c ON c.area = a.area AND c.periodo = p.periodo""",
        "perf_area",
        extra=(("src", f"SELECT area, {LABEL} AS periodo FROM perf_area WHERE score IS NOT NULL AND area IS NOT NULL"),),
    ),
)
def area_period_count(spark, sf_dir):
    return A.area_period_count(model(spark, sf_dir))


@register(
    "area_period_mean",
    with_ctes(
        f"SELECT area, ano, semestre, {r6('avg(score)')} AS media, count(score) AS n FROM perf_area WHERE area IS NOT NULL GROUP BY 1, 2, 3",
        "perf_area",
    ),
)
def area_period_mean(spark, sf_dir):
    return A.area_period_mean(model(spark, sf_dir))


@register(
    "period_pivot",
    with_ctes(
        "SELECT cpf, "
        + ", ".join(
            f"CAST(max(CASE WHEN ano = {y} AND semestre = {s} THEN score END) AS double) AS perf_{s}_{y}"
            for y in PERIOD_YEARS for s in (1, 2)
        )
        + " FROM perf_long GROUP BY cpf",
        "perf_long",
    ),
)
def period_pivot(spark, sf_dir):
    return A.period_pivot(model(spark, sf_dir))


@register(
    "period_delta",
    with_ctes(
        f"SELECT primeiro, ultimo, {r6('mf')} AS media_primeiro, {r6('ml')} AS media_ultimo, {r6('ml - mf')} AS delta FROM per_delta",
        "per_delta",
    ),
)
def period_delta(spark, sf_dir):
    return A.period_delta(model(spark, sf_dir))


@register(
    "potential_fit",
    with_ctes(
        f"""SELECT {r6(sql_pearson('potencial_bruto', 'perf_media'))} AS r, count(*) AS n,
  {r6('regr_slope(perf_media, potencial_bruto)')} AS slope, {r6('regr_intercept(perf_media, potencial_bruto)')} AS intercept,
  min(potencial_bruto) AS x_min, max(potencial_bruto) AS x_max
FROM base WHERE potencial_bruto IS NOT NULL AND perf_media IS NOT NULL AND area IS NOT NULL""",
        "base",
    ),
)
def potential_fit(spark, sf_dir):
    return A.potential_fit(model(spark, sf_dir))


@register(
    "attr_corr_by_area",
    with_ctes(
        f"SELECT area, idx, {r6(sql_pearson('value', 'perf_media'))} AS r, count(*) AS n FROM apl_area GROUP BY 1, 2",
        "apl_area",
    ),
)
def attr_corr_by_area(spark, sf_dir):
    return A.attr_corr_by_area(model(spark, sf_dir))


@register(
    "attr_corr_global",
    with_ctes(
        f"""SELECT idx, {r6('_r')} AS r, n, CAST(row_number() OVER (ORDER BY _r DESC NULLS LAST, idx) AS int) AS rank
FROM (SELECT idx, {sql_pearson('value', 'perf_media')} AS _r, count(*) AS n FROM apl GROUP BY 1)""",
        "apl",
    ),
)
def attr_corr_global(spark, sf_dir):
    return A.attr_corr_global(model(spark, sf_dir))


_ASSESS = [("Raciocínio", "raciocinio"), ("Social", "social"), ("Motivacional", "motivacional"), ("Cultura", "cultura_pontuacao")]
_WORDS = """CASE WHEN _r IS NULL THEN NULL ELSE concat_ws(' ',
  CASE WHEN abs(_r) >= 0.4 THEN 'forte' WHEN abs(_r) >= 0.2 THEN 'moderada' ELSE 'fraca' END,
  CASE WHEN _r > 0 THEN 'positiva' ELSE 'negativa' END) END"""


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for _, c in _ASSESS) + " AND perf_media IS NOT NULL"
_ASSESS_R = " UNION ALL ".join(
    f"SELECT '{label}' AS assessment, {r6(sql_pearson(col, 'perf_media'))} AS r FROM base WHERE {_COMPLETE}" for label, col in _ASSESS
)


@register(
    "assessment_corr",
    with_ctes(
        f"SELECT assessment, {r6('_r')} AS r, n, {_WORDS} AS associacao FROM ("
        + "\nUNION ALL\n".join(
            f"SELECT '{label}' AS assessment, {sql_pearson(col, 'perf_media')} AS _r, count(*) AS n FROM cc"
            for label, col in _ASSESS
        )
        + ")",
        "base",
        extra=(
            (
                "cc",
                "SELECT * FROM base WHERE "
                + " AND ".join(f"{c} IS NOT NULL" for _, c in _ASSESS)
                + " AND perf_media IS NOT NULL",
            ),
        ),
    ),
)
def assessment_corr(spark, sf_dir):
    return A.assessment_corr(model(spark, sf_dir))


@register(
    "duration_vs_score",
    with_ctes(
        f"""SELECT k.assessment, {r6('any_value(corte)')} AS corte, {r6(sql_pearson('dur', 'score'))} AS r, count(*) AS n,
  {r6('regr_slope(score, dur)')} AS slope, {r6('regr_intercept(score, dur)')} AS intercept,
  {r6('median(dur)')} AS mediana_dur
FROM d k JOIN (
  SELECT assessment, CASE WHEN assessment = 'click' THEN quantile_cont(dur, 0.90) ELSE quantile_cont(dur, 0.95) END AS corte
  FROM d GROUP BY 1) c ON k.assessment = c.assessment
WHERE k.dur <= c.corte GROUP BY k.assessment""",
        "assess_sessions",
        extra=(
            (
                "d",
                """SELECT assessment, score, date_diff('microsecond', inicio, fim) / 6e7 AS dur FROM assess_sessions
WHERE score IS NOT NULL AND inicio IS NOT NULL AND fim IS NOT NULL AND date_diff('microsecond', inicio, fim) / 6e7 > 0""",
            ),
        ),
    ),
)
def duration_vs_score(spark, sf_dir):
    return A.duration_vs_score(model(spark, sf_dir))


@register(
    "top_attrs_by_area",
    with_ctes(
        f"""SELECT area, rank, idx, atributo, {r6('_r')} AS r FROM (
  SELECT area, idx, _r, CAST(row_number() OVER (PARTITION BY area ORDER BY _r DESC NULLS LAST, idx) AS int) AS rank
  FROM (SELECT area, idx, {sql_pearson('value', 'perf_media')} AS _r FROM apl_area
        WHERE area IN (SELECT area FROM apl_area GROUP BY area HAVING count(DISTINCT cpf) >= 5) GROUP BY 1, 2)
) LEFT JOIN attribute_names USING (idx) WHERE rank <= 3 AND (SELECT count(DISTINCT cpf) FROM apl_area) > 10""",
        "apl_area", "attribute_names",
    ),
)
def top_attrs_by_area(spark, sf_dir):
    return A.top_attrs_by_area(model(spark, sf_dir))


_TOP3 = f"""SELECT area, idx, _r, CAST(row_number() OVER (PARTITION BY area ORDER BY _r DESC NULLS LAST, idx) AS int) AS rank
  FROM (SELECT area, idx, {sql_pearson('value', 'perf_media')} AS _r FROM apl_area
        WHERE area IN (SELECT area FROM apl_area GROUP BY area HAVING count(DISTINCT cpf) >= 5) GROUP BY 1, 2)"""


@register(
    "hiring_hint",
    with_ctes(
        f"""SELECT area, string_agg(printf('%s (r=%.2f)', atributo, round(_r, 6)), ', ' ORDER BY rank) AS atributos,
  'Priorizar candidatos com alto score em ' || string_agg(CASE WHEN rank <= 2 THEN atributo END, ' e ' ORDER BY rank) AS recomendacao
FROM ({_TOP3}) LEFT JOIN attribute_names USING (idx) WHERE rank <= 3 AND (SELECT count(DISTINCT cpf) FROM apl_area) > 10 GROUP BY area""",
        "apl_area", "attribute_names",
    ),
)
def hiring_hint(spark, sf_dir):
    return A.hiring_hint(model(spark, sf_dir))


@register(
    "culture_by_area",
    with_ctes(
        f"""SELECT area, {r6('_med')} AS mediana, {r6('_geral')} AS mediana_geral,
  CAST(row_number() OVER (ORDER BY _med DESC, area) AS int) AS ordem
FROM (SELECT area, median(cultura_pontuacao) AS _med FROM base
      WHERE cultura_pontuacao IS NOT NULL AND area IS NOT NULL GROUP BY 1),
     (SELECT median(cultura_pontuacao) AS _geral FROM base WHERE cultura_pontuacao IS NOT NULL)""",
        "base",
    ),
)
def culture_by_area(spark, sf_dir):
    return A.culture_by_area(model(spark, sf_dir))


@register(
    "culture_mix",
    with_ctes(
        f"""SELECT g.area, g.classe, g.n, {pct('g.n', 'sum(g.n) OVER (PARTITION BY g.area)')} AS pct, o.ordem AS ordem_classe
FROM (
  SELECT a.area, o.classe, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT area FROM cm) a CROSS JOIN culture_order o
  LEFT JOIN (SELECT area, cultura_classificacao AS classe, count(*) AS n FROM cm GROUP BY 1, 2) c
    ON c.area = a.area AND c.classe = o.classe
  WHERE o.classe IN (SELECT cultura_classificacao FROM cm)
) g JOIN culture_order o ON g.classe = o.classe""",
        "base", "culture_order",
        extra=(("cm", "SELECT * FROM base WHERE cultura_classificacao IS NOT NULL AND area IS NOT NULL"),),
    ),
)
def culture_mix(spark, sf_dir):
    return A.culture_mix(model(spark, sf_dir))


@register(
    "culture_box",
    with_ctes(
        box_sql("cb", "area", "cultura_pontuacao"),
        "base",
        extra=(("cb", "SELECT area, cultura_pontuacao FROM base WHERE cultura_pontuacao IS NOT NULL AND area IS NOT NULL"),),
    ),
)
def culture_box(spark, sf_dir):
    return A.culture_box(model(spark, sf_dir))


@register(
    "culture_band_counts",
    with_ctes(
        """SELECT p.cultura_classificacao AS classe, count(*) AS n, any_value(o.ordem) AS ordem
FROM people p JOIN culture_order o ON p.cultura_classificacao = o.classe GROUP BY 1""",
        "people", "culture_order",
    ),
)
def culture_band_counts(spark, sf_dir):
    return A.culture_band_counts(model(spark, sf_dir))


@register(
    "perf_by_band",
    with_ctes(
        f"""SELECT b.cultura_classificacao AS classe, {r6('avg(perf_media)')} AS media, {r6('stddev_samp(perf_media)')} AS dp,
  count(*) AS n, any_value(o.ordem) AS ordem
FROM base b JOIN culture_order o ON b.cultura_classificacao = o.classe WHERE b.perf_media IS NOT NULL GROUP BY 1""",
        "base", "culture_order",
    ),
)
def perf_by_band(spark, sf_dir):
    return A.perf_by_band(model(spark, sf_dir))


@register(
    "perf_box_by_band",
    with_ctes(
        box_sql("pb", "classe", "perf_media"),
        "base",
        extra=(
            (
                "pb",
                "SELECT cultura_classificacao AS classe, perf_media FROM base "
                "WHERE cultura_classificacao IS NOT NULL AND perf_media IS NOT NULL",
            ),
        ),
    ),
)
def perf_box_by_band(spark, sf_dir):
    return A.perf_box_by_band(model(spark, sf_dir))


@register(
    "low_band_share",
    with_ctes(f"SELECT classificados, baixos, {pct('baixos', 'classificados')} AS pct FROM low_band", "low_band"),
)
def low_band_share(spark, sf_dir):
    return A.low_band_share(model(spark, sf_dir))


@register("trajectory_class", with_ctes("SELECT * FROM traj_class", "traj_class"))
def trajectory_class(spark, sf_dir):
    return A.trajectories(model(spark, sf_dir))


@register(
    "trajectory_mix",
    with_ctes(
        f"SELECT trajetoria, n, {pct('n', 'sum(n) OVER ()')} AS pct FROM (SELECT trajetoria, count(*) AS n FROM traj_class GROUP BY 1)",
        "traj_class",
    ),
)
def trajectory_mix(spark, sf_dir):
    return A.trajectory_mix(model(spark, sf_dir))


@register(
    "trajectory_curve",
    with_ctes(
        f"""SELECT t.trajetoria, l.ano, l.semestre, {r6('avg(l.score)')} AS media, count(l.score) AS n
FROM perf_long l JOIN traj_class t ON l.cpf = t.cpf GROUP BY 1, 2, 3 HAVING count(l.score) >= 5""",
        "perf_long", "traj_class",
    ),
)
def trajectory_curve(spark, sf_dir):
    return A.trajectory_curve(model(spark, sf_dir))


@register(
    "person_record",
    with_ctes(
        f"""SELECT p.cpf, p.nome_completo, a.area, p.potencial_bruto, p.cultura_classificacao,
  {r6('p.raciocinio')} AS raciocinio, {r6('p.social')} AS social, {r6('p.motivacional')} AS motivacional,
  p.cultura_pontuacao, s.serie, {r6('s._m')} AS perf_media, t.atributos
FROM people p LEFT JOIN area a ON p.cpf = a.cpf LEFT JOIN (
  SELECT cpf, string_agg(printf('%d-%dº:%d', ano, semestre, score), ' | ' ORDER BY ano, semestre) AS serie,
    avg(score) AS _m
  FROM perf_long WHERE score IS NOT NULL GROUP BY cpf) s ON p.cpf = s.cpf
LEFT JOIN (
  SELECT cpf, string_agg(printf('%d:%.6f', idx, value), ' | ' ORDER BY idx) AS atributos
  FROM attributes_long WHERE value IS NOT NULL GROUP BY cpf) t ON p.cpf = t.cpf""",
        "people", "area", "perf_long", "attributes_long",
    ),
)
def person_record(spark, sf_dir):
    from pyspark.sql import functions as F

    from crewlens.functions.stats import rounded

    df = A.person_record(model(spark, sf_dir))
    return df.select(*[rounded(c).alias(c) if c in ("raciocinio", "social", "motivacional") else F.col(c) for c in df.columns])


@register("score_mode", with_ctes("SELECT * FROM score_mode_q", "score_mode_q"))
def score_mode(spark, sf_dir):
    return A.score_mode(model(spark, sf_dir))


@register(
    "area_mean_of_means",
    with_ctes(
        f"SELECT area, {r6('_mm')} AS media, CAST(row_number() OVER (ORDER BY _mm DESC, area) AS int) AS rank FROM area_mm",
        "area_mm",
    ),
)
def area_mean_of_means(spark, sf_dir):
    return A.area_mean_rank(model(spark, sf_dir))


_BEST_WORST = """SELECT arg_min(area, (-_mm, area)) AS melhor_area, arg_min(area, (_mm, area)) AS pior_area FROM area_mm"""


@register("area_best_worst", with_ctes(_BEST_WORST, "area_mm"))
def area_best_worst(spark, sf_dir):
    return A.area_best_worst(model(spark, sf_dir))


@register(
    "area_share",
    with_ctes(
        f"""SELECT area, n, {pct('n', 'total')} AS pct, rank, n * 100.0 / total < 5 AS abaixo_5pct,
  round(sum(CASE WHEN rank <= 2 THEN n * 100.0 / total END) OVER (), 6) AS pct_duas_maiores
FROM (SELECT area, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, area) AS int) AS rank
      FROM base WHERE area IS NOT NULL GROUP BY area), (SELECT count(*) AS total FROM base)""",
        "base",
    ),
)
def area_share(spark, sf_dir):
    return A.area_share(model(spark, sf_dir))


@register(
    "headline_kpis",
    with_ctes(
        f"""SELECT c.total, c.com_avaliacao, c.r_potencial, c.mediana_cultura, c.r_cultura,
  {pct('c.com_avaliacao', 'c.total')} AS pct_avaliados,
  m.score_modal, m.pct_modal, {pct('lb.baixos', 'lb.classificados')} AS pct_cultura_baixa,
  bw.melhor_area, bw.pior_area, {r6('d.ml - d.mf')} AS delta, d.primeiro AS primeiro_periodo, d.ultimo AS ultimo_periodo,
  ta.idx AS atributo_top, ta.r AS r_atributo_top, ts.assessment_top, ts.r_assessment_top, k.subalocados, k.em_risco
FROM (SELECT count(*) AS total, count(CASE WHEN n_avaliacoes > 0 THEN 1 END) AS com_avaliacao,
        {r6(sql_pearson('potencial_bruto', 'perf_media'))} AS r_potencial,
        {r6('median(cultura_pontuacao)')} AS mediana_cultura,
        {r6(sql_pearson('cultura_pontuacao', 'perf_media'))} AS r_cultura FROM base) c,
  score_mode_q m, low_band lb, ({_BEST_WORST}) bw, per_delta d,
  (SELECT max(idx) AS idx, max(r) AS r FROM (
     SELECT idx, {r6('_r')} AS r, row_number() OVER (ORDER BY _r DESC NULLS LAST, idx) AS rank
     FROM (SELECT idx, {sql_pearson('value', 'perf_media')} AS _r FROM apl GROUP BY 1)) WHERE rank = 1) ta,
  (SELECT arg_max(assessment, (r, assessment)) AS assessment_top, max(r) AS r_assessment_top FROM ({_ASSESS_R}) WHERE r IS NOT NULL) ts,
  (SELECT count(CASE WHEN potencial_bruto > q66 AND perf_media < 2.0 THEN 1 END) AS subalocados,
          count(CASE WHEN potencial_bruto <= q33 AND perf_media < 1.5 THEN 1 END) AS em_risco FROM nb_banded) k""",
        "base", "score_mode_q", "low_band", "area_mm", "per_delta", "nb_banded", "apl",
    ),
)
def headline_kpis(spark, sf_dir):
    return A.headline_kpis(model(spark, sf_dir))
