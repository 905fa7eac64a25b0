"""Queries of the 9-box family."""

from __future__ import annotations

from crewlens.catalog import ORACLE, model, register
from crewlens.oracle.ctes import with_ctes
from crewlens.functions.labels import QUADRANT_ORDER
from crewlens.plans import ninebox


@register(
    "ninebox_matrix",
    with_ctes(
        """SELECT d.pot_cat, d.perf_cat, d.quadrante, coalesce(c.n, 0) AS n,
  round(CAST(coalesce(c.n, 0) AS double) * 100.0 / nullif(sum(coalesce(c.n, 0)) OVER (), 0), 6) AS pct,
  d.valor
FROM quadrant_dim d LEFT JOIN (
  SELECT pot_cat, perf_cat, count(*) AS n FROM nb_banded
  WHERE pot_cat IS NOT NULL AND perf_cat IS NOT NULL GROUP BY 1, 2
) c ON d.pot_cat = c.pot_cat AND d.perf_cat = c.perf_cat""",
        "nb_banded", "quadrant_dim",
    ),
)
def ninebox_matrix(spark, sf_dir):
    return ninebox.matrix(model(spark, sf_dir))


@register(
    "ninebox_listing",
    with_ctes(
        """SELECT cpf, nome_completo, area, round(potencial_bruto, 6) AS potencial_bruto,
  round(perf_media, 6) AS perf_media, pot_cat, perf_cat, quadrante, CAST(coalesce(_ordem, 0) AS int) AS ordem
FROM nb_quad""",
        "nb_quad",
    ),
)
def ninebox_listing(spark, sf_dir):
    return ninebox.listing(model(spark, sf_dir))


@register(
    "ninebox_quadrant",
    with_ctes(
        """SELECT cpf, nome_completo, area, round(potencial_bruto, 6) AS potencial_bruto,
  round(perf_media, 6) AS perf_media, pot_cat, perf_cat, quadrante, CAST(coalesce(_ordem, 0) AS int) AS ordem
FROM nb_quad WHERE quadrante IN ('Estrela', 'Enigma', 'Core')""",
        "nb_quad",
    ),
)
def ninebox_quadrant(spark, sf_dir):
    """the listing of chosen quadrants."""
    return ninebox.listing(model(spark, sf_dir), ("Estrela", "Enigma", "Core"))


@register(
    "quadrant_counts",
    with_ctes("SELECT quadrante, count(*) AS n FROM nb_quad GROUP BY 1", "nb_quad"),
)
def quadrant_counts(spark, sf_dir):
    return ninebox.quadrant_counts(model(spark, sf_dir))


@register(
    "ninebox_profile",
    with_ctes(
        """SELECT q.quadrante, a.idx, round(avg(a.value), 6) AS media, count(a.value) AS n
FROM attributes_long a JOIN prof_q q ON a.cpf = q.cpf GROUP BY 1, 2""",
        "nb_pop", "attrs_complete", "quadrant_dim", "attributes_long",
        extra=(
            ("prof_pop", "SELECT * FROM nb_pop WHERE cpf IN (SELECT cpf FROM attrs_complete)"),
            (
                "prof_cuts",
                "SELECT quantile_cont(potencial_bruto, 0.33) AS q33, quantile_cont(potencial_bruto, 0.66) AS q66 FROM prof_pop",
            ),
            (
                "prof_band",
                """SELECT p.cpf,
    CASE WHEN perf_media >= 0 AND perf_media <= 1.5 THEN 'Baixa'
         WHEN perf_media > 1.5 AND perf_media <= 2.5 THEN 'Média'
         WHEN perf_media > 2.5 AND perf_media <= 3.01 THEN 'Alta' END AS perf_cat,
    CASE WHEN potencial_bruto >= 0 AND potencial_bruto <= c.q33 THEN 'Baixo'
         WHEN potencial_bruto > c.q33 AND potencial_bruto <= c.q66 THEN 'Médio'
         WHEN potencial_bruto > c.q66 AND potencial_bruto <= 101 THEN 'Alto' END AS pot_cat
  FROM prof_pop p, prof_cuts c""",
            ),
            (
                "prof_q",
                """SELECT b.cpf, coalesce(d.quadrante, 'N/A') AS quadrante FROM prof_band b
  LEFT JOIN quadrant_dim d ON b.pot_cat = d.pot_cat AND b.perf_cat = d.perf_cat""",
            ),
        ),
    ),
)
def ninebox_profile(spark, sf_dir):
    return ninebox.profile(model(spark, sf_dir))


QUERIES_SQL_PROFILE = ORACLE["ninebox_profile"]


@register(
    "ninebox_profile_wide",
    with_ctes(
        "SELECT idx, "
        + ", ".join(f"max(CASE WHEN quadrante = '{q}' THEN media END) AS \"{q}\"" for q in QUADRANT_ORDER)
        + " FROM prof GROUP BY idx",
        extra=(("prof", "SELECT * FROM (" + QUERIES_SQL_PROFILE + ")"),),
    ),
)
def ninebox_profile_wide(spark, sf_dir):
    return ninebox.profile_wide(model(spark, sf_dir))


_MOVE_COLS = """cpf, nome_completo, area, round(potencial_bruto, 6) AS potencial_bruto, round(perf_media, 6) AS perf_media"""


@register(
    "moves_promotable",
    with_ctes(
        f"SELECT {_MOVE_COLS} FROM nb_banded WHERE pot_cat = 'Alto' AND perf_cat IN ('Baixa', 'Média')",
        "nb_banded",
    ),
)
def moves_promotable(spark, sf_dir):
    return ninebox.moves(model(spark, sf_dir))[0]


@register(
    "moves_at_risk",
    with_ctes(
        f"SELECT {_MOVE_COLS} FROM nb_banded WHERE pot_cat = 'Baixo' AND perf_cat = 'Baixa'",
        "nb_banded",
    ),
)
def moves_at_risk(spark, sf_dir):
    return ninebox.moves(model(spark, sf_dir))[1]


@register(
    "kpi_moves",
    with_ctes(
        """SELECT count(CASE WHEN potencial_bruto > q66 AND perf_media < 2.0 THEN 1 END) AS subalocados,
  count(CASE WHEN potencial_bruto <= q33 AND perf_media < 1.5 THEN 1 END) AS em_risco,
  count(*) AS populacao
FROM nb_banded""",
        "nb_banded",
    ),
)
def kpi_moves(spark, sf_dir):
    return ninebox.kpi_moves(model(spark, sf_dir))
