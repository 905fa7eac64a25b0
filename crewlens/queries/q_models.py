"""Model queries. The DuckDB twins run the same fits in SQL:
Lloyd passes as a recursive query over all models, least squares by elimination
on the matrix of second moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import model, register
from crewlens.functions.stats import rounded
from crewlens.operators.kmeans import MAX_PASSES, TOLERANCE
from crewlens.oracle.ctes import CTES, with_ctes
from crewlens.plans import ml

CTES.update(
    {
        "feats": (
            """SELECT cpf, list((value - mean) / std ORDER BY idx) AS z FROM (
  SELECT a.cpf, a.idx, a.value, avg(a.value) OVER w AS mean, coalesce(nullif(stddev_pop(a.value) OVER w, 0), 1) AS std
  FROM attributes_long a JOIN attrs_complete c ON a.cpf = c.cpf WINDOW w AS (PARTITION BY a.idx)) GROUP BY cpf""",
            ("attributes_long", "attrs_complete"),
        ),
        "n_feats": ("SELECT count(*) AS n FROM feats", ("feats",)),
    }
)


def fits_ctes(ks: str) -> tuple[tuple[str, str], ...]:
    """Every (k, seed) model, and the best of each k with its labels and cluster numbers."""
    return (
        (
            "seeded",
            f"""SELECT s, z, row_number() OVER (PARTITION BY s ORDER BY md5(cpf || ':' || s), cpf) AS nth
FROM feats, (SELECT unnest(range({ml.SEED}, {ml.SEED + ml.N_INIT})) AS s)""",
        ),
        (
            "lloyd",
            f"""WITH RECURSIVE it(step, k, s, centres, done) AS (
  SELECT 0, k, s, list(z ORDER BY nth), false
  FROM seeded, (SELECT unnest({ks}) AS k), n_feats WHERE nth <= k AND k < n AND n >= {ml.MIN_ROWS_CLUSTERS} GROUP BY k, s
  UNION ALL
  SELECT step + 1, k, s, moved, list_sum(list_transform(range(1, k + 1), lambda c: list_distance(centres[c], moved[c]) ** 2)) <= {TOLERANCE}
  FROM (
    SELECT step, k, s, any_value(centres) AS centres, list(coalesce(m, centres[c]) ORDER BY c) AS moved FROM (
      SELECT o.step, o.k, o.s, o.centres, o.c, any_value(v.m) AS m
      FROM (SELECT step, k, s, centres, unnest(range(1, k + 1)) AS c FROM it WHERE NOT done AND step < {MAX_PASSES}) o
      LEFT JOIN (
        SELECT k, s, c, list(x ORDER BY i) AS m FROM (
          SELECT k, s, c, i, avg(x) AS x FROM (
            SELECT k, s, c, unnest(z) AS x, unnest(range(1, len(z) + 1)) AS i FROM (
              SELECT k, s, z, list_position(d, list_min(d)) AS c FROM (
                SELECT it.k, it.s, f.z, list_transform(it.centres, lambda c: list_distance(c, f.z)) AS d
                FROM it, feats f WHERE NOT it.done AND it.step < {MAX_PASSES})))
          GROUP BY k, s, c, i)
        GROUP BY k, s, c) v ON v.k = o.k AND v.s = o.s AND v.c = o.c
      GROUP BY o.step, o.k, o.s, o.centres, o.c)
    GROUP BY step, k, s))
SELECT k, s, arg_max(centres, step) AS centres FROM it GROUP BY k, s""",
        ),
        (
            "labels",
            """SELECT k, s, cpf, z, list_position(d, list_min(d)) AS c, list_min(d) ** 2 AS dist FROM (
  SELECT l.k, l.s, f.cpf, f.z, list_transform(l.centres, lambda c: list_distance(c, f.z)) AS d FROM lloyd l, feats f)""",
        ),
        ("inertias", "SELECT k, s, sum(dist) AS inertia FROM labels GROUP BY k, s"),
        ("best_fit", "SELECT k, arg_min(s, inertia) AS s, min(inertia) AS inertia FROM inertias GROUP BY k"),
        ("best_labels", "SELECT l.* FROM labels l JOIN best_fit b ON l.k = b.k AND l.s = b.s"),
        (
            "clusters",
            """SELECT n.k, n.c, n.n, row_number() OVER (PARTITION BY n.k ORDER BY n.n DESC, l.centres[n.c] DESC) AS cluster
FROM (SELECT k, s, c, count(*) AS n FROM best_labels GROUP BY 1, 2, 3) n JOIN lloyd l ON l.k = n.k AND l.s = n.s""",
        ),
    )


_ARCHETYPES = (
    *fits_ctes(f"[{ml.K_ARCHETYPES}]"),
    (
        "assign",
        """SELECT b.cpf, CAST(c.cluster AS int) AS cluster, 'Perfil ' || c.cluster AS perfil
FROM best_labels b JOIN clusters c ON b.k = c.k AND b.c = c.c""",
    ),
    (
        "profile",
        """SELECT s.cluster, s.perfil, a.idx, avg(a.value) AS _media, count(*) AS n
FROM attributes_long a JOIN assign s ON a.cpf = s.cpf GROUP BY 1, 2, 3""",
    ),
    (
        "fit_area",
        """SELECT b.area, s.cluster, s.perfil, avg(b.perf_media) AS _media, count(*) AS n FROM base b JOIN assign s ON b.cpf = s.cpf
WHERE b.perf_media IS NOT NULL AND b.area IS NOT NULL GROUP BY 1, 2, 3""",
    ),
)


@register(
    "kmeans_elbow",
    with_ctes(
        """SELECT CAST(b.k AS int) AS k, round(b.inertia, 6) AS inercia, round(sil.v, 6) AS silhouette, n_feats.n
FROM best_fit b JOIN sil ON sil.k = b.k, n_feats""",
        "n_feats",
        extra=(
            *fits_ctes(f"range({min(ml.K_RANGE)}, {max(ml.K_RANGE) + 1})"),
            (
                "totals",
                """SELECT k, c, any_value(n) AS n, list(t ORDER BY i) AS t, any_value(q) AS q FROM (
  SELECT k, c, i, sum(x) AS t, any_value(n) AS n, any_value(q) AS q FROM (
    SELECT b.k, b.c, w.n, w.q, unnest(b.z) AS x, unnest(range(1, len(b.z) + 1)) AS i
    FROM best_labels b JOIN (SELECT k, c, count(*) AS n, sum(list_inner_product(z, z)) AS q FROM best_labels GROUP BY 1, 2) w
      ON w.k = b.k AND w.c = b.c) GROUP BY k, c, i) GROUP BY k, c""",
            ),
            (
                "sil",
                """SELECT k, avg(CASE WHEN n = 1 THEN 0 ELSE (other - own) / greatest(other, own) END) AS v FROM (
  SELECT b.k, b.cpf, any_value(CASE WHEN t.c = b.c THEN t.n END) AS n,
    min(CASE WHEN t.c <> b.c THEN m END) AS other, min(CASE WHEN t.c = b.c THEN m * t.n / (t.n - 1) END) AS own
  FROM best_labels b JOIN totals t ON t.k = b.k,
    LATERAL (SELECT list_inner_product(b.z, b.z) + (t.q - 2 * list_inner_product(b.z, t.t)) / t.n AS m)
  GROUP BY b.k, b.cpf) GROUP BY k""",
            ),
        ),
    ),
)
def kmeans_elbow(spark, sf_dir):
    return ml.kmeans_elbow(model(spark, sf_dir))


def archetypes(spark, sf_dir) -> ml.Archetypes:
    """A k = 4 fit (best of 10 starts) on the tables as they are now."""
    return ml.Archetypes(model(spark, sf_dir))


@register(
    "kmeans_profile",
    with_ctes(
        "SELECT cluster, perfil, idx, round(_media, 6) AS media, n FROM profile", "n_feats", "base", extra=_ARCHETYPES
    ),
)
def kmeans_profile(spark, sf_dir):
    p = archetypes(spark, sf_dir).profile()
    return p.select("cluster", "perfil", "idx", rounded("_media").alias("media"), "n")


@register(
    "kmeans_area_fit",
    with_ctes(
        "SELECT area, cluster, perfil, round(_media, 6) AS perf_media, n FROM fit_area", "n_feats", "base", extra=_ARCHETYPES
    ),
)
def kmeans_area_fit(spark, sf_dir):
    return archetypes(spark, sf_dir).area_fit()


@register(
    "kmeans_ideal",
    with_ctes(
        """SELECT b.area, b.cluster, t.perfil, round(b._media, 6) AS perf_media, b.n AS n_ideal, CAST(b.n_area AS bigint) AS n_area,
  CAST(t.rank AS int) AS rank, t.idx, m.atributo, round(t._media, 6) AS media
FROM (SELECT *, sum(n) OVER (PARTITION BY area) AS n_area, row_number() OVER (PARTITION BY area ORDER BY _media DESC, cluster) AS r
      FROM fit_area) b
JOIN (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY _media DESC, idx) AS rank FROM profile) t ON t.cluster = b.cluster
LEFT JOIN attribute_names m ON m.idx = t.idx
WHERE b.r = 1 AND t.rank <= 4""",
        "n_feats", "base", "attribute_names", extra=_ARCHETYPES,
    ),
)
def kmeans_ideal(spark, sf_dir):
    return archetypes(spark, sf_dir).ideal()


# Gauss-Jordan elimination, a column a step, on the z-scored normal equations.
_REGRESSION = (
    (
        "reg_rows",
        """SELECT b.cpf, list_concat([b.raciocinio, b.social, b.motivacional, b.cultura_pontuacao], a.v) AS x, b.perf_media AS y
FROM base b JOIN (SELECT cpf, list(value ORDER BY idx) AS v FROM attributes_long WHERE cpf IN (SELECT cpf FROM attrs_complete) GROUP BY cpf) a
  ON a.cpf = b.cpf
WHERE b.raciocinio IS NOT NULL AND b.social IS NOT NULL AND b.motivacional IS NOT NULL AND b.cultura_pontuacao IS NOT NULL
  AND b.perf_media IS NOT NULL""",
    ),
    ("reg_long", "SELECT cpf, y, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM reg_rows"),
    (
        "reg_z",
        """SELECT cpf, y - avg(y) OVER w AS y, i, (v - avg(v) OVER w) / coalesce(nullif(stddev_pop(v) OVER w, 0), 1) AS z
FROM reg_long WINDOW w AS (PARTITION BY i)""",
    ),
    ("reg_n", "SELECT count(*) AS n, var_pop(y) * count(*) AS yy FROM reg_rows"),
    ("reg_p", "SELECT max(i) AS p FROM reg_z"),
    (
        "reg_m",
        """SELECT i, list_append(list(g ORDER BY j), any_value(h)) AS row FROM (
  SELECT a.i, b.i AS j, sum(a.z * b.z) AS g, any_value(e.h) AS h FROM reg_z a JOIN reg_z b ON a.cpf = b.cpf
  JOIN (SELECT i, sum(z * y) AS h FROM reg_z GROUP BY i) e ON e.i = a.i GROUP BY a.i, b.i) GROUP BY i""",
    ),
    (
        "reg_solved",
        """WITH RECURSIVE g(step, m) AS (
  SELECT 0, list(row ORDER BY i) FROM reg_m
  UNION ALL
  SELECT step + 1, list_transform(m, lambda r, i: CASE WHEN i = step + 1 THEN list_transform(r, lambda v: v / r[step + 1])
    ELSE list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
  FROM g, reg_p WHERE step < p)
SELECT list_transform(m, lambda r: r[len(r)]) AS coefs FROM g, reg_p WHERE step = p""",
    ),
    (
        "reg_coefs",
        """SELECT unnest(coefs) AS coef, unnest(range(1, len(coefs) + 1)) AS i FROM reg_solved""",
    ),
    (
        "reg_r2",
        """SELECT sum(c.coef * e.h) / any_value(yy) AS r2 FROM reg_coefs c
JOIN (SELECT i, sum(z * y) AS h FROM reg_z GROUP BY i) e ON e.i = c.i, reg_n""",
    ),
)


@register(
    "regression_coefs",
    with_ctes(
        f"""SELECT variavel, round(coef, 6) AS coef, CAST(row_number() OVER (ORDER BY abs(coef) DESC, variavel) AS int) AS rank,
  round(r2, 6) AS r2, n
FROM (SELECT CASE i WHEN 1 THEN 'Raciocínio' WHEN 2 THEN 'Social' WHEN 3 THEN 'Motivacional' WHEN 4 THEN 'Cultura'
  ELSE 'atributo-' || (i - 4) END AS variavel, coef FROM reg_coefs), reg_r2, reg_n WHERE n > {ml.MIN_ROWS_REGRESSION}""",
        "base", "attributes_long", "attrs_complete", extra=_REGRESSION,
    ),
)
def regression_coefs(spark, sf_dir):
    return ml.regression_coefs(model(spark, sf_dir))


@register(
    "simple_fit_check",
    with_ctes(
        """SELECT round(regr_slope(perf_media, potencial_bruto), 6) AS slope,
  round(regr_intercept(perf_media, potencial_bruto), 6) AS intercept,
  round(regr_r2(perf_media, potencial_bruto), 6) AS r2, CAST(regr_count(perf_media, potencial_bruto) AS bigint) AS n
FROM base""",
        "base",
    ),
)
def simple_fit_check(spark, sf_dir):
    """One-feature least squares (A18) over all people: the closed form the regression reduces to."""
    b = model(spark, sf_dir).base("potencial_bruto", "perf_media")
    y, x = F.col("perf_media"), F.col("potencial_bruto")
    return b.agg(
        rounded(F.regr_slope(y, x)).alias("slope"), rounded(F.regr_intercept(y, x)).alias("intercept"),
        rounded(F.regr_r2(y, x)).alias("r2"), F.regr_count(y, x).alias("n"),
    )
