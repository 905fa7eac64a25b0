"""Behavioural clusters and regression.

* Features stay in the person's attribute array (no shuffle by attribute),
  z-scored with *population* std (sklearn ``StandardScaler``; std 0 -> scale 1)
  from one vector aggregate.
* K-Means fits all (k, start) models over one scan per Lloyd pass
  (``operators/kmeans.py``) and keeps the least inertia of 10 starts per k, with
  the reference's stopping rule. Starts are k rows chosen by digest, so results
  do not depend on the cluster. Clusters are numbered by size.
* Silhouette is the squared Euclidean one, linear in the rows: same purpose as
  the reference's pairwise score, not the same number (that one is O(n^2)).
* Regression solves the normal equations of one vector aggregate; dependent
  columns get the least-norm solution, as least squares does.
* Only model outputs (centres, second moments: bounded by k and the feature
  count) come back to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.functions.stats import DISPLAY_SCALE, rounded
from crewlens.operators.arrays import array_mean, element_rows, gram_matrix
from crewlens.operators.core import top_k
from crewlens.operators.kmeans import assigned, best_of, fit_many, silhouettes
from crewlens.plans.people import ASSESSMENT_COLUMNS, ATTRIBUTE_PREFIX, PeopleModel
from crewlens.session import written_once

# Model settings of the reference's analysis.
SEED = 42
N_INIT = 10
K_RANGE = range(2, 9)
K_ARCHETYPES = 4
MIN_ROWS_REGRESSION = 20
MIN_ROWS_CLUSTERS = 8
TOP_CENTROID_ATTRS = 4

#: A column whose variance is under this share of its mean square is constant; eigenvalues under it are none.
FLAT = 1e-12


def scaled_vectors(m: PeopleModel) -> DataFrame:
    """(cpf, z): the complete attribute arrays, z-scored element by element, written once."""
    full = m.complete_vectors()
    stats = full.groupBy(F.lit(0).alias("_all")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("attrs")).alias("_s")
    )
    n = F.col("_s.count")
    one = stats.select(
        vector_to_array("_s.mean").alias("_mean"),
        F.transform(vector_to_array("_s.variance"), lambda v: F.coalesce(F.nullif(F.sqrt(v * (n - 1) / n), F.lit(0.0)), F.lit(1.0))).alias("_std"),
    )
    centred = F.zip_with("attrs", "_mean", lambda v, mean: v - mean)
    # one row: the statistics of the whole table
    z = full.crossJoin(F.broadcast(one)).select("cpf", F.zip_with(centred, "_std", lambda v, s: v / s).alias("z"))
    return written_once(z, "features")


def kmeans_elbow(m: PeopleModel, ks=K_RANGE, n_init: int = N_INIT, seed: int = SEED) -> DataFrame:
    """Inertia (best of ``n_init``) and silhouette for each k."""
    spark = m.people_raw.sparkSession
    z = scaled_vectors(m)
    n, rows = z.count(), []
    if n >= MIN_ROWS_CLUSTERS:  # the reference's guard for the whole block
        best = best_of(fit_many(z, "cpf", "z", [k for k in ks if k < n], range(seed, seed + n_init)))
        scores = silhouettes(z, "z", list(best.values()))
        rows = [(k, round(f.inertia, DISPLAY_SCALE), round(scores[k], DISPLAY_SCALE), n) for k, f in best.items()]
    return spark.createDataFrame(rows, "k int, inercia double, silhouette double, n long")


class Archetypes:
    """k = 4 behavioural archetypes and what they mean per area."""

    def __init__(self, m: PeopleModel, k: int = K_ARCHETYPES, n_init: int = N_INIT, seed: int = SEED):
        self.m = m
        z = scaled_vectors(m)
        if z.count() < MIN_ROWS_CLUSTERS:  # the reference's guard for the whole block
            numbered = z.select("cpf", F.lit(0).alias("cluster")).where(F.lit(False))
        else:
            numbered = assigned(z, "cpf", "z", best_of(fit_many(z, "cpf", "z", [k], range(seed, seed + n_init)))[k])
        self.assign = numbered.select("cpf", "cluster", F.concat(F.lit("Perfil "), F.col("cluster")).alias("perfil"))

    def profile(self) -> DataFrame:
        """Centroids in original units (mean attribute per cluster) and sizes."""
        a = self.m.complete_vectors().join(self.assign, "cpf")
        means = a.groupBy("cluster", "perfil").agg(array_mean("attrs").alias("_m"), F.count(F.lit(1)).alias("n"))
        return element_rows(means, ["cluster", "perfil", "n"], "_m", self.m.n_attributes(), "_media")

    def area_fit(self) -> DataFrame:
        """Mean performance per area x archetype (people with performance)."""
        return self._area_fit().select("area", "cluster", "perfil", rounded("_media").alias("perf_media"), "n")

    def _area_fit(self) -> DataFrame:
        b = self.m.base("area", "perf_media").where(F.col("perf_media").isNotNull() & F.col("area").isNotNull())
        return b.join(self.assign, "cpf").groupBy("area", "cluster", "perfil").agg(
            F.avg("perf_media").alias("_media"), F.count(F.lit(1)).alias("n")
        )

    def ideal(self) -> DataFrame:
        """Best archetype per area (highest raw mean, ties -> lower cluster), its mean, its
        people out of the area's, and its top-4 attributes by raw centroid."""
        order = F.struct((-F.col("_media")).alias("v"), F.col("cluster").alias("c"))
        best = self._area_fit().groupBy("area").agg(
            F.min_by(F.struct("cluster", "_media", "n"), order).alias("b"), F.sum("n").alias("n_area")
        )
        best = best.select("area", "b.cluster", rounded("b._media").alias("perf_media"), F.col("b.n").alias("n_ideal"), "n_area")
        top = top_k(self.profile().drop("n"), ["cluster"], [F.col("_media").desc(), F.col("idx")], TOP_CENTROID_ATTRS, "rank")
        return self.m.named(best.join(top, "cluster")).select(
            "area", "cluster", "perfil", "perf_media", "n_ideal", "n_area", "rank", "idx", "atributo", rounded("_media").alias("media")
        )


def least_squares(moments: dict) -> tuple[np.ndarray, float]:
    """(coefficients of the z-scored features, R^2) from raw second moments; the last column is the target.

    The least-norm solution: a constant feature and the surplus of dependent
    ones get what a pseudo-inverse gives. R^2 of a constant target is 1 if the
    fit is exact, as every fit of it is.
    """
    means = np.array(moments["means"])
    raw = np.zeros((len(means), len(means)))
    raw[np.triu_indices(len(means))] = moments["products"]
    raw += np.triu(raw, 1).T
    cov = raw - np.outer(means, means)
    var = np.diag(cov).copy()
    flat = var <= FLAT * np.diag(raw)
    std = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    cov[flat, :] = 0.0
    cov[:, flat] = 0.0
    r = cov / np.outer(std, std)
    coefs = np.linalg.pinv(r[:-1, :-1], rcond=FLAT, hermitian=True) @ r[:-1, -1] * std[-1]
    explained = float(coefs @ r[:-1, -1]) * std[-1]
    return coefs, 1.0 if flat[-1] else explained / float(var[-1])


def regression_coefs(m: PeopleModel) -> DataFrame:
    """Linear regression of mean performance on the z-scored assessments and attributes.

    Coefficients ranked by absolute value, with R^2 and n. Fewer than 21
    complete rows -> empty result with the same schema (reference guard).
    """
    assess = list(ASSESSMENT_COLUMNS.values())
    base = m.base(*assess, "perf_media").dropna(subset=[*assess, "perf_media"]).join(m.complete_vectors(), "cpf")
    moments = gram_matrix(base, [F.col(c) for c in assess], "attrs", "perf_media")
    n, rows = moments["n"], []
    if n > MIN_ROWS_REGRESSION:
        coefs, r2 = least_squares(moments)
        names = list(ASSESSMENT_COLUMNS) + [f"{ATTRIBUTE_PREFIX}{i + 1}" for i in range(len(coefs) - len(assess))]
        ranked = sorted(zip(names, coefs.tolist()), key=lambda t: (-abs(t[1]), t[0]))
        rows = [(v, round(c, DISPLAY_SCALE), i + 1, round(float(r2), DISPLAY_SCALE), n) for i, (v, c) in enumerate(ranked)]
    return m.people_raw.sparkSession.createDataFrame(rows, "variavel string, coef double, rank int, r2 double, n long")
