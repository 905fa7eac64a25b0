"""Invariants of SURVEY §5 on the sf0.01 tables."""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_MID


def q(spark, name):
    return E.queries()[name](spark, SF_MID)


def test_ninebox_cells_sum_to_population(spark):
    cells = q(spark, "ninebox_matrix").collect()
    pop = q(spark, "ninebox_listing").where(F.col("quadrante") != "N/A").count()
    assert sum(r.n for r in cells) == pop > 1000
    assert math.isclose(sum(r.pct for r in cells), 100.0, abs_tol=1e-4)


def test_score_shares_sum_to_100_per_period(spark):
    tot = q(spark, "score_share").groupBy("ano", "semestre").agg(F.sum("pct").alias("t")).collect()
    assert all(math.isclose(r.t, 100.0, abs_tol=1e-4) for r in tot)


def test_every_close_has_an_open_twin(spark):
    for name in ("scd2_area", "scd2_job"):
        df = q(spark, name)
        closes = df.where("acao = 'fechar'").select("chg_id").distinct()
        opens = df.where("acao = 'abrir'").select("chg_id").distinct()
        assert closes.join(opens, "chg_id", "left_anti").count() == 0
        assert df.where("acao = 'fechar'").where(F.col("id").isNull()).count() == 0


def test_salary_output_disjoint_from_history(spark):
    from crewlens.catalog import fixtures

    hist = fixtures(spark, SF_MID).sys_salaries.select("person", F.to_date("dt").alias("d"))
    new = q(spark, "salary_new").select("person", F.to_date("date").alias("d"))
    assert new.join(hist, ["person", "d"]).count() == 0


def test_pending_and_resolved_cover_the_feed(spark):
    ids = q(spark, "feed_resolve")
    pend = q(spark, "feed_pending")
    not_found = pend.where(F.col("person").isNull()).count()
    assert ids.where(F.col("person").isNotNull()).count() + not_found == ids.count()


def regression_table(spark):
    from crewlens.catalog import model
    from crewlens.plans.people import ASSESSMENT_COLUMNS

    m = model(spark, SF_MID)
    assess = list(ASSESSMENT_COLUMNS.values())
    pdf = m.base(*assess, "perf_media").dropna().join(m.complete_vectors(), "cpf").toPandas()  # test-side brute force on a small fixture
    x = np.column_stack([pdf[assess].to_numpy(float), np.array(pdf["attrs"].tolist())])
    names = list(ASSESSMENT_COLUMNS) + [f"atributo-{i + 1}" for i in range(x.shape[1] - len(assess))]
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    return names, z, pdf["perf_media"].to_numpy(float)


def test_regression_matches_least_squares(spark):
    """All 64 attributes: coefficients and R^2 of a plain least-squares fit, residual orthogonal to every feature."""
    names, z, y = regression_table(spark)
    assert z.shape[1] == 68 and len(y) > 100
    coefs = q(spark, "regression_coefs").collect()
    beta, *_ = np.linalg.lstsq(z, y - y.mean(), rcond=None)
    residual = y - y.mean() - z @ beta
    r2 = 1 - (residual**2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.abs(z.T @ residual).max() < 1e-9 and math.isclose(coefs[0].r2, r2, abs_tol=2e-6)
    found = {r.variavel: r.coef for r in coefs}
    assert all(math.isclose(found[n], b, abs_tol=2e-6) for n, b in zip(names, beta))
    assert [r["rank"] for r in coefs] == list(range(1, 69)) and sorted(coefs, key=lambda r: r["rank"])[0].coef != 0


def test_kmeans_elbow_falls_and_matches_plain_fits(spark):
    from crewlens.catalog import model
    from crewlens.operators.kmeans import best_of, fit_many, silhouettes
    from crewlens.plans import ml

    z = ml.scaled_vectors(model(spark, SF_MID))
    x = np.array([r.z for r in z.orderBy("cpf").collect()])
    assert x.shape == (500, 64) and np.abs(x.mean(0)).max() < 1e-9 and np.abs(x.std(0) - 1).max() < 1e-9
    fits = fit_many(z, "cpf", "z", [2, 4], range(42, 45))
    assert len(fits) == 6
    for f in fits:
        dist = ((x[:, None, :] - f.centres) ** 2).sum(2)
        own = dist.argmin(1)
        assert math.isclose(f.inertia, dist.min(1).sum(), rel_tol=1e-9) and f.sizes.tolist() == np.bincount(own, minlength=f.k).tolist()
        means = np.array([x[own == c].mean(0) for c in range(f.k)])
        assert ((means - f.centres) ** 2).sum() < 0.01  # a further pass hardly moves them
    best = best_of(fits)
    assert best[4].inertia < best[2].inertia == min(f.inertia for f in fits if f.k == 2)
    pairs = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    for k, got in silhouettes(z, "z", list(best.values())).items():
        own = ((x[:, None, :] - best[k].centres) ** 2).sum(2).argmin(1)
        s = []
        for i in range(len(x)):
            means = [pairs[i][(own == c) & (np.arange(len(x)) != i)].mean() for c in range(k)]
            inner, other = means[own[i]], min(v for c, v in enumerate(means) if c != own[i])
            s.append((other - inner) / max(other, inner))
        assert math.isclose(got, np.mean(s), abs_tol=1e-9)


def test_cluster_means_weighted_by_size_are_the_population_means(spark):
    from crewlens.catalog import model

    profile = q(spark, "kmeans_profile")
    pooled = profile.groupBy("idx").agg((F.sum(F.col("media") * F.col("n")) / F.sum("n")).alias("p"), F.sum("n").alias("n"))
    long = model(spark, SF_MID).complete_vectors().select(F.posexplode("attrs").alias("_p", "v"))
    plain = long.groupBy((F.col("_p") + 1).alias("idx")).agg(F.avg("v").alias("m"), F.count("v").alias("k"))
    rows = pooled.join(plain, "idx").collect()
    assert len(rows) == 64 and all(math.isclose(r.p, r.m, abs_tol=1e-5) and r.n == r.k for r in rows)


def test_area_shares_stay_below_100_when_people_lack_an_area(spark):
    rows = q(spark, "area_share").collect()
    assert 80 < sum(r.pct for r in rows) < 99.9
    two = sum(r.pct for r in rows if r["rank"] <= 2)
    assert all(math.isclose(r.pct_duas_maiores, two, abs_tol=1e-5) for r in rows)


def test_results_follow_rewritten_files(spark, tmp_path):
    """Nothing is kept by path: the same folder with other rows gives other results."""
    import shutil

    # file by file into a new folder: a copied folder would keep the source's read-only mode
    folder = str(tmp_path / "data")
    os.mkdir(folder)
    for name in os.listdir("/root/testdata/sf0.001"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}", f"{folder}/{name}")
    first = E.queries()["score_distribution"](spark, folder).agg(F.sum("n")).first()[0]
    half = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_custkey % 2 = 0")
    os.remove(f"{folder}/orders.parquet")
    half.write.parquet(f"{folder}/orders.parquet")
    second = E.queries()["score_distribution"](spark, folder).agg(F.sum("n")).first()[0]
    assert 0 < second < first
