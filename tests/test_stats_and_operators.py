"""Edge cases of the statistics helpers and generic operators (FIXTURES §C)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from crewlens.functions.stats import cut3, pearson, quantile_cuts
from crewlens.operators import core
from crewlens.operators.scd2 import scd2_diff


def test_pearson_degenerate_groups_are_null(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 2.0), ("const", 1.0, 5.0), ("const", 1.0, 7.0), ("ok", 1.0, 1.0), ("ok", 2.0, 2.0), ("ok", 3.0, None)],
        "g string, x double, y double",
    )
    out = {r.g: r.r for r in df.groupBy("g").agg(pearson("x", "y").alias("r")).collect()}
    assert out["one"] is None
    assert out["const"] is None
    assert math.isclose(out["ok"], 1.0)


def test_cut3_right_closed_with_lowest(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (1.51,), (2.5,), (3.0,), (3.01,), (3.02,), (-0.1,), (None,)], "x double")
    got = [r.b for r in df.select(cut3("x", 0.0, 1.5, 2.5, 3.01, ("Baixa", "Média", "Alta")).alias("b")).collect()]
    assert got == ["Baixa", "Baixa", "Média", "Média", "Alta", "Alta", None, None, None]


def test_cut3_equal_edges_leave_middle_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    got = [r.b for r in df.select(cut3("x", 0.0, 2.0, 2.0, 101.0, ("L", "M", "H")).alias("b")).collect()]
    assert got == ["L", "L", "H"]


def test_quantile_cuts_linear_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "x double")
    row = quantile_cuts(df, "x").first()
    assert math.isclose(row.q33, 1 + 0.33 * 9)
    assert math.isclose(row.q66, 1 + 0.66 * 9)


def test_keep_by_last_and_first(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 5)], "k int, v string, o int")
    last = {r.k: r.v for r in core.keep_by(df, ["k"], F.col("o"), last=True).collect()}
    first = {r.k: r.v for r in core.keep_by(df, ["k"], F.col("o"), last=False).collect()}
    assert last == {1: "b", 2: "c"} and first == {1: "a", 2: "c"}


def test_duplicates_and_members(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "y")], "k int, v string")
    row = core.duplicate_rows(df).first()
    assert (row.linhas, row.distintos, row.duplicados) == (5, 3, 2)
    assert core.duplicated_members(df, ["k"]).count() == 4


def test_crosstab_zero_fill(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    got = {(r.r, r.c): r.n for r in core.crosstab_zero_fill(df, ["r"], "c", ["x", "y", "z"]).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 0, ("a", "z"): 0, ("b", "x"): 0, ("b", "y"): 1, ("b", "z"): 0}


def test_null_profile_only_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3.0, None), (3, None, "b"), (4, 1.0, "c")], "a int, b double, c string")
    got = {r.coluna: (r.nulos, r.pct_nulos) for r in core.null_profile(df).collect()}
    assert got == {"b": (2, 50.0), "c": (1, 25.0)}


def test_scd2_diff_branches_and_fanout(spark):
    changes = spark.createDataFrame(
        [(1, 10, "2020-01-05", 7), (2, 20, "2020-01-05", 8), (3, 30, "2020-01-05", 9), (4, 40, "2020-01-05", 1)],
        "chg_id int, person int, dt string, novo int",
    ).withColumn("dt", F.to_date("dt"))
    active = spark.createDataFrame(
        # 10: none; 20: same value; 30: changed; 40: two active rows (fan-out)
        [(200, 20, "2019-01-01", 8), (300, 30, "2019-01-01", 5), (400, 40, "2019-01-01", 2), (401, 40, "2019-06-01", 3)],
        "id int, person int, start_date string, atual int",
    ).withColumn("start_date", F.to_date("start_date"))
    out = scd2_diff(
        changes, active, "person", "dt", "novo", "atual",
        new_payload={"v": F.col("novo")}, cur_payload={"v": F.col("atual")},
    ).collect()
    by = {}
    for r in out:
        by.setdefault(r.person, []).append((r.acao, r.id, r.v))
    assert sorted(by[10]) == [("abrir", None, 7)]
    assert 20 not in by
    assert sorted(by[30]) == [("abrir", None, 9), ("fechar", 300, 5)]
    assert sorted(by[40], key=str) == sorted(
        [("abrir", None, 1), ("abrir", None, 1), ("fechar", 400, 2), ("fechar", 401, 3)], key=str
    )
    closes = [r for r in out if r.acao == "fechar"]
    assert all(r.end_date is not None for r in closes)


def test_exact_quantiles_match_numpy_on_skewed_groups(spark):
    import numpy as np

    from crewlens.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(3)]          # a third-plus of all rows
    rows += [(f"g{i % 7}", float(v)) for i, v in enumerate(rng.exponential(size=2000).round(2))]
    rows += [("one", 5.0), ("ties", 1.0), ("ties", 1.0), ("ties", 2.0), (None, 3.0), ("nul", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.33, 0.5, 0.9, 0.95, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy=400).collect()}
    small = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(small)
    for g in got:
        for p in probs:
            k = f"q{int(round(p * 100))}"
            assert math.isclose(got[g][k], small[g][k], rel_tol=1e-12, abs_tol=1e-12)
    by: dict = {}
    for g, v in rows:
        if v is not None and g is not None:  # null group keys are dropped (pandas groupby)
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, vals in by.items():
        expect = np.quantile(np.array(vals), probs)  # linear interpolation
        for p, e in zip(probs, expect):
            assert math.isclose(got[g][f"q{int(round(p * 100))}"], e, rel_tol=1e-9, abs_tol=1e-9), (g, p)


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, "u", "v", 2.0)], "cpf long, `URL a` string, `URL b` string, `Performance 1º/2018` double")
    assert core.drop_prefix(df, "URL").columns == ["cpf", "Performance 1º/2018"]
    assert core.cols_with_prefix(df, "URL") == ["URL a", "URL b"]
    renamed = core.rename_literals(df, [("Performance ", "perf_"), ("º/", "_")])
    assert renamed.columns[-1] == "perf_1_2018"
    assert core.move_first(df, "URL b").columns[0] == "URL b"
    assert core.with_fallback(df, "area", F.lit("N/A")).first().area == "N/A"
    long = core.melt(renamed, ["cpf"], ["perf_1_2018"], "semestre", "score").first()
    assert (long.semestre, long.score) == ("perf_1_2018", 2.0)


def test_quantiles_with_a_hot_value_and_far_outliers(spark):
    """One value holds 90 % of the rows; a few values span 300 orders of magnitude."""
    import numpy as np

    from crewlens.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    values = [2.0] * 9000 + rng.normal(2, 1e-6, 900).tolist() + [1e300, -1e300, 1e-300, 0.0, -0.0, 1e15]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.01, 0.02, 0.05, 0.5, 0.95, 0.999, 1.0]
    got = exact_quantiles(df, [], "v", probs, [f"p{i}" for i in range(len(probs))]).first()
    for i, want in enumerate(np.quantile(np.array(values), probs)):
        assert math.isclose(got[i], want, rel_tol=1e-9), (probs[i], got[i], want)
    assert exact_quantiles(df.where("v > 1e308"), [], "v", [0.5], ["m"]).collect() == []


def test_building_the_plans_runs_no_job(spark):
    from crewlens.operators.quantiles import exact_quantiles
    from crewlens.operators.sequence import next_in_group

    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v"))
    spark.sparkContext.setJobGroup("building", "no job may start here")
    try:
        exact_quantiles(df, ["g"], "v", [0.5])
        next_in_group(df, "g", ["id"], "v", "n", F.floor(F.col("id") / 10))
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbered_matches_a_window(spark):
    from pyspark.sql import Window

    from crewlens.operators.sequence import numbered

    rows = [(i * i % 991, f"n{i}") for i in range(700)] + [(5, "x"), (5, "a"), (10**9, "far")]
    df = spark.createDataFrame(rows, "o long, name string")
    want = df.withColumn("n", F.row_number().over(Window.orderBy("o", "name")).cast("long"))
    assert sorted(numbered(df, "o", "name", "n").collect()) == sorted(want.collect())
    assert numbered(df.where("o < 0"), "o", "name", "n").collect() == []


def test_an_outlier_id_leaves_the_numbering_spread(spark):
    from crewlens.operators import sequence

    df = spark.range(40_000).select(F.when(F.col("id") == 7, F.lit(2**50)).otherwise(F.col("id")).alias("o"), F.lit("n").alias("name"))
    parts = []
    plain = sequence.written_once
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one partition
    try:
        sequence.written_once = lambda rows, name: parts.append(plain(rows, name)) or parts[-1]
        got = sequence.numbered(df.repartition(4), "o", "name", "n")
    finally:
        sequence.written_once = plain
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.where("n = 40000").first()["o"] == 2**50 and got.where("n <> o + IF(o > 7, 0, 1)").count() == 1
    most = parts[0].groupBy("_part").count().agg(F.max("count")).first()[0]
    assert most < 20_000


def test_key_filter_keeps_every_match_and_little_else(spark):
    from crewlens.operators.reduce import reduced_by_keys

    big = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.col("id").alias("_bits"), F.col("id").cast("string").alias("v"))
    big = big.unionByName(spark.createDataFrame([(None, 1, "x")], big.schema))
    keys = spark.range(0, 50_000, 100).select(F.col("id").alias("k"), F.lit(1).alias("w")).unionByName(spark.createDataFrame([(None, 1)], "k long, w int"))
    kept = reduced_by_keys(big, keys, "k")
    assert kept.columns == big.columns
    assert kept.where("k % 100 = 0").count() == 2000 and kept.count() < 2050
    few = reduced_by_keys(big, keys, "k", bits=1 << 10)  # a crowded filter loses nothing either
    assert few.where("k % 100 = 0").count() == 2000
    assert reduced_by_keys(big, keys.limit(0), "k").count() == 0


def test_key_filter_leaves_columns_of_its_own_names(spark):
    from crewlens.operators.reduce import reduced_by_keys

    big = spark.range(1000).selectExpr("id AS k", "id AS _bits", "id + 1 AS _place", "id + 2 AS _AT", "id + 3 AS _bucket")
    kept = reduced_by_keys(big, spark.range(0, 1000, 100).withColumnRenamed("id", "k"), "k").where("k % 100 = 0")
    assert kept.columns == big.columns
    assert sorted(map(tuple, kept.collect())) == [(i, i, i + 1, i + 2, i + 3) for i in range(0, 1000, 100)]


def test_next_in_group_matches_window_on_hot_key(spark):
    from pyspark.sql import Window

    from crewlens.operators.sequence import next_in_group

    rows = [(1, d, d * 10) for d in range(4000)]                       # one hot key
    rows += [(k, d, k * 1000 + d) for k in range(2, 300) for d in range(3)]
    rows += [(None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "k int, d int, v int")
    got = next_in_group(df, "k", ["d"], "v", "nxt", F.floor(F.col("d") / 100))
    want = df.withColumn("nxt", F.lead("v").over(Window.partitionBy("k").orderBy("d")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    from crewlens.operators.sequence import neighbour_in_group

    got = neighbour_in_group(df, "k", ["d"], "v", "prv", F.floor(F.col("d") / 100), back=True)
    want = df.withColumn("prv", F.lag("v").over(Window.partitionBy("k").orderBy("d")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
