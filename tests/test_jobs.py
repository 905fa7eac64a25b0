"""The two CLI jobs on a reference-shaped delivery built from the sf0.01 tables."""

from __future__ import annotations

import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from crewlens.jobs import clean_job, feed_job
from crewlens.plans.feed import FeedJob
from crewlens.plans.people import PeopleModel
from crewlens.sources.fixtures import Fixtures
from tests.conftest import SF_MID


def test_clean_job_on_reference_headers(spark):
    fx = Fixtures(spark, SF_MID)
    m = PeopleModel.from_fixtures(fx)
    d = tempfile.mkdtemp(prefix="crewlens-clean-")
    renames = {
        "cpf": "CPF", "nome": "Nome", "sobrenome": "Sobrenome", "raciocinio": "Raciocínio", "social": "Social",
        "motivacional": "Motivacional", "cultura_pontuacao": "Cultura pontuação",
        "cultura_classificacao": "Cultura classificação", "potencial_bruto": "Potencial Bruto",
    }
    assess = fx.people_main.withColumnsRenamed(renames).select(
        "*", F.lit(None).cast("string").alias("Match"), F.lit("http://x").alias("URL Raciocínio"),
        F.lit("2019-03-01T10:00:00-03:00").alias("Início - Raciocínio"), F.lit("not a date").alias("Fim - Raciocínio"),
    )
    assess.write.parquet(f"{d}/assessments.parquet")
    wide = (
        fx.perf_long.withColumn("_p", F.format_string("Performance %dº/%d", "semestre", "ano"))
        .groupBy("cpf").pivot("_p").agg(F.first("score")).withColumnRenamed("cpf", "CPF")
    )
    wide.write.parquet(f"{d}/performance.parquet")
    fx.area_raw.orderBy("ordinal", "cpf").coalesce(1).select(
        F.col("cpf").alias("CPF"), F.col("area").alias("Área")
    ).write.parquet(f"{d}/area.parquet")

    res = clean_job(spark, d, f"{d}/out.parquet")
    out = spark.read.parquet(res["output"])
    assert "Match" not in out.columns and not [c for c in out.columns if c.startswith("URL")]
    assert dict(out.dtypes)["Início - Raciocínio"] == "timestamp_ntz"
    first = out.select("Início - Raciocínio", "Fim - Raciocínio").first()
    assert str(first[0]) == "2019-03-01 13:00:00" and first[1] is None
    cols = ["nome_completo", "area", "perf_media", "n_avaliacoes", "cultura_classificacao"]
    got = sorted(map(tuple, out.select(F.col("cpf").cast("long"), *cols).collect()))
    want = sorted(map(tuple, m.merged.select("cpf", *cols).collect()))
    assert got == want
    assert {r["tabela"] for r in res["summary"]} == {"assessments", "performance", "area", "merged"}


def test_feed_job_matches_plan(spark):
    fx = Fixtures(spark, SF_MID)
    d = tempfile.mkdtemp(prefix="crewlens-feed-")
    fx.feed.orderBy("chg_id").drop("chg_id").coalesce(1).withColumnsRenamed(
        {"colaborador": "Colaborador", "data_alteracao": "Data de Alteração", "salario": "Salário",
         "departamento": "Departamento", "cargo": "Cargo", "situacao": "Situação"}
    ).write.parquet(f"{d}/changes.parquet")
    fx.sys_people.write.parquet(f"{d}/sys/people.parquet")
    fx.sys_salaries.select("person", F.date_format("dt", "dd/MM/yyyy").alias("date"), "salary").write.parquet(
        f"{d}/sys/salaries.parquet"
    )
    fx.sys_areas.write.parquet(f"{d}/sys/areas.parquet")
    fx.sys_instances.write.parquet(f"{d}/sys/instances.parquet")
    fx.sys_jobs.write.parquet(f"{d}/sys/jobs.parquet")
    got = feed_job(spark, f"{d}/changes.parquet", f"{d}/sys", f"{d}/out")
    want = FeedJob.from_fixtures(fx).summary().first().asDict()
    assert got == want
    assert spark.read.parquet(f"{d}/out/instancia_area.parquet").where("id = ''").count() == want["instancias_novas"]
    assert spark.read.parquet(f"{d}/out/rejeitados.parquet").count() == 0


def test_file_order_decides_the_last_row(spark):
    """A one-row file before a large one: the larger file is packed first, but its rows come later."""
    from crewlens.jobs import area_table, read_in_order
    from crewlens.plans.people import clean_area

    for fmt in ("parquet", "csv"):
        d = tempfile.mkdtemp(prefix="crewlens-order-")
        path = f"{d}/area.{fmt}"
        for name, rows in (("a", [("7", "Old")]), ("b", [(str(i), f"area {i}") for i in range(20_000)] + [("7", "New"), ("7", "Newest")])):
            out = f"{d}/{name}"
            frame = spark.createDataFrame(rows, "CPF string, `Área` string").coalesce(1)
            (frame.write.option("header", True).csv(out) if fmt == "csv" else frame.write.parquet(out))
            import glob
            import os
            import shutil

            os.makedirs(path, exist_ok=True)
            part = glob.glob(f"{out}/part-*.{fmt}" if fmt == "csv" else f"{out}/part-*.parquet")[0]
            shutil.copyfile(part, f"{path}/part-{name}.{fmt}")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        try:
            table = area_table(read_in_order(spark, path))
            assert table.select("ordinal").distinct().count() == 20_003
            assert clean_area(table).where("cpf = '7'").first().area == "Newest"
            order = [r.area for r in table.orderBy("ordinal").collect()]
            assert order[0] == "Old" and order[1:5] == ["area 0", "area 1", "area 2", "area 3"] and order[-1] == "Newest"
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_salary_days_typed_text_and_unreadable(spark):
    from crewlens.jobs import salary_history

    typed, none = salary_history(spark.sql("SELECT 1 AS person, DATE '2020-01-02' AS date, 5.0 AS salary"))
    assert str(typed.first().dt) == "2020-01-02 00:00:00" and none.count() == 0
    text = spark.createDataFrame([(1, "02/01/2020"), (2, "2020-01-02"), (3, "31/02/2020"), (4, None)], "person int, date string")
    good, bad = salary_history(text)
    assert [(r.person, str(r.dt)) for r in good.collect()] == [(1, "2020-01-02 00:00:00")]
    assert sorted(r.person for r in bad.collect()) == [2, 3, 4] and bad.first().motivo


def test_feed_amounts_stay_decimal_and_header_row_is_found(spark):
    from decimal import Decimal

    from crewlens.jobs import changes_table

    d = tempfile.mkdtemp(prefix="crewlens-sheet-")
    lines = ["Relatório,,,,,", ",,,,,", "Colaborador,Data de Alteração,Salário,Departamento,Cargo,Situação",
             "Ana Lima,2024-01-02,1234567890123.45,Dept A,Analista,Atual", "Ze X,2024-01-03,10.10,,,Atual"]
    with open(f"{d}/sheet.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    rows = changes_table(spark, f"{d}/sheet.csv", header_row=2).orderBy("chg_id").collect()
    assert [(r.colaborador, r.salario, r.cargo) for r in rows] == [
        ("Ana Lima", Decimal("1234567890123.45"), "Analista"), ("Ze X", Decimal("10.10"), None),
    ]


@pytest.mark.parametrize("ext", [".parquet", ".orc", ".json", ".csv"])
def test_round_trip_keeps_columns_without_a_value(spark, tmp_path, ext):
    from crewlens.jobs import roundtrip_digests

    df = spark.createDataFrame([(2, "b", None), (1, "a", None), (3, None, None)], "n long, x string, y string")
    got = {r[0]: tuple(r)[1:] for r in roundtrip_digests(spark, df, "n", str(tmp_path / f"some{ext}")).collect()}
    digest = sum(int(hashlib.md5(t).hexdigest()[:8], 16) for t in (b"1:a", b"2:b"))
    assert got == {"x": (3, 2, digest), "y": (3, 0, 0)}
    none = roundtrip_digests(spark, df.limit(0), "n", str(tmp_path / f"none{ext}")).collect()
    assert sorted(map(tuple, none)) == [("x", 0, 0, 0), ("y", 0, 0, 0)]
