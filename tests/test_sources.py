"""Sources and sinks round-trip (S1, S3, S4, S6, S7) in a scratch folder."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from crewlens.sources import tables as T


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="crewlens-test-")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_write_read_roundtrip(spark, scratch, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = T.write_table(df, f"{scratch}/t.{fmt}")
    back = T.read_table(spark, path)
    assert sorted(str(r["v"]) for r in back.collect()) == ["a", "b"]


def test_unknown_suffix_raises(spark):
    with pytest.raises(ValueError):
        T.read_table(spark, "/x/table.xlsx")


def test_default_output_path():
    assert T.default_output_path("data/people.parquet") == "data/people_limpo.parquet"
    assert T.default_output_path("data/people") == "data/people_limpo"


def test_promote_header(spark):
    rows = [(0, "Relatorio", None), (1, None, None), (2, "Colaborador", "Cargo"), (3, "Ana", "Analista")]
    df = spark.createDataFrame(rows, "ord int, c0 string, c1 string")
    out = T.promote_header(df, "ord", 2)
    assert out.columns == ["ord", "Colaborador", "Cargo"]
    assert [tuple(r)[1:] for r in out.collect()] == [("Ana", "Analista")]


def test_table_columns_is_lazy(spark):
    df = spark.range(3).withColumn("x", F.lit(1))
    assert T.table_columns(df) == ["id", "x"]


def test_load_people(spark, scratch):
    for name in ("assessments", "performance", "area"):
        T.write_table(spark.createDataFrame([(1,)], "cpf long"), f"{scratch}/{name}.parquet")
    got = T.load_people(spark, scratch)
    assert set(got) == {"assessments", "performance", "area"}
