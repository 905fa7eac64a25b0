"""The job path as queries: tables written in every format and read back, and stored person tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlens.catalog import fixtures, model, register
from crewlens.jobs import roundtrip_digests
from crewlens.oracle.ctes import with_ctes
from crewlens.plans.people import store_person_tables
from crewlens.queries import q_clean, q_feed  # noqa: F401  (registers the CTEs used below)
from crewlens.session import scratch_folder

_SHEET = ("colaborador", "data_alteracao", "salario", "departamento", "cargo", "situacao")
_DIGESTS = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS coluna, count(*) AS linhas, count({c}) AS preenchidos,
  CAST(coalesce(sum(CAST('0x' || substr(md5(linha || ':' || {c}), 1, 8) AS bigint)), 0) AS bigint) AS resumo FROM sheet"""
    for c in _SHEET
)
_SHEET_SQL = """SELECT row_number() OVER (ORDER BY chg_id) AS linha, colaborador,
  strftime(data_alteracao, '%Y-%m-%d %H:%M:%S') AS data_alteracao, CAST(CAST(salario AS decimal(18, 2)) AS varchar) AS salario,
  departamento, cargo, situacao FROM feed"""


def _roundtrip(ext: str):
    def query(spark, sf_dir):
        """The client list as a delivered file, read in file order."""
        feed = fixtures(spark, sf_dir).feed
        sheet = feed.select(
            "chg_id", "colaborador", F.date_format("data_alteracao", "yyyy-MM-dd HH:mm:ss").alias("data_alteracao"),
            F.col("salario").cast("decimal(18,2)").cast("string").alias("salario"), "departamento", "cargo", "situacao",
        )
        return roundtrip_digests(spark, sheet, "chg_id", f"{scratch_folder(spark, 'delivery')}/changes{ext}")

    return query


for _ext in (".parquet", ".orc", ".json", ".csv"):
    register(f"roundtrip_{_ext[1:]}", with_ctes(_DIGESTS, "feed", extra=(("sheet", _SHEET_SQL),)))(_roundtrip(_ext))


@register("stored_merge", q_clean.MERGED_SQL)
def stored_merge(spark, sf_dir):
    """J1 over co-partitioned tables: people, areas and scores bucketed by person, merged without a shuffle."""
    stored = store_person_tables(model(spark, sf_dir), scratch_folder(spark, "person-tables"))
    return q_clean.merged_columns(stored)
