"""Raw-data profiling.

Every profile is one aggregate pass (plus an unpivot) over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.operators import core
from crewlens.plans.people import PeopleModel


def describe_people(m: PeopleModel) -> DataFrame:
    """A20 over the numeric columns of the raw assessment table (the person key
    is an identifier, text in the source, so it is not described)."""
    cols = [c for c in core.numeric_columns(m.people_raw) if c != "cpf"]
    return core.describe_numeric(m.people_raw, cols)


def null_profile_raw(m: PeopleModel) -> DataFrame:
    """A19 on each raw input table (assessments, performance, area)."""
    parts = [
        core.null_profile(m.people_raw, "assessments"),
        core.null_profile(m.perf, "performance"),
        core.null_profile(m.area_raw, "area"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_profile_merged(m: PeopleModel) -> DataFrame:
    """A19 over the merged data set (D1 output): only columns with nulls."""
    return core.null_profile(merged(m))


def merged(m: PeopleModel) -> DataFrame:
    """Cleaned people ⟕ deduplicated area ⟕ performance summary ⟕ period scores."""
    return m.merged_with_periods()


def run_summary(m: PeopleModel) -> DataFrame:
    """S8 for the cleaning job: rows x columns of each input and of the merged
    output, and how many people got an area (one aggregate per table)."""
    parts = [
        ("assessments", m.people_raw, None),
        ("performance", m.perf, None),
        ("area", m.area_raw, None),
        ("merged", merged(m), F.col("area").isNotNull()),
    ]
    out = None
    for name, df, mapped in parts:
        part = df.agg(
            F.count(F.lit(1)).alias("linhas"),
            # only defined for the merged table (missing elsewhere, hence double)
            (F.count(F.when(mapped, 1)) if mapped is not None else F.lit(None)).cast("double").alias("com_area"),
        ).select(F.lit(name).alias("tabela"), "linhas", F.lit(len(df.columns)).alias("colunas"), "com_area")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_values(m: PeopleModel) -> DataFrame:
    """Sorted distinct raw band labels, raw areas and cleaned names (picker list)."""
    parts = [
        m.people_raw.select(F.lit("cultura_classificacao").alias("coluna"), F.col("cultura_classificacao").alias("valor")),
        m.area_raw.select(F.lit("area").alias("coluna"), F.col("area").alias("valor")),
        m.people.select(F.lit("nome_completo").alias("coluna"), F.col("nome_completo").alias("valor")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("valor").isNotNull()).distinct().orderBy("coluna", "valor")


def duplicate_counts(m: PeopleModel) -> DataFrame:
    """Duplicates after the first occurrence, per table and key."""
    specs = [
        ("assessments", "*", m.people_raw, None),
        ("assessments", "cpf", m.people_raw, ["cpf"]),
        ("assessments", "nome,sobrenome", m.people_raw, ["nome", "sobrenome"]),
        ("area", "cpf", m.area_raw, ["cpf"]),
        ("performance", "cpf,ano,semestre", m.perf, ["cpf", "ano", "semestre"]),
    ]
    out = None
    for table, key, df, keys in specs:
        part = core.duplicate_rows(df, keys).select(F.lit(table).alias("tabela"), F.lit(key).alias("chave"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def area_duplicated_members(m: PeopleModel) -> DataFrame:
    """Every area row whose cpf appears more than once."""
    return core.duplicated_members(m.area_raw, ["cpf"])


def key_overlap(m: PeopleModel) -> DataFrame:
    """Cpf overlap between assessments, performance and area."""
    flags = core.key_overlap({"main": m.people_raw, "perf": m.perf, "area": m.area_raw}, "cpf")
    mn, pf, ar = F.col("in_main") == 1, F.col("in_perf") == 1, F.col("in_area") == 1

    def cnt(cond):
        return F.count(F.when(cond, 1))

    return flags.agg(
        cnt(mn).alias("cpf_main"), cnt(pf).alias("cpf_perf"), cnt(ar).alias("cpf_area"),
        cnt(mn & pf & ar).alias("nas_tres"),
        cnt(mn & ~pf).alias("main_sem_perf"), cnt(mn & ~ar).alias("main_sem_area"),
        cnt(pf & ~mn).alias("perf_sem_main"), cnt(ar & ~mn).alias("area_sem_main"),
        cnt(mn & ~pf & ~ar).alias("so_main"),
    )
