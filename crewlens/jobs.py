"""Batch jobs with the reference's two entry points.

    python -m crewlens.jobs clean <dataset_dir> [output] [--format parquet]
    python -m crewlens.jobs feed  <changes> <system_dir> <out_dir> [--header-row K]

``clean`` reads a delivery of three tables (assessments, performance, area),
standardises the headers, drops the empty ``Match`` and ``URL*`` columns,
parses the ``Início``/``Fim`` timestamps, turns wide ``Performance <half>º/<year>``
columns into the long form, writes the merged person table (D1) and prints the
run summary and null profile. ``feed`` runs the change feed (E1-E7) and writes
the five import tables. Both are one lazy plan per output; the only actions
are the writes and the small summaries.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlens.operators import core
from crewlens.operators.sequence import numbered
from crewlens.plans.feed import FeedJob, salary_days
from crewlens.plans.people import PeopleModel
from crewlens.plans.profile import run_summary
from crewlens.sources import tables as T

# The reference's input headers -> our column names.
ASSESSMENT_HEADERS = {
    "CPF": "cpf",
    "Nome": "nome",
    "Sobrenome": "sobrenome",
    "E-mail": "email",
    "Raciocínio": "raciocinio",
    "Social": "social",
    "Motivacional": "motivacional",
    "Cultura pontuação": "cultura_pontuacao",
    "Cultura classificação": "cultura_classificacao",
    "Potencial Bruto": "potencial_bruto",
}
AREA_HEADERS = {"CPF": "cpf", "Área": "area"}
PERFORMANCE_RENAMES = (("Performance ", "perf_"), ("º/", "_"), ("º ", "_"))
CHANGE_HEADERS = {
    "Colaborador": "colaborador",
    "Data de Alteração": "data_alteracao",
    "Salário": "salario",
    "Departamento": "departamento",
    "Cargo": "cargo",
    "Situação": "situacao",
}
EMPTY_COLUMN = "Match"
URL_PREFIX = "URL"
TIMESTAMP_PREFIXES = ("Início", "Fim")
SALARY_DATE_FORMAT = "dd/MM/yyyy"
MONEY = "decimal(18,2)"


def rename_known(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P5: rename the columns present in ``mapping``; others keep their name."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def read_in_order(spark: SparkSession, path: str, name: str = "ordinal", schema_read=None) -> DataFrame:
    """S1 plus the file order as a column (N4): files by name, rows by their place in the file.

    Spark packs larger files first, so its own row ids are no file order. For
    Parquet the place is the row index; for text formats it is the position of
    the split and of the row in it. A table that already has the column keeps it.
    """
    df = schema_read(path) if schema_read else T.read_table(spark, path)
    if name in df.columns:
        return df
    parquet = T.suffix_of(path) == ".parquet"
    place = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    # row ids of a text file count on from its splits: their start keeps a file's rows in order
    begin = F.lit(0).cast("long") if parquet else F.col("_metadata.file_block_start")
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), begin.alias("_begin"), place.alias("_place"))
    files = rows.select("_file").distinct()
    rank = files.withColumn("_rank", F.row_number().over(Window.orderBy("_file")))  # one row per file
    order = F.col("_rank").cast("long") * F.lit(1 << 44) + F.col("_begin") + F.col("_place") % F.lit(1 << 33)
    return rows.join(F.broadcast(rank), "_file").withColumn(name, order).drop("_file", "_begin", "_place", "_rank")


def roundtrip_digests(spark: SparkSession, df: DataFrame, order: str, path: str) -> DataFrame:
    """Write ``df`` in ``order`` to ``path`` (format by suffix), read it back in file order, and digest every column.

    ``coluna``, ``linhas``, ``preenchidos`` (values that are there) and
    ``resumo``: the sum of 32 bits of md5("row number:value"), which changes with
    any value and with its place. Empty input gives zeros. JSON keeps no name of
    a column without a value, so it is read with the names and types written.
    """
    values = [c for c in df.columns if c != order]
    sheet = df.orderBy(order).select(*values)
    T.write_table(sheet, path)
    typed = (lambda p: T.read_table(spark, p, sheet.schema)) if T.suffix_of(path) == ".json" else None
    back = numbered(read_in_order(spark, path, "_ordinal", typed), "_ordinal", "_ordinal", "_linha")

    def digest(c: str):
        text = F.concat_ws(":", F.col("_linha").cast("string"), F.col(c).cast("string"))
        return F.when(F.col(c).isNotNull(), F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))

    parts = [F.count(c).alias(f"n_{i}") for i, c in enumerate(values)]
    parts += [F.coalesce(F.sum(digest(c)), F.lit(0)).alias(f"s_{i}") for i, c in enumerate(values)]
    one = back.agg(F.count(F.lit(1)).alias("linhas"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(f"n_{i}").alias("preenchidos"), F.col(f"s_{i}").alias("resumo")) for i, c in enumerate(values)])
    return one.select("linhas", F.explode(rows).alias("r")).select("r.coluna", "linhas", "r.preenchidos", "r.resumo")


def standardize_assessments(df: DataFrame) -> DataFrame:
    """D1 preparation: P1 drop ``Match``, P2 drop ``URL*``, X11/X12 parse
    ``Início``/``Fim`` as UTC timestamps (bad -> null), P5 rename headers."""
    df = df.drop(EMPTY_COLUMN)
    df = core.drop_prefix(df, URL_PREFIX)
    types = dict(df.dtypes)
    for c in core.cols_with_prefix(df, *TIMESTAMP_PREFIXES):
        raw = F.col(f"`{c}`")
        # text (possibly with a UTC offset) -> instant -> UTC wall time; typed
        # timestamps are converted in the session zone (UTC)
        parsed = F.try_to_timestamp(raw) if types[c] == "string" else raw.try_cast("timestamp")
        df = df.withColumn(c, parsed.cast("timestamp_ntz"))
    df = rename_known(df, ASSESSMENT_HEADERS)
    for c in ("cpf",):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("string"))
    return df


def performance_long(df: DataFrame) -> DataFrame:
    """Performance in long form ``(cpf, ano, semestre, score)``.

    Wide input (``Performance 1º/2018`` or ``perf_1_2018`` headers) is renamed
    (P4), its period columns selected by prefix (P3), melted (R1) and the
    period parsed from the name (X9).
    """
    df = rename_known(df, {"CPF": "cpf"})
    if {"ano", "semestre", "score"} <= set(df.columns):
        return df.select(F.col("cpf").cast("string").alias("cpf"), "ano", "semestre", "score")
    df = core.rename_literals(df, PERFORMANCE_RENAMES)
    periods = core.cols_with_prefix(df, "perf_")
    long = core.melt(
        df.select(F.col("cpf").cast("string").alias("cpf"), *[F.col(c).try_cast("double").alias(c) for c in periods]),
        ["cpf"], periods, "_col", "score",
    )
    parts = F.split("_col", "_")
    return long.select(
        "cpf", parts[2].cast("int").alias("ano"), parts[1].cast("int").alias("semestre"), "score"
    )


def area_table(df: DataFrame) -> DataFrame:
    """The area table with its ``ordinal`` column (file order, see ``read_in_order``)."""
    return rename_known(df, AREA_HEADERS).select(F.col("cpf").cast("string").alias("cpf"), "area", "ordinal")


def clean_job(spark: SparkSession, dataset_dir: str, output: str | None = None, ext: str = ".parquet",
              fmt: str | None = None) -> dict:
    """Lifecycle (1): load -> clean -> merge -> write; returns the run summary."""
    t = T.load_people(spark, dataset_dir, ext)
    t["area"] = read_in_order(spark, f"{dataset_dir.rstrip('/')}/area{ext}")
    people = standardize_assessments(t["assessments"])
    m = PeopleModel(people, area_table(t["area"]), performance_long(t["performance"]))
    merged = m.merged_with_periods()
    out = output or T.default_output_path(dataset_dir.rstrip("/") + "/merged" + ext)
    T.write_table(merged, out, fmt)
    summary = [r.asDict() for r in run_summary(m).collect()]
    nulls = [r.asDict() for r in core.null_profile(merged).orderBy(F.col("pct_nulos").desc(), "coluna").collect()]
    return {"output": out, "summary": summary, "nulls": nulls}


def changes_table(spark: SparkSession, path: str, header_row: int | None = None) -> DataFrame:
    """E1 input: the client list, optionally with preamble rows before the header (S3)."""
    if header_row is None:
        df = read_in_order(spark, path, "chg_id")
    else:
        plain = spark.read.option("header", False).csv if T.suffix_of(path) == ".csv" else None
        raw = read_in_order(spark, path, "chg_id", plain)
        # the header is the row with that many rows before it
        ids = [r["chg_id"] for r in raw.select("chg_id").orderBy("chg_id").limit(header_row + 1).collect()]
        df = T.promote_header(raw, "chg_id", ids[-1])
    df = rename_known(df, CHANGE_HEADERS)
    return df.select(
        "chg_id", "colaborador",
        F.col("data_alteracao").cast("timestamp_ntz").alias("data_alteracao"),
        F.col("salario").cast(MONEY).alias("salario"),
        "departamento", "cargo", "situacao",
    )


def salary_history(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history with ``dt``, rejects); the day is a typed date or text in dd/MM/yyyy."""
    return salary_days(df, "dt" if "dt" in df.columns else "date", SALARY_DATE_FORMAT)


def feed_job(spark: SparkSession, changes: str, system_dir: str, out_dir: str, header_row: int | None = None,
             ext: str = ".parquet", fmt: str | None = None, sequence: bool | str = False,
             normalize_departments: bool = False) -> dict:
    """Lifecycle (2): resolve, diff and write the five import tables and the salary rejects."""
    base = system_dir.rstrip("/")
    salaries, rejects = salary_history(T.read_table(spark, f"{base}/salaries{ext}"))
    job = FeedJob(
        changes_table(spark, changes, header_row),
        T.read_table(spark, f"{base}/people{ext}"),
        salaries,
        T.read_table(spark, f"{base}/areas{ext}"),
        T.read_table(spark, f"{base}/instances{ext}"),
        T.read_table(spark, f"{base}/jobs{ext}"),
        sequence=sequence, normalize_departments=normalize_departments,
    )
    def write(name: str, df: DataFrame) -> None:
        T.write_table(df, f"{out_dir.rstrip('/')}/{name}{ext if fmt is None else '.' + fmt}", fmt)

    counts = job.run(write)
    write("rejeitados", rejects)
    return counts


def main(argv=None) -> None:
    from crewlens.session import build_session

    ap = argparse.ArgumentParser(prog="crewlens.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("clean")
    c.add_argument("dataset_dir")
    c.add_argument("output", nargs="?")
    c.add_argument("--ext", default=".parquet")
    c.add_argument("--format")
    f = sub.add_parser("feed")
    f.add_argument("changes")
    f.add_argument("system_dir")
    f.add_argument("out_dir")
    f.add_argument("--header-row", type=int)
    f.add_argument("--sequence", nargs="?", const="latest", default=False, choices=["latest", "chain"],
                   help="apply only the latest change of a person, or all in order, each ended by the next")
    f.add_argument("--normalize-departments", action="store_true")
    f.add_argument("--ext", default=".parquet")
    f.add_argument("--format")
    args = ap.parse_args(argv)
    spark = build_session(app_name=f"crewlens-{args.cmd}")
    if args.cmd == "clean":
        res = clean_job(spark, args.dataset_dir, args.output, args.ext, args.format)
    else:
        res = feed_job(spark, args.changes, args.system_dir, args.out_dir, args.header_row, args.ext, args.format, args.sequence, args.normalize_departments)
    print(json.dumps(res, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
