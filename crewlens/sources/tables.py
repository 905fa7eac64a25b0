"""Table readers and writers."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Readers chosen by file suffix. Excel workbooks are re-aimed as one table per
# file; a workbook's sheets become sibling tables in a dataset folder.
_READERS = {
    ".parquet": lambda r, p: r.parquet(p),
    ".csv": lambda r, p: r.option("header", True).option("inferSchema", False).csv(p),
    ".json": lambda r, p: r.json(p),
    ".orc": lambda r, p: r.orc(p),
}

_WRITERS = {
    "parquet": lambda w, p: w.parquet(p),
    "csv": lambda w, p: w.option("header", True).csv(p),
    "json": lambda w, p: w.json(p),
    "orc": lambda w, p: w.orc(p),
}


def suffix_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a table with the reader chosen by the path suffix.

    Unknown suffixes raise ``ValueError`` like the reference's dispatcher.
    A schema, when given, is applied instead of inference.
    """
    ext = suffix_of(path)
    if ext not in _READERS:
        raise ValueError(f"unsupported file type: {ext or '<none>'}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return _READERS[ext](reader, path)


def load_people(spark: SparkSession, dataset_dir: str, ext: str = ".parquet") -> dict[str, DataFrame]:
    """The three related tables of one delivery (assessments, performance, area)."""
    base = dataset_dir.rstrip("/")
    return {name: read_table(spark, f"{base}/{name}{ext}") for name in ("assessments", "performance", "area")}


def table_columns(df: DataFrame) -> list[str]:
    """Header-only probe; resolving the schema runs no job."""
    return list(df.columns)


def promote_header(df: DataFrame, ordinal_col: str, k: int) -> DataFrame:
    """S3: take the row with ``ordinal == k`` as header, keep rows after it.

    ``df`` is a headerless table whose rows carry an explicit ordinal (file row
    number). The header row is one row, so fetching it is a bounded action.
    """
    value_cols = [c for c in df.columns if c != ordinal_col]
    header = df.where(F.col(ordinal_col) == k).select(*value_cols).first()
    if header is None:
        raise ValueError(f"no row with {ordinal_col} == {k}")
    names = [str(v) if v is not None else f"_c{i}" for i, v in enumerate(header)]
    return df.where(F.col(ordinal_col) > k).select(
        F.col(ordinal_col), *[F.col(c).alias(n) for c, n in zip(value_cols, names)]
    )


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> str:
    """Write a result table; the format comes from ``fmt`` or the suffix."""
    fmt = (fmt or suffix_of(path).lstrip(".") or "parquet").lower()
    if fmt not in _WRITERS:
        raise ValueError(f"unsupported output format: {fmt}")
    _WRITERS[fmt](df.write.mode(mode), path)
    return path


def default_output_path(input_path: str) -> str:
    """``<stem>_limpo.<ext>`` next to the input."""
    p = input_path.rstrip("/")
    if "." not in PurePosixPath(p).name:
        return f"{p}_limpo"
    stem, ext = p.rsplit(".", 1)
    return f"{stem}_limpo.{ext}"
