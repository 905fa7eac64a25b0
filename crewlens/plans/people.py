"""Canonical people data set (D1) in long form, and its cleaning steps.

Inputs are the reference's three tables re-shaped for Spark:

* ``people``  - one assessment row per person (``cpf`` key),
* ``area``    - ``(cpf, area, ordinal)`` with duplicate keys (keep the last),
* ``perf``    - long performance ``(cpf, ano, semestre, score)``,
* ``attrs``   - behavioural attributes ``(cpf, attrs)``, one array per person,
* ``sessions``- timed assessment attempts ``(cpf, assessment, inicio, fim, score)``.

Every derived table is a lazy DataFrame over the scans; nothing is kept
between queries, so a result always follows the files as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.functions import text

# Presence flags (P9): flag name -> source column.
PRESENCE_FLAGS = {
    "fez_raciocinio": "raciocinio",
    "fez_cultura": "cultura_pontuacao",
    "fez_social": "social",
    "fez_motivacional": "motivacional",
    "fez_perfil": "perfil_comunicacao",
    "fez_atributos": "atributo_comunicacao",
}

# Column of the culture band.
BAND_COLUMN = "cultura_classificacao"

# Prefix of the attribute columns in the source tables (fixed value).
ATTRIBUTE_PREFIX = "atributo-"

ASSESSMENT_COLUMNS = {
    # label -> column (fixed order of the reference's assessment list)
    "Raciocínio": "raciocinio",
    "Social": "social",
    "Motivacional": "motivacional",
    "Cultura": "cultura_pontuacao",
}


def clean_expressions(people: DataFrame) -> dict[str, "F.Column"]:
    """D1 step 1 as named expressions: full name (X6), raw band label, flags."""
    exprs = {"nome_completo": text.full_name("nome", "sobrenome")}
    for c in people.columns:
        if c not in ("nome", "sobrenome", BAND_COLUMN):
            exprs[c] = F.col(c)
    exprs[BAND_COLUMN] = F.col(BAND_COLUMN)  # folded by ``clean_people``
    for flag, src in PRESENCE_FLAGS.items():
        if src in people.columns:
            exprs[flag] = F.col(src).isNotNull().cast("int")
    return exprs


def folded_once(df: DataFrame, source: DataFrame, col: str, fold) -> DataFrame:
    """``df`` with ``fold`` applied to ``col``, computed once per distinct text of ``source``.

    Labels repeat, folding them is costly, and a filter on a folded column would
    be pushed down with a copy of the whole expression. So the distinct raw
    texts (reduced map-side) are folded and joined back: a left join on a unique
    key, which goes away where the column is not read and which AQE broadcasts.
    """
    raw = source.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_raw")).agg(F.lit(1).alias("_one"))
    folded = raw.select("_raw", fold("_raw").alias("_folded"))
    joined = df.withColumnRenamed(col, "_text").join(folded, F.col("_text") == F.col("_raw"), "left")
    return joined.select(*[F.col("_folded").alias(c) if c == col else F.col(c) for c in df.columns])


def clean_people(people: DataFrame, cols=None) -> DataFrame:
    """D1 step 1: the cleaned assessment table (optionally only ``cols``)."""
    exprs = clean_expressions(people)
    names = [c for c in exprs if cols is None or c in cols or c == "cpf"]
    plain = people.select(*[exprs[c].alias(c) for c in names])
    if BAND_COLUMN not in names:
        return plain
    return folded_once(plain, people, BAND_COLUMN, text.band_label)


def fold_area(col):
    """Area names: strip -> title -> NFKD fold."""
    return text.fold_ascii(text.title_case(text.strip_py(col)), "NFKD")


def clean_area(area: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """D1 step 2: the last area row per cpf (W2), its name folded.

    ``max_by`` over the explicit ordinal is one partial + final aggregate, so a
    person with many area rows never needs a sort of all their rows.
    """
    last = area.where(F.col("cpf").isNotNull()).groupBy("cpf").agg(F.max_by("area", order_col).alias("area"))
    return folded_once(last, area, "area", fold_area)


def perf_summary(perf: DataFrame) -> DataFrame:
    """A8 + A9: mean score and number of scored periods per person."""
    return perf.where(F.col("cpf").isNotNull()).groupBy("cpf").agg(
        F.avg("score").alias("perf_media"),
        F.count("score").alias("n_avaliacoes"),
    )


def period_column():
    """The wide column name of a half-year."""
    return F.format_string("perf_%d_%d", F.col("semestre"), F.col("ano"))


@dataclass
class PeopleModel:
    people_raw: DataFrame
    area_raw: DataFrame
    perf: DataFrame
    attrs: DataFrame | None = None
    sessions: DataFrame | None = None
    #: (idx, coluna): the source's column name of each attribute
    attr_columns: DataFrame | None = None

    @classmethod
    def from_fixtures(cls, fx) -> "PeopleModel":
        return FixtureModel(fx)

    @cached_property
    def people(self) -> DataFrame:
        """Cleaned assessment table (lazy; analyses read it through ``merged``)."""
        return clean_people(self.people_raw)

    @cached_property
    def area(self) -> DataFrame:
        return clean_area(self.area_raw)

    @cached_property
    def summary(self) -> DataFrame:
        """A8/A9 per person (the reference recomputes it at ~20 sites)."""
        return perf_summary(self.perf)

    @cached_property
    def merged(self) -> DataFrame:
        """Cleaned people ⟕ last area ⟕ performance summary, one row per person.

        A lazy relation of joins on the unique person key: an analysis that
        selects no column of a side does not scan it.
        """
        return (
            self.people.join(self.area, "cpf", "left")
            .join(self.summary, "cpf", "left")
            .withColumn("n_avaliacoes", F.coalesce(F.col("n_avaliacoes"), F.lit(0).cast("long")))
        )

    def merged_with_periods(self) -> DataFrame:
        """The merged table with one ``perf_<half>_<year>`` column per half-year.

        The column list spans the first to the last year of the data, read from
        a one-row aggregate.
        """
        wide = self.perf.where(F.col("cpf").isNotNull()).withColumn("_c", period_column())
        wide = wide.groupBy("cpf").pivot("_c", self.period_columns()).agg(F.first("score").cast("double"))
        return self.merged.join(wide, "cpf", "left")

    def period_columns(self) -> list[str]:
        """Names of the period columns, in order of time."""
        span = self.perf.agg(F.min("ano").alias("a"), F.max("ano").alias("z")).first()
        if span["a"] is None:
            return []
        return [f"perf_{half}_{year}" for year in range(span["a"], span["z"] + 1) for half in (1, 2)]

    @cached_property
    def perf_area(self) -> DataFrame:
        """Long performance of the people in the base, with their area (R1 output)."""
        return self.perf.join(self.people.select("cpf").join(self.area, "cpf", "left"), "cpf")

    def base(self, *cols: str) -> DataFrame:
        """Columns of the merged person table (``cpf`` first)."""
        return self.merged.select("cpf", *[c for c in cols if c != "cpf"])

    def complete_vectors(self) -> DataFrame:
        """people with every attribute non-null, one array per person (no regrouping)."""
        size = self.attrs.agg(F.max(F.size("attrs")).alias("_n"))
        full = self.attrs.crossJoin(F.broadcast(size)).where(
            (F.size("attrs") == F.col("_n")) & F.forall("attrs", lambda v: v.isNotNull())
        )
        return full.select("cpf", "attrs")

    def attrs_complete(self) -> DataFrame:
        """Key set of ``complete_vectors``."""
        return self.complete_vectors().select("cpf")

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``idx``) plus ``atributo``, the column name without its group prefix.

        Joined to finished results only: a few rows per group on the left, one
        row per attribute on the right. Without names the position stands in.
        """
        if self.attr_columns is None:
            return df.withColumn("atributo", F.col("idx").cast("string"))
        names = self.attr_columns.select("idx", text.strip_prefix("coluna", ATTRIBUTE_PREFIX).alias("atributo"))
        return df.join(names, "idx", "left")

    def n_attributes(self) -> int:
        """Number of attributes, from the data."""
        return self.attrs.agg(F.max(F.size("attrs")).alias("n")).first()["n"] or 0


class FixtureModel(PeopleModel):
    """The model over driver tables: a table is opened when an analysis first asks for it."""

    def __init__(self, fx):
        self._fx = fx

    @cached_property
    def people_raw(self) -> DataFrame:
        return self._fx.people_main

    @cached_property
    def area_raw(self) -> DataFrame:
        return self._fx.area_raw

    @cached_property
    def perf(self) -> DataFrame:
        return self._fx.perf_long

    @cached_property
    def attrs(self) -> DataFrame:
        return self._fx.attributes

    @cached_property
    def sessions(self) -> DataFrame:
        return self._fx.assess_sessions

    @cached_property
    def attr_columns(self) -> DataFrame:
        return self._fx.attribute_columns


#: Buckets of stored person tables: a join of two reads no shuffle and one bucket pair a task.
PERSON_BUCKETS = 64


def store_person_tables(m: PeopleModel, path: str, buckets: int = PERSON_BUCKETS) -> "StoredModel":
    """The cleaned person tables written once under ``path``, all bucketed and sorted by the person key.

    ``people``, ``area``, ``perf`` and ``attrs`` share the key, the number of
    buckets and the hash, so every later join or group-by on the person reads
    them without an exchange. Each table is shuffled once, here.
    """
    spark, name = m.people.sparkSession, f"person_{uuid.uuid4().hex}"
    for part, df in (("people", m.people), ("area", m.area), ("perf", m.perf), ("attrs", m.attrs)):
        spread = df.repartition(buckets, "cpf")
        spread.write.bucketBy(buckets, "cpf").sortBy("cpf").option("path", f"{path.rstrip('/')}/{part}").saveAsTable(f"{name}_{part}")
    return StoredModel(spark, name)


class StoredModel(PeopleModel):
    """The model over tables that ``store_person_tables`` has written in this session's catalog."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._name = spark, name

    @cached_property
    def people(self) -> DataFrame:
        return self._spark.table(f"{self._name}_people")

    @cached_property
    def area(self) -> DataFrame:
        return self._spark.table(f"{self._name}_area")

    @cached_property
    def perf(self) -> DataFrame:
        return self._spark.table(f"{self._name}_perf")

    @cached_property
    def attrs(self) -> DataFrame:
        return self._spark.table(f"{self._name}_attrs")
