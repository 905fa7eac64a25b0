"""HR change feed: resolve people by name, diff against system state.

Inputs (all DataFrames):

* ``changes``   - client list ``(chg_id, colaborador, data_alteracao, salario,
  departamento, cargo, situacao)``; ``chg_id`` is the file-row ordinal;
* ``people``    - ``(person, nome, sobrenome)``, duplicate names possible;
* ``salaries``  - ``(person, dt, salary)`` history;
* ``areas``     - ``(id, person, start_date, end_date, area)``, active = null end;
* ``instances`` - ``(id, name)`` area instances;
* ``jobs``      - ``(id, person, start_date, end_date, name[, level])``.

Shuffles: one name-key join for resolution, person-key joins for history;
the "first row per name" and "best person per name" picks are partial
aggregates (``min_by``), never a sort of a whole name group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crewlens.functions import labels as L
from crewlens.functions import text
from crewlens.operators.core import attach_one_row, keep_by
from crewlens.operators.reduce import reduced_by_keys
from crewlens.operators.scd2 import scd2_chain, scd2_diff
from crewlens.operators.sequence import numbered
from crewlens.session import written_once


def import_ids(df: DataFrame) -> DataFrame:
    """Import-file form of SCD2 records: the existing id to edit, blank to create."""
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))


CHANGE_COLS = ("chg_id", "colaborador", "data_alteracao", "salario", "departamento", "cargo", "situacao")


def split_names(changes: DataFrame) -> DataFrame:
    """Upper -> NFD fold -> collapse whitespace -> split once into (nome, sobrenome)."""
    first, rest = text.split_first(text.normalize_text(F.upper("colaborador")))
    return changes.select(*CHANGE_COLS, first.alias("nome"), rest.alias("sobrenome"))


def person_priority(people: DataFrame, jobs: DataFrame, areas: DataFrame) -> DataFrame:
    """2 if the person has job and area history, 1 if either, else 0."""
    in_jobs = jobs.select("person").distinct().withColumn("_j", F.lit(1))
    in_areas = areas.select("person").distinct().withColumn("_a", F.lit(1))
    return (
        people.join(in_jobs, "person", "left")
        .join(in_areas, "person", "left")
        .select(
            "person", "nome", "sobrenome",
            (F.coalesce(F.col("_j"), F.lit(0)) + F.coalesce(F.col("_a"), F.lit(0))).alias("prioridade"),
        )
    )


def best_person_per_name(prio: DataFrame) -> DataFrame:
    """One person per (nome, sobrenome): highest priority, then lowest id."""
    order = F.struct((-F.col("prioridade")).alias("p"), F.col("person").alias("id"))
    return prio.groupBy("nome", "sobrenome").agg(
        F.min_by("person", order).alias("person"), F.max("prioridade").alias("prioridade")
    )


def resolve(changes_split: DataFrame, best: DataFrame) -> DataFrame:
    """Left join on the null-safe name pair (N1); ``person`` first."""
    b = best.select(F.col("nome").alias("_n"), F.col("sobrenome").alias("_s"), "person")
    j = changes_split.join(
        b,
        changes_split["nome"].eqNullSafe(b["_n"]) & changes_split["sobrenome"].eqNullSafe(b["_s"]),
        "left",
    )
    return j.select("person", *CHANGE_COLS, "nome", "sobrenome")


def pending(ids: DataFrame, people: DataFrame) -> DataFrame:
    """Not-found rows ∪ first change per duplicated system name ∪ changes that lack a
    target, each with its reason.

    Ambiguous people stay in the main flow (only not-found rows are removed). A
    resolved change without a status, or a current one without a department or
    job title, opens and closes nothing there; it is listed here, once for each
    missing value.
    """
    not_found = ids.where(F.col("person").isNull()).withColumn("motivo", F.lit(L.REASON_NOT_FOUND))
    dup_names = (
        people.groupBy("nome", "sobrenome").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    )
    d = dup_names.select(F.col("nome").alias("_n"), F.col("sobrenome").alias("_s"))
    amb_rows = ids.join(
        d, ids["nome"].eqNullSafe(d["_n"]) & ids["sobrenome"].eqNullSafe(d["_s"]), "left_semi"
    )
    ambiguous = keep_by(amb_rows, ["nome", "sobrenome"], F.col("chg_id"), last=False).withColumn(
        "motivo", F.lit(L.REASON_DUPLICATE)
    )
    return not_found.unionByName(ambiguous.select(*not_found.columns)).unionByName(missing_targets(ids))


def missing_targets(ids: DataFrame) -> DataFrame:
    """Resolved changes with a null status, department or job title, one row per reason."""
    status = F.col("situacao")
    current = F.coalesce(status.startswith(L.PRESENT_STATUS_PREFIX), F.lit(False))
    reasons = F.array(
        F.when(status.isNull(), F.lit(L.REASON_NO_STATUS)),
        F.when(current & F.col("departamento").isNull(), F.lit(L.REASON_NO_DEPARTMENT)),
        F.when(current & F.col("cargo").isNull(), F.lit(L.REASON_NO_JOB)),
    )
    return ids.where(F.col("person").isNotNull()).select("*", F.explode(F.array_compact(reasons)).alias("motivo"))


def latest_per_person(ids: DataFrame) -> DataFrame:
    """B10, ``sequence=True``: only a person's latest change (by date, then file order) is applied."""
    order = F.struct("data_alteracao", "chg_id")
    cols = [c for c in ids.columns if c != "person"]
    last = ids.where(F.col("person").isNotNull()).groupBy("person").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_row")
    )
    return last.select("person", *[F.col(f"_row.{c}").alias(c) for c in cols])


def salary_rows(found: DataFrame, salaries: DataFrame) -> DataFrame:
    """E4 part 1: classify every resolved change (X18) against the last salary date.

    Only the history of people in the feed is aggregated and shuffled.
    """
    last = reduced_by_keys(salaries, found, "person")
    last = last.groupBy("person").agg(F.max("dt").alias("ultima_data_salario"))
    j = found.join(last, "person", "left")
    date, lastd = F.col("data_alteracao"), F.col("ultima_data_salario")
    raise_type = (
        F.when(F.col("person").isNull(), F.lit(L.RAISE_OTHERS))
        .when(lastd.isNull(), F.lit(L.RAISE_INITIAL))
        .when(date > lastd, F.lit(L.RAISE_RAISE))
        .otherwise(F.lit(L.RAISE_INITIAL))
    )
    return j.select(
        F.lit("").alias("id"), "person", date.alias("date"), F.col("salario").alias("salary"),
        raise_type.alias("raise_type"), F.to_date(date).alias("_day"),
    )


def salary_days(salaries: DataFrame, day_col: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """(history with ``dt``, rejects) of salary rows whose day is a text or a typed date.

    Text is read strictly in ``fmt``. A row without a readable day is kept out
    of the history and listed with its reason.
    """
    typed = dict(salaries.dtypes)[day_col] != "string"
    day = F.col(day_col)
    dt = (day if typed else F.try_to_timestamp(day, F.lit(fmt))).cast("timestamp_ntz")
    parsed = salaries.withColumn("dt", dt)
    bad = parsed.where(F.col("dt").isNull()).drop("dt").withColumn("motivo", F.lit(L.REASON_BAD_DAY))
    return parsed.where(F.col("dt").isNotNull()), bad


def paid_days(found: DataFrame, salaries: DataFrame) -> DataFrame:
    """Distinct (person, day) of the salary history, of people in the feed."""
    return reduced_by_keys(salaries, found, "person").select("person", F.to_date("dt").alias("_day")).distinct()


def salary_split(found: DataFrame, salaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new salary rows, already-present rows) on the (person, day) key (J4 anti / J5 semi)."""
    rows = salary_rows(found, salaries)
    hist = paid_days(found, salaries)
    keys = ["person", "_day"]
    new = rows.join(hist, keys, "left_anti").drop("_day")
    skipped = rows.join(hist, keys, "left_semi").select("person", "date", "salary")
    return new, skipped


def new_instances(found: DataFrame, instances: DataFrame) -> DataFrame:
    """E5: departments not yet known, numbered max(id)+1.. in order of first appearance.

    Names are free text, so their number grows with the feed: they are numbered
    inside range partitions, never in one window.
    """
    depts = (
        found.where(F.col("departamento").isNotNull())
        .groupBy(F.col("departamento").alias("name"))
        .agg(F.min("chg_id").alias("_first"))
    )
    new = depts.join(instances.select("name"), "name", "left_anti")
    max_id = instances.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_max"))
    return attach_one_row(numbered(new, "_first", "name", "_nth"), max_id).select(
        (F.col("_max") + F.col("_nth")).cast("long").alias("id"), "name"
    )


def instance_map(instances: DataFrame, created: DataFrame) -> DataFrame:
    """Name -> id over existing + new instances; the last duplicate name wins."""
    allinst = instances.select("id", "name", F.lit(0).alias("_src")).unionByName(
        created.select("id", "name", F.lit(1).alias("_src"))
    )
    return allinst.groupBy("name").agg(F.max_by("id", F.struct("_src", "id")).alias("area_nova"))


def current_rows(found: DataFrame) -> DataFrame:
    """changes whose status starts with 'Atual' (null status -> not current)."""
    return found.where(F.coalesce(F.col("situacao").startswith(L.PRESENT_STATUS_PREFIX), F.lit(False)))


def scd2_area(found: DataFrame, areas: DataFrame, instances: DataFrame, created: DataFrame, chain: bool = False) -> DataFrame:
    """Close / open area records; departments mapped to instance ids.

    A change whose department is null is not applied (it would open a record
    without an area); ``pending`` lists it with its reason. ``chain``: the
    changes of a person follow each other instead of each meeting the system row.
    """
    cur = current_rows(found).where(F.col("departamento").isNotNull())
    mapped = cur.join(instance_map(instances, created), cur["departamento"] == F.col("name"), "left").drop("name")
    active = areas.where(F.col("end_date").isNull()).select("id", "person", "start_date", F.col("area").alias("area_atual"))
    diff = partial(scd2_chain, tie="chg_id") if chain else scd2_diff
    return diff(
        mapped, active, "person", "data_alteracao", "area_nova", "area_atual",
        new_payload={"area": F.col("area_nova").cast("long")},
        cur_payload={"area": F.col("area_atual").cast("long")},
        carry=("chg_id",),
    )


def scd2_job(found: DataFrame, jobs: DataFrame, chain: bool = False) -> DataFrame:
    """Close / open job records on the normalised title (``chain`` as in ``scd2_area``).

    New titles are exported upper-case with accents kept; level = first word
    (normalised). A history row without a level gets it from its own title.
    """
    cur = current_rows(found).where(F.col("cargo").isNotNull()).select(
        "*",
        text.normalize_text(F.upper("cargo")).alias("cargo_norm"),
        text.first_word_level("cargo").alias("level_novo"),
    )
    level = F.col("level") if "level" in jobs.columns else text.first_word_level("name")
    active = jobs.where(F.col("end_date").isNull()).select(
        "id", "person", "start_date",
        F.col("name").alias("cargo_atual"),
        text.normalize_text("name").alias("cargo_atual_norm"),
        level.alias("level_atual"),
    )
    diff = partial(scd2_chain, tie="chg_id") if chain else scd2_diff
    return diff(
        cur, active, "person", "data_alteracao", "cargo_norm", "cargo_atual_norm",
        new_payload={"name": F.upper("cargo"), "level": F.col("level_novo")},
        cur_payload={"name": F.col("cargo_atual"), "level": F.col("level_atual")},
        carry=("chg_id",),
    )


@dataclass
class FeedJob:
    changes: DataFrame
    people: DataFrame
    salaries: DataFrame
    areas: DataFrame
    instances: DataFrame
    jobs: DataFrame
    #: B10: "each" change against the system row (True / "latest": only a person's latest;
    #: "chain": in order, each opening closed by the next)
    sequence: bool | str = False
    #: Compare departments upper-cased, without accents and doubled spaces
    normalize_departments: bool = False

    @classmethod
    def from_fixtures(cls, fx) -> "FeedJob":
        return cls(fx.feed, fx.sys_people, fx.sys_salaries, fx.sys_areas, fx.sys_instances, fx.sys_jobs)

    @cached_property
    def people_norm(self) -> DataFrame:
        """System names normalised the same way as the client side."""
        return self.people.select(
            "person", text.normalize_text("nome").alias("nome"), text.normalize_text("sobrenome").alias("sobrenome")
        )

    @cached_property
    def priority(self) -> DataFrame:
        return person_priority(self.people_norm, self.jobs, self.areas)

    @cached_property
    def best(self) -> DataFrame:
        """One person per system name (name-keyed, people-sized)."""
        return best_person_per_name(self.priority)

    @cached_property
    def ids(self) -> DataFrame:
        """The resolved change list; every output starts from it."""
        changes = self.changes
        if self.normalize_departments:
            changes = changes.withColumn("departamento", text.normalize_text(F.upper("departamento")))
        return resolve(split_names(changes), self.best)

    @cached_property
    def found(self) -> DataFrame:
        if self.sequence in (True, "latest"):
            return latest_per_person(self.ids)
        return self.ids.where(F.col("person").isNotNull())

    @cached_property
    def known_instances(self) -> DataFrame:
        if self.normalize_departments:
            return self.instances.withColumn("name", text.normalize_text(F.upper("name")))
        return self.instances

    @cached_property
    def pending(self) -> DataFrame:
        return pending(self.ids, self.people_norm)

    @cached_property
    def salaries_split(self) -> tuple[DataFrame, DataFrame]:
        return salary_split(self.found, self.salaries)

    @cached_property
    def created(self) -> DataFrame:
        return new_instances(self.found, self.known_instances)

    @cached_property
    def area_changes(self) -> DataFrame:
        return scd2_area(self.found, self.areas, self.known_instances, self.created, self.sequence == "chain")

    @cached_property
    def job_changes(self) -> DataFrame:
        return scd2_job(self.found, self.jobs, self.sequence == "chain")

    @property
    def salary_marks(self) -> DataFrame:
        """Every salary row of the feed, ``_h`` = 1 where its day is in the history."""
        hist = paid_days(self.found, self.salaries).withColumn("_h", F.lit(1))
        return salary_rows(self.found, self.salaries).join(hist, ["person", "_day"], "left")

    def run(self, write: Callable[[str, DataFrame], None]) -> dict[str, int]:
        """Hand every output to ``write`` once; return the counts taken while they are written.

        The resolved list, where every output starts, is written first. Counts
        are observed metrics of the writes, so no output is computed twice.
        """
        counts: dict[str, int] = {}

        def observed(df: DataFrame, use: Callable[[DataFrame], DataFrame | None], **named) -> DataFrame | None:
            seen = Observation()
            out = use(df.observe(seen, *[expr.alias(name) for name, expr in named.items()]))
            got = seen.get
            counts.update({name: got.get(name) or 0 for name in named})
            return out

        def output(name: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
            return lambda df: write(name, shape(df))

        everything, acao, old = F.count(F.lit(1)), F.col("acao"), F.col("_h").isNotNull()
        self.ids = observed(
            self.ids, lambda df: written_once(df, "resolved"), linhas=everything, resolvidos=F.count_if(F.col("person").isNotNull()),
        )
        observed(self.pending, output("pendencias"), pendentes=everything)
        observed(
            self.salary_marks, output("salarios", lambda df: df.where("_h IS NULL").select("id", "person", "date", "salary", "raise_type")),
            salarios_novos=F.count_if(~old), salarios_ignorados=F.count_if(old),
        )
        # ids are internal; the import file leaves them blank
        observed(self.created, output("instancia_area", lambda df: df.select(F.lit("").alias("id"), "name")), instancias_novas=everything)
        observed(
            self.area_changes, output("areas", import_ids), areas_fechadas=F.count_if(acao == "fechar"), areas_abertas=F.count_if(acao == "abrir"),
        )
        observed(
            self.job_changes, output("cargos", import_ids), cargos_fechados=F.count_if(acao == "fechar"), cargos_abertos=F.count_if(acao == "abrir"),
        )
        return counts

    def summary(self) -> DataFrame:
        """Run counts as one row, from one pass over each output."""
        counts = self.run(lambda name, df: df.write.format("noop").mode("overwrite").save())
        return self.changes.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))
