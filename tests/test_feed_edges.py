"""Change-feed edge rows (FIXTURES §C) on hand-built tables."""

from __future__ import annotations

import datetime as dt

from crewlens.functions import labels as L
from crewlens.plans.feed import FeedJob


def build(spark):
    d = dt.datetime
    changes = spark.createDataFrame(
        [
            (1, "Jôão  Silva", d(2024, 3, 1), 100.0, "Dept A", "Analista de Operações", "Atual"),
            (2, "Ana", d(2024, 3, 1), 200.0, "Dept New", "Coordenador", "Atual"),          # one-word name
            (3, "Maria Souza", d(2024, 3, 1), 300.0, "Dept A", "Assistente", "Atual"),    # duplicated name
            (4, "Nobody Here", d(2024, 3, 1), 400.0, "Dept A", "Assistente", "Atual"),    # not found
            (5, "Joao Silva", d(2024, 1, 1), 150.0, "Dept A", "Analista de Operacoes", "Desligado"),
        ],
        "chg_id long, colaborador string, data_alteracao timestamp_ntz, salario double, departamento string, "
        "cargo string, situacao string",
    )
    people = spark.createDataFrame(
        [(1, "JOAO", "SILVA"), (2, "ANA", None), (3, "MARIA", "SOUZA"), (4, "MARIA", "SOUZA")],
        "person long, nome string, sobrenome string",
    )
    salaries = spark.createDataFrame(
        [(1, d(2024, 3, 1), 90.0), (3, d(2023, 1, 1), 10.0), (4, d(2023, 1, 1), 10.0)],
        "person long, dt timestamp_ntz, salary double",
    )
    areas = spark.createDataFrame(
        [(10, 1, d(2020, 1, 1), None, 1), (11, 4, d(2020, 1, 1), None, 2)],
        "id long, person long, start_date timestamp_ntz, end_date timestamp_ntz, area int",
    )
    instances = spark.createDataFrame([(1, "Dept A"), (2, "Dept B")], "id int, name string")
    jobs = spark.createDataFrame(
        [(20, 1, d(2020, 1, 1), None, "ANALISTA DE OPERACOES"), (21, 4, d(2020, 1, 1), None, "ASSISTENTE")],
        "id long, person long, start_date timestamp_ntz, end_date timestamp_ntz, name string",
    )
    return FeedJob(changes, people, salaries, areas, instances, jobs)


def test_resolution_null_safe_and_priority(spark):
    j = build(spark)
    ids = {r.chg_id: r.person for r in j.ids.collect()}
    assert ids[1] == 1 and ids[5] == 1
    assert ids[2] == 2                      # null surname matches null surname
    assert ids[3] == 4                      # 4 has area + job history -> priority 2
    assert ids[4] is None


def test_pending_reasons(spark):
    j = build(spark)
    got = sorted((r.chg_id, r.motivo) for r in j.pending.collect())
    assert got == [(3, L.REASON_DUPLICATE), (4, L.REASON_NOT_FOUND)]


def test_salary_classes_and_skip(spark):
    j = build(spark)
    new, skipped = j.salaries_split
    cls = {(r.person, r.date.month): r.raise_type for r in new.collect()}
    assert (1, 3) not in cls                # same day as history -> skipped
    assert cls[(2, 3)] == L.RAISE_INITIAL   # no history
    assert cls[(4, 3)] == L.RAISE_RAISE     # after last
    assert cls[(1, 1)] == L.RAISE_INITIAL   # before last
    assert [r.person for r in skipped.collect()] == [1]


def test_new_instances_numbered_after_max(spark):
    j = build(spark)
    assert [(r.id, r.name) for r in j.created.collect()] == [(3, "Dept New")]


def test_area_and_job_scd2(spark):
    j = build(spark)
    areas = sorted((r.person, r.acao, r.area) for r in j.area_changes.collect())
    # person 1: same area -> nothing; 2: no active -> open (new instance 3); 4: 2 -> 1 close+open
    assert areas == [(2, "abrir", 3), (4, "abrir", 1), (4, "fechar", 2)]
    jobs = sorted((r.person, r.acao, r.name, r.level) for r in j.job_changes.collect())
    # person 1: same title after normalisation; 4: same title; 2: no active job -> open
    assert jobs == [(2, "abrir", "COORDENADOR", "COORDENADOR")]


def test_summary_counts_are_consistent(spark):
    j = build(spark)
    s = j.summary().first()
    assert s.linhas == 5 and s.resolvidos == 4 and s.pendentes == 2
    assert s.salarios_novos + s.salarios_ignorados == s.resolvidos


def test_missing_targets_are_pending_with_a_reason(spark):
    j = build(spark)
    extra = spark.createDataFrame(
        [
            (6, "Ana", dt.datetime(2024, 4, 1), 210.0, None, None, "Atual"),
            (7, "Ana", dt.datetime(2024, 5, 1), 220.0, "Dept A", "Coordenador", None),
            (8, "Ana", dt.datetime(2024, 6, 1), 230.0, None, None, "Desligado"),
        ],
        j.changes.schema,
    )
    j = FeedJob(j.changes.unionByName(extra), j.people, j.salaries, j.areas, j.instances, j.jobs)
    got = sorted((r.chg_id, r.motivo) for r in j.pending.collect() if r.chg_id > 5)
    assert got == [(6, L.REASON_NO_JOB), (6, L.REASON_NO_DEPARTMENT), (7, L.REASON_NO_STATUS)]
    assert not [r for r in j.area_changes.collect() + j.job_changes.collect() if r.chg_id > 5]
    assert {r.date.month for r in j.salaries_split[0].collect() if r.person == 2} == {3, 4, 5, 6}


def test_options_sequence_and_normalised_departments(spark):
    j = build(spark)
    extra = spark.createDataFrame(
        [(6, "Ana", dt.datetime(2024, 4, 1), 1.0, "dépt  b", "Gerente", "Atual")], j.changes.schema
    )
    parts = (j.changes.unionByName(extra), j.people, j.salaries, j.areas, j.instances, j.jobs)
    plain = FeedJob(*parts)
    assert sorted(r.name for r in plain.created.collect()) == ["Dept New", "dépt  b"]
    assert [r.name for r in FeedJob(*parts, normalize_departments=True).created.collect()] == ["DEPT NEW"]
    last = FeedJob(*parts, sequence=True)
    assert sorted(r.chg_id for r in last.found.collect()) == [1, 3, 6]
    opened = [(r.person, r.chg_id) for r in last.job_changes.collect() if r.acao == "abrir"]
    assert (2, 6) in opened and (2, 2) not in opened


def chained(changes, active):
    """One person at a time: the current value moves with every change."""
    out = []
    for person in {p for p, _, _, _ in changes}:
        rows = sorted((d, c, v) for p, d, c, v in changes if p == person)
        system = max([(s, i, v) for i, p, s, v in active if p == person and v is not None], default=None)
        value, has, open_at = (system[2], True, None) if system else (None, False, None)
        for d, c, v in rows:
            if has and v == value:
                continue
            if open_at:
                out.append((person, "abrir", open_at[1], open_at[0], d, open_at[2]))
            elif system:
                out.append((person, "fechar", c, system[0], d, system[2]))
            open_at, value, has = (d, c, v), v, True
        if open_at:
            out.append((person, "abrir", open_at[1], open_at[0], None, open_at[2]))
    return sorted(out, key=str)


def test_changes_of_a_person_as_a_chain(spark):
    import random

    from pyspark.sql import functions as F

    from crewlens.operators.scd2 import scd2_chain

    rng = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    changes = [(rng.randint(1, 30), day(rng.randint(0, 40)), c, rng.choice(["a", "b", "c", None])) for c in range(400)]
    changes += [(99, day(c // 3), 1000 + c, rng.choice("ab")) for c in range(300)]  # one person with many changes
    active = [(10 + p, p, day(-rng.randint(1, 9)), rng.choice(["a", "b", None])) for p in range(1, 25)] + [(900, 3, day(-20), "c")]
    got = scd2_chain(
        spark.createDataFrame(changes, "person long, at timestamp_ntz, chg_id long, new string").repartition(3),
        spark.createDataFrame(active, "id long, person long, start_date timestamp_ntz, cur string"),
        "person", "at", "new", "cur", {"value": F.col("new")}, {"value": F.col("cur")}, carry=("chg_id",), tie="chg_id",
    ).collect()
    assert sorted(((r.person, r.acao, r.chg_id, r.start_date, r.end_date, r.value) for r in got), key=str) == chained(changes, active)
    assert {r.id for r in got if r.acao == "fechar"} <= {a[0] for a in active} - {900}


def test_counts_taken_while_writing_equal_the_outputs(spark):
    j = build(spark)
    written = {}
    counts = j.run(lambda name, df: written.__setitem__(name, df.collect()))
    assert counts == {
        "linhas": 5, "resolvidos": 4, "pendentes": len(written["pendencias"]), "salarios_novos": len(written["salarios"]),
        "salarios_ignorados": 1, "instancias_novas": len(written["instancia_area"]),
        **{f"areas_{w}s": sum(r.acao == a for r in written["areas"]) for w, a in (("fechada", "fechar"), ("aberta", "abrir"))},
        **{f"cargos_{w}s": sum(r.acao == a for r in written["cargos"]) for w, a in (("fechado", "fechar"), ("aberto", "abrir"))},
    }
    empty = FeedJob(j.changes.limit(0), j.people, j.salaries, j.areas, j.instances, j.jobs)
    assert set(empty.run(lambda name, df: df.write.format("noop").mode("overwrite").save()).values()) == {0}
