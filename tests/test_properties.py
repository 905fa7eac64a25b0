"""Custom operators against pure-Python models of their rules on random inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from crewlens.operators import core
from crewlens.operators.scd2 import scd2_diff


def test_scd2_diff_matches_rules(spark):
    rnd = random.Random(3)
    changes = [(i, rnd.randint(1, 40), rnd.randint(1, 30), rnd.choice([1, 2, 3, None])) for i in range(300)]
    active = []
    for p in range(1, 41):
        for j in range(rnd.choice([0, 1, 1, 1, 2])):           # none, one or two active rows
            active.append((p * 10 + j, p, rnd.randint(0, 5), rnd.choice([1, 2, 3, None])))
    cdf = spark.createDataFrame(changes, "chg_id int, person int, dt int, novo int")
    adf = spark.createDataFrame(active, "id int, person int, start_date int, atual int")
    got = scd2_diff(
        cdf, adf, "person", "dt", "novo", "atual",
        new_payload={"v": F.col("novo")}, cur_payload={"v": F.col("atual")}, carry=("chg_id",),
    ).collect()
    got = [(r.acao, r.id, r.person, r.start_date, r.end_date, r.v, r.chg_id) for r in got]

    want = []
    for chg, person, dt, novo in changes:
        rows = [a for a in active if a[1] == person] or [None]
        for a in rows:
            cur = None if a is None else a[3]
            if cur is None:
                want.append(("abrir", None, person, dt, None, novo, chg))
            elif cur != novo:
                want.append(("fechar", a[0], person, a[2], dt, cur, chg))
                want.append(("abrir", None, person, dt, None, novo, chg))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_keep_by_and_members_match_python(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, 3, 4, None]), rnd.randint(0, 10**6), f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    last = {r.k: r.v for r in core.keep_by(df, ["k"], F.col("o"), last=True).collect()}
    first = {r.k: r.v for r in core.keep_by(df, ["k"], F.col("o"), last=False).collect()}
    by: dict = {}
    for k, o, v in rows:
        by.setdefault(k, []).append((o, v))
    assert last == {k: max(x)[1] for k, x in by.items()}
    assert first == {k: min(x)[1] for k, x in by.items()}
    members = sorted(r.v for r in core.duplicated_members(df, ["k"]).collect())
    assert members == sorted(v for k, o, v in rows if len(by[k]) > 1)


def test_name_resolution_matches_python(spark):
    from crewlens.plans.feed import best_person_per_name, resolve

    rnd = random.Random(9)
    names = [("ANA", "SILVA"), ("ANA", None), ("JOAO", "SOUZA"), ("MARIA", None), ("LEO", "LIMA")]
    people = [(p, *rnd.choice(names), rnd.randint(0, 2)) for p in range(1, 60)]
    prio = spark.createDataFrame(people, "person long, nome string, sobrenome string, prioridade int")
    best = best_person_per_name(prio)
    changes = spark.createDataFrame(
        [(i, "x", None, 0.0, "d", "c", "Atual", *rnd.choice(names + [("ZE", "X")])) for i in range(80)],
        "chg_id long, colaborador string, data_alteracao timestamp_ntz, salario double, departamento string, "
        "cargo string, situacao string, nome string, sobrenome string",
    )
    got = {r.chg_id: r.person for r in resolve(changes, best).collect()}
    pick = {}
    for p, n, s, pr in people:
        key = (n, s)
        if key not in pick or (-pr, p) < (-pick[key][1], pick[key][0]):
            pick[key] = (p, pr)
    for r in changes.collect():
        assert got[r.chg_id] == (pick.get((r.nome, r.sobrenome)) or (None,))[0]
