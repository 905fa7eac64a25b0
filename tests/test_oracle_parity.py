"""Every registered query with an oracle equals its DuckDB twin (sf0.001, exact values)."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL, duck_views

ORACLE = E.oracle_sql()


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v

    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck_small(duck):
    duck_views(duck, SF_SMALL)
    return duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck_small.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert canon(srows, df.columns) == canon(orows, ocols)


def test_every_query_has_stable_schema(spark):
    for name, fn in E.queries().items():
        if name.startswith("kmeans"):
            continue
        df = fn(spark, SF_SMALL)
        assert df.columns == fn(spark, SF_SMALL).columns, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 9
    assert sum(r.n for r in rows) > 0
