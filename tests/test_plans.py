"""Plan properties that matter at scale (checked on the executed plans)."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_MID


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scanned(text: str) -> dict[str, set]:
    """Columns read of each table."""
    found: dict[str, set] = {}
    for block in text.split("\n\n"):
        table = re.search(r"/(\w+)\.parquet", block)
        if "Scan parquet" in block and table:
            schema = re.search(r"ReadSchema: struct<(.*)>", block).group(1)
            found.setdefault(table[1], set()).update(c.split(":")[0] for c in schema.split(",") if c)
    return found


def test_only_the_tables_and_columns_of_a_question_are_scanned(spark):
    found = scanned(formatted(E.queries()["score_distribution"](spark, SF_MID)))
    assert set(found) <= {"orders", "customer", "nation"}
    assert found["orders"] <= {"o_custkey", "o_orderdate", "o_orderpriority"}
    assert found["customer"] <= {"c_custkey", "c_nationkey"}


def test_date_boundaries_reach_the_scan(spark):
    text = formatted(E.queries()["feed_resolve"](spark, SF_MID))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_attributes_are_never_exploded(spark):
    for name in ("top_attrs_by_area", "attr_corr_by_area", "attr_corr_global", "ninebox_profile", "hiring_hint"):
        plan = E.queries()[name](spark, SF_MID)._jdf.queryExecution().optimizedPlan().toString()
        # a 9-box plan explodes the wanted ranks of its terciles, never the attributes
        assert not [x for x in plan.split("\n") if "Generate" in x and "_ranks" not in x], name


@pytest.mark.parametrize("name", ["ninebox_matrix", "headline_kpis", "feed_summary", "culture_by_area", "scd2_area"])
def test_no_cartesian_and_one_row_nested_loops(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[name](spark, SF_MID)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    assert "CartesianProduct" not in plan
    # nested-loop joins only attach one-row aggregates (BuildRight of an ungrouped aggregate)
    for line in plan.split("\n"):
        if "BroadcastNestedLoopJoin" in line:
            assert "BuildRight" in line


def test_stored_person_tables_join_without_a_shuffle(spark, tmp_path):
    """People, areas and scores share their buckets: nothing but the small label tables is exchanged."""
    from crewlens.catalog import model
    from crewlens.plans.people import store_person_tables

    m = model(spark, SF_MID)
    stored = store_person_tables(m, str(tmp_path / "people"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (stored.base("area", "perf_media", "cultura_pontuacao"), stored.perf_area, stored.base("perf_media").join(stored.complete_vectors(), "cpf")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and "Bucketed: true" in formatted(df)
        plain = m.base("area", "perf_media")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" in plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    key = ["cpf", "area", "perf_media", "n_avaliacoes"]
    assert sorted(map(tuple, stored.merged.select(*key).collect())) == sorted(map(tuple, m.merged.select(*key).collect()))
