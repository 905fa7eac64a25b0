from __future__ import annotations

import pytest

import corpus_pipeline
from crewlens.llm import decontaminate, language_id, pii, simhash
from crewlens.llm.tokenize import WORD_BPE, encoder

from .conftest import SMALL, rows_of
from .test_decontaminate import all_leaks
from .test_spans import plain_pii


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "benchmark_decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_each_stage_works_on_what_came_before(spark, name, request):
    docs = request.getfixturevalue(name)
    columns = docs.columns
    state = docs
    seen = []
    for stage, run in corpus_pipeline.STAGES:
        state = corpus_pipeline.materialize(run(spark, state, SMALL), f"test-{stage}")
        seen.append(state)
        if stage != "packing":
            assert state.columns == columns
    kept, single, clean, masked, pieces = seen
    found = language_id.identify_languages(docs)
    assert kept.count() == found.where("not rejected").count()
    groups = {r["component_id"] for r in simhash.near_duplicates(kept).collect()}
    assert single.count() == len(groups)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    if name == "small_docs":
        rows = [(r["doc_id"], r["text"]) for r in single.collect()]
        leaks = {d for d, *_ in all_leaks([r for r in rows if len(r[1]) < 3000], items)}
        assert not leaks & {r["doc_id"] for r in clean.collect()}
        assert {r[0] for r in rows} - {r["doc_id"] for r in clean.collect()} >= leaks
    assert decontaminate.find_leaks(clean, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert rows_of(masked, "doc_id") == rows_of(clean, "doc_id")
    assert not any(plain_pii(r["text"] or "") for r in masked.collect())
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in masked.collect():
        if not any(c in "0123456789@" for c in before[r["doc_id"]] or ""):
            assert r["text"] == before[r["doc_id"]]
    texts = [r["text"] or "" for r in masked.collect()]
    ids = sum(len(e.ids) + 1 for e in encoder(WORD_BPE).full.encode_batch(texts, add_special_tokens=False))
    assert sum(r["length"] for r in pieces.select("length").collect()) == ids
    assert pii.mask_personal_data(masked).count() == masked.count()


def test_run(spark):
    result = corpus_pipeline.run(spark, SMALL)
    assert result.count() > 0 and {"doc_id", "start", "length", "ids", "sequence_id"} <= set(result.columns)


def test_stages_leave_columns_with_internal_names_alone(spark):
    """Names that stages use inside, in other cases too, come out as they went in."""
    from crewlens.llm.decontaminate import drop_leaks
    from crewlens.llm.simhash import keep_one_per_group

    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(1, text, 11, "a", 5, 6), (2, text, 22, "b", 7, 8), (3, "other words altogether here today", 33, "c", 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _FP long, _Row string, _leak_ID long, _LEAK_HASH long")
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    left = drop_leaks(docs, spark.createDataFrame([(1, text)], "item_id long, text string"), scaled=True)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [rows[2]]
