"""Long documents: cut into pieces for the search, with the rows of the whole."""

from __future__ import annotations

import random

import corpus_pipeline
from crewlens.llm.decontaminate import PIECE_TOKENS, find_leaks

from .test_decontaminate import as_set, words
from .test_scaled_leaks import scaled_leaks


def test_a_long_document_full_of_an_item(spark):
    """A task that held the whole document for each of its 27,000 hits would need 10 GB."""
    item = " ".join(f"item{i}" for i in range(30))
    text = " ".join(f"{item} between{i}" for i in range(600))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for scaled in (True, False):
        got = find_leaks(docs, bench, scaled=scaled).collect()
        assert sorted(r["doc_token"] for r in got) == [31 * i for i in range(600)]
        assert {(r["item_tokens"], r["equal_tokens"], r["window_equal"]) for r in got} == {(30, 30, 13)}


def test_pieces_meet_anywhere(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([2, 5, 9, 12, 13, 20, 40, 60, PIECE_TOKENS + 90])]
    items.append((50, "aa bb " * 10))  # meets itself on many diagonals
    docs = []
    for d, near in enumerate([0, PIECE_TOKENS, 2 * PIECE_TOKENS, 346, 692]):
        body = rng.choices(vocab, k=900)
        for _, text in items:
            part = words(text)
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "other"
            at = max(0, min(len(body), near + rng.randint(-len(part) - 8, 8)))
            body[at:at] = part
        docs.append((d, " ".join(body)))
    docs += [(20, items[-2][1]), (21, " ".join(words(items[-2][1])[100:])), (22, "aa bb " * 200), (23, None), (24, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = scaled_leaks([(d, t or "") for d, t in docs], items)
    got = find_leaks(frame, bench, scaled=True)
    assert as_set(got) == want and got.count() == len(want)
    assert as_set(find_leaks(frame, bench, scaled=True, block_tokens=3000)) == want


def test_the_stage_drops_a_long_document_full_of_an_item(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(1, " ".join(f"{item} between{i}" for i in range(600))), (2, "nothing of the kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert [r["doc_id"] for r in kept.collect()] == [2]
