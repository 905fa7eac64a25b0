from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from crewlens.llm import queries
from crewlens.llm.decontaminate import SHORT_MASKS, WINDOW, drop_leaks, find_leaks

from .test_decontaminate import as_set, words


def scaled_leaks(docs, items):
    """Every document, item and diagonal of the scaled rule, by brute force; no texts of one token."""
    out = set()
    for doc, text in docs:
        d = words(text)
        for item, body in items:
            q = words(body)
            wide = min(WINDOW, len(q), len(d))
            if min(len(q), len(d)) < 2:
                continue
            for diagonal in range(-len(q) + 1, len(d)):
                line = [int(d[diagonal + k] == q[k]) for k in range(len(q)) if 0 <= diagonal + k < len(d)]
                best = max((sum(line[a : a + wide]) for a in range(len(line) - wide + 1)), default=0)
                if best * 10 >= wide * 8:
                    out.add((doc, item, diagonal, len(q), sum(line), best))
    return out


def test_short_masks_lose_no_overlap():
    for n in range(1, WINDOW):
        masks = [m for m, sizes in SHORT_MASKS.items() if n in sizes]
        for differ in combinations(range(n), n - -(-n * 8 // 10)):
            assert any(not any(at + k in differ for k in m) for m in masks for at in range(n - m[-1]))


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=1 + i % 16 if i < 32 else 30))) for i in range(40)]
    docs = []
    for d in range(500):
        part = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            part[rng.randrange(len(part))] = rng.choice(vocab)
        a = rng.randint(0, len(part) // 2) if d % 3 == 0 else 0
        part = part[a : a + rng.randint(1, 13)] if d % 3 == 0 else part
        body = rng.choices(vocab, k=rng.randint(0, 20)) if d % 2 else []
        at = rng.randint(0, len(body))
        body[at:at] = part
        docs.append((d, " ".join(body)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = scaled_leaks(docs, items)
    assert {min(WINDOW, r[3]) for r in want} == set(range(2, WINDOW + 1))
    found = find_leaks(frame, bench, scaled=True)
    assert as_set(found) == want and found.count() == len(want)
    assert as_set(find_leaks(frame, bench, block_tokens=200, scaled=True)) == want  # several blocks
    assert {r["doc_id"] for r in drop_leaks(frame, bench, scaled=True).collect()} == {d for d, _ in docs} - {r[0] for r in want}


QUESTION = "which river flows through the old capital of the northern province"  # 11 tokens
LONG = "in the year of the great flood which town on the river was the first to be rebuilt by its people"
CASES = [
    (0, "we ask which river runs through the old capital of the northern province here and now"),  # one word of 11 changed
    (1, "the great flood which town on the river was the first"),  # 11 tokens copied from a longer item
    (2, "as they say open sesame now and the door moved"),  # an item of 2 tokens
    (3, "他说。今天天气很好。然后走了"),  # one token, a sentence
    (4, "this says river and nothing else of the province or of the town"),
    (5, "river"),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(CASES, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(0, QUESTION), (1, LONG), (2, "Open sesame!"), (3, "今天天气很好"), (4, "river")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_the_query_and_the_stage_find_short_leaks(spark, folder):
    found = queries.QUERIES["op10_spaced_seed_leaks"](spark, folder)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5}


def test_sql_twin_states_the_scaled_rule(spark):
    """Short items and documents, one word off, one-token texts: the registered SQL gives the operator's rows."""
    import duckdb
    import pandas as pd

    from crewlens.llm.decontaminate import find_leaks
    from crewlens.llm.queries import ORACLE

    words = "red fox jumps over the lazy dog while seven wise owls watch from above in silence".split()
    items = [(n, " ".join(words[:n])) for n in range(1, 17)] + [(40, "光合作用过程"), (41, "photosynthesis"), (42, "")]
    docs = []
    for n in range(1, 17):
        for off in (None, 0, n // 2, n - 1):
            part = list(words[:n])
            if off is not None:
                part[off] = "zzz"
            docs.append((len(docs), " ".join(part)))
            docs.append((len(docs), "aa bb " + " ".join(part) + " cc dd ee"))
    docs += [(900, "光合作用过程"), (901, "photosynthesis"), (902, None), (903, "x 光合作用过程 y"), (904, docs[9][1]), (904, docs[9][1])]
    got = find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), scaled=True
    ).drop("text_hash")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = con.execute(ORACLE["op10_spaced_seed_leaks"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300
