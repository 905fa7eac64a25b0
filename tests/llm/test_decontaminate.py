from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from crewlens.llm.decontaminate import LEAST_TOKENS, MASKS, NEEDED, WINDOW, drop_leaks, find_leaks

from .conftest import SMALL, rows_of


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def all_leaks(docs, items):
    """Every document, item and diagonal, by brute force."""
    out = set()
    for doc, text in docs:
        d = words(text)
        for item, body in items:
            q = words(body)
            wide = min(WINDOW, len(q))
            need = NEEDED if len(q) >= WINDOW else len(q)
            if len(q) < LEAST_TOKENS:
                continue
            for diagonal in range(-len(q) + 1, len(d)):
                line = [int(d[diagonal + k] == q[k]) for k in range(len(q)) if 0 <= diagonal + k < len(d)]
                best = max((sum(line[a : a + wide]) for a in range(len(line) - wide + 1)), default=0)
                if best >= need:
                    out.add((doc, item, diagonal, len(q), sum(line), best))
    return out


def as_set(df):
    return {tuple(r) for r in df.drop("text_hash").collect()}


def test_masks_lose_no_overlap():
    for differ in combinations(range(WINDOW), WINDOW - NEEDED):
        assert any(
            not any(at + k in differ for k in mask) for mask in MASKS for at in range(WINDOW - mask[-1])
        )


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 8, 12, 13, 14, 20, 45])))) for i in range(24)]
    items += [(99, None), (98, ""), items[0], (None, items[5][1])]
    docs = []
    for d in range(320):
        body = rng.choices(vocab, k=rng.randint(0, 60))
        if d % 2:
            part = words(rng.choice(items[:24])[1])
            a = rng.randint(0, max(0, len(part) - 13))
            part = part[a : a + rng.randint(5, 50)]
            for _ in range(rng.randint(0, 4)):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(vocab)
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, ", ".join(body).upper() if d % 3 else " ".join(body)))
    docs += [(1, None), (None, items[7][1] + " tail"), docs[5], docs[5], (7, "")]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, _words string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = all_leaks(docs, items)
    assert len(want) > 40
    found = find_leaks(frame, bench)
    assert as_set(found) == want and found.count() == len(want)
    assert as_set(find_leaks(frame, bench, block_tokens=60)) == want  # several blocks
    bad = {(d, t) for d, t in docs if any(w[0] == d for w in all_leaks([(d, t)], items))}
    kept = drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert rows_of(kept, "doc_id", "text") == sorted(
        [x for x in docs if x not in bad], key=lambda r: tuple((v is None, v) for v in r)
    )


@pytest.mark.parametrize("name", ["edge_docs", "no_docs"])
def test_edges(spark, name, request):
    docs = request.getfixturevalue(name)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).count() == 0
    assert drop_leaks(docs, bench).count() == docs.count()


def test_plan_is_native_and_broadcasts_only_the_benchmark(spark, small_docs):
    plan = find_leaks(small_docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan
