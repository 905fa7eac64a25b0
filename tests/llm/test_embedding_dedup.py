from __future__ import annotations

import math
import random

import numpy as np
import pytest

from crewlens.llm.embedding_dedup import join_intervals, near_duplicates

from .test_simhash import components


def check(rows, frame, **named):
    """Against all pairs; rows of the same length only."""
    got = near_duplicates(frame, **named).collect()

    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / math.sqrt(sum(x * x for x in np.array(v, float))) if usable(v) else None for _, v in rows]
    pairs, links = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    roots, least = components(len(rows), pairs), {}
    for (vec, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), vec) if x is not None], default=None)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((v, n, least[r], v == least[r]) for (v, _), n, r in zip(rows, links, roots)), key=key)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=key) == want
    return len(pairs)


def make(spark, rows, kind="float"):
    return spark.createDataFrame([(a, v, 1, 0) for a, v in rows], f"vec_id long, embedding array<{kind}>, label int, node int").repartition(4)


@pytest.mark.parametrize("interval_rows", [4096, 40])
def test_against_all_pairs(spark, interval_rows):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):  # groups of near copies, chains, and unrelated vectors
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows) * 3 + 1, (centre + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist()))
    rows += [(len(rows) * 3 + 1 + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(150)]
    rows += [(10_000 + i, rows[0][1]) for i in range(30)] + [(5000, [2 * x for x in rows[5][1]])]
    random.Random(1).shuffle(rows)
    assert check(rows, make(spark, rows), interval_rows=interval_rows) > 1000


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (8, [2.0, 0.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.1, 0.0]), (13, [-1.0, 0.0]), (14, [1e-30, 0.0]),
    ]
    check(rows, make(spark, rows, "double"))
    check(rows[:6], make(spark, rows[:6], "double"))
    assert near_duplicates(make(spark, [])).count() == 0


def test_integer_vectors(spark):
    rows = [(1, [1, 2, 3]), (2, [2, 4, 6]), (3, [3, -2, 1])]
    check(rows, make(spark, rows, "int"))


def test_recursion_drops_only_distant_blocks():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(60, 8)) * 0.1 for c in rng.normal(size=(9, 8))])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    x = x[np.lexsort(x.T[::-1])]
    got = np.zeros((len(x), len(x)), bool)
    for a, c, near, doubt in join_intervals(x, None, 0.9, block_rows=16):
        assert not doubt.any()
        got[a : a + near.shape[0], c : c + near.shape[1]] |= near
    assert np.array_equal(got, np.triu(x @ x.T >= 0.9, 1))
    y, z = x[:200], x[200:]
    got = np.zeros((200, len(z)), bool)
    for a, c, near, _ in join_intervals(y, z, 0.9, block_rows=16):
        got[a : a + near.shape[0], c : c + near.shape[1]] |= near
    assert np.array_equal(got, y @ z.T >= 0.9)


def test_links_at_exactly_the_least_cosine(spark):
    """(1, 0, ..) and (9, 3, 3, 1, 0, ..) have cosine 0.9 to the last digit, whatever the principal axes are."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        near, far = [1.0] + [0.0] * 7, [9.0, 3.0, 3.0, 1.0] + [0.0] * 4
        below = [9.0, 3.0, 3.0, 1.0 + 1e-12] + [0.0] * 4
        rows = [(1, near), (2, far), (3, below), (4, [2.0**40 * x for x in near])] + [(10 + i, (rng.normal(size=8) - 3).tolist()) for i in range(40)]
        got = {r["vec_id"]: r for r in near_duplicates(make(spark, rows, "double")).collect()}
        assert got[1]["n_links"] == 2 and got[4]["n_links"] == 2  # each other and the vector at 0.9
        assert got[2]["component_id"] == 1 and got[2]["n_links"] == 3


def test_vectors_whose_squares_vanish_or_overflow(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 1.0]), (3, [2.0, 2.1]), (4, [1e200, 1e200]), (5, [-1e-310, 1e-310]), (6, [-3e300, 3.1e300]), (7, [1.0, -1.0])]
    got = sorted(tuple(r) for r in near_duplicates(make(spark, rows, "double")).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
