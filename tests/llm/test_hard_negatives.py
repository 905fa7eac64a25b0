from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewlens.llm import hard_negatives as hn

from .conftest import rows_of

SCHEMA = "vec_id long, embedding array<double>, label int, slot int, score string, ID string"


def brute(rows, is_anchor, positives=5, negatives=5, percent=80, scale=256.0):
    """All scores in Python integers."""
    usable = []
    for vec, v, label in rows:
        if vec is None or v is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            continue
        usable.append((vec, tuple(math.floor(scale * x) for x in v), label))
    out = []
    for vec, a, label in {r for r in usable if is_anchor(r[0])}:
        scored = sorted({(-min(max(sum(x * y for x, y in zip(a, v)), -(2**63) + 2), 2**63 - 1), i, lab) for i, v, lab in usable if len(v) == len(a)})
        same = sorted({(s, i) for s, i, lab in scored if lab == label and i != vec})[:positives]
        for s, i in same:
            fit = sorted({(t, j) for t, j, lab in scored if lab != label and percent * -s <= 100 * -t <= 100 * -s})[:negatives]
            out += [(vec, i, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def mine(spark, rows, **named):
    frame = spark.createDataFrame([(*r, 1, "s", "x") for r in rows], SCHEMA).repartition(4)
    return rows_of(hn.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **named))


def table(seed, n, dim, spread, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] * rng.choice([0.5, 1, 2]) + spread * rng.normal(size=dim)).tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize(("spread", "named"), [(0.1, {}), (0.6, {"anchor_block": 7, "positives": 3, "negatives": 9}), (3.0, {"percent": 30})])
def test_against_all_scores(spark, monkeypatch, spread, named):
    monkeypatch.setattr(hn, "STEP_ROWS", 16)
    monkeypatch.setattr(hn, "CHUNK_ROWS", 64)
    monkeypatch.setattr(hn, "SEED_ROWS", 30)
    rows = table(3, 400, 8, spread)
    want = brute(rows, lambda i: i % 10 == 0, **{k: v for k, v in named.items() if k != "anchor_block"})
    assert mine(spark, rows, **named) == want and len(want) > 50


def test_ties_repeats_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5], i % 2) for i in range(60)]  # all scores tie
    rows += rows[:30] + [(10, [1.0, 0.5], 1), (20, [-1.0, 0.25], 0), (7, [2.0, 0.0], 0)]
    rows += [(100, [0.0, 0.0], 0), (110, [], 1), (111, [], 1), (112, [], 0), (120, [1.0], 0), (121, [2.0], 0), (122, [1.9], 1)]
    rows += [(130, [nan, 1.0], 0), (140, [inf, 1.0], 0), (150, [None, 1.0], 0), (160, None, 1), (170, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (180, [1e307, 1.0], 0)]
    assert mine(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_very_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist(), int(rng.integers(0, 2))) for i in range(80)]
    rows += [(100 + i, [1e200 * (i + 1), 1.0, 0.0], i % 2) for i in range(6)] + [(200, [1e12, 1e12, 1e12], 0), (201, [1e12, 1e12, 1e12 - 1], 0), (202, [1e12, 1e12 - 3, 1e12], 1)]
    assert mine(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert hn.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_and_walks_end_early():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 16))))
    ids, labels = np.arange(4000), rng.integers(0, 4, 4000)
    anchors = hn.cluster(np.arange(40), ids[:40], labels[:40], rows[:40])
    norms = hn._norms(rows)
    for c in range(len(anchors.centres)):
        own = slice(anchors.edges[c], anchors.edges[c + 1])
        bound = hn.upper_bounds(rows, norms, anchors.centres[c], anchors.radii[c])
        assert (rows @ anchors.vectors[own].T <= bound[:, None] * anchors.norms[own] + 1e-6).all()
    search = hn.Positives(anchors, 5)
    assert hn.walk(anchors, search, ids, labels, rows) < 0.5 * 40 * 4000
