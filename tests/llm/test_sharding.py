from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crewlens.llm.sharding import kd_shards


def check(docs, shards=24, **named):
    rows = kd_shards(docs, shards, **named).collect()
    source = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for shard, members in by.items():
        assert 0 <= shard < shards
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
        ids = [m["doc_id"] for m in sorted(members, key=lambda m: m["slot"])]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    return {s: sum(m["size"] for m in ms) for s, ms in by.items()}, max((r["size"] for r in rows), default=0)


def test_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes, largest = check(docs)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(b - mean) <= 5 * largest * 0.5 + 0.01 * mean for b in sizes.values())


def test_hot_values_and_repeated_rows_are_split(spark):
    """Half of the rows are one row; all share source and language."""
    rows = [(7, "same text", "en", "src0")] * 3000 + [(i, "x" * (i % 50), "en", "src0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    sizes, largest = check(docs, 8)
    mean = sum(sizes.values()) / 8
    assert all(abs(b - mean) < 4 * largest + 0.01 * mean for b in sizes.values())


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_edges(name, request):
    check(request.getfixturevalue(name), 24)
    check(request.getfixturevalue(name), 3)


def test_target_bytes(small_docs):
    total = sum(r["size"] for r in kd_shards(small_docs, 1).collect())
    shards = {r["shard"] for r in kd_shards(small_docs, target_bytes=total // 10 + 1).collect()}
    assert shards == set(range(10))


def test_plan_is_native(small_docs):
    plan = kd_shards(small_docs, 4)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_dimensions_of_other_types(spark):
    docs = spark.createDataFrame([(str(i), "t" * i) for i in range(40)], "doc_id string, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r["shard"] for r in kd_shards(docs, 4).collect()} == {0, 1, 2, 3}


def plain_tree(rows, leaves, top=(1 << 30) - 1):
    """Plain recursion: sort along the widest dimension, cut where the bytes come nearest to the share."""
    low = [min(r[1][d] for r in rows) for d in range(2)]
    high = [max(r[1][d] for r in rows) for d in range(2)]
    scaled = [(doc, [math.floor((v[d] - low[d]) / (high[d] - low[d]) * float(top)) for d in range(2)], size) for doc, v, size in rows]

    def split(part, n):
        if n == 1:
            return [part]
        width = [max(r[1][d] for r in part) - min(r[1][d] for r in part) for d in range(2)]
        dim = 0 if width[0] >= width[1] else 1
        part = sorted(part, key=lambda r: r[1][dim])
        goal, under, cut = sum(r[2] for r in part) * (n // 2) / n, 0, 0
        while under + part[cut][2] < goal:
            under += part[cut][2]
            cut += 1
        if under + part[cut][2] - goal <= goal - under:
            cut += 1
        return split(part[:cut], n // 2) + split(part[cut:], n - n // 2)

    return {doc: i for i, leaf in enumerate(split(scaled, leaves)) for doc, _, _ in leaf}


@pytest.mark.parametrize(("leaves", "seed"), [(2, 1), (5, 2), (24, 3)])
def test_shards_equal_a_plain_tree(spark, leaves, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        n = rng.randint(0, 400)
        rows.append((rng.randint(0, 10**6) * 600 + i, "y" * n, rng.random()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, w double").repartition(5)
    got = {r["doc_id"]: r["shard"] for r in kd_shards(docs, leaves, dimensions={"order": F.col("doc_id").cast("double"), "w": F.col("w")}).collect()}
    assert got == plain_tree([(d, (float(d), w), len(t) + 8) for d, t, w in rows], leaves)
