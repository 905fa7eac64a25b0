from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from crewlens.llm.common import connected_components
from crewlens.llm.simhash import anchors, fingerprint, fingerprint_links, keep_one_per_group, near_duplicates

from .conftest import rows_of


def plain_fingerprint(text):
    words = [w for w in _split(text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    word = ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if word:
                yield word
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if word:
        yield word


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_against_all_pairs(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
    roots = components(len(rows), pairs)
    least = {}
    for (doc, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), doc) if x is not None], default=None)
    want = sorted(((d, f"{f:016x}", least[r]) for (d, f), r in zip(rows, roots)), key=lambda r: (r[0] is None, r))
    got = rows_of(near_duplicates(docs))
    assert Counter(got) == Counter(want)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(3)
    values = {0, 2**64 - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):
            w = v
            for b in rng.sample(range(64), rng.randint(1, 3)):
                w ^= 1 << b
            values.add(w)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_anchor_counts():
    values = np.random.default_rng(1).integers(-(2**63), 2**63, 500, dtype=np.int64)
    row, _ = anchors(values, 0)
    assert sorted(row.tolist()) == list(range(500))  # one home each
    row, key = anchors(values, 2)
    assert len({*zip(row.tolist(), key.tolist())}) == len(row) and 55 < len(row) / 500 < 70


def test_components_on_paths_stars_and_cliques(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (9, 3), (3, 9)]
    edges += [(a, b) for a in range(700, 712) for b in range(700, a)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    where = {n: i for i, n in enumerate(nodes)}
    roots = components(len(nodes), [(where[a], where[b]) for a, b in edges if a != b])
    least = {}
    for n, r in zip(nodes, roots):
        least.setdefault(r, n)
    assert got == {n: least[r] for n, r in zip(nodes, roots)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fingerprint_of_long_and_odd_texts():
    for text in (None, "", "a", "A b", "é É ß", " ".join(str(i * i) for i in range(3000))):
        assert fingerprint(text) == plain_fingerprint(text)


def test_keep_one(edge_docs, no_docs):
    found = near_duplicates(edge_docs)
    kept = keep_one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    groups = {r["component_id"] for r in found.collect()}
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, groups))
    assert keep_one_per_group(no_docs).count() == 0


def test_copies_are_never_broadcast(spark, tmp_path):
    """61 copies of each fingerprint stand behind a table that Spark takes as small."""
    spark.range(500).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fp")
    links = fingerprint_links(spark.read.parquet(f"{tmp_path}/fp"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert links.count() == 0


def test_keeping_one_never_broadcasts_copies(spark, monkeypatch):
    """The stage of the pipeline joins by the same links as the operator."""
    from crewlens.llm import simhash

    plans, links_of = [], simhash.fingerprint_links

    def links(*args):
        plans.append((got := links_of(*args))._jdf.queryExecution().executedPlan().toString())
        return got

    monkeypatch.setattr(simhash, "fingerprint_links", links)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', sha1(cast(id AS string)), ' ', md5(cast(id AS string)), ' end') AS text")
    assert keep_one_per_group(docs).count() == 300
    assert len(plans) == 1 and "Broadcast" not in plans[0]
