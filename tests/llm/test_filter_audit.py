from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from crewlens.llm import filter_audit as fa

from .conftest import rows_of

LABELS = "doc_id long, quality int, toxic int, n int"


def plain_mask(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), bool(re.search("[#$%&*|]", text))]
    return sum(1 << i for i, f in enumerate(fails) if f)


def brute(rows, labels):
    """Every order over every row, one filter after another."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    docs = []
    for doc, text, part in rows:
        mask = plain_mask(text or "") + 16 * (doc is not None and doc > least[text or ""])
        docs.append((part or "", {f for i, f in enumerate("ABCDE") if mask >> i & 1}, doc in good, doc in toxic))
    out, share = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, own in enumerate(order, 1):
            before = set(order[: step - 1])
            for part, fails, g, t in docs:
                row = out.setdefault((part, order, step), [0, 0, 0, 0, 0, 0])
                removed = own in fails and not fails & before
                row[0] += not fails & (before | {own})
                row[1] += removed
                row[2] += own in fails and bool(fails & before)
                row[3] += fails == {own}
                row[4] += removed and g
                row[5] += removed and t
                share[part, own] += removed
    return sorted((p, o, s, *v, share[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit(spark, rows, labels, **named):
    docs = spark.createDataFrame([(d, t, p, 1, "x", b"k") for d, t, p in rows], "doc_id long, text string, lang string, mask int, h string, K binary")
    said = spark.createDataFrame([(*r, 1) for r in labels], LABELS)
    return rows_of(fa.filter_interactions(docs.repartition(3), said, **named))


def table():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None, "en"), (1, "", None), (2, " \n\t\x0b", "en"), (None, "same text", "en"), (9, "same text", "de"), (9, "same text", "de"), (11, "same text", "")]
    for i in range(60):
        text = " ".join(rng.sample(words, rng.choice([90, 99, 100, 130])))
        text += rng.choice(["", " 5%", " " + "A" * 60, " " + " ".join(["dup"] * 60), " x y", "É" * 300])
        rows.append((100 + i, text, rng.choice(["en", "de", None])))
    rows += [(i, rows[20][1], "en") for i in range(300, 500)]  # one text holds most rows
    rows += [(50 + i, rows[30 + i][1], "fr") for i in range(9)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, _, _ in rows if rng.random() < 0.6]
    return rows, labels + [(None, 1, 1), (9, 0, 0), (9, 1, 0), (9, 1, 0), (12345, 1, 1)]


@pytest.mark.parametrize("named", [{}, {"broadcast_bytes": 0}, {"digest": lambda k: F.xxhash64(F.substring(k, 1, 1))}])
def test_against_every_order(spark, named):
    rows, labels = table()
    assert audit(spark, rows, labels, **named) == brute(rows, labels)


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert fa.filter_interactions(no_docs, labels).count() == 0
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in edge_docs.collect()]
    assert rows_of(fa.filter_interactions(edge_docs, labels)) == brute(rows, [])


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(fa, "_PIECE", 7)
    for text in ["a b " * 80 + "longer-than-a-piece x", "é" * 50, "", " " * 30, "One Two % " * 40]:
        assert fa.text_mask(text.encode()) == plain_mask(text)


def test_sketch_clears_uniques_only(spark):
    rows = spark.range(20_000).select(F.col("id"), F.sha2((F.col("id") % 15_000).cast("string"), 256).cast("binary").alias("k"))
    got = fa.RepeatSketch(rows).mark(rows).groupBy((F.col("id") % 15_000 < 5_000).alias("twice"), "maybe").count().collect()
    n = {(r["twice"], r["maybe"]): r["count"] for r in got}
    assert (True, False) not in n and n[True, True] == 10_000
    assert n[False, True] < 0.03 * 10_000
