from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from crewlens.llm import suffix_dedup as sd

from .conftest import rows_of

WANT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, match):
    """Every string of ``match`` bytes of every text, counted."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(raw[p : p + match] for _, raw in texts for p in range(len(raw) - match + 1))
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - match + 1):
            if seen[raw[p : p + match]] > 1:
                gone[p + 1 : p + 1 + match] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, 1, 2, b"z", "y") for d, t in rows], "doc_id long, text string, part int, doc int, payload binary, ID2 string").repartition(parts)


def corpus(seed, match):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(match // 8, match // 2)) for _ in range(6)]
    exact = prose(match)[: match - 30]
    while len(exact.encode()) < match:
        exact += "x"
    while len(exact.encode()) > match:
        exact = exact[:-1]
    texts = [None, "", "short", "q" * (4 * match), "ab" * match, "q" * (match - 1), exact + "!" + exact, exact, exact[1:]]
    for _ in range(50):
        parts = [prose(rng.randint(0, match // 3))]
        for _ in range(rng.randint(0, 3)):
            whole = rng.choice(passages)
            a = rng.randint(0, len(whole) // 3)
            parts += [whole[a : len(whole) - rng.randint(0, len(whole) // 4)], prose(rng.randint(0, 9))]
        texts.append("".join(parts))
    texts += [texts[20]] * 40 + [texts[21][:-3] + "zzz", texts[22][5:]]
    near = texts[23]
    texts += [near[: len(near) // 2] + "_" + near[len(near) // 2 :], passages[0] * 3, passages[1] + passages[1][: match // 2]]
    return list(enumerate(texts)) + [(3, prose(match)), (None, texts[24])]


@pytest.mark.parametrize(("match", "batches", "piece"), [(40, 4, 2 << 20), (40, 3, 100), (64, 1, 2 << 20), (100, 4, 333)])
def test_against_counted_strings(spark, monkeypatch, match, batches, piece):
    rows = corpus(match + batches, match)
    monkeypatch.setattr(sd, "PIECE_BYTES", piece)
    got = rows_of(sd.remove_long_repeats(frame(spark, rows), match=match, batches=batches, bucket_bytes=4000), *WANT)
    want = brute(rows, match)
    assert got == want
    assert sum(r[2] for r in want) > 1000 and any(r[3] > 1 for r in want)


def test_edges(spark, edge_docs, no_docs):
    assert sd.remove_long_repeats(no_docs).columns == WANT
    assert sd.remove_long_repeats(no_docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    short = [r for r in rows if len(r[1] or "") < 10_000]
    docs = edge_docs.where("length(text) < 10000 OR text IS NULL")
    assert rows_of(sd.remove_long_repeats(docs, match=16), *WANT) == brute(short, 16)
    whole = sd.remove_long_repeats(edge_docs, with_text=True).collect()
    texts = Counter(t or "" for _, t in rows)
    for r in whole:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    assert texts and {r["n_removed"] for r in whole if r["n_bytes"] == 5000} == {5000}  # one letter 5,000 times


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 100, 4000).astype(np.uint8)
    match = 48
    anchor = sd.anchor_of(buf, sd.reach_of(match))
    lead = {}
    for p in range(len(buf) - match + 1):
        assert 0 <= anchor[p] - p < sd.reach_of(match)
        assert lead.setdefault(buf[p : p + match].tobytes(), anchor[p] - p) == anchor[p] - p
    plain = np.array([buf[p : p + 5].min() for p in range(len(buf) - 4)])
    assert (sd.sliding_least(buf, 5) == plain).all()


def test_levels_merge_geometrically(spark):
    rows = corpus(1, 40)
    path = sd._stored(frame(spark, rows, 16), "doc_id", "text", 8)
    stored = spark.read.schema("part int, doc int, id long, text string, batch int").parquet(path)
    index, sizes = sd.SuffixIndex(spark, 40, 2), []
    for b in range(8):
        index.add(stored.where(f"batch = {b}"))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1], [8]]


def test_settled_by_scan():
    rows = [(1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 2, 0), (3, 3, 0), (4, 1, 1), (5, 1, 0), (5, 1, 0), (5, 2, 2)]
    entries = np.zeros(len(rows), sd._ENTRY)
    for name, column in zip(("core", "whole", "state"), zip(*rows)):
        entries[name] = column
    state = sd.scan(entries)
    assert state.tolist() == [1, 1, 0, 2, 2, 2, 1, 3, 1, 2]
    entries["state"] = state
    assert [tuple(x)[:2] for x in sd.thinned(entries)] == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1), (5, 2)]
    assert (sd.unpacked(sd.packed(entries), sd._ENTRY) == entries).all()
