from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crewlens.llm import ngram_lm as N

from .test_simhash import _split


def plain_model(texts):
    """(base, score) functions of an interpolated modified Kneser-Ney bigram model, in plain Python."""
    count, pairs = Counter(), Counter()
    for t in texts:
        words = [*_split(t), "</s>"]
        count.update(words)
        pairs.update(zip(["<s>", *words], words))
    total, distinct = sum(count.values()), len(count)
    context, follow, before = Counter(), defaultdict(Counter), Counter()
    for (v, w), n in pairs.items():
        context[v] += n
        follow[v][min(n, 3)] += 1
        before[w] += 1

    def ds(counts):
        n = Counter(min(c, 5) for c in counts)
        return N.discounts(n[1], n[2], n[3], n[4])

    d2, d1 = ds(pairs.values()), ds(before.values())
    types = len(pairs)
    rest = sum(d1[min(c, 3) - 1] for c in before.values()) / types if types else 1.0

    def cut(n, d):
        return max(n - d[min(n, 3) - 1], 0.0) if n else 0.0

    def low(w):
        return (cut(before[w], d1) / types if types else 0.0) + rest / (distinct + 1)

    def p(v, w):
        if not context[v]:
            return low(w)
        free = sum(d2[k - 1] * n for k, n in follow[v].items())
        return (cut(pairs[v, w], d2) + free * low(w)) / context[v]

    return count, total, distinct, p


def check(docs, spark_rows):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count, total, distinct, p = plain_model([t for d, t in rows if not held(d)])
    want = []
    for d, t in rows:
        words = [*_split(t), "</s>"]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        score = sum(math.log10(p(v, w)) for v, w in zip(["<s>", *words], words))
        want.append((d is None, d or 0, held(d), len(words), sum(count[w] > 0 for w in words), total, round(base, 5), round(score, 5)))
    got = [
        (r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5))
        for r in spark_rows.collect()
    ]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], abs=2e-4) and a[7] == pytest.approx(b[7], abs=2e-4)


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_scores_equal_a_plain_model(name, request):
    docs = request.getfixturevalue(name)
    check(docs, N.language_model_scores(docs))


def test_many_buckets_and_flushes(small_docs, monkeypatch):
    monkeypatch.setattr(N, "FLUSH_TOKENS", 500)
    shape = N.fit(small_docs.where(N.trained_on(small_docs["doc_id"])).repartition(5), bucket_bytes=20_000)
    assert shape.buckets > 5
    check(small_docs, N.score_documents(small_docs, shape))


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b", "a a d", "c b a", "e f a b a b a b"]
    shape = N.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    vocab = sorted({w for t in texts for w in t.split()})
    hashes = {w: N.token_pairs(pa.array([w]))[0][0] for w in [*vocab, "never"]}
    hashes["</s>"] = N.END
    for context in [N.START, *(hashes[w] for w in [*vocab, "never"])]:
        tokens = np.array([*hashes.values()], np.uint64)
        _, _, logs = N.score_tokens(shape, tokens, np.full(len(tokens), context, np.uint64))
        assert (10**logs).sum() == pytest.approx(1.0)


def test_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = N.language_model_scores(spark.createDataFrame([(held, "a b", 1)], "doc_id long, text string, bucket int")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0)]


def test_frequent_pairs_keep_their_count(spark):
    docs = spark.createDataFrame([(i, "x y " * 200) for i in range(6)], "doc_id long, text string")
    check(docs, N.language_model_scores(docs))
