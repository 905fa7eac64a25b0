from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crewlens.llm import ngram_lm as N
from crewlens.llm import queries

from .conftest import SMALL
from .test_simhash import _split


def plain_model(texts):
    """score(words) of an interpolated modified Kneser-Ney model of order three, in plain Python."""
    vocabulary, raw, triples = set(), Counter(), Counter()
    for t in texts:
        words = ["<s>", *_split(t), "</s>"]
        vocabulary.update(words[1:])
        raw.update(zip(words, words[1:]))
        triples.update(zip(words, words[1:], words[2:]))
    before, used = Counter(w for _, w in raw), Counter((v, w) for _, v, w in triples)
    used.update({k: n for k, n in raw.items() if k[0] == "<s>"})

    def level(counts):
        n = Counter(min(c, 5) for c in counts.values())
        d = N.discounts(n[1], n[2], n[3], n[4])
        mass, free = Counter(), defaultdict(float)
        for k, c in counts.items():
            context = k[:-1] if isinstance(k, tuple) else ()
            mass[context] += c
            free[context] += d[min(c, 3) - 1]

        def p(context, key, lower):
            if not mass[context]:
                return lower
            c = counts[key]
            return (max(c - d[min(c, 3) - 1], 0.0) * (c > 0) + free[context] * lower) / mass[context]

        return p

    p1, p2, p3 = level(before), level(used), level(triples)

    def score(words):
        words, total = ["<s>", *words, "</s>"], 0.0
        for i in range(1, len(words)):
            w, v = words[i], words[i - 1]
            p = p2((v,), (v, w), p1((), w, 1 / (len(vocabulary) + 1)))
            if i > 1:
                p = p3((words[i - 2], v), (words[i - 2], v, w), p)
            total += math.log10(p)
        return total

    return score


def check(docs, scored):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    score = plain_model([t for d, t in rows if not held(d)])
    want = sorted((d is None, d or 0, round(score(_split(t)), 5)) for d, t in rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 5)) for r in scored.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-4)


@pytest.mark.parametrize("name", ["edge_docs", "small_docs"])
def test_scores_equal_a_plain_model(name, request):
    docs = request.getfixturevalue(name)
    check(docs, N.language_model_scores(docs, order=3))


def test_the_query_is_of_order_three(spark, small_docs):
    check(small_docs, queries.QUERIES["op3_kneser_ney"](spark, SMALL))


def test_many_buckets_flushes_and_frequent_triples(spark, small_docs, monkeypatch):
    monkeypatch.setattr(N, "FLUSH_TOKENS", 500)
    docs = small_docs.select("doc_id", "text").union(spark.createDataFrame([(900_000 + i, "x y " * 200) for i in range(6)], "doc_id long, text string"))
    shape = N.fit(docs.where(N.trained_on(docs["doc_id"])).repartition(5), bucket_bytes=20_000, order=3)
    assert shape.buckets > 5
    check(docs, N.score_documents(docs, shape))


def test_empty_texts_only(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(20)], "doc_id long, text string")
    check(docs, N.language_model_scores(docs, order=3))
    none = N.language_model_scores(docs.where("doc_id < 0"), order=3)
    assert none.count() == 0


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b", "a a d", "c b a", "e f a b a b a b"]
    shape = N.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    vocab = sorted({w for t in texts for w in t.split()})
    hashes = {w: N.token_pairs(pa.array([w]))[0][0] for w in [*vocab, "never"]}
    words = [hashes[w] for w in [*vocab, "never"]]
    for u in [N.START, *words]:
        for v in words:
            ends = [*words, N.END]  # a row per end: v after u, then the end
            tokens = np.array([x for w in ends for x in (v, w)], np.uint64)
            before = np.array([x for _ in ends for x in (u, v)], np.uint64)
            _, _, logs = N.score_tokens(shape, tokens, before, np.arange(len(tokens)) % 2 == 0)
            assert (10 ** logs[1::2]).sum() == pytest.approx(1.0)
