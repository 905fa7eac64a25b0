from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from crewlens.llm import language_id as L

from .conftest import rows_of


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0


def plain_buckets(text):
    """N-gram buckets of a text, one character loop at a time."""
    raw = bytearray(b" ")
    data = text.encode()
    for i, b in enumerate(data):
        if 0x41 <= b <= 0x5A:
            b += 32
        elif b == b"\xc3"[0]:
            pass
        elif i and data[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 32
        raw.append(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20)
    out = {}
    for n in L.GRAMS:
        for a in range(len(raw) - n + 1):
            gram = raw[a : a + n]
            if 0x20 in gram[1:-1] or (n == 2 and gram == b"  "):
                continue
            key = (int.from_bytes(gram, "big") + n) * 0x9E3779B1 & 0xFFFFFFFF
            bucket = key >> (32 - L.BUCKET_BITS)
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_buckets_equal_a_plain_count():
    texts = ["Ab cd, É é ß!", "x", "", "L'été 12 fois", "漢字 kanji"]
    for text, (bucket, count) in zip(texts, L.bucket_counts(pa.array(texts))):
        assert dict(zip(bucket.tolist(), count.tolist())) == plain_buckets(text + " ")


def test_prediction_equals_the_counts(small_docs):
    texts = [r["text"] or "" for r in small_docs.collect()] + ["", "a", "word " * 900_000]
    model = L.fit_language_model(small_docs)
    best, score, fit = model.predict(pa.array(texts))
    for i, (bucket, count) in enumerate(L.bucket_counts(pa.array(texts))):
        sums = model.table[bucket].astype(float).T @ count
        p = model.scores(sums[None, :-1], np.array([count.sum()]))[0]
        assert fit[i] == pytest.approx(sums[-1] / max(1, count.sum()), abs=1e-3)
        assert score[i] == pytest.approx(p.max(), abs=1e-3) and p[best[i]] == pytest.approx(p.max(), abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify_languages(docs).collect()
    assert len(rows) == len(truth)
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    right = np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in test])
    assert right > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.01 and all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, edge_docs, no_docs):
    found = {(r["doc_id"], r["lang_pred"]): r for r in L.identify_languages(edge_docs).collect()}
    rows = edge_docs.collect()
    assert L.identify_languages(edge_docs).count() == len(rows)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            got = found[r["doc_id"], "und"]
            assert got["score"] == 0.0 and got["rejected"]
    assert L.identify_languages(no_docs).count() == 0 and L.keep_identified(no_docs).count() == 0
    kept = L.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns
    want = sum(any(c.isalpha() for c in r["text"] or "") for r in rows)
    assert want - 2 <= kept.count() <= want
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert rows_of(L.identify_languages(unlabelled), "lang_pred", "score", "rejected") == [("und", 0.0, True)]


def test_training_never_looks_at_held_out_rows(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "aa" if i % 2 else "bb") for i in range(300)]
    spoiled = [(i, t, "zz" if held(i) else l) for i, t, l in rows]
    schema = "doc_id long, text string, lang string"
    assert L.fit_language_model(spark.createDataFrame(spoiled, schema)).languages == ("aa", "bb")
    one, two = (L.fit_language_model(spark.createDataFrame(r, schema)) for r in (rows, spoiled))
    assert np.array_equal(one.table, two.table)


FOREIGN = [
    "A kutya a ház előtt ül és nézi az embereket, akik a piacra mennek kenyérért és tejért minden reggel, mert az élet itt lassú és csendes.",
    "Koira istuu talon edessä ja katselee ihmisiä, jotka kävelevät torille ostamaan leipää ja maitoa joka aamu, koska elämä on hidasta.",
    "De hond zit voor het huis en kijkt naar de mensen die elke ochtend naar de markt lopen om brood en melk te kopen, want het is rustig.",
    "Собака сидит перед домом и смотрит на людей, которые каждое утро идут на рынок за хлебом и молоком, потому что жизнь здесь тихая.",
    "犬は家の前に座って、毎朝市場へパンと牛乳を買いに行く人々を眺めている。ここの生活は静かでゆっくりしているからだ。",
]


def test_unlearnt_languages_are_rejected_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit_language_model(docs)
    assert 0.001 < model.temperature < 20  # inside the grid
    rng = np.random.default_rng(4)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(30)) for _ in range(40)]
    parts = [t[a : a + n] for t in FOREIGN for a, n in ((0, 60), (0, 200), (20, 80), (40, 90))]
    bad = spark.createDataFrame([(i, t, None) for i, t in enumerate(noise + parts)], "doc_id long, text string, lang string")
    got = [r["rejected"] for r in L.identify_languages(bad, model=model).collect()]
    assert np.mean(got) >= 0.9
    clean = L.identify_languages(docs, model=model).where("held_out AND lang_pred <> 'und'").collect()
    assert np.mean([r["rejected"] for r in clean]) < 0.003


def test_a_hot_id_and_many_labels_leave_every_language_in(spark):
    rows = [(1, f"{w} beta {i}", "aa") for i, w in enumerate(["alpha", "omega"] * 1500)]  # one id holds most rows
    rows += [(i, f"gamma delta {i} epsilon", "bb") for i in range(2, 400)] + [(9, "same words again", "cc")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    a, b = L.fit_language_model(docs), L.fit_language_model(docs.repartition(3))
    assert a.languages == ("aa", "bb", "cc") and np.array_equal(a.table, b.table)


def test_a_language_of_one_text_in_many_copies_is_learnt(spark):
    for i in range(1, 5):
        rows = [(1, f"text {n} of many", "aa") for n in range(50)] + [(9, f"copied {i}", "cc")] * 5000
        model = L.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model.languages == ("aa", "cc")


def test_the_most_frequent_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    rows = [(i * 5 + 1, f"text {i % 7} words", f"l{i % 3 if i % 3 < 2 else 100 + i}") for i in range(400)]
    model = L.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("l0", "l1")
