from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crewlens.llm import tokenize
from crewlens.llm.bytescan import hashed_words
from crewlens.llm.common import scratch_path
from crewlens.llm.packing import binary_lengths, pack_documents
from crewlens.llm.tokenize import BYTE_BPE, WORD_BPE, Encoder
from crewlens.llm.token_files import file_digests, read_documents, read_metadata, write_token_files

from .conftest import rows_of

PARTS = [
    "a", "B", "the", "'s", "'", "é", "É", " ", "  ", "\n", "\t", " ", " ", "1", "23", ".", "!!", "€", "é", "́",
    " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "漢字", "😀", "Σ", "ς", "İ", "'LL", "-", "_", "​", "᠎",
    "\r\n", "</w>", "Ġ", "ſ", "\x00", "\x0b",
]


def library_ids(vocab, texts):
    return [e.ids for e in tokenize.encoder(vocab).full.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("vocab", [tokenize.WORD_BPE, tokenize.BYTE_BPE], ids=lambda v: v.file)
def test_ids_equal_the_library(vocab, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(8000)]
    monkeypatch.setattr(tokenize, "MEMO_PIECES", 3000)  # the memo starts anew several times
    enc = tokenize.Encoder(vocab)
    for at in range(0, len(texts), 1000):
        ids, lengths = enc.encode(pa.array(texts[at : at + 1000]))
        got = np.split(ids, np.cumsum(lengths)[:-1])
        assert [g.tolist() for g in got] == library_ids(vocab, texts[at : at + 1000])


def test_long_text_over_several_blocks():
    text = " ".join(f"Word{i % 5003},é{i % 97}" for i in range(400_000))
    ids, lengths = tokenize.encoder(tokenize.BYTE_BPE).encode(pa.array([text, None, "x"]))
    want = library_ids(tokenize.BYTE_BPE, [text, "", "x"])
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert hashed_words(pa.array([text, "", "a b"]))[1].tolist() == [400_000, 0, 2]


def check_packing(docs):
    pieces = pack_documents(docs).collect()
    want = defaultdict(list)
    source = docs.select("doc_id", "text").collect()
    for r, ids in zip(source, library_ids(tokenize.WORD_BPE, [r["text"] or "" for r in source])):
        want[r["doc_id"]].append([*ids, 2])
    got = defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) == 1 << p["bucket"] <= 4096 and p["offset"] == 0
        assert p["ids_crc32"] == crc(p["ids"])
        got[p["doc_id"]].append((p["doc_tokens"], p["start"], p["ids"]))
    assert set(got) == set(want)
    for doc, texts in want.items():
        expected = sorted(
            (len(t), at, t[at : at + n])
            for t in texts for at, n in zip(np.cumsum([0, *binary_lengths(len(t))]).tolist(), binary_lengths(len(t)))
        )
        assert sorted(got[doc]) == expected
    numbers = sorted(p["sequence_id"] for p in pieces)
    assert numbers == list(range(len(pieces)))
    by_number = sorted(pieces, key=lambda p: p["sequence_id"])
    assert [p["bucket"] for p in by_number] == sorted((p["bucket"] for p in pieces), reverse=True)


def test_packing(edge_docs, small_docs):
    check_packing(edge_docs)
    check_packing(small_docs)


def test_packing_empty(no_docs):
    assert pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_token_files(spark, name, request):
    docs = request.getfixturevalue(name)
    path = scratch_path(spark, "test-tokens")
    write_token_files(docs, path, row_group_bytes=1 << 16, page_bytes=1 << 12)
    source = docs.select("doc_id", "text").collect()
    ids = [[*x, 0] for x in library_ids(tokenize.BYTE_BPE, [r["text"] or "" for r in source])]
    rows = file_digests(spark, path).orderBy("start").collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(i), crc(i)) for i in ids)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert rows_of(read_metadata(spark, path)) == rows_of(file_digests(spark, path), "doc_id", "start", "n_tokens")
    if name == "small_docs":
        some = read_documents(spark, path, [3, 17])
        want = {r["doc_id"]: i for r, i in zip(source, ids) if r["doc_id"] in (3, 17)}
        assert {r["doc_id"]: list(r["ids"]) for r in some.collect()} == want
        plan = some._jdf.queryExecution().toString()
        assert "PushedFilters: [In(doc_id" in plan


def test_token_file_format(spark, small_docs):
    """Dictionary for ids, delta for metadata, several row groups, page indexes."""
    import glob

    import pyarrow.parquet as pq

    from crewlens.llm.common import local_view

    path = scratch_path(spark, "test-format")
    write_token_files(small_docs, path, row_group_bytes=1 << 16, page_bytes=1 << 12)
    groups = 0
    for file in glob.glob(f"{local_view(path)}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and cols["doc_id"].has_column_index
            assert "RLE_DICTIONARY" in cols["ids.list.element"].encodings and cols["ids.list.element"].has_offset_index
    assert groups >= 1


def test_runs_of_rows_cover_a_batch_in_order():
    from crewlens.llm.bytescan import small_batches, text_buffer

    texts = ["a" * n for n in (0, 5, 90, 3, 200, 0, 1, 40, 40, 40)] + [None, "é" * 30]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"]).slice(1)
    runs = [*small_batches(whole, 1, limit=100)]
    assert sum(([*r.column(0).to_pylist()] for r in runs), []) == whole.column(0).to_pylist()
    assert all(len(r) for r in runs) and len(runs) > 3
    for r in runs:
        buf, offs = text_buffer(r.column(1))
        assert [bytes(buf[a:z]).decode() for a, z in zip(offs, offs[1:])] == [t or "" for t in r.column(1).to_pylist()]
    assert [*small_batches(whole.slice(0, 0), 1)] == []


def test_scripts_without_spaces_are_cut_between_rows():
    from crewlens.llm.bytescan import blocks, text_buffer

    texts = ["漢字かな" * 400, "一二三" * 900, "plain words here " * 50, "，。" * 700] * 6
    column = pa.array(texts)
    buf, offs = text_buffer(column)
    cuts = [*blocks(buf, offs, size=8000)]
    assert cuts[0][0] == 0 and cuts[-1][1] == len(buf) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert len(cuts) > 5
    for vocab in (tokenize.WORD_BPE, tokenize.BYTE_BPE):
        ids, lengths = tokenize.encoder(vocab).encode(column)
        assert [g.tolist() for g in np.split(ids, np.cumsum(lengths)[:-1])] == library_ids(vocab, texts)


def test_packing_is_the_same_without_the_broadcast(small_docs, monkeypatch):
    from crewlens.llm import packing

    wide = rows_of(pack_documents(small_docs, with_ids=False))
    monkeypatch.setattr(packing, "BROADCAST_SLICES", 0)
    assert rows_of(pack_documents(small_docs, with_ids=False)) == wide


def regular_words(bits: int) -> list[str]:
    """A Thue-Morse word of 2 ** bits letters and its complement: sums of powers modulo 2^64 cannot tell them apart."""
    word = "a"
    for _ in range(bits):
        word += word.translate({97: 98, 98: 97})
    return [word, word.translate({97: 98, 98: 97})]


@pytest.mark.parametrize("vocab", [BYTE_BPE, WORD_BPE])
def test_words_a_polynomial_hash_confuses(vocab):
    from crewlens.llm.bytescan import hashed_words

    enc = Encoder(vocab)
    words = [w for bits in (10, 11, 12) for w in regular_words(bits)]
    texts = words + [f"x {w} y" for w in words] + words
    ids, lengths = enc.encode(pa.array(texts))
    edges = [0, *np.cumsum(lengths).tolist()]
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == enc.full.encode(t, add_special_tokens=False).ids
    assert len(set(hashed_words(pa.array(words))[0].tolist())) == len(words)


@pytest.mark.parametrize("vocab", [BYTE_BPE, WORD_BPE])
def test_generations_and_equal_hashes_change_no_id(vocab, monkeypatch):
    """A tiny table, and a hash under which most pieces are equal."""
    import crewlens.llm.tokenize as tk

    rng = np.random.default_rng(7)
    letters = list("abcdeéßñüçÀÖøłŁжΣ") + ["ªb", "µ", "Ǆ", "İ", "ﬁ", "é"]
    words = ["".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(900)] + ["it's", "x1y2", "--", "日本語", "  "]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(200)]
    plain = tk.span_hashes
    for size, weak in ((50, False), (10_000, True)):
        monkeypatch.setattr(tk, "MEMO_PIECES", size)
        monkeypatch.setattr(tk, "span_hashes", (lambda b, s, e: (e - s).astype(np.uint64) * np.uint64(1 << 40) + b[s]) if weak else plain)
        if weak:  # within one block equal hashes must mean equal pieces: one word a block
            batches = [[w] for w in words * 2]
        else:
            batches = [texts[i : i + 20] for i in range(0, 200, 20)] * 2
        enc = Encoder(vocab)
        for batch in batches:
            ids, lengths = enc.encode(pa.array(batch))
            edges = [0, *np.cumsum(lengths).tolist()]
            for i, t in enumerate(batch):
                want = enc.full.encode(t, add_special_tokens=False).ids
                assert ids[edges[i] : edges[i + 1]].tolist() == want, t
