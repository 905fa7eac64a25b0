from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crewlens.llm import pii, secrets
from crewlens.llm.queries import QUERIES

from .conftest import rows_of

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
SECRETS = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"),
]


def plain_pii(text):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span(), True))
    return out


def plain_secrets(text):
    out = []
    for n, (kind, pattern) in enumerate(SECRETS):
        for m in re.finditer(pattern, text):
            if (kind == "assign" and len(m.group(2)) < 8) or (kind == "access" and len(m.group()) < 16) or (kind == "hex" and len(m.group()) < 32):
                continue
            out.append((m.start(), n, (kind, *m.span(), True)))
    return [s for _, _, s in sorted(out)]


def test_pattern_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "@", ".", "-", "1", "25", "+", " ", "(", ")", "4111 1111 1111 1111", "b.c", "9", "%", "é", "\n", "300", "４"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 18)))
        assert pii.pattern_spans(text) == plain_pii(text)
    parts = [
        "password", "token", "API_KEY", "apikey", "Secret", " ", "=", ":", '"', "'", "abcdef0123", "AKIA", "ABCD1234", "AKIAQ",
        "deadbeefdeadbeef", ".", "é", "ſecret", "toKen", "x", "\n", "  ", "9",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    for text, spans in zip(texts, secrets.find_spans(texts, secrets.default_grammar())):
        assert [s for s in spans if s[3]] == plain_secrets(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_on_unseen_rows():
    field = pii.default_field()
    table = pii.labelled_table(300, seed=99)
    paths, sure = field.decode([w for w, _ in table])
    wrong = sum(pii.LABELS[a] != b for path, (_, tags) in zip(paths, table) for a, b in zip(path, tags))
    assert wrong / sum(len(t) for _, t in table) < 0.01
    assert all(0 <= p.min() and p.max() <= 1 + 1e-9 for p in sure)


def test_viterbi_equals_all_paths():
    from itertools import product

    import numpy as np

    field = pii.default_field()
    words = ["call", "(988)", "555-2485"]
    score, _ = field.potentials([words])
    best = max(
        product(range(len(pii.LABELS)), repeat=3),
        key=lambda p: field.begin[p[0]] + sum(score[0, t, p[t]] for t in range(3)) + sum(field.move[p[t], p[t + 1]] for t in range(2)),
    )
    assert field.decode([words])[0][0] == [*best]
    total = sum(
        np.exp(field.begin[p[0]] + sum(score[0, t, p[t]] for t in range(3)) + sum(field.move[p[t], p[t + 1]] for t in range(2)))
        for p in product(range(len(pii.LABELS)), repeat=3)
    )
    assert pii._sums(score, np.array([3]), field.move, field.begin)[2][0] == pytest.approx(np.log(total))


def test_field_adds_what_patterns_miss_and_leaves_prose():
    field = pii.default_field()
    text = "write to +1 (269) 555-3296 4524132264652876 today"  # one run of digits to the patterns
    found = pii.find_spans([text, "In 1999 the 300 pages cost $4.50, see 2024-05-12 and v1.2.3.", "no digits at all"], field)
    assert [(k, text[a:z]) for k, a, z, _ in found[0]] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    assert found[1:] == [[], []]


def test_mask(edge_docs, no_docs, spark):
    docs = spark.createDataFrame(
        [(1, "mail a.b@c.org now 1.2.3.4", 9, "k"), (None, None, 3, "k"), (2, "clean", 5, "k")], "doc_id long, text string, n_chars int, spans string"
    )
    out = pii.mask_personal_data(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert rows_of(out, "doc_id", "text", "n_chars") == [(1, "mail <EMAIL> now <IP>", 21), (2, "clean", 5), (None, None, 3)]
    assert pii.mask_personal_data(edge_docs).count() == edge_docs.count() and pii.mask_personal_data(no_docs).count() == 0


def test_automata_tell_credentials_from_ordinary_strings():
    grammar = secrets.default_grammar()
    for kind, rows in secrets.example_credentials(200, seed=77).items():
        assert sum(grammar.score(r)[1] > grammar.margin for r in rows) > 0.95 * len(rows), kind
    ordinary = [r for rows in secrets.example_ordinary(200, seed=78).values() for r in rows if len(r) >= secrets.CANDIDATE_CHARS]
    assert sum(grammar.score(r)[1] > grammar.margin for r in ordinary) <= 0.003 * len(ordinary)


def test_automaton_is_a_distribution_and_merges_states():
    import math

    auto = secrets.infer_automaton(["ab1", "ab1", "xy2", "ab12", "zz345"] * 20)
    out = {}
    for (state, _), (_, p) in auto.move.items():
        out[state] = out.get(state, 0) + math.exp(p)
    for state, stop in enumerate(auto.stop):
        assert out.get(state, 0) + math.exp(stop) <= 1 + 1e-9
    loop = secrets.infer_automaton(["1" * n for n in range(1, 60) for _ in range(max(1, int(200 * 0.9**n)))])
    assert len(loop.stop) < 20  # sixty states fold


def test_added_secret_and_long_texts():
    grammar = secrets.default_grammar()
    key = "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"
    texts = [f"use {key}, please", "é" * 5000 + f" {key}", "a" * 200_000, "the " * 50_000 + key]
    for text, spans in zip(texts, secrets.find_spans(texts, grammar)):
        assert [text[a:z] for _, a, z, base in spans if not base] == ([key] if key in text else [])


@pytest.mark.parametrize("name", ["op7_grammar_secrets", "op9_crf_personal_data"])
def test_digests(spark, name):
    plain = plain_secrets if name.startswith("op7") else plain_pii
    kinds = [k for k, _ in (SECRETS if name.startswith("op7") else PII)]
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{z}" for k, a, z, _ in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("find", [pii.find_personal_data, secrets.find_secrets])
def test_edges(find, edge_docs, no_docs):
    assert find(edge_docs).count() == edge_docs.count() and find(no_docs).count() == 0


def test_shapes_of_whole_words():
    assert pii.shape("Ab12-cDé9" + "x" * 100 + "7") == "Aa9-aAa9a9" and pii.shape("12é", full=True) == "99a"
    assert pii.shape("a" * 60 + "9") != pii.shape("a" * 60) and pii.shape("--..99") == "--..9"


def test_long_windows_equal_one_chain(monkeypatch):
    """Pieces with carried messages give the labels and marginals of the whole chain."""
    rng = random.Random(2)
    pool = ["call", "+1", "(555)", "123-4567", "4111", "1111", "a.b@c.org", "10.0.0.1", "x9", "end.", "2020"]
    words = [rng.choice(pool) for _ in range(700)]
    field = pii.default_field()
    paths, sure = field.decode([words])
    for size in (1, 7, 100, 699, 700, 4096):
        monkeypatch.setattr(pii, "_PIECE_WORDS", size)
        path, p = field.decode_long(words)
        assert path == paths[0] and np.allclose(p, sure[0], atol=1e-9)


def test_memory_is_bounded_by_words_not_by_the_longest_window():
    import tracemalloc

    texts = ["1 " * 60_000] + ["call 555 now"] * 255
    field = pii.default_field()
    tracemalloc.start()
    found = pii.find_spans(texts, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 256 and peak < 200 << 20


def test_taken_places_against_all_pairs():
    from crewlens.llm.spans import Taken

    rng = random.Random(6)
    spans = [("k", a, a + rng.randint(1, 12), True) for a in (rng.randint(0, 200) for _ in range(30))]
    taken = Taken(spans)
    for a in range(0, 220):
        for z in range(a + 1, a + 9):
            assert taken.meets(a, z) == any(s < z and a < e for _, s, e, _ in spans)
    assert not Taken([]).meets(0, 5)


def test_edges_carry_their_own_counts():
    """A folded format keeps the frequencies of its characters: 10 digits and 6 letters of 16."""
    rng = random.Random(11)
    rows = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(400)]
    automaton = secrets.infer_automaton(rows)
    drawn = "".join(rows)
    for symbol, want in (("9", 10 / 16), ("f", 6 / 16)):
        p = [math.exp(v[1]) for (state, c), v in automaton.move.items() if c == symbol]
        assert any(abs(x - want) < 0.03 for x in p)
    state, taken = 0, Counter()
    for value in rows:  # the machine run over its own examples: each edge's share is its probability
        state = 0
        for c in secrets.classes(value):
            taken[state, c] += 1
            state = automaton.move[state, c][0]
    for s in {s for s, _ in taken}:
        total = sum(n for (t, _), n in taken.items() if t == s)
        if total > 2000:
            for (t, c), n in taken.items():
                if t == s:
                    assert abs(math.exp(automaton.move[t, c][1]) - n / total) < 0.03
    assert abs(drawn.count("a") / len(drawn) - 1 / 16) < 0.01


def test_unmerged_automaton_scores_like_the_examples():
    """With nothing merged the automaton is the prefix tree: a string's likelihood is its smoothed share, move by move."""
    rows = ["ab1", "ab1", "zZ", "9"]
    automaton = secrets.infer_automaton(rows)
    tree, ends = {}, Counter()
    for r in rows:
        for i, c in enumerate(secrets.classes(r)):
            tree.setdefault(secrets.classes(r)[:i], Counter())[c] += 1
        ends[secrets.classes(r)] += 1
    if len(automaton.stop) == len({secrets.classes(r)[:i] for r in rows for i in range(len(r) + 1)}):
        for r in rows:
            total, symbols = 0.0, secrets.classes(r)
            for i, c in enumerate(symbols):
                out = tree[symbols[:i]]
                total += math.log((out[c] + 0.5) / (out.total() + ends[symbols[:i]] + 0.5 * (len(out) + 1)))
            last = tree.get(symbols, Counter())
            total += math.log((ends[symbols] + 0.5) / (last.total() + ends[symbols] + 0.5 * (len(last) + 1)))
            assert math.isclose(automaton.log_likelihood(symbols), total, rel_tol=1e-9)
