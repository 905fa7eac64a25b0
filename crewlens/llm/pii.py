"""Personal data: fixed patterns, and a linear-chain conditional random field.

The field labels white-space words from features of their shape. It is trained
by gradient ascent on a small labelled table and decoded with Viterbi in numpy
batches. Its spans are added to those of the patterns where every word of a
span has a high marginal probability and no pattern span is touched.

Words of letters alone carry no shape that a label could rest on: the chain is
cut at words further than ``CONTEXT`` from a word with a digit or an at sign,
and those words are outside by construction.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.spans import Span, Taken, mask_spans, span_column

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
FEATURES = 1 << 13
CONTEXT = 2
ADD_ABOVE = 0.98
#: words (padding included) that are decoded together, and words of a long window that are decoded at a time
_BATCH_WORDS, _PIECE_WORDS = 1 << 15, 1 << 12

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_SHAPED = re.compile(r"[0-9@]")
_OUTSIDE = "()[]<>{}\"'.,;:!?#*$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start.

    Each pattern is matched leftmost and non-overlapping; matches that fail
    their check are dropped. Addresses are sought from their at sign outward,
    so a long run of letters costs no more than its length.
    """
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end(), True))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span(), True))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span(), True))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append(("phone", *m.span(), True))
    return found


# -- the field ---------------------------------------------------------------
def _sort_of(c: str) -> str:
    return "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c


_ASCII_SORT = {i: _sort_of(chr(i)) for i in range(128)}
_RUN = re.compile(r"([Aa9])\1+")


def shape(word: str, full: bool = False) -> str:
    """The whole word, letters as A or a, digits as 9, signs as they are; runs collapsed unless ``full``."""
    out = word.translate(_ASCII_SORT) if word.isascii() else "".join(map(_sort_of, word))
    return out if full else _RUN.sub(r"\1", out)


def word_features(words: Sequence[str], i: int) -> list[int]:
    """Hashed features of word ``i``."""
    word = words[i].strip(_OUTSIDE) or words[i]
    digits = sum("0" <= c <= "9" for c in word)
    left = shape(words[i - 1].strip(_OUTSIDE)) if i else "^"
    right = shape(words[i + 1].strip(_OUTSIDE)) if i + 1 < len(words) else "$"
    keys = [
        "bias", f"s {shape(word)}", f"f {shape(word, True)}", f"d {min(digits, 20)}", f"n {min(len(word), 24)}",
        f"l {left}", f"r {right}", f"ls {left} {shape(word)}", f"sr {shape(word)} {right}",
        f"first {words[i][0] if not words[i][0].isalnum() else ''}", f"dots {word.count('.')}", f"at {'@' in word}",
    ]
    return [zlib.crc32(k.encode()) % FEATURES for k in keys]


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # feature x label
    move: np.ndarray  # label x label
    begin: np.ndarray

    def potentials(self, windows: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(window x position x label scores, lengths), padded with zeros."""
        lengths = np.array([len(w) for w in windows])
        out = np.zeros((len(windows), int(lengths.max()), len(self.begin)))
        for n, words in enumerate(windows):
            index = np.array([word_features(words, i) for i in range(len(words))])
            out[n, : len(words)] = self.emit[index].sum(axis=1)
        return out, lengths

    def decode_long(self, words: Sequence[str]) -> tuple[list[int], np.ndarray]:
        """``decode`` of one window of any length, holding one piece of it at a time.

        Forward messages are carried from piece to piece and kept only where a
        piece begins; then the pieces are gone through backwards with the exact
        messages from both sides, so the result is that of one long chain.
        """
        cuts = list(range(0, len(words), _PIECE_WORDS))

        def scores(a: int) -> np.ndarray:
            z = min(a + _PIECE_WORDS, len(words))
            return self.emit[np.array([word_features(words, i) for i in range(a, z)])].sum(axis=1)

        def forward(score: np.ndarray, sums, best):
            alpha, back = np.empty_like(score), np.zeros(score.shape, np.int8)
            for t, here in enumerate(score):
                if best is None:
                    sums, best = self.begin + here, self.begin + here
                else:
                    through = best[:, None] + self.move
                    back[t] = through.argmax(axis=0)
                    best = through.max(axis=0) + here
                    sums = _log_sum(sums[:, None] + self.move, 0) + here
                alpha[t] = sums
            return alpha, back, sums, best

        entries, sums, best = [], None, None
        for a in cuts:
            entries.append((sums, best))
            _, _, sums, best = forward(scores(a), sums, best)
        total, label = _log_sum(sums, 0), int(best.argmax())
        path, sure = np.zeros(len(words), np.int64), np.zeros(len(words))
        beta = np.zeros(len(self.begin))
        for a, (sums, best) in zip(reversed(cuts), reversed(entries)):
            score = scores(a)
            alpha, back, _, _ = forward(score, sums, best)
            for t in range(len(score) - 1, -1, -1):
                path[a + t], sure[a + t] = label, math.exp(alpha[t, label] + beta[label] - total)
                if a + t:
                    label = int(back[t, label])
                    beta = _log_sum(self.move + (score[t] + beta)[None, :], 1)
        return path.tolist(), sure

    def decode(self, windows: Sequence[Sequence[str]]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Viterbi labels of each window, and the marginal probability of each word's label."""
        score, lengths = self.potentials(windows)
        n, steps, k = score.shape
        best, back = self.begin + score[:, 0], np.zeros((n, steps, k), np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + self.move
            live = (t < lengths)[:, None]
            back[:, t] = np.where(live, through.argmax(axis=1), np.arange(k))
            best = np.where(live, through.max(axis=1) + score[:, t], best)
        path = np.zeros((n, steps), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        alpha, beta, total = _sums(score, lengths, self.move, self.begin)
        p = np.exp(alpha + beta - total[:, None, None])
        sure = np.take_along_axis(p, path[:, :, None], 2)[:, :, 0]
        return [path[i, :m].tolist() for i, m in enumerate(lengths)], [sure[i, :m] for i, m in enumerate(lengths)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _sums(score, lengths, move, begin):
    """Forward and backward log sums, and the log partition of each window."""
    n, steps, k = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = begin + score[:, 0]
    for t in range(1, steps):
        on = _log_sum(alpha[:, t - 1][:, :, None] + move, 1) + score[:, t]
        alpha[:, t] = np.where((t < lengths)[:, None], on, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        on = _log_sum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], on, 0.0)
    return alpha, beta, _log_sum(alpha[:, -1], 1)


def train_field(table: Sequence[tuple[Sequence[str], Sequence[str]]], rounds: int = 80, rate: float = 0.5, penalty: float = 1e-3) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adagrad over the whole table."""
    windows = [list(w) for w, _ in table]
    lengths = np.array([len(w) for w in windows])
    n, steps, k = len(windows), int(lengths.max()), len(LABELS)
    number = {name: i for i, name in enumerate(LABELS)}
    index = np.zeros((n, steps, len(word_features(windows[0], 0))), np.int64)
    truth = np.zeros((n, steps), np.int64)
    for i, (words, tags) in enumerate(table):
        for t, tag in enumerate(tags):
            index[i, t] = word_features(words, t)
            truth[i, t] = number[tag]
    here = np.arange(steps) < lengths[:, None]
    gold = np.eye(k)[truth] * here[:, :, None]
    both = here[:, 1:]
    moves = np.zeros((k, k))
    np.add.at(moves, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    flat = index[here]
    field = Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k))
    state = [np.full_like(x, 1e-6) for x in (field.emit, field.move, field.begin)]
    for _ in range(rounds):
        score = field.emit[index].sum(axis=2) * here[:, :, None]
        alpha, beta, total = _sums(score, lengths, field.move, field.begin)
        p = np.exp(alpha + beta - total[:, None, None]) * here[:, :, None]
        pair = np.exp(
            alpha[:, :-1, :, None] + field.move + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        emit = np.zeros_like(field.emit)
        np.add.at(emit, flat, (gold - p)[here][:, None, :])
        steps_up = (emit / n, (moves - pair.sum(axis=(0, 1))) / n, (gold - p)[:, 0].sum(axis=0) / n)
        values = []
        for x, up, seen in zip((field.emit, field.move, field.begin), steps_up, state):
            up = up - penalty * x / n
            seen += up * up
            values.append(x + rate * up / np.sqrt(seen))
        field = Field(*values)
    return field


def labelled_table(rows: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: word sequences with personal data and look-alikes."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: "".join(rng.choices("abcdehilmnorstu", k=rng.randint(1, 9)))
    number = lambda: str(rng.randint(0, 255))

    def email():
        user = rng.choice([f"{name()}.{digits(2)}", name(), f"{name()}_{name()}", f"{name()}+{name()}"])
        return [f"{user}@{name()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'example.com', 'co.uk'])}"]

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([
            [f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{digits(2)}", digits(1), digits(2), digits(2), digits(2), digits(2)],
            [f"+{digits(2)}{digits(9)}"], [f"{a}-{b}-{c}"], [f"+{digits(1)}-{a}-{b}-{c}"],
        ])

    def card():
        return rng.choice([[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]])

    def other():
        return rng.choice([
            [str(rng.randint(1900, 2030))], [digits(rng.choice([1, 2, 3, 5, 6, 8, 10, 12, 13, 20]))], [f"{number()}.{digits(2)}"],
            [f"{digits(1)}.{digits(1)}.{digits(1)}"], [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"], [f"${number()}.{digits(2)}"],
            [f"1{digits(1)}:{digits(2)}"], [f"{name()}{digits(2)}"], [f"{name()}={digits(3)}{name()}{digits(4)}"], [f"@{name()}"],
            ["pages", number(), "to", number()], [f"{number()}%"], [f"A{digits(4)}-{digits(2)}"], [f"AKIA{digits(3)}QX{digits(4)}ZT{digits(2)}"],
            ["token", "=", f'"{digits(9)}ab{digits(9)}ef{digits(9)}c"'], [digits(4), digits(4)], ["(", digits(3), ")"], [f"({digits(4)})"],
            [f"{digits(3)}-{digits(2)}"], ["=", digits(16) + "f"],
        ])

    makers = {"email": email, "ip": lambda: [".".join(number() for _ in range(4))], "card": card, "phone": phone}
    table = []
    for _ in range(rows):
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 3)):
                words.append(rng.choice([name(), name().title(), name() + ",", "the", "of", "—", "##"]))
                tags.append("O")
            kind = rng.choice([*KINDS, None, None, None])
            got = makers[kind]() if kind else other()
            tags += ["O"] * len(got) if kind is None else [f"B-{kind}", *[f"I-{kind}"] * (len(got) - 1)]
            if rng.random() < 0.2:
                got[-1] += rng.choice(".,;:###***")
            words += got
        words.append(rng.choice([name(), "end."]))
        tags.append("O")
        table.append((words, tags))
    return table


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(labelled_table())


def field_spans(texts: Sequence[str], field: Field, add_above: float = ADD_ABOVE) -> list[list[tuple[str, int, int]]]:
    """Spans that the field is sure of, per text, in order of start."""
    windows, homes = [], []
    for n, text in enumerate(texts):
        if not _SHAPED.search(text):
            continue
        words = [m.span() for m in _WORD.finditer(text)]
        near = np.zeros(len(words) + 2 * CONTEXT, bool)
        for i, (a, z) in enumerate(words):
            if _SHAPED.search(text, a, z):
                near[i : i + 2 * CONTEXT + 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near[CONTEXT : CONTEXT + len(words)], [False]]).astype(np.int8)))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            windows.append([text[s:e] for s, e in words[a:z]])
            homes.append((n, words[a:z]))
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for some in _batches([len(w) for w in windows]):
        if len(windows[some[0]]) > _PIECE_WORDS:
            paths, sure = zip(*[field.decode_long(windows[i]) for i in some])
        else:
            paths, sure = field.decode([windows[i] for i in some])
        for i, path, p in zip(some, paths, sure):
            n, places = homes[i]
            t = 0
            while t < len(path):
                label = LABELS[path[t]]
                if label[0] != "B":
                    t += 1
                    continue
                stop = t + 1
                while stop < len(path) and LABELS[path[stop]] == f"I-{label[2:]}":
                    stop += 1
                if p[t:stop].min() >= add_above:
                    a, z = places[t][0], places[stop - 1][1]
                    while z > a and texts[n][z - 1] in _OUTSIDE and texts[n][z - 1] != ")":
                        z -= 1
                    while a < z and texts[n][a] in _OUTSIDE and texts[n][a] != "(":
                        a += 1
                    if a < z:
                        found[n].append((label[2:], a, z))
                t = stop
    for f in found:
        f.sort(key=lambda s: s[1])
    return found


def _batches(lengths: Sequence[int]) -> Iterator[list[int]]:
    """Windows of like length together: their number times the longest stays under ``_BATCH_WORDS``; long ones go alone."""
    some: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if some and (len(some) + 1) * lengths[i] > _BATCH_WORDS or lengths[i] > _PIECE_WORDS:
            if some:
                yield some
            some = []
        some.append(i)
    if some:
        yield some


def find_spans(texts: Sequence[str], field: Field) -> list[list[Span]]:
    """Pattern spans and the field's additions, by kind as listed, then start."""
    out = []
    for text, extra in zip(texts, field_spans(texts, field)):
        spans = pattern_spans(text)
        taken = Taken(spans)
        spans += [(k, a, z, False) for k, a, z in extra if not taken.meets(a, z)]
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (kind, start, end, base).

    Offsets are code points, the end exclusive; ``base`` tells pattern spans
    from the field's. Null and empty texts have none; repeated rows each give a
    row; other columns are ignored; an empty table gives no rows.
    """
    field = field or default_field()
    find = lambda texts: find_spans(texts, field)
    return docs.select(F.col(id_col).alias("doc_id"), span_column(find, F.col(text_col).cast("string")).alias("spans"))


def mask_personal_data(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with personal data replaced by its kind in angle brackets.

    All columns stay; an ``n_chars`` column follows the new length. Null texts stay null.
    """
    field = field or default_field()

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        found = find_spans([v or "" for v in values], field)
        return pa.array([mask_spans(v, s) if s else v for v, s in zip(values, found)], pa.string())

    out = docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
