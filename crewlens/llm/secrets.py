"""Secret scans by grammar inference.

Labelled credentials are read as strings of character classes. Their prefix
tree is folded by merging states whose outgoing frequencies are statistically
compatible (Hoeffding bounds), which leaves one probabilistic automaton per
format; ordinary strings give automata of their own. Every long unbroken run of
credential characters in a text is a candidate and is scored by the logarithm
of its likelihood under the best credential format over that under the best
ordinary one. Spans of the fixed patterns stay; candidates that touch none and
score above the margin that labelled ordinary strings leave are added.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlens.llm.bytescan import text_buffer
from crewlens.llm.spans import Span, Taken, span_column

BASE_KINDS = ("assign", "access", "hex")
CANDIDATE_CHARS = 16
#: How sure the test must be that two states differ (Hoeffding's alpha).
ALPHA = 0.2
#: States seen less often than this say nothing about a difference.
LEAST_SEEN = 5
#: Log probability of a move that no example made.
SURPRISE = math.log(0.02)

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % CANDIDATE_CHARS)

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), True) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), True) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
    return found


# -- automata ----------------------------------------------------------------
_CLASS = {chr(b): "." for b in range(128)}
_CLASS |= {c: "9" for c in "0123456789"} | {c: "f" for c in "abcdef"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: "F" for c in "ABCDEF"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in "+/_=-"}
_CLASSES = sorted(set(_CLASS.values()))


def classes(value: str) -> str:
    """Character classes: digit, hex and other letters of either case, and each sign."""
    return "".join([_CLASS.get(c, ".") for c in value])


@dataclass(frozen=True)
class Automaton:
    """Log probabilities: of each move (state, class), of stopping, and of each class anywhere.

    A move that no example made costs ``SURPRISE`` and the class's own
    probability, and leads back to the start: one odd character does not decide.
    """

    move: dict[tuple[int, str], tuple[int, float]]
    stop: tuple[float, ...]
    loose: dict[str, float]

    def log_likelihood(self, symbols: str) -> float:
        state, total = 0, 0.0
        for s in symbols:
            state, p = self.move.get((state, s)) or (0, SURPRISE + self.loose[s])
            total += p
        return total + self.stop[state]


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return abs(a / n - b / m) > bound


def infer_automaton(examples: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """Fold the prefix tree of class strings; states are tried in breadth-first order."""
    children: list[dict[str, int]] = [{}]
    counts: list[Counter] = [Counter()]  # how often each edge was taken
    passed, ended = [0], [0]
    for symbols, n in sorted(Counter(map(classes, examples)).items()):
        at = 0
        passed[0] += n
        for s in symbols:
            if s not in children[at]:
                children[at][s] = len(children)
                children.append({})
                counts.append(Counter())
                passed.append(0)
                ended.append(0)
            counts[at][s] += n
            at = children[at][s]
            passed[at] += n
        ended[at] += n

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if passed[x] < LEAST_SEEN or passed[y] < LEAST_SEEN:
                continue
            if _differ(ended[x], passed[x], ended[y], passed[y], alpha):
                return False
            for s in children[x].keys() | children[y].keys():
                i, j = children[x].get(s), children[y].get(s)
                if _differ(counts[x][s], passed[x], counts[y][s], passed[y], alpha):
                    return False
                if i is not None and j is not None and i != j:
                    todo.append((i, j))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            passed[x] += passed[y]
            ended[x] += ended[y]
            counts[x].update(counts[y])
            for s, j in children[y].items():
                i = children[x].get(s)
                if i is None:
                    children[x][s] = j
                elif i != j:
                    todo.append((i, j))

    kept = [0]
    while True:
        known = set(kept)
        edge = next(((r, s, c) for r in kept for s, c in sorted(children[r].items()) if c not in known), None)
        if edge is None:
            break
        parent, symbol, state = edge
        into = next((r for r in kept if compatible(r, state)), None)
        if into is None:
            kept.append(state)
        else:  # its tree is folded into the kept state, whose edge now leads back
            children[parent][symbol] = into
            fold(into, state)
    number = {s: i for i, s in enumerate(kept)}
    move, stop = {}, []
    for s in kept:
        out = {c: (number[t], counts[s][c]) for c, t in children[s].items()}
        total = sum(n for _, n in out.values()) + ended[s]
        smooth = total + 0.5 * (len(out) + 1)
        for c, (to, n) in out.items():
            move[number[s], c] = (to, math.log((n + 0.5) / smooth))
        stop.append(math.log((ended[s] + 0.5) / smooth))
    seen = Counter("".join(map(classes, examples)))
    total = seen.total() + 0.5 * len(_CLASSES)
    return Automaton(move, tuple(stop), {c: math.log((seen[c] + 0.5) / total) for c in _CLASSES})


def example_credentials(rows: int = 1500, seed: int = 23) -> dict[str, list[str]]:
    """Labelled credentials made by rule, by format."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    formats = {
        "access_key": lambda: rng.choice(["AKIA", "ASIA"]) + pick(upper + digit, 16),
        "hex_key": lambda: pick(digit + "abcdef", rng.choice([18, 20, 24, 28, 32, 40, 64])),
        "mixed_key": lambda: pick(upper + lower + digit, rng.choice([20, 24, 32, 36, 40])),
        "prefixed_key": lambda: rng.choice(["ghp_", "sk_live_", "sk-", "glpat-", "xoxb-"]) + pick(upper + lower + digit, rng.choice([24, 36])),
        "base64_key": lambda: pick(upper + lower + digit + "+/", rng.choice([39, 42, 43])) + rng.choice(["", "=", "=="]),
    }
    return {kind: [make() for _ in range(rows)] for kind, make in formats.items()}


def example_ordinary(rows: int = 2250, seed: int = 29) -> dict[str, list[str]]:
    """Long runs of credential characters that are no secrets, by type."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda a=2, z=9: "".join(rng.choices(letters, k=rng.randint(a, z)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    sign = lambda c, n=4: c.join(word() for _ in range(rng.randint(2, n)))
    types = {
        "word": lambda: rng.choice([word(16, 40), word(16, 40).title(), word(16, 40).upper(), word(15, 30) + "."]),
        "joined": lambda: rng.choice([sign("-"), sign("_"), sign("/"), sign("."), sign("_").upper(), "/" + sign("/") + "/", sign("--")]),
        "camel": lambda: "".join(word().title() for _ in range(rng.randint(3, 5))),
        "host": lambda: f"{word()}{digits(rng.randint(0, 2))}.{word()}.{rng.choice(['com', 'org', 'co.uk'])}",
        "path": lambda: "/".join([word(), f"{word()}{digits(2)}", f"{word()}.{word(2, 3)}"]),
        "named": lambda: f"{sign('_')}{rng.choice('-_')}{digits(rng.randint(1, 4))}",
        "number": lambda: rng.choice([digits(rng.randint(16, 24)), f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(4)}", f"20{digits(2)}-{digits(2)}-{digits(2)}_{digits(6)}", "-".join(digits(4) for _ in range(4))]),
        "line": lambda: rng.choice("=-._+") * rng.randint(16, 60),
        "uuid": lambda: "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12)),
        "dated": lambda: f"{word()}-20{digits(2)}-{digits(2)}-{digits(2)}.{word(2, 4)}",
    }
    return {kind: [make() for _ in range(rows)] for kind, make in types.items()}


@dataclass(frozen=True)
class Grammar:
    """Automata of the credential formats and of ordinary strings, and the least score of a secret."""

    formats: dict[str, Automaton]
    ordinary: dict[str, Automaton]
    margin: float

    def score(self, value: str) -> tuple[str, float]:
        """(best format, log likelihood ratio per character)."""
        symbols = classes(value)
        kind, best = max(((k, a.log_likelihood(symbols)) for k, a in self.formats.items()), key=lambda x: x[1])
        plain = max(a.log_likelihood(symbols) for a in self.ordinary.values())
        return kind, (best - plain) / len(symbols)


def infer_grammar(credentials: dict[str, list[str]], ordinary: dict[str, list[str]], alpha: float = ALPHA) -> Grammar:
    """Automata from four fifths of the labelled strings; the margin clears every ordinary string of the rest."""
    fit = lambda rows: [r for i, r in enumerate(rows) if i % 5]
    grammar = Grammar(
        {k: infer_automaton(fit(v), alpha) for k, v in credentials.items()},
        {k: infer_automaton(fit(v), alpha) for k, v in ordinary.items()}, 0.0,
    )
    rest = [r for v in ordinary.values() for r in v[::5]]
    return Grammar(grammar.formats, grammar.ordinary, max([0.1, *(grammar.score(r)[1] for r in rest)]) + 0.05)


@lru_cache(maxsize=1)
def default_grammar() -> Grammar:
    return infer_grammar(example_credentials(), example_ordinary())


def find_spans(texts: Sequence[str], grammar: Grammar) -> list[list[Span]]:
    """Pattern spans and added ones, by start, then kind as listed (patterns first)."""
    kinds = [*BASE_KINDS, *grammar.formats]
    out = []
    for text, long_run in zip(texts, _has_long_run(texts)):
        if not long_run and not _KEYWORD.search(text):
            out.append([])
            continue
        spans = pattern_spans(text)
        taken = Taken(spans)
        for m in _CANDIDATE.finditer(text):
            a, z = m.span()
            while z > a and text[z - 1] in ".-":
                z -= 1
            if z - a < CANDIDATE_CHARS or taken.meets(a, z):
                continue
            kind, score = grammar.score(text[a:z])
            if score > grammar.margin:
                spans.append((kind, a, z, False))
        out.append(sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))
    return out


def _has_long_run(texts: Sequence[str]) -> np.ndarray:
    """Whether a text holds a run of candidate length; short texts with a keyword are looked at anyway."""
    buf, offs = text_buffer(pa.array(texts, pa.large_string()))
    found = np.zeros(len(texts), bool)
    step = 4 << 20
    for a in range(0, len(buf), step):
        part = buf[a : a + step + CANDIDATE_CHARS - 1]
        gaps = np.flatnonzero(~_RUN[part])
        edge = np.concatenate([[-1], gaps, [len(part)]])
        long = edge[:-1][np.diff(edge) > CANDIDATE_CHARS] + 1 + a
        long_end = edge[1:][np.diff(edge) > CANDIDATE_CHARS] + a
        first = np.searchsorted(offs, long, "right") - 1
        found[first] = True  # a run over a row's end only asks for a closer look
        last = np.searchsorted(offs, long_end - 1, "right") - 1
        for s, e in zip(first[first != last], last[first != last]):
            found[s : e + 1] = True
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (kind, start, end, base).

    Offsets are code points, the end exclusive; ``base`` tells pattern spans
    from inferred formats. Null and empty texts have none; repeated rows each
    give a row; other columns are ignored; an empty table gives no rows.
    """
    grammar = grammar or default_grammar()
    find = lambda texts: find_spans(texts, grammar)
    return docs.select(F.col(id_col).alias("doc_id"), span_column(find, F.col(text_col).cast("string")).alias("spans"))
