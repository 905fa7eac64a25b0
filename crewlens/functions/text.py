"""Text functions as native column expressions.

Spark has no Unicode normaliser, so accent folding is a ``translate`` whose
map is *derived* on first use from Python's Unicode database: every code point
with a decomposition is decomposed (NFD or NFKD) and its ASCII remainder
becomes the replacement. Whatever is still non-ASCII after the
map is dropped, which also removes combining marks of already-decomposed
input. Everything runs inside whole-stage codegen; no Python UDF.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``re`` ``\s`` sees it on ASCII text (includes the
# file/group/record/unit separators), written as a Java/RE2 class.
WS_CLASS = "[\\x09-\\x0D\\x20\\x1C-\\x1F]"
# Every character Python's ``str.isspace`` accepts (``strip()`` / ``split()``
# without arguments); the ``\\x{..}`` form reads the same in Java and RE2.
PY_SPACE = (
    "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)


@lru_cache(maxsize=2)
def fold_maps(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from_chars, to_chars, multi) for ``translate`` plus multi-letter expansions.

    A character whose decomposition keeps exactly one ASCII character maps to
    it; one that keeps several (e.g. a ligature under NFKD) is expanded by a
    map lookup; one that keeps none is left to the final non-ASCII strip.
    """
    src, dst, multi = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        # only characters with a decomposition of their own can leave ASCII behind
        if not unicodedata.decomposition(ch):
            continue
        kept = unicodedata.normalize(form, ch).encode("ascii", "ignore").decode("ascii")
        if len(kept) == 1:
            src.append(ch)
            dst.append(kept)
        elif len(kept) > 1:
            multi.append((ch, kept))
    return "".join(src), "".join(dst), tuple(multi)


def fold_ascii(col, form: str = "NFKD") -> Column:
    """X1/X2 core: decompose + drop non-ASCII. Null stays null.

    ``form='NFKD'`` is the cleaning job's folder (compatibility characters such
    as ``º`` become ``o``); ``form='NFD'`` is the change-feed normaliser.
    """
    c = F.col(col) if isinstance(col, str) else col
    src, dst, multi = fold_maps(form)
    if multi:
        # multi-letter expansions (ligatures, fractions, roman numerals...):
        # per-character map lookup, only for strings that contain one
        # one literal, which the optimizer turns into a constant map
        expand = F.str_to_map(F.lit("\x02".join(f"{ch}\x03{kept}" for ch, kept in multi)), F.lit("\x02"), F.lit("\x03"))
        chars = F.regexp_extract_all(c, F.lit("(?s)."), 0)  # whole code points
        expanded = F.array_join(F.transform(chars, lambda ch: F.coalesce(F.try_element_at(expand, ch), ch)), "")
        c = F.when(c.rlike("[" + "".join(ch for ch, _ in multi) + "]"), expanded).otherwise(c)
    c = F.translate(c, src, dst)
    return F.regexp_replace(c, "[^\\x00-\\x7F]", "")


def collapse_ws(col) -> Column:
    """Collapse whitespace runs to one space and trim."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, WS_CLASS + "+", " "))


def normalize_text(col) -> Column:
    """NFD fold to ASCII, collapse whitespace, trim."""
    return collapse_ws(fold_ascii(col, "NFD"))


def strip_py(col) -> Column:
    """Python ``str.strip()``: every Unicode whitespace character at both ends."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "^" + PY_SPACE + "+|" + PY_SPACE + "+$", "")


def title_case(col) -> Column:
    """Python ``str.title()``: a word starts after any non-letter.

    ``initcap`` only splits on spaces ("Médio-baixo"); here the text is cut
    into letter runs and non-letter runs and each run is capitalised.
    Known difference: a word-*initial* character with a special titlecase
    mapping (``ß``, ligatures such as ``ﬁ``) is upper-cased ("SS", "FI")
    where Python writes "Ss", "Fi".
    """
    c = F.col(col) if isinstance(col, str) else col
    runs = F.regexp_extract_all(c, F.lit("(\\p{L}+|[^\\p{L}]+)"), 1)
    capped = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.when(c.isNotNull(), F.array_join(capped, ""))


def band_label(col) -> Column:
    """Strip -> title -> NFKD fold -> spaces to hyphens ("médio baixo " -> "Medio-Baixo")."""
    return F.replace(fold_ascii(title_case(strip_py(col)), "NFKD"), F.lit(" "), F.lit("-"))


def full_name(first, last) -> Column:
    """title(strip(first) + ' ' + strip(last)); null when either part is null."""
    f = F.col(first) if isinstance(first, str) else first
    s = F.col(last) if isinstance(last, str) else last
    return title_case(F.concat(strip_py(f), F.lit(" "), strip_py(s)))


def split_first(col) -> tuple[Column, Column]:
    """Split once on whitespace -> (first word, rest or null)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, WS_CLASS + "+", 2)
    return F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


def first_word_level(col) -> Column:
    """First word of the title, upper-cased and normalised (job level)."""
    c = F.col(col) if isinstance(col, str) else col
    words = F.split(strip_py(c), PY_SPACE + "+")
    return normalize_text(F.upper(F.element_at(words, 1)))


def strip_prefix(col, prefix: str) -> Column:
    """The text without ``prefix`` at its start (unchanged when it has none)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)
