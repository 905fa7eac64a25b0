from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"

EDGE_TEXTS = [
    None, "", " \n\t ", "one", "Two words", "x" * 30, "ÀÉ ñ ß — “quoted” 漢字 😀", "tab\tand\x0bvt a\x0cb", "it's  we'll  'S",
    "<|endoftext|> <|startoftext|>", "!!! ??? ...", "a" * 5000, "The same text here twice over", "The same text here twice over",
    "the SAME text here twice over", " nbsp   em", "Mixed123abc 45.67 x_y-z", "end",
]


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, and columns whose names operators use inside)."""
    rows = [(1000 + i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", len(t or ""), i, "x") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(None, "no id at all", "en", "s", 12, 1, "y"), (1001, "an id that another row has", "fr", "s", 3, 1, "z")]
    rows += [(2000, "long " + " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000)), "de", "s", 1, 1, "w")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _part int, fp string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    """All rows as sorted tuples."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda r: tuple((x is None, x) for x in r))
