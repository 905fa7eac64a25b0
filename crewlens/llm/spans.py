"""Character spans found in texts: Arrow form, digests, masking."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind, start, end (code points, end exclusive) and whether a fixed pattern found it
SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
])

Span = tuple[str, int, int, bool]


def span_column(find: Callable[[Sequence[str]], list[list[Span]]], text: Column) -> Column:
    """Apply ``find`` (texts -> spans of each) to a string column; null texts are empty."""

    @F.arrow_udf(T.ArrayType(SPAN))
    def run(texts: pa.Array) -> pa.Array:
        found = find(texts.fill_null("").to_pylist())
        edges = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        flat = [s for f in found for s in f]
        kind, start, end, base = zip(*flat) if flat else ((), (), (), ())
        values = pa.StructArray.from_arrays(
            [pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(base, pa.bool_())],
            names=["kind", "start", "end", "base"],
        )
        return pa.ListArray.from_arrays(pa.array(edges), values)

    return run(text)


class Taken:
    """Which places of a text spans hold already: a query looks up one bound, however many spans there are."""

    def __init__(self, spans: Sequence[Span]):
        order = sorted((a, z) for _, a, z, _ in spans)
        self.starts, self.ends, top = [a for a, _ in order], [], 0
        for _, z in order:
            top = max(top, z)
            self.ends.append(top)

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def mask_spans(text: str, spans: Sequence[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
