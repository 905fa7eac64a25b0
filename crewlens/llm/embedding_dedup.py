"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors have cosine >= c exactly where their distance is at most
epsilon = sqrt(2 - 2c). Vectors are turned onto the principal axes of the
table, put into grid cells of side epsilon along the leading axes and sorted by
cell (the epsilon grid order). The order is cut into intervals of a bounded
number of vectors. Pairs of intervals are refined top down, from the whole
order to single intervals, and a pair is dropped as soon as the boxes around
its two intervals are more than epsilon apart; each pair left is one task,
which goes on halving and dropping in the same way down to small blocks and
compares those with one matrix product.

A task reports, per vector, how many partners it found, and a spanning forest
of the links; it never lists all pairs of a dense group. Equal vectors take
part once, with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.common import connected_components, dense_index, materialize

MIN_COSINE = 0.9
GRID_AXES = 6
#: Vectors of an interval, at most: a task holds two intervals.
INTERVAL_ROWS = 4096
#: Intervals that one interval of the level above is cut into.
FAN_OUT = 8
#: Vectors of the smallest block, compared without further halving.
BLOCK_ROWS = 256
_SLACK = 1e-9  # boxes are widened by this, far above rounding


#: Cosines this close to the least one are decided on the stored vectors.
_DOUBT = 1e-9


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, its largest component in [0.5, 1): squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def plain_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; scaling by powers of two leaves every digit as it is."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _stack(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _moments(vectors: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(mean of x x^T minus mean mean^T, rows): one short row per input batch and entry is summed."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            x = _unit(_stack(batch.column(0)))
            square += x.T @ x
            total += x.sum(axis=0)
            n += len(x)
        if n:
            values = np.concatenate([square.ravel(), total, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "v"])

    rows = vectors.select("vec").mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return np.zeros((size, size)), 0
    values = np.zeros(size * size + size + 1)
    for r in rows:
        values[r["at"]] = r["v"]
    n = values[-1]
    mean = values[size * size : -1] / n
    return values[: size * size].reshape(size, size) / n - np.outer(mean, mean), int(n)


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least distance between boxes (last axis: dimensions)."""
    apart = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return np.sqrt((apart * apart).sum(axis=-1))


def join_intervals(
    x: np.ndarray, y: np.ndarray | None, min_cosine: float, block_rows: int = BLOCK_ROWS
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of links between two intervals of unit vectors on principal axes (``y`` None: within ``x``).

    Yields (row of x, row of y, links, doubtful pairs), the last two as boolean
    matrices. Halves both intervals in turn and drops halves whose boxes are
    more than epsilon apart. Turning costs a few last digits: pairs within
    ``_DOUBT`` of ``min_cosine`` are no links yet.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * (min_cosine - _DOUBT))) + _SLACK
    same = y is None
    other = x if same else y
    todo = [(0, len(x), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        p, q = x[a:b], other[c:d]
        if not len(p) or not len(q) or _gap(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)) > epsilon:
            continue
        if b - a > block_rows or d - c > block_rows:
            m, n = (a + b) // 2, (c + d) // 2
            todo += [(a, m, c, n), (a, m, n, d), (m, b, c, n), (m, b, n, d)]
            continue
        cosine = p @ q.T
        if same and a == c:
            cosine = np.where(np.triu(np.ones(cosine.shape, bool), 1), cosine, -2.0)
        near = cosine >= min_cosine + _DOUBT
        doubt = (cosine > min_cosine - _DOUBT) & ~near
        if near.any() or doubt.any():
            yield a, c, near, doubt


class _Forest:
    """Union-find over rows: keeps the links that join two trees."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def links(self, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
        return [(i, j) for i, j in zip(rows.tolist(), cols.tolist()) if self.join(i, j)]


def _pairs_of_intervals(boxes: DataFrame, count: int, axes: int, epsilon: float) -> DataFrame:
    """(``a``, ``b``), a <= b: intervals whose boxes come within ``epsilon``, found level by level."""
    levels = max(1, math.ceil(math.log(max(count, 2), FAN_OUT)))
    spark = boxes.sparkSession
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    apart = [F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0)) for i in range(axes)]
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col("interval") / FAN_OUT**level).cast("long")
        here = boxes.groupBy(node.alias("node")).agg(
            *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(axes)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(axes)]
        )
        step = F.sequence(F.lit(0), F.lit(FAN_OUT - 1))
        wider = pairs.select(F.explode(F.transform(step, lambda k: F.col("a") * FAN_OUT + k)).alias("a"), "b")
        wider = wider.select("a", F.explode(F.transform(step, lambda k: F.col("b") * FAN_OUT + k)).alias("b")).where("a <= b")
        left = here.select(F.col("node").alias("a"), *[F.col(f"{s}{i}").alias(f"a_{s}{i}") for s in ("lo", "hi") for i in range(axes)])
        right = here.select(F.col("node").alias("b"), *[F.col(f"{s}{i}").alias(f"b_{s}{i}") for s in ("lo", "hi") for i in range(axes)])
        near = wider.join(left, "a").join(right, "b")
        pairs = materialize(near.where(sum(x * x for x in apart) <= epsilon * epsilon).select("a", "b"), "interval-pairs")
    return pairs


def near_duplicates(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    grid_axes: int = GRID_AXES,
    interval_rows: int = INTERVAL_ROWS,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other vectors at cosine >= ``min_cosine`` (double
    precision), equal ones included; ``component_id`` is the smallest id
    reachable over links; ``kept`` marks the row whose id that is. Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different length never link with each other.
    Repeated rows count as separate vectors. A null id gives a row; it is a
    component's id only if all its rows have none. Other columns are ignored;
    an empty table gives no rows.
    """
    vec = F.col(vector_col)
    element = embeddings.schema[vector_col].dataType.elementType
    wide = T.DoubleType() if not isinstance(element, (T.FloatType, T.DoubleType)) else element
    rows = embeddings.select(F.col(id_col).alias("vec_id"), vec.cast(T.ArrayType(wide)).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vec", F.when(usable, F.col("vec")))
    # equal vectors take part once; -0.0 equals 0.0
    rows = rows.withColumn("vec", F.transform("vec", lambda v: F.when(v == 0, F.lit(0).cast(wide)).otherwise(v)))
    rows = rows.withColumn("_hash", F.xxhash64("vec"))
    groups = rows.where(F.col("vec").isNotNull()).groupBy("_hash", "vec").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    sizes = [r["n"] for r in groups.select(F.size("vec").alias("n")).distinct().collect()]
    found = None
    for size in sizes:  # usually one
        part = groups.where(F.size("vec") == size)
        links = _join_one_size(part, size, min_cosine, grid_axes, interval_rows)
        found = links if found is None else found.union(links)
    alone = rows.where(F.col("vec").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if found is None:
        return alone
    # partners come as (node, links); forest links as (node, other)
    found = materialize(found, "vector-links")
    partners = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    forest = found.where(F.col("other").isNotNull()).select(F.col("node").alias("src"), F.col("other").alias("dst"))
    parts = connected_components(forest).select(F.col("id").alias("node"), "component")
    state = groups.drop("vec").join(partners, "node", "left").join(parts, "node", "left").select(
        "node", "_hash", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root")
    )
    state = materialize(state, "vector-groups")
    named = state.groupBy("root").agg(F.min("least").alias("component_id"))
    state = state.join(named, "root").select(
        "node", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"
    )
    # back to the rows over the vector itself, one line per distinct vector on one side
    lookup = groups.select("_hash", F.col("vec").alias("_vec"), "node").join(state, "node")
    rows = rows.where(F.col("vec").isNotNull())
    back = rows.join(lookup, (rows["_hash"] == lookup["_hash"]) & (rows["vec"] == lookup["_vec"]))
    linked = back.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.union(alone)


def _join_one_size(groups: DataFrame, size: int, min_cosine: float, grid_axes: int, interval_rows: int) -> DataFrame:
    """(``node``, ``links``, ``other``): partner counts (``other`` null) and forest links of one vector length."""
    covariance, n = _moments(groups, size)
    axes = np.ascontiguousarray(np.linalg.eigh(covariance)[1][:, ::-1])  # principal axes, widest first
    lead = min(grid_axes, size)
    epsilon = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    count = max(1, math.ceil(n / interval_rows))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_stack(batch.column(1))) @ axes
            cells = np.floor(x[:, :lead] / max(epsilon, 1e-6)).astype(np.int64) + (1 << 24)
            first = [pa.array(cells[:, i]) for i in range(lead)]
            raw = np.ascontiguousarray(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.StructArray.from_arrays(first, names=[f"c{i}" for i in range(lead)]),
                    pa.array([r.tobytes() for r in raw], pa.binary()), batch.column(2),
                    *[pa.array(x[:, i]) for i in range(lead)],
                ],
                names=["node", "cell", "x", "copies", *[f"p{i}" for i in range(lead)]],
            )

    cell_type = ", ".join(f"c{i}: long" for i in range(lead))
    points = groups.select("node", "vec", "copies").mapInArrow(
        turn, f"node long, cell struct<{cell_type}>, x binary, copies long, " + ", ".join(f"p{i} double" for i in range(lead))
    )
    placed = points.withColumn("_all", F.lit(0))
    placed = dense_index(placed, "_all", ["cell", "p0", "node"], "place", "grid-order")
    placed = materialize(placed.withColumn("interval", F.floor(F.col("place") * count / n).cast("long")), "intervals")
    boxes = placed.groupBy("interval").agg(
        *[F.min(f"p{i}").alias(f"lo{i}") for i in range(lead)], *[F.max(f"p{i}").alias(f"hi{i}") for i in range(lead)]
    )
    pairs = _pairs_of_intervals(materialize(boxes, "interval-boxes"), count, lead, math.sqrt(max(0.0, 2 - 2 * (min_cosine - _DOUBT))) + _SLACK)

    # each pair of intervals is one group of at most 2 * interval_rows vectors
    sides = pairs.select("a", "b", F.col("a").alias("interval"), F.lit(0).alias("side")).union(
        pairs.where("a < b").select("a", "b", F.col("b").alias("interval"), F.lit(1).alias("side"))
    )
    dealt = sides.join(placed.select("interval", "node", "x", "copies", "place"), "interval")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        halves = [pdf[pdf["side"] == s] for s in (0, 1)]
        x, y = (np.frombuffer(b"".join(h["x"]), np.float64).reshape(len(h), size) for h in halves)
        within = not len(y)
        node = pdf["node"].to_numpy() if within else np.concatenate([h["node"].to_numpy() for h in halves])
        copies = pdf["copies"].to_numpy() if within else np.concatenate([h["copies"].to_numpy() for h in halves])
        shift = 0 if within else len(x)
        links, forest, edges, open_pairs = np.zeros(len(node), np.int64), _Forest(len(node)), [], []
        for a, c, near, doubt in join_intervals(x, None if within else y, min_cosine):
            rows = slice(a, a + near.shape[0])
            cols = slice(c + shift, c + shift + near.shape[1])
            links[rows] += near @ copies[cols]
            links[cols] += near.T @ copies[rows]
            i, j = np.nonzero(near)
            edges += forest.links(i + a, j + c + shift)
            open_pairs += [(u + a, v + c + shift) for u, v in np.argwhere(doubt).tolist()]
        has = np.flatnonzero(links)
        src, dst = (np.array([e[i] for e in edges + open_pairs], np.int64) for i in (0, 1))
        return pd.DataFrame({
            "node": np.concatenate([node[has], node[src]]),
            "links": np.concatenate([links[has], np.zeros(len(src), np.int64)]),
            "other": pd.array([None] * len(has) + node[dst].tolist(), dtype="Int64"),
            "doubt": np.arange(len(has) + len(src)) >= len(has) + len(edges),
        })

    found = dealt.groupBy("a", "b").applyInPandas(compare, "node long, links long, other long, doubt boolean")
    found = materialize(found, "vector-links")
    return found.where("NOT doubt").drop("doubt").unionByName(_decided(found.where("doubt"), groups, min_cosine))


def _decided(doubtful: DataFrame, groups: DataFrame, min_cosine: float) -> DataFrame:
    """The doubtful pairs that are links by the plain cosine of the stored vectors, as counts and forest links."""
    pairs = doubtful.select("node", "other")
    for side in ("node", "other"):
        held = groups.select(F.col("node").alias(side), F.col("vec").alias(f"{side}_vec"), F.col("copies").alias(f"{side}_copies"))
        pairs = pairs.join(held, side)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = plain_cosines(_stack(batch.column(2)), _stack(batch.column(3))) >= min_cosine
            a, b, n, m = (batch.column(i).to_numpy()[near] for i in (0, 1, 4, 5))
            none = [None] * len(a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, b, a])), pa.array(np.concatenate([m, n, np.zeros(len(a), np.int64)])),
                    pa.array([*none, *none, *b.tolist()], pa.int64()),
                ],
                names=["node", "links", "other"],
            )

    columns = ["node", "other", "node_vec", "other_vec", "node_copies", "other_copies"]
    return pairs.select(*columns).mapInArrow(decide, "node long, links long, other long")
