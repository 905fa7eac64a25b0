"""Shards of near-equal bytes by a k-d tree over document metadata.

A node is split at the weighted median (for an odd number of leaves, the
matching quantile) of its widest metadata dimension, until each leaf holds the
target bytes. All nodes of a level are searched at once: a pass adds up bytes
per node and slice of the current interval, picks the slice in which the
quantile falls and goes on inside it, so only slice totals are shuffled and
the rows stay where they are. Dimensions are ordered by (value, hash of the
row): a value that a third of all rows share is cut like any other.

Only built-in functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.llm.common import dense_index, materialize

SHARDS = 24
SLICES = 2048
#: A cut may stand this share of a shard's bytes off its place.
CLOSE = 0.0005
_VALUE_TOP = (1 << 30) - 1
_TIE_BITS = 32


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def document_dimensions(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """Metadata coordinates of documents: place in the collection, size, source and language."""
    number = F.xxhash64(id_col) if dict(docs.dtypes)[id_col] in ("string", "binary") else F.col(id_col)
    dims = {"order": number.cast("double"), "size": F.log2(text_size(F.col(text_col).cast("string")).cast("double"))}
    for name in ("source", "lang"):
        if name in docs.columns:
            dims[name] = F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")).cast("double")
    return dims


@dataclass
class _Node:
    leaves: int
    dim: str = ""
    cut: int = 0  # rows whose key on ``dim`` is below go left
    left: _Node | None = None
    right: _Node | None = None
    number: int = -1  # among the level's open nodes while growing, then the shard


@dataclass
class _Search:
    node: _Node
    dim: str
    low: int
    high: int  # the cut lies in low .. high
    below: int  # bytes under ``low``
    goal: float
    close: float  # bytes that need not be cut further


def _number_of(node: _Node, keys: dict[str, Column]) -> Column:
    """The number of the leaf (of the tree as it stands) that a row falls in."""
    if node.left is None:
        return F.lit(node.number)
    return F.when(keys[node.dim] < F.lit(node.cut), _number_of(node.left, keys)).otherwise(_number_of(node.right, keys))


def _grow(rows: DataFrame, dims: list[str], keys: dict[str, Column], leaves: int, slices: int) -> _Node:
    """The tree, level by level. The driver sees one row per open node and pass."""
    root = _Node(leaves, number=0)
    level = [root]
    while any(n.leaves > 1 for n in level):
        for i, node in enumerate(level):
            node.number = i
        placed = rows.withColumn("_node", _number_of(root, keys))
        extent = [F.min(f"_v_{d}").alias(f"lo_{d}") for d in dims] + [F.max(f"_v_{d}").alias(f"hi_{d}") for d in dims]
        stats = placed.groupBy("_node").agg(F.sum("size").alias("bytes"), *extent).collect()
        searches = []
        for r in stats:
            node = level[r["_node"]]
            if node.leaves > 1:
                dim = max(dims, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"])
                goal = r["bytes"] * (node.leaves // 2) / node.leaves
                searches.append(_Search(node, dim, r[f"lo_{dim}"] << _TIE_BITS, (r[f"hi_{dim}"] + 1) << _TIE_BITS, 0, goal, CLOSE * r["bytes"] / node.leaves))
        open_ = list(searches)
        while open_:
            open_ = _narrow(placed, open_, keys, slices)
        for s in searches:
            s.node.dim, s.node.cut = s.dim, s.low
        following = []
        for node in level:
            if node.leaves == 1:
                following.append(node)
                continue
            half = node.leaves // 2
            if not node.dim:  # no rows: any cut will do
                node.dim = dims[0]
            node.left, node.right = _Node(half), _Node(node.leaves - half)
            following += [node.left, node.right]
        level = following
    for i, node in enumerate(level):
        node.number = i
    return root


def _narrow(placed: DataFrame, searches: list[_Search], keys: dict[str, Column], slices: int) -> list[_Search]:
    """One pass over the rows: each search goes on in the slice where its goal is reached."""
    names = list(keys)
    width = [max(1, -((s.low - s.high) // slices)) for s in searches]
    lines = ", ".join(
        f"({s.node.number}, {names.index(s.dim)}, {s.low}L, {s.high}L, {w}L, {float(s.goal - s.below)!r}D)"
        for s, w in zip(searches, width)
    )
    wanted = placed.sparkSession.sql(f"SELECT * FROM VALUES {lines} AS t(_node, _dim, _low, _high, _wide, _goal)")
    inside = placed.join(F.broadcast(wanted), "_node")  # one row per open node, fewer than the shards
    key = F.lit(None).cast("long")
    for i, name in enumerate(names):
        key = F.when(F.col("_dim") == i, keys[name]).otherwise(key)
    inside = inside.withColumn("_key", key).where((F.col("_key") >= F.col("_low")) & (F.col("_key") < F.col("_high")))
    slice_no = F.expr("(_key - _low) div _wide")  # whole division: the keys take 62 bits
    totals = inside.groupBy("_node", "_goal", slice_no.alias("_slice")).agg(
        F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
    )
    upto = Window.partitionBy("_node").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = totals.withColumn("_upto", F.sum("_bytes").over(upto)).where(F.col("_upto") >= F.col("_goal"))
    first = summed.groupBy("_node").agg(F.min_by(F.struct("_slice", "_bytes", "_rows", "_upto"), "_slice").alias("f")).collect()
    hit = {r["_node"]: r["f"] for r in first}
    going = []
    for s, step in zip(searches, width):
        f = hit.get(s.node.number)
        if f is None:  # nothing inside reaches the goal (rounding): all of it goes left
            s.low = s.high
            continue
        under = s.below + f["_upto"] - f["_bytes"]
        low, high = s.low + f["_slice"] * step, min(s.high, s.low + (f["_slice"] + 1) * step)
        if step == 1 or f["_rows"] == 1 or f["_bytes"] <= s.close:  # to the side that leaves the smaller error
            s.low = high if under + f["_bytes"] - s.goal <= s.goal - under else low
        else:
            s.low, s.high, s.below = low, high, under
            going.append(s)
    return going


def kd_shards(
    docs: DataFrame,
    shards: int | None = SHARDS,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: dict[str, Column] | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``shards`` leaves, or as many as ``target_bytes`` asks for. Shard sizes are
    equal up to the documents that stand at the cuts. ``slot`` counts 0, 1, 2 ...
    within a shard in order of id. Null ids and null metadata stand lowest; a
    null text has the crc of an empty one; repeated rows are placed
    one by one; a table with fewer rows than shards leaves some empty; an empty
    table gives no rows.
    """
    dims = dimensions or document_dimensions(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [f"d{i}" for i in range(len(dims))]
    meta = docs.select(
        F.col(id_col).alias("doc_id"), text_size(F.col(text_col).cast("string")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.when(~F.isnan(c), c).alias(n) for n, c in zip(names, dims.values())],
    )
    # equal rows get keys of their own; the number is fixed by writing it
    tie = F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    meta = materialize(meta.withColumn("_tie", tie), "shard-metadata")
    got = meta.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        *[x for n in names for x in (F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"))],
    ).first()
    leaves = shards if target_bytes is None else max(1, math.ceil(got["bytes"] / target_bytes))
    scaled = []
    for n in names:
        low, high = got[f"lo_{n}"], got[f"hi_{n}"]
        if low is None or high == low:
            scaled.append(F.lit(0).cast("long").alias(f"_v_{n}"))
        else:
            part = (F.col(n) - F.lit(low)) / F.lit(high - low) * F.lit(float(_VALUE_TOP))
            scaled.append(F.coalesce(F.floor(part).cast("long"), F.lit(0)).alias(f"_v_{n}"))
    rows = meta.select("doc_id", "size", "text_crc32", "_tie", *scaled)
    keys = {n: F.shiftleft(F.col(f"_v_{n}"), _TIE_BITS).bitwiseOR(F.col("_tie")) for n in names}
    tree = _grow(rows, names, keys, leaves, slices)
    placed = rows.select("doc_id", "size", "text_crc32", "_tie", _number_of(tree, keys).cast("int").alias("shard"))
    return dense_index(placed, "shard", ["doc_id", "_tie"], "slot", "shards").drop("_tie")
