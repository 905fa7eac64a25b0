"""Many K-Means fits over one scan: every (k, start) model in every Lloyd pass.

A pass assigns each row to the nearest centre of every open model and adds up
all new centres in one aggregate, so the number of jobs is the number of passes
of the slowest model, not the sum over models. Distances are one matrix product
per Arrow batch; tasks send one partial sum per (model, centre), merged by a
vector aggregate. Starts are fixed by a digest of the row key, so a fit has the
same result on any cluster and in any other engine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stop when the centres of a model move by less than this share of the mean variance (squared, summed).
TOLERANCE = 1e-4
MAX_PASSES = 300


@dataclass
class Fit:
    """One finished model."""

    k: int
    start: int
    centres: np.ndarray
    sizes: np.ndarray
    inertia: float


def first_centres(rows: DataFrame, key: str, values: str, ks: Sequence[int], starts: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """The first k rows by md5("key:start"), ties by key, for every k and start.

    The window keeps max(ks) rows of a start in every task before it shuffles.
    """
    tries = rows.select(key, values, F.explode(F.array(*[F.lit(s) for s in starts])).alias("_start"))
    order = Window.partitionBy("_start").orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("_start").cast("string"))), key)
    top = tries.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= max(ks)).select("_start", "_nth", values).collect()
    found = {s: [r[values] for r in sorted((r for r in top if r["_start"] == s), key=lambda r: r["_nth"])] for s in starts}
    return {(k, s): np.array(found[s][:k], float) for k in ks for s in starts if len(found[s]) >= k}


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every row to every centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1), 0.0)


def nearest(dist: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """For each model (columns edges[m]:edges[m + 1]) the nearest centre of every row, the first of equals."""
    return [dist[:, a:z].argmin(1) for a, z in zip(edges, edges[1:])]


def _sums(rows: DataFrame, values: str, models: dict[tuple[int, int], np.ndarray]) -> dict[int, tuple[int, np.ndarray, float, float]]:
    """One pass: for every centre (numbered over all models) its rows, their sum, squared norms and squared distances."""
    centres = np.concatenate(list(models.values()))
    edges = np.cumsum([0] + [len(c) for c in models.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), centres.shape[1] + 3))
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            dist = distances(x, centres)
            norms = (x * x).sum(1)
            for a, own in zip(edges, nearest(dist, edges)):
                hot = np.zeros((len(x), own.max() + 1))
                hot[np.arange(len(x)), own] = 1.0
                part = np.column_stack([np.ones(len(x)), norms, dist[np.arange(len(x)), a + own], x])
                total[a : a + hot.shape[1]] += hot.T @ part
        used = np.flatnonzero(total[:, 0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["centre", "sums"])

    sent = rows.select(values).mapInArrow(run, "centre int, sums array<double>")
    both = Summarizer.metrics("mean", "count").summary(array_to_vector("sums"))
    merged = sent.groupBy("centre").agg(both.alias("s")).select("centre", vector_to_array("s.mean").alias("m"), F.col("s.count").alias("n"))
    out = {}
    for r in merged.collect():  # one row per centre
        s = np.array(r["m"]) * r["n"]
        out[r["centre"]] = (round(s[0]), s[3:], s[1], s[2])
    return out


def fit_many(rows: DataFrame, key: str, values: str, ks: Sequence[int], starts: Sequence[int], tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> list[Fit]:
    """All (k, start) models of the z-scored arrays in ``values``, fitted side by side.

    Every array has the same length and no nulls; a k above the number of rows
    has no model. A centre that loses all its rows stays where it is. Rows at
    equal distance go to the centre that comes first. Only centres reach the
    driver: ks x starts x length numbers.
    """
    open_models = first_centres(rows, key, values, ks, starts)
    done: dict[tuple[int, int], np.ndarray] = {}
    for _ in range(max_passes):
        if not open_models:
            break
        sums, at = _sums(rows, values, open_models), 0
        moved = {}
        for name, old in open_models.items():
            new = np.array([sums[at + i][1] / sums[at + i][0] if at + i in sums else c for i, c in enumerate(old)])
            at += len(old)
            (done if ((new - old) ** 2).sum() <= tolerance else moved)[name] = new
        open_models = moved
    done.update(open_models)
    if not done:
        return []
    models = {name: done[name] for name in sorted(done)}
    sums, at, fits = _sums(rows, values, models), 0, []
    for (k, start), centres in models.items():
        own = [sums.get(at + i) for i in range(k)]
        fits.append(Fit(k, start, centres, np.array([o[0] if o else 0 for o in own]), float(sum(o[3] for o in own if o))))
        at += k
    return fits


def best_of(fits: Sequence[Fit]) -> dict[int, Fit]:
    """The fit with the least inertia of each k, ties by start."""
    best: dict[int, Fit] = {}
    for f in sorted(fits, key=lambda f: (f.k, f.inertia, f.start)):
        best.setdefault(f.k, f)
    return best


def silhouettes(rows: DataFrame, values: str, fits: Sequence[Fit]) -> dict[int, float]:
    """Mean silhouette (squared Euclidean, linear time) of each fit by its k, all fits in two passes.

    The mean squared distance of a row to a cluster follows from the cluster's
    count, sum and sum of squared norms. A row alone in its cluster counts 0.
    """
    if not fits:
        return {}
    models = {(f.k, f.start): f.centres for f in fits}
    sums = _sums(rows, values, models)
    centres = np.concatenate(list(models.values()))
    edges = np.cumsum([0] + [len(c) for c in models.values()])
    count = np.array([sums[i][0] if i in sums else 0 for i in range(len(centres))], float)
    total = np.array([sums[i][1] if i in sums else np.zeros(centres.shape[1]) for i in range(len(centres))])
    square = np.array([sums[i][2] if i in sums else 0.0 for i in range(len(centres))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(edges) - 1), 0
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            n += len(x)
            norms, all_own, cross = (x * x).sum(1), nearest(distances(x, centres), edges), x @ total.T
            for m, (a, z) in enumerate(zip(edges, edges[1:])):
                own, i = all_own[m], np.arange(len(x))
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = norms[:, None] + (square[a:z] - 2.0 * cross[:, a:z]) / count[a:z]
                    inner = mean[i, own] * count[a:z][own] / (count[a:z][own] - 1)
                    mean[i, own] = np.inf
                    mean[:, count[a:z] == 0] = np.inf
                    other = mean.min(1)
                    s = np.where(count[a:z][own] > 1, (other - inner) / np.maximum(other, inner), 0.0)
                found[m] += np.nan_to_num(s).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), pa.array(found), pa.array(np.full(len(found), n), pa.int64())], names=["m", "s", "n"])

    got = rows.select(values).mapInArrow(run, "m int, s double, n long").groupBy("m").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return {fits[r["m"]].k: r["s"] / r["n"] for r in got if r["n"]}


def assigned(rows: DataFrame, key: str, values: str, fit: Fit, out: str = "cluster") -> DataFrame:
    """``key`` and the 1-based cluster, numbered by size, then by the centre's coordinates, largest first."""
    order = sorted(range(fit.k), key=lambda i: (-fit.sizes[i], *(-fit.centres[i]).tolist()))
    number = np.empty(fit.k, np.int32)
    number[order] = np.arange(1, fit.k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            own = number[distances(x, fit.centres).argmin(1)] if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32())], names=[key, out])

    return rows.select(key, values).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out} int")
