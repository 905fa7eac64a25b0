"""Hard negatives by exact inner-product search over lists that anchors share.

Anchors are clustered by direction. A cluster's centre and angular radius bound
the inner product of any row with any member: norm x cos(angle to the centre -
radius). Rows are sorted by that bound once per cluster, and every member walks
the list until the bound falls under what it still needs, which certifies that
no later row counts (the MAXIMUS scheme). Rows stay where they are read; the
anchors come to them in broadcast blocks of bounded size. Scores are exact
integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlens.llm.common import materialize, scratch_path

#: anchors of one broadcast block
ANCHOR_BLOCK = 16_384
#: rows that a task holds at a time, and rows between two looks at the bounds
CHUNK_ROWS, STEP_ROWS = 16_384, 512
#: rows of the sample whose scores give walks their first thresholds (no effect on results)
SEED_ROWS = 4_096

_NONE = -(2**63) + 1  # below every score
_EXACT = 2.0**52  # products of norms under this are exact in doubles


@dataclass
class Anchors:
    """Anchors of one vector length, sorted by cluster."""

    number: np.ndarray  # in the block
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    edges: np.ndarray  # cluster c holds edges[c]:edges[c + 1]
    centres: np.ndarray
    radii: np.ndarray


def quantised(ids: pa.Array, labels: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, floor(scale * x) as doubles) of the usable rows, one triple for each vector length."""
    if isinstance(vectors, pa.ChunkedArray):
        ids, labels, vectors = ids.combine_chunks(), labels.combine_chunks(), vectors.combine_chunks()
    edges = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # nulls are NaN here
    lengths = np.diff(edges)
    fit = (bad[edges[1:]] == bad[edges[:-1]]) & ~np.asarray(vectors.is_null())
    fit &= ~np.asarray(ids.is_null()) & ~np.asarray(labels.is_null())
    all_ids, all_labels = ids.fill_null(0).to_numpy(), labels.fill_null(0).to_numpy()
    for d in np.unique(lengths[fit]).tolist():
        at = np.flatnonzero(fit & (lengths == d))
        yield all_ids[at], all_labels[at], flat[edges[at][:, None] + np.arange(d)]


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


def _angles(m: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.arccos(np.clip((m / norms[:, None]) @ centre, -1.0, 1.0))


def cluster(number: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rounds: int = 8) -> Anchors:
    """About sqrt(n) clusters by direction; zero and very large vectors form one with a radius of half a turn."""
    norms = _norms(vectors)
    plain = np.isfinite(norms) & (norms > 0)
    unit = np.where(plain[:, None], vectors / np.where(plain, norms, 1.0)[:, None], 0.0)
    k = max(1, round(math.sqrt(plain.sum())))
    rows = np.flatnonzero(plain)
    centres = unit[rows[np.linspace(0, len(rows) - 1, k).astype(int)]] if len(rows) else np.zeros((1, vectors.shape[1]))
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own[plain], unit[plain])
        size = _norms(sums)
        centres = np.where((size > 0)[:, None], sums / np.where(size > 0, size, 1.0)[:, None], centres)
    own = np.where(plain, (unit @ centres.T).argmax(1), len(centres))
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(centres) + 2))
    centres = np.concatenate([centres, np.zeros((1, vectors.shape[1]))])
    radii = np.full(len(centres), math.pi)
    for c in range(len(centres) - 1):
        at = order[edges[c] : edges[c + 1]]
        radii[c] = _angles(vectors[at], norms[at], centres[c]).max() if len(at) else 0.0
    return Anchors(number[order], ids[order], labels[order], vectors[order], norms[order], edges, centres, radii)


def upper_bounds(rows: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """No unit vector within ``radius`` of ``centre`` has a larger inner product with a row than this."""
    angle = np.maximum(_angles(rows, norms, centre) - radius - 1e-7, 0.0)
    bound = norms * np.cos(angle)
    bound += np.abs(bound) * 1e-9 + 1e-9
    return np.where(np.isfinite(norms) & ~np.isnan(bound), np.where(norms > 0, bound, 0.0), np.inf)


def exact_scores(rows: np.ndarray, row_norms: np.ndarray, anchors: np.ndarray, anchor_norms: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond a long they stand at its limits."""
    if row_norms.max(initial=0) * anchor_norms.max(initial=0) < _EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = whole(rows).astype(object) @ whole(anchors).astype(object).T
    return np.clip(wide, _NONE + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The first ``k`` (score, id) of every slot: higher scores first, ties by smaller id, equal entries once."""

    def __init__(self, slots: int, k: int, start: np.ndarray | None = None):
        self.scores, self.ids = np.full((slots, k), _NONE), np.zeros((slots, k), np.int64)
        self.need = np.full(slots, _NONE) if start is None else start.copy()

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k, touched = self.scores.shape[1], np.unique(slot)
        old_slot, old = np.repeat(touched, k), self.scores[touched].ravel()
        have = old > _NONE
        slot = np.concatenate([slot, old_slot[have]])
        score = np.concatenate([score, old[have]])
        ids = np.concatenate([ids, self.ids[touched].ravel()[have]])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        fresh = np.ones(len(slot), bool)
        fresh[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[fresh], score[fresh], ids[fresh]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = rank < k
        self.scores[touched] = _NONE
        self.scores[slot[top], rank[top]] = score[top]
        self.ids[slot[top], rank[top]] = ids[top]
        self.need[touched] = np.maximum(self.need[touched], self.scores[touched, -1])


class Positives:
    """What anchors look for first: rows of their label under another id."""

    def __init__(self, anchors: Anchors, k: int, start: np.ndarray | None = None):
        self.a, self.best = anchors, Best(len(anchors.ids), k, start)

    def needed(self, members: slice) -> np.ndarray:
        return self.best.need[members].astype(float)

    def see(self, members: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        a = self.a
        hit = (labels[:, None] == a.labels[members]) & (ids[:, None] != a.ids[members]) & (scores >= self.best.need[members])
        r, c = np.nonzero(hit)
        self.best.add(members[c], scores[r, c], ids[r])


class Negatives:
    """Rows of another label that score within a window under each positive."""

    def __init__(self, anchors: Anchors, positive_scores: np.ndarray, k: int, percent: int, start: np.ndarray | None = None):
        self.a, self.high = anchors, positive_scores  # one column per positive, _NONE where there is none
        share = 100 - percent
        low = self.high - (share * (self.high // 100) + share * (self.high % 100) // 100)
        self.open = (self.high > _NONE) & (low <= self.high)
        low = np.where(self.open, low, 2**63 - 1).ravel()
        self.best = Best(low.size, k, low if start is None else np.maximum(low, start))

    def needed(self, members: slice) -> np.ndarray:
        need = np.where(self.open, self.best.need.reshape(self.high.shape).astype(float), np.inf)
        return need[members].min(1, initial=np.inf)

    def see(self, members: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        other, width = labels[:, None] != self.a.labels[members], self.high.shape[1]
        found = []
        for j in range(width):
            slot = members * width + j
            hit = other & self.open[members, j] & (scores <= self.high[members, j]) & (scores >= self.best.need[slot])
            r, c = np.nonzero(hit)
            found.append((slot[c], scores[r, c], ids[r]))
        if found:
            self.best.add(*[np.concatenate(x) for x in zip(*found)])


def walk(anchors: Anchors, search, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> int:
    """One chunk of rows against all anchors; returns how many scores were computed."""
    norms, scored = _norms(rows), 0
    for c in range(len(anchors.centres)):
        members = np.arange(anchors.edges[c], anchors.edges[c + 1])
        if not len(members):
            continue
        bound = upper_bounds(rows, norms, anchors.centres[c], anchors.radii[c])
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), STEP_ROWS):
            with np.errstate(over="ignore", invalid="ignore"):
                reach = anchors.norms[members] * bound[order[at]] + 0.5  # scores are whole numbers
            members = members[~(reach < search.needed(members))]  # the others are done: certified
            if not len(members):
                break
            block = order[at : at + STEP_ROWS]
            scores = exact_scores(rows[block], norms[block], anchors.vectors[members], anchors.norms[members])
            search.see(members, ids[block], labels[block], scores)
            scored += scores.size
    return scored


def _search(rows: DataFrame, block: dict[int, tuple], make, scale: float) -> DataFrame:
    """All rows against one block of anchors, rows in place: (``slot``, ``score``, ``id``) of each task's best."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: (group, make(group, state)) for d, (group, state) in shared.value.items()}
        for table in _chunks(batches):
            for ids, labels, found in quantised(table.column(0), table.column(1), table.column(2), scale):
                if found.shape[1] in searches:
                    walk(*searches[found.shape[1]], ids, labels, found)
        for group, search in searches.values():
            best, width = search.best, len(search.best.scores) // len(group.ids)
            r, c = np.nonzero(best.scores > _NONE)
            slot = group.number[r // width].astype(np.int64) * width + r % width
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(best.scores[r, c]), pa.array(best.ids[r, c])], names=["slot", "score", "id"])

    return rows.mapInArrow(run, "slot long, score long, id long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, have = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            kept.append(batch.slice(at, CHUNK_ROWS))
            have += kept[-1].num_rows
            if have >= CHUNK_ROWS:
                yield pa.Table.from_batches(kept)
                kept, have = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every slot over all tasks, ``rank`` from 1 (a task sends ``k`` at most)."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: float = 256.0,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """For every anchor and each of its first ``positives`` rows of the same label, its hard negatives.

    A component x becomes floor(``scale`` * x); a score is the integer inner
    product with the anchor. Higher scores come first, ties by smaller id.
    Negatives are the first ``negatives`` rows of another label with
    ``percent`` % of the positive's score <= score <= the positive's score.
    Columns: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score``, ``negative_score``; no row where nothing fits.

    Rows with a null id, label or vector, or a component that is null or not
    finite (also once scaled) take no part. Vectors of different lengths are
    not compared; empty ones score 0 with each other. A row is another row if
    its id differs; rows with equal id and score count once, so repeated rows
    change nothing, and an id that anchors share with different vectors is
    mined once for each. Scores beyond a long stand at its limits. Anchors are
    a query set against all rows: they are broadcast in blocks of about
    ``anchor_block``, one pass over the rows each for positives and negatives.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    plain = plain.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    chosen = rows.where(is_anchor).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    chosen = materialize(chosen.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct(), "anchors")
    n_blocks = max(1, math.ceil(chosen.count() / anchor_block))
    thin = max(1, plain.count() // SEED_ROWS)
    seed = plain.where(F.pmod(F.xxhash64("id"), F.lit(thin)) == 0).limit(4 * SEED_ROWS).toArrow()
    seed = list(quantised(seed.column(0), seed.column(1), seed.column(2), scale))
    path = scratch_path(spark, "negatives")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], result).write.parquet(path)
    for b in range(n_blocks):
        block = chosen.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks)) == b).toArrow()
        groups, start = [], 0
        for ids, labels, vectors in quantised(block.column(0), block.column(1), block.column(2), scale):
            groups.append(cluster(np.arange(start, start + len(ids)), ids, labels, vectors))
            start += len(ids)
        if not start:
            continue

        def seeded(make) -> dict[int, tuple]:
            out = {}
            for g in groups:
                search = make(g, None)
                for ids, labels, found in seed:
                    if found.shape[1] == g.vectors.shape[1]:
                        walk(g, search, ids, labels, found)
                out[g.vectors.shape[1]] = (g, search.best.need)
            return out

        make = lambda g, need: Positives(g, positives, need)
        near = _first(_search(plain, seeded(make), make, scale), positives).toArrow()
        slot, rank = near["slot"].to_numpy(), near["rank"].to_numpy() - 1
        scores, partners = np.full((start, positives), _NONE), np.zeros((start, positives), np.int64)
        scores[slot, rank], partners[slot, rank] = near["score"].to_numpy(), near["id"].to_numpy()

        make = lambda g, need: Negatives(g, scores[g.number], negatives, percent, need)
        far = _first(_search(plain, seeded(make), make, scale), negatives)
        ids = np.zeros(start, np.int64)
        for g in groups:
            ids[g.number] = g.ids
        keys = pa.table({
            "slot": np.arange(scores.size), "anchor_id": np.repeat(ids, positives), "positive_id": partners.ravel(), "positive_score": scores.ravel(),
        })
        named = far.join(F.broadcast(spark.createDataFrame(keys)), "slot")  # one block's slots
        named.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)
