"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (within
words, with word ends); a linear softmax on the average gives the language.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample; a temperature fitted on a part kept back calibrates
the score. The softmax only weighs the learnt languages against each other, so
rejection also looks at the fit: the mean log frequency of the text's n-grams in
the sample, which a language that was not learnt cannot reach. Both bounds come
from the part kept back. Prediction is one pass over whole texts: the product of
embeddings and softmax weights is a table with one row per hash bucket, and the
log frequencies are one more column of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlens.llm.bytescan import blocks, text_buffer

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BUCKET_BITS = 16
DIMENSIONS = 16
#: Distinct texts of each language that training looks at, about, and languages, the most frequent first.
SAMPLE_ROWS, MAX_LANGUAGES = 400, 200
#: Rows of an Arrow batch that are predicted together.
RUN_ROWS = 512
EPOCHS = 12
RATE = 4.0
#: Share of correctly labelled calibration texts that may be rejected.
REJECT_SHARE = 0.001
#: Share of an n-gram that no sampled text holds.
UNSEEN = 1e-7

_KEEP = np.full(256, 0x20, np.uint8)  # everything that is no letter separates words
_KEEP[0x80:] = np.arange(0x80, 0x100)
for _b in range(26):
    _KEEP[0x41 + _b] = _KEEP[0x61 + _b] = 0x61 + _b
_MULTIPLIER = np.uint32(0x9E3779B1)


def _letters(buf: np.ndarray) -> np.ndarray:
    """Lower-cased letters (A-Z and the two-byte Latin capitals), spaces elsewhere."""
    out = _KEEP[buf]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def _grams(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of the n-grams that lie in one word, its ends included."""
    size = len(letters) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = letters == 0x20
    inner = np.zeros(size, bool)
    for k in range(1, n - 1):
        inner |= gap[k : k + size]
    inner |= gap[:size] & gap[n - 1 :] if n == 2 else False
    key = np.zeros(size, np.uint32)
    for k in range(n):
        key = (key << np.uint32(8)) | letters[k : k + size]
    at = np.flatnonzero(~inner)
    bucket = ((key[at] + np.uint32(n)) * _MULTIPLIER) >> np.uint32(32 - BUCKET_BITS)
    return at, bucket.astype(np.int64)


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes with a space after each row, and the rows' offsets."""
    buf, offs = text_buffer(column)
    out = np.full(len(buf) + len(offs) - 1, 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offs[1:] + np.arange(len(offs) - 1)] = False
    out[keep] = buf
    return out, offs + np.arange(len(offs))


def bucket_counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row: its distinct n-gram buckets and how often each occurs."""
    buf, offs = _padded(column)
    rows = []
    for a, z in zip(offs[:-1], offs[1:]):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for s, e in blocks(buf[a:z]):
            letters = np.concatenate([[np.uint8(0x20)], _letters(buf[a + s : a + e])])
            for n in GRAMS:
                total += np.bincount(_grams(letters, n)[1], minlength=len(total))
        used = np.flatnonzero(total)
        rows.append((used.astype(np.uint32), total[used].astype(np.uint32)))
    return rows


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # bucket x language: embedding times softmax weight; last column: log frequency
    bias: np.ndarray
    temperature: float
    threshold: float  # least score
    least_fit: float

    def scores(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from summed table rows."""
        logits = (sums / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the best language, its score, the text's fit) for each row, over whole texts."""
        buf, offs = _padded(column)
        n_rows = len(offs) - 1
        sums, grams = np.zeros((n_rows, self.table.shape[1])), np.zeros(n_rows, np.int64)
        for a, z in blocks(buf, offs):
            letters = np.concatenate([[np.uint8(0x20)], _letters(buf[a:z])])
            first = int(np.searchsorted(offs, a, "right")) - 1
            last = int(np.searchsorted(offs, z, "left"))
            edges = np.maximum(offs[first : last + 1] - a, 0)  # row r holds letters edges[r] .. edges[r+1]
            for n in GRAMS:
                at, bucket = _grams(letters, n)
                if not len(at):
                    continue
                # an n-gram belongs to the row of its last byte but one; rows end in a space
                cut = np.searchsorted(at + (n - 2), edges[:-1] if last > first else edges[:0])
                size = np.diff(np.append(cut, len(at)))
                full = np.flatnonzero(size)
                if len(full):
                    sums[first + full] += np.add.reduceat(self.table[bucket], cut[full], axis=0)
                    grams[first + full] += size[full]
        p = self.scores(sums[:, :-1], grams)
        best = p.argmax(axis=1)
        return best, p[np.arange(n_rows), best], sums[:, -1] / np.maximum(grams, 1)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 17) -> Model | None:
    """Fit a model on (language, buckets, counts); every fifth row is kept back for calibration.

    Under 25 rows none is kept back, and the model rejects only texts without a letter.
    """
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    languages = tuple(sorted({r[0] for r in rows}))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[::5].tolist()) if len(rows) >= 25 else set()
    label = {name: i for i, name in enumerate(languages)}
    embed = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    fit = [i for i in order.tolist() if i not in held]
    share = [None] * len(rows)
    for i, (_, _, counts) in enumerate(rows):
        share[i] = counts / counts.sum()
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit).tolist():
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, x = rows[i][1], share[i]
            h = x @ embed[buckets]
            z = h @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[rows[i][0]]] -= 1
            back = weight @ p
            weight -= rate * np.outer(h, p)
            bias -= 0.05 * rate * p
            embed[buckets] -= rate * np.outer(x, back)
    table = embed @ weight
    usual = np.zeros(len(embed))
    for i in fit:
        usual[rows[i][1]] += share[i] / len(fit)
    usual = np.log(usual + UNSEEN)

    check = sorted(held) or fit
    logits = np.array([share[i] @ table[rows[i][1]] for i in check]) + bias
    truth = np.array([label[rows[i][0]] for i in check])

    # targets a little short of certain, by the number of texts: without them no temperature is cold enough for separable text
    sure = (len(truth) + 1) / (len(truth) + 2)
    target = np.full(logits.shape, (1 - sure) / max(1, len(languages) - 1))
    target[np.arange(len(truth)), truth] = sure

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

    temperature = min(np.geomspace(0.001, 20, 201).tolist(), key=loss)
    p = np.exp(logits / temperature - (logits / temperature).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p[np.arange(len(truth)), truth][p.argmax(axis=1) == truth]
    # the least that texts kept back reach, less their spread: a few hundred do not show how far one in a thousand goes
    odds = np.log(np.maximum(right, 1e-12)) - np.log(np.maximum(1 - right, 1e-12))
    floor = float(1 / (1 + np.exp(odds.std() - np.quantile(odds, REJECT_SHARE)))) if len(right) else 0.0
    fits = np.array([share[i] @ usual[rows[i][1]] for i in check])
    least = float(np.quantile(fits, REJECT_SHARE) - fits.std())
    if not held:  # too few texts to keep any back: bounds taken from the fitted ones would reject clean text
        floor, least = 0.0, -np.inf
    return Model(languages, np.column_stack([table, usual]).astype(np.float32), bias, temperature, floor, least)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> Model | None:
    """Train on about ``sample_rows`` distinct texts of each language, chosen by a hash of id and text.

    Rows that ``held_out`` marks, or without text or language, are never looked
    at. An id or a text that many rows share is drawn like any other and counts
    once; the text of least hash is always drawn, so a language of few texts in
    many copies is not lost. Of more than ``MAX_LANGUAGES`` language values the most frequent are
    learnt. One count per language and the sampled n-gram counts reach the driver.
    """
    usable = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id", "text"), F.lit(1 << 30))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    upto = [(r["lang"], max(min(1.0, sample_rows / r["n"]) * (1 << 30), r["least"] + 1.0)) for r in sizes]
    share = F.create_map(*[F.lit(x) for pair in upto for x in pair])
    sample = usable.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang").distinct()

    def count(batches):
        for batch in batches:
            found = bucket_counts(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())],
                names=["lang", "buckets", "counts"],
            )

    rows = sample.select("text", "lang").mapInArrow(count, "lang string, buckets binary, counts binary").collect()
    # row order may differ between runs; training must not
    rows = sorted((r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in rows)
    return train([(lang, np.frombuffer(b, np.uint32).astype(np.int64), np.frombuffer(c, np.uint32)) for lang, b, c in rows])


def language_columns(text: Column, model: Model | None) -> Column:
    """Struct of ``lang``, ``score`` and ``fit`` for a string column; ``und`` with score 0 without a letter."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("fit"))
    names = pa.array(model.languages)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        # a few rows at a time: copies of a whole Arrow batch of texts would be most of a worker's memory
        runs = [model.predict(texts.slice(at, RUN_ROWS)) for at in range(0, max(1, len(texts)), RUN_ROWS)]
        best, score, fit = (np.concatenate(x) for x in zip(*runs))
        columns = [names.take(pa.array(best)), pa.array(score, pa.float64()), pa.array(fit, pa.float64())]
        return pa.StructArray.from_arrays(columns, names=["lang", "score", "fit"])

    found = predict(text)
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.struct(
        F.when(lettered, found["lang"]).otherwise(F.lit(UNKNOWN)).alias("lang"),
        F.when(lettered, found["score"]).otherwise(F.lit(0.0)).alias("score"), found["fit"].alias("fit"),
    )


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Trains on ``docs`` unless a model is given. A null text, or one without a
    letter, is ``und`` with score 0 and rejected; so is every text if no row
    has a language to learn. A null id counts as held out; repeated rows each
    give a row; other columns are ignored; an empty table gives no rows.
    """
    model = model or fit_language_model(docs, id_col, text_col, lang_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), language_columns(text, model).alias("_found"))
    return rows.select(
        "doc_id", "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"),
        rejected(F.col("_found"), model).alias("rejected"),
    )


def rejected(found: Column, model: Model | None) -> Column:
    """No letter, a score under what right answers reach, or a fit that no learnt language has."""
    if model is None:
        return found["lang"] == UNKNOWN
    return (found["lang"] == UNKNOWN) | (found["score"] < F.lit(model.threshold)) | (found["fit"] < F.lit(model.least_fit))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows the model rejects; all columns stay as they are.

    A row goes by its own text alone, so null ids and repeated rows are treated
    alike. If no row has a language to learn, every text is rejected.
    """
    model = fit_language_model(docs, id_col, text_col, lang_col)
    found = language_columns(F.col(text_col).cast("string"), model)
    return docs.where(~rejected(found, model))
