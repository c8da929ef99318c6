"""Toxicity by a linear classifier on character n-grams scaled with naive Bayes log-count ratios.

A gram weighs by the logarithm of how often a document has it. The ratio of its smoothed share among toxic documents to that among the others,
in logarithms, scales the gram; a regularised logistic regression is fitted on the scaled grams. Grams are hashed
into ``SLOTS`` places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh_name, materialize

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
SIZES = (3, 4, 5, 6, 8)
ITERATIONS = 700
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Slots that count, the weight of each, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def gram_slots(text: str) -> Iterator[np.ndarray]:
    """Slots of the lower-case text's character n-grams, one array per size of ``SIZES``."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rolled = chars
    for n in range(2, max(SIZES) + 1):
        if len(chars) < n:
            return
        rolled = rolled[:-1] * _BASE + chars[n - 1 :]
        if n in SIZES:
            yield ((rolled + np.uint64(n)) * _MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _found(text: str, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots that occur in a text, and log2(1 + count) of each."""
    found = [s if wanted is None else s[wanted[s]] for s in gram_slots(text)]
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    slots, counts = np.unique(np.concatenate(found), return_counts=True)
    return slots, np.log2(1 + counts)


def learning_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, text) of ``max_rows`` labelled rows at most, those whose ids hash lowest: every label has the same chance.

    Rows whose crc32(id) mod 3 is 1 are held out. An id with several labels has the largest; of several rows of an
    id one counts, the one whose text hashes lowest.
    """
    held = F.crc32(F.col(id_col).cast("string")) % 3 == 1
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    # ``max_rows`` bounds the broadcast side.
    joined = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), id_col)
    return joined.groupBy(id_col).agg(F.max("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t")).select("y", "t")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 8000,
    max_features: int | None = 1024,
    smoothing: float = 1.0,
    strength: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    :param max_rows: labelled rows used at most; all of them where there are fewer.
    :param max_features: grams kept, those whose shares in the two classes differ most for their spread; None keeps all.
    :param smoothing: added to each count of the log-count ratio.
    :param strength: weight of the quadratic penalty.

    With no labels, or labels of one kind, the model has no grams and its intercept is the smoothed share of toxic
    rows. Whole texts are used; null texts count as empty. What reaches the driver is bounded by ``max_rows`` texts times
    the grams kept, as slots present in the sample.
    """
    rows = materialize(learning_rows(docs, labels, max_rows, id_col, text_col, label_col), "toxicity-sample")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((toxic + 1) / (clean + 1)))
    if not toxic or not clean:
        return Model(np.empty(0, np.int64), np.empty(0), prior)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(y == 1), _found(text)[0]] += 1
        used = np.flatnonzero(seen.sum(axis=0))
        cols = [pa.array(used), pa.array(seen[1, used].astype(np.int64)), pa.array(seen[0, used].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["slot", "toxic", "clean"])

    counts = rows.mapInArrow(count, "slot bigint, toxic bigint, clean bigint").groupBy("slot")
    counts = counts.agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q"))
    share = (F.col("p") + F.col("q") + 1.0) / (toxic + clean + 2.0)
    spread = F.sqrt(share * (1 - share) * (1.0 / toxic + 1.0 / clean))
    apart = F.abs(F.col("p") / F.lit(toxic) - F.col("q") / F.lit(clean)) / spread
    top = (counts if max_features is None else counts.orderBy(apart.desc(), "slot").limit(max_features)).collect()
    slots = np.array(sorted(r.slot for r in top), np.int64)
    by_slot = {r.slot: r for r in top}
    p = np.array([by_slot[s].p for s in slots.tolist()]) + smoothing
    q = np.array([by_slot[s].q for s in slots.tolist()]) + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(SLOTS, bool)
        wanted[slots] = True
        for batch in batches:
            made = [_found(t, wanted) for t in batch.column(1).to_pylist()]
            at = pa.array([np.searchsorted(slots, x).astype("<u4").tobytes() for x, _ in made], pa.binary())
            size = pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), at, size], names=["y", "found", "size"])

    sample = rows.mapInArrow(hits, "y int, found binary, size binary").toArrow()
    found = [np.frombuffer(x, "<u4").astype(np.int64) for x in sample.column("found").to_pylist()]
    sizes = [np.frombuffer(x, "<f4").astype(float) for x in sample.column("size").to_pylist()]
    y = np.array(sample.column("y").to_pylist(), float)
    weights, bias = _logistic(found, sizes, y, ratio, prior, strength)
    return Model(slots, weights * ratio, bias)


def _logistic(found: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, scale: np.ndarray, prior: float, strength: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the mean log loss with a quadratic penalty."""
    cols = np.concatenate(found) if found else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    # Summed in an order of their own: the fit does not depend on how the sample came in.
    total = np.bincount(rows, (cols + 1) * np.concatenate(sizes), len(found)) if found else np.empty(0)
    order = np.lexsort((y, total, [len(x) for x in found]))
    cols, rows = np.concatenate([found[i] for i in order]), np.repeat(np.arange(len(found)), [len(found[i]) for i in order])
    y, n = y[order], len(found)
    value = scale[cols] * np.concatenate([sizes[i] for i in order])
    energy = np.bincount(rows, value**2, n)
    step = 4.0 / (energy.mean() * 4 + 1 + strength / n)
    w, b = np.zeros(len(scale)), prior
    ahead_w, ahead_b, momentum = w, b, 1.0
    last = np.inf
    for _ in range(ITERATIONS):
        z = np.bincount(rows, value * ahead_w[cols], n) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        loss = np.mean(np.logaddexp(0, z) - y * z) + strength / n / 2 * (ahead_w**2).sum()
        if loss > last + 1e-9:
            step, ahead_w, ahead_b, momentum = step / 2, w, b, 1.0
            last = np.inf
            continue
        last = loss
        new_w = ahead_w - step * (np.bincount(cols, value * error[rows], len(scale)) + strength / n * ahead_w)
        new_b = ahead_b - step * error.sum()
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead_w, ahead_b = new_w + (momentum - 1) / after * (new_w - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new_w, new_b, after
    return w, float(b)


def _sum(weight: np.ndarray, text: str, wanted: np.ndarray) -> float:
    slots, size = _found(text, wanted)
    return float((weight[slots] * size).sum())


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` DOUBLE in 0..1, larger where label 1 is likelier; only the text is read.

    Null and empty texts score by the intercept alone. A column of the name of ``score_col`` is replaced.
    """
    base = docs.drop(score_col)
    names, at = [*base.columns, score_col], base.columns.index(text_col)
    slots, weights, bias = model.slots, model.weights, model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(SLOTS)
        weight[slots] = weights
        wanted = np.zeros(SLOTS, bool)
        wanted[slots] = True
        for batch in batches:
            z = np.array([bias + _sum(weight, t, wanted) if t else bias for t in batch.column(at).to_pylist()], float)
            made = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    held_out is false for a null id. Repeated rows each keep their row and score alike.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = score(docs.select(id_col, text_col), model, text_col=text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns of ``docs``."""
    made = fresh_name(docs, "score")
    scored = score(docs, fit(docs, labels, text_col=text_col, **options), text_col=text_col, score_col=made)
    return scored.where(F.col(made) < threshold).drop(made)
