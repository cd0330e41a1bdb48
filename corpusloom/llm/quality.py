"""Quality of texts by naive Bayes support vectors over byte n-grams."""

from __future__ import annotations

import io
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import Batches, hold, prepare, release, rows_to_batches, text_bytes
from corpusloom.session import materialise

# n-grams of 1 to LONGEST bytes are hashed to this many places
PLACES = 1 << 18
LONGEST = 4
# the classifier is fitted on at most this many labelled rows, those of the lowest id hashes
SAMPLE_ROWS = 4_000
REPEATS = 5
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 12
_BLOCK = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: bytes) -> np.ndarray:
    """Flags of the places of all n-grams that a text holds.

    Besides byte n-grams there are n-grams over words that only tell which of the next
    REPEATS words repeat the one before, or the one before that: texts of repeated
    words hold no unusual bytes.
    """
    flags = np.zeros(PLACES, bool)
    words = text.split()
    for lag in (1, 2):
        if len(words) > lag:
            same = np.fromiter(map(eq, words, words[lag:]), np.int64, len(words) - lag)
            code = np.zeros(max(0, len(same) - REPEATS + 1), np.int64)
            for n in range(REPEATS):
                code = code << 1 | same[n : n + len(code)]
            flags[(lag - 1 << REPEATS) + code] = True
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), _BLOCK):
        block = raw[at : at + _BLOCK + LONGEST - 1].astype(np.uint64)
        code = np.zeros(len(block), np.uint64)
        for n in range(LONGEST):
            if len(block) <= n:
                break
            code = (code[: len(block) - n] << np.uint64(8) | block[n:]) if n else block
            # the length of the n-gram is part of its code
            flags[((code | np.uint64((n + 1) << 40)) * _FACTOR) >> np.uint64(46)] = True
    return flags


class Model:
    """Weights per place: ``margin`` for the decision, ``square`` for the length of a row, and the scale of scores."""

    def __init__(self, margin: np.ndarray, square: np.ndarray, bias: float, slope: float, shift: float):
        self.margin, self.square, self.bias, self.slope, self.shift = margin, square, bias, slope, shift

    def score(self, text: bytes) -> float:
        flags = indicators(text).astype(np.float32)
        length = float(flags @ self.square) ** 0.5
        decision = float(flags @ self.margin) / length + self.bias if length else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -500, 500))))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, margin=self.margin, square=self.square, rest=np.array([self.bias, self.slope, self.shift]))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> "Model":
        with np.load(io.BytesIO(data)) as found:
            return Model(found["margin"], found["square"], *found["rest"].tolist())


def constant(share: float) -> Model:
    """Scores every text with the share of label 1, for labels of one class or none."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))


def _fit_once(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios, then dual coordinate descent of the hinge loss on rows scaled by them."""
    positive, negative = np.full(PLACES, SMOOTHING), np.full(PLACES, SMOOTHING)
    for places, label in zip(rows, labels):
        (positive if label > 0 else negative)[places] += 1
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    scaled = []
    for places in rows:
        values = ratio[places]
        length = np.sqrt((values**2).sum())
        scaled.append((values / length if length else values).astype(np.float32))
    weights, bias, dual = np.zeros(PLACES), 0.0, np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            places, values, label = rows[i], scaled[i], labels[i]
            gradient = label * (weights[places] @ values + bias) - 1
            curve = float(values @ values) + 1  # the constant feature
            new = min(max(dual[i] - gradient / curve, 0.0), COST)
            if new != dual[i]:
                step = (new - dual[i]) * label
                dual[i] = new
                weights[places] += step * values
                bias += step
    return weights * ratio, ratio**2, bias


def _decisions(fitted: tuple, rows: list[np.ndarray]) -> np.ndarray:
    margin, square, bias = fitted
    return np.array([margin[p].sum() / np.sqrt(square[p].sum()) + bias if square[p].sum() else bias for p in rows])


def _scale(decisions: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from decisions to labels, by Newton's method."""
    # targets a little inside 0 and 1 keep the slope finite for separable decisions
    n1, n0 = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * decisions + shift, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * decisions).sum(), (p - target).sum()])
        h = np.array([[(w * decisions**2).sum() + 1e-6, (w * decisions).sum()], [(w * decisions).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 1e-3)), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of rows of places and labels 1 and -1; scores are scaled on decisions over left-out halves."""
    if len(set(labels.tolist())) < 2:
        return constant(float((labels > 0).mean()) if len(labels) else 0.5)
    half = np.zeros(len(rows), bool)
    for value in (1, -1):  # both halves get every second row of each class
        half[np.flatnonzero(labels == value)[::2]] = True
    decisions = np.zeros(len(rows))
    for side in (half, ~half):
        if len(set(labels[side].tolist())) == 2:
            fitted = _fit_once([r for r, s in zip(rows, side) if s], labels[side])
            decisions[~side] = _decisions(fitted, [r for r, s in zip(rows, side) if not s])
    whole = _fit_once(rows, labels)
    if not decisions.any():
        decisions = _decisions(whole, rows)
    slope, shift = _scale(decisions, labels)
    return Model(whole[0].astype(np.float32), whole[1].astype(np.float32), whole[2], slope, shift)


def train(
    documents: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on the texts of at most ``sample_rows`` labelled rows for which ``usable`` (over ``labels``) is true.

    Labels other than 0 and 1 and null keys are left out. Of more rows, those with the
    lowest hash of the key are taken. One task fits the bounded sample.
    """
    spark = documents.sparkSession
    prepare(spark)
    known = labels.where(usable & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    chosen = known.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k", "y").limit(sample_rows)
    rows = documents.select(F.col(key).cast("bigint").alias("k"), text_bytes(text).alias("t"))
    schema = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("places", pa.binary())])

    def places(batches: Batches) -> Batches:
        release()
        return rows_to_batches(batches, schema, lambda b: (
            (k, y, np.flatnonzero(indicators(t.as_py())).astype("<i4").tobytes())
            for k, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))
        ))

    def fitted(batches: Batches) -> Batches:
        release()
        rows = sorted((k, y, p) for b in batches for k, y, p in zip(*(c.to_pylist() for c in b.columns)))
        model = fit([np.frombuffer(p, "<i4") for _, _, p in rows], np.array([2 * y - 1 for _, y, _ in rows], np.int64))
        yield pa.RecordBatch.from_pylist([{"model": model.to_bytes()}])

    # at most sample_rows short rows are broadcast
    sample = materialise(rows.join(F.broadcast(chosen), "k").select("k", "y", "t").mapInArrow(places, "k bigint, y int, places binary"), "sample")
    found = sample.coalesce(1).mapInArrow(fitted, "model binary").collect()
    return Model.from_bytes(bytes(found[0]["model"])) if found else constant(0.5)


def with_scores(documents: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``documents`` and the score of every whole text, 0 to 1. Null, empty and very long texts are scored too."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model.to_bytes())
    kind = documents.schema.simpleString()

    def run(batches: Batches) -> Batches:
        own = hold(("quality", shared.value), lambda: Model.from_bytes(shared.value))
        for batch in batches:
            scores = pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["row", "score"])

    # the columns travel as one value, so their names cannot clash with others
    rows = documents.select(F.struct("*").alias("row"), text_bytes(text).alias("text"))
    scored = rows.mapInArrow(run, f"row {kind}, score double")
    return scored.select("row.*", F.col("score").alias(out))
