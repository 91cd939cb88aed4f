"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each whole text gives a vector of statistics (shares of kinds of characters, lengths, repetition). Standardised, it goes through random
Fourier features, which approximate a Gaussian kernel; the normal equations of ridge regression are summed by partition and solved once
on the driver; isotonic regression over rows that the ridge hasn't seen turns scores into probabilities.

Labels are learnt from a bounded sample (``SAMPLE`` rows or so of the labelled ones; all when there are fewer): the driver gets one sum of
``FEATURES``-squared numbers and the calibration rows' scores, whatever the input's size. Every document is scored.

Defined cases: null and empty texts have a vector of zeros and a score like any other; labels that are null are left out; a document
with several labels counts with their mean; without labels, or with labels of one kind only, the score is the labels' mean (0.5 without
any) for all; a null ``doc_id`` is scored and not held out; rows repeat as they are; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, bounded_sample, held_out, summed, texts

SAMPLE = 20_000
FEATURES = 192
PARTIALS = 16
WIDTH = 1.0  # of the kernel, in units of the root of the number of statistics
RIDGE = 1e-3

_UPPER, _LOWER, _DIGIT, _SPACE = (np.array([f(chr(c)) for c in range(128)] + [False] * 128, bool) for f in (str.isupper, str.islower, str.isdigit, str.isspace))
_HIGH = np.arange(256) >= 128
_LEAD = np.arange(256) >= 192
_END = np.isin(np.arange(256), [ord(c) for c in ".,;:"])
_SHOUT = np.isin(np.arange(256), [ord(c) for c in "!?"])
_MARK = np.isin(np.arange(256), [ord(c) for c in "#$%&*|<>{}[]=_~^\\/@+"])
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _END, _SHOUT, _MARK], axis=1).astype(float)
STATISTICS = 24


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` numbers of a whole text; none depends on its language, source or id."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ _CLASSES / len(raw)
    p = counts[counts > 0] / len(raw)
    words = raw.split()
    n = max(1, len(words))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    upper = sum(map(bytes.isupper, words))
    return [
        *shares.tolist(),
        float(-(p * np.log2(p)).sum()),
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        distinct / n,
        distinct / n**0.75,
        pairs / max(1, n - 1),
        again / n,
        upper / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        float(counts[_MARK].max(initial=0) / len(raw)),
        raw.count(b" | ") / n,
    ]


class Fourier:
    """The feature map: cosines of random projections, the same ones for the same seed."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([out, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots and values of the best rising step function, joined by lines."""
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    knots, first = np.unique(xs, return_index=True)
    sums, sizes = np.add.reduceat(ys, first), np.diff(np.append(first, len(ys)))
    blocks: list[list[float]] = []  # sum, rows, first knot, last knot
    for k, (s, n) in enumerate(zip(sums.tolist(), sizes.tolist(), strict=True)):
        blocks.append([s, n, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    at, value = [], []
    for s, n, a, z in blocks:
        for k in {a, z}:
            at.append(knots[k])
            value.append((s + 0.5) / (n + 1) if n < 10 else s / n)
    order = np.argsort(at, kind="stable")
    return np.array(at)[order], np.maximum.accumulate(np.array(value)[order])


class QualityModel:
    """What scores a text: statistics, features, ridge weights, calibration."""

    def __init__(self, prior: float, features: Fourier | None = None, weights: np.ndarray | None = None, knots: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.prior, self.features, self.weights, self.knots, self.values = prior, features, weights, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.prior)
        r = self.raw(x)
        # the calibrated probability, with a trace of the raw score that orders rows within a step
        return np.clip(0.998 * np.interp(r, self.knots, self.values) + 0.001 + 0.001 * np.tanh(r - 0.5), 0, 1)


def _vectors(docs: DataFrame) -> DataFrame:
    """``x`` (the statistics, as bytes of doubles) and ``y`` of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(statistics(t)).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1), b.column(2), b.column(3)], names=["x", "y", "fold", ID])

    return docs.mapInArrow(run, f"x binary, y double, fold int, {ID} long")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learn from rows of ``labels`` that aren't held out."""
    known = labels.filter(F.col(target).isNotNull() & F.col(ID).isNotNull() & ~held_out()).groupBy(F.col(ID).cast("long").alias(ID)).agg(F.avg(F.col(target).cast("double")).alias("y"))
    known = bounded_sample(known, sample)
    prior = known.agg(F.avg("y"), F.min("y"), F.max("y")).first()
    if prior[0] is None or prior[1] == prior[2]:
        return QualityModel(0.5 if prior[0] is None else float(prior[0]))
    fold = F.pmod(F.xxhash64(F.lit("calibration"), ID), F.lit(4)).cast("int")
    rows = texts(docs).join(F.broadcast(known), ID).select(TEXT, "y", fold.alias("fold"), ID)  # at most about ``sample`` ids are broadcast
    # the scan keeps its tasks; only the sample's vectors move, in an order that doesn't depend on them, dealt by id so that copies spread
    rows = _vectors(rows).repartition(PARTIALS, ID).sortWithinPartitions(ID, "x", "y").drop(ID).persist()
    try:
        return _solve(rows, float(prior[0]))
    finally:
        rows.unpersist()


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column(0).to_pylist()), float).reshape(b.num_rows, STATISTICS)
    return x, b.column(1).to_numpy(), b.column(2).to_numpy()


def _solve(rows: DataFrame, prior: float) -> QualityModel:
    def spread(b: pa.RecordBatch) -> np.ndarray:
        x, _, _ = _matrix(b)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    moments = summed(rows, spread)
    if moments is None:
        return QualityModel(prior)
    mean = moments[1 : STATISTICS + 1] / moments[0]
    features = Fourier(mean, np.sqrt(np.maximum(moments[STATISTICS + 1 :] / moments[0] - mean**2, 0)) + 1e-6)

    def normal(b: pa.RecordBatch) -> np.ndarray:
        x, y, fold = _matrix(b)
        z = features(x[fold > 0])
        return np.concatenate([(z.T @ z).ravel(), z.T @ y[fold > 0], [len(z)]])

    sums, d = summed(rows, normal, wide=True), FEATURES + 1
    gram, right, n = sums[: d * d].reshape(d, d), sums[d * d : -1], sums[-1]
    weights = np.linalg.solve(gram + RIDGE * max(n, 1) / d * np.eye(d), right)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold = _matrix(b)
            yield pa.RecordBatch.from_arrays([pa.array(features(x[fold == 0]) @ weights), pa.array(y[fold == 0])], names=["s", "y"])

    pairs = np.array([tuple(r) for r in rows.mapInArrow(calibrate, "s double, y double").collect()])  # about a quarter of the sample
    if not len(pairs):
        pairs = np.array([[0.0, 0.0], [1.0, 1.0]])
    return QualityModel(prior, features, weights, *isotonic(pairs[:, 0], pairs[:, 1]))


def score(docs: DataFrame, model: QualityModel, cut: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 at ``cut`` or more): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model.score(x))], names=[ID, "held_out", "score"])

    out = texts(docs).withColumn("held_out", held_out()).mapInArrow(run, f"{ID} long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with their columns; scored where they are read, without a shuffle."""
    schema = docs.schema
    at = schema.names.index(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, STATISTICS)
            yield b.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
