"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the classes' common one and towards
independent features. A document's score comes from the difference of two Gaussian log-densities,
each a Mahalanobis distance through a Cholesky factor that is computed once, through a logistic curve
whose slope and offset are fitted on the training rows' differences. Labels are learnt from sums over
all labelled training rows, added up where the rows are; only the sums reach the driver.

Defined cases: a null or empty text has the statistics of no words and gets a score; labelled rows
without a quality are left out; where one class has no training row the score is the other class's
share; repeated rows are scored row by row; a null doc_id counts as not held out; columns other than
those named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, table
from .quality_rules import STOP_WORDS

FEATURES = (
    "log words", "log word length", "log longest word", "symbols", "bars", "capitals", "exclamations", "digits",
    "letters", "distinct words", "repeated lines", "log compression", "stop words", "stops", "log line length", "marked words",
)
#: Shares of the common covariance and of its diagonal in a class's covariance; the least variance.
COMMON, DIAGONAL, LEAST = 0.1, 0.1, 1e-3
CUT = 0.3

_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&<>~^{}")
_BARS = bytes(c for c in range(256) if c not in b"|")
_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_EXCLAMATIONS = bytes(c for c in range(256) if c not in b"!?")
_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_ENDS = bytes(c for c in range(256) if c not in b".,;:")
_MARKS = b"#*$%&<>|!~^{}"


def statistics(data: bytes) -> list[float]:
    """FEATURES of a text's UTF-8 bytes: shares under square roots, sizes under logarithms."""
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    lengths = list(map(len, words))
    lines = [x for x in data.split(b"\n") if x]
    share = lambda drop, of=size: math.sqrt(len(data.translate(None, drop)) / of)
    low = data.lower().split()
    return [
        math.log1p(len(words)),
        math.log1p(sum(lengths) / n),
        math.log1p(max(lengths, default=0)),
        share(_SYMBOLS, n),
        share(_BARS, n),
        share(_CAPITALS),
        share(_EXCLAMATIONS, n),
        share(_DIGITS),
        math.sqrt(len(data.translate(None, _LETTERS)) / size),
        len(set(low)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log(size / len(zlib.compress(data, 1))),
        math.sqrt(sum(w in _STOPS for w in low) / n),
        share(_ENDS, n),
        math.log1p(size / max(1, len(lines))),
        math.sqrt(sum(w[-1] in _MARKS for w in words) / n),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py() or b"") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_featured, "doc_id long, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this partition's rows, for each class: how many, the sum, and the sum of outer products."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column("x").to_pylist())
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    place = np.arange(total.size)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["place", "value"])


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # (2, d)
    inverse: np.ndarray  # (2, d, d): inverses of the Cholesky factors
    offset: np.ndarray  # (2,): half the log-determinants
    slope: float = 1.0
    bias: float = 0.0
    only: float | None = None  # the score where one class alone was seen

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = [((x - m) @ i.T) for m, i in zip(self.means, self.inverse)]
        return (0.5 * (z[0] ** 2).sum(axis=1) + self.offset[0]) - (0.5 * (z[1] ** 2).sum(axis=1) + self.offset[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.slope * squashed(self.difference(x)) + self.bias, -700, 700)))


def squashed(difference: np.ndarray) -> np.ndarray:
    """Signed roots, as far differences say little more than nearer ones."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def discriminant(total: np.ndarray) -> Discriminant:
    """From the sums of both classes (2, 1 + d + d * d)."""
    d = len(FEATURES)
    n = total[:, 0]
    if n.min() < 2:
        share = 0.5 if n.sum() == 0 else float(n[1] / n.sum())
        none = np.zeros((2, d))
        return Discriminant(none, np.zeros((2, d, d)), np.zeros(2), only=share)
    means = total[:, 1 : 1 + d] / n[:, None]
    own = total[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    common = (n[:, None, None] * own).sum(axis=0) / n.sum()
    inverse, offset = [], []
    for c in (0, 1):
        s = (1 - COMMON) * own[c] + COMMON * common
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + LEAST * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        offset.append(np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverse), np.array(offset))


#: Bins of the squashed difference over -LIMIT to LIMIT in which training rows are counted for the curve.
BINS, LIMIT = 800, 20.0


def _binned(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS))
        for batch in batches:
            if batch.num_rows:
                s = squashed(model.difference(np.array(batch.column("x").to_pylist())))
                b = np.clip(((s + LIMIT) / (2 * LIMIT) * BINS).astype(np.int64), 0, BINS - 1)
                np.add.at(counts, (batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), b), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(counts.size)), pa.array(counts.ravel())], ["place", "value"])

    return run


def curve(counts: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and bias of the logistic curve of greatest likelihood over binned differences."""
    s = (np.arange(BINS) + 0.5) / BINS * 2 * LIMIT - LIMIT
    theta = np.array([1.0, 0.0])
    design = np.stack([s, np.ones(BINS)])
    for _ in range(steps):  # Newton's, with a small penalty that keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(theta @ design, -700, 700)))
        n = counts.sum(axis=0)
        gradient = design @ (counts[1] - n * p) - 0.5 * (theta - [1.0, 0.0])
        hessian = (design * (n * p * (1 - p))) @ design.T + 0.5 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(theta[0]), float(theta[1])


def _added(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    total = np.zeros(shape[0] * shape[1])
    for place, value in rows.groupBy("place").agg(F.sum("value").alias("value")).collect():  # as many rows as sums
        total[place] = value
    return total.reshape(shape)


def fit(training: DataFrame) -> Discriminant:
    """From training (x, y) with y 0 or 1."""
    d = len(FEATURES)
    schema = "place long, value double"
    model = discriminant(_added(training.mapInArrow(_sums, schema), (2, 1 + d + d * d)))
    if model.only is not None:
        return model
    slope, bias = curve(_added(training.mapInArrow(_binned(model), schema), (2, BINS)))
    return Discriminant(model.means, model.inverse, model.offset, slope, bias)


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array(batch.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return run


def held_out(doc_id) -> object:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    known = durable(featured(docs).withColumn("held_out", held_out(F.col("doc_id"))))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)").where(~held_out(F.col("doc_id")))
    model = fit(known.where(~F.col("held_out")).join(marked, "doc_id").select("x", F.col("y").cast("long").alias("y")))
    return known.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))
