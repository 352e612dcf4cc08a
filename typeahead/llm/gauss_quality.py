"""Document quality by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics (sizes, letter case, marks,
digits, repetition of words, lines and passages, entropy).  The labelled rows that may train
give, by sums in Spark, each class's mean and covariance; the covariances are shrunk towards
the pooled one and towards a multiple of the identity.  Their Cholesky factors are worked out
once and kept: a text's log-density under a class is then one triangular product (its
Mahalanobis distance) and a constant.  The difference of the two log-densities is mapped to
a probability by a logistic curve, fitted on a histogram of the training rows' differences.

Null text is an empty one, whose statistics are those of no characters; it gets a score like
any other.  Rows that repeat a document are scored each; a document labelled more than once
trains once per label row; null ids and null labels do not train.  Without labels of both
classes the score is the share of label 1 among the labels there are, 0.5 without any.  An
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_remainder, stage, table
from .queries import register

TO_POOLED, TO_SPHERE = 0.1, 0.02   # shrinkage of the class covariances
BINS = 400                         # of the histogram that the logistic curve is fitted on
BLOCK = 1 << 20                    # bytes deflated at a time


def byte_class(chars: bytes) -> np.ndarray:
    found = np.zeros(256, np.float64)
    found[np.frombuffer(chars, np.uint8)] = 1
    return found


UPPER = byte_class(bytes(range(65, 91)))
LOWER = byte_class(bytes(range(97, 123)))
DIGIT = byte_class(b"0123456789")
STOPS = byte_class(b".,;:?")
MARKS = byte_class(bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"-!|"))
HIGH = byte_class(bytes(range(128, 256)))
BASIC = (UPPER, LOWER, DIGIT, STOPS, MARKS, HIGH, byte_class(b"!"), byte_class(b"|"))


def share(part: float, whole: float) -> float:
    """Arcsine of the root of a share: spreads the shares near 0 and 1."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def deflated(raw: bytes) -> int:
    return sum(len(zlib.compress(raw[i:i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of one whole text in UTF-8."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = float(len(raw))
    up, low, digits, stops, marks, high, bang, pipe = (float(count @ c) for c in BASIC)
    words = raw.split()
    counts = Counter(words)
    n_words, n_distinct = len(words), len(counts)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = len(lines)
    again = n_lines - len(set(lines))
    p = count[count > 0] / max(n, 1)
    once = sum(1 for c in counts.values() if c == 1)
    most = max(counts.values(), default=0)
    ends = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"?", b"!"))
    caps = sum(1 for w in counts if w.isupper() and len(w) > 1)
    n_runs = max(0, n_words - 4)
    runs = len(set(zip(words, words[1:], words[2:], words[3:], words[4:])))
    return [np.log1p(n), np.log1p(n_words), np.log1p((n - n_words) / max(n_words, 1)),
            np.log1p(n / max(n_lines, 1)), np.log1p(n_words / max(stops + bang, 1)),
            share(up, up + low), share(digits, n), share(stops, n), share(marks, n), share(high, n),
            share(bang, n), share(pipe, n), float(-(p * np.log(p)).sum()),
            np.log1p(n_distinct) / np.log1p(max(n_words, 1)), share(once, n_distinct), share(most, n_words),
            share(again, n_lines), share(ends, n_lines), share(caps, n_distinct),
            share(n_runs - runs, n_runs), deflated(raw) / (n + 64.0)]


N_STATS = len(statistics(b""))


def measure(batches):
    """id, held_out and statistics of every row."""
    for batch in batches:
        texts = batch.column(2)
        rows = [statistics(texts[i].as_py() or b"") for i in range(len(texts))]
        flat = pa.array(np.array(rows, np.float64).reshape(-1), pa.float64())
        ends = pa.array(np.arange(0, N_STATS * len(rows) + 1, N_STATS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)],
                                         ["id", "held_out", "stats"])


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


def moments(batches):
    """Per batch and label: the sums of [1, x] x [1, x]."""
    d = N_STATS + 1
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.column_stack([np.ones(len(y)), matrix(batch.column(1))])
        labels = np.unique(y)
        sums = [(x[y == c].T @ x[y == c]).ravel() for c in labels]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(labels, d * d), pa.int32()), pa.array(np.tile(np.arange(d * d), len(labels)), pa.int32()),
             pa.array(np.concatenate(sums) if sums else np.empty(0), pa.float64())], ["label", "cell", "value"])


class Gaussian(NamedTuple):
    mean: np.ndarray
    whiten: np.ndarray  # inverse of the covariance's Cholesky factor
    constant: float     # log-density at the mean

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.constant - 0.5 * np.einsum("ij,ij->i", z, z)


class Model(NamedTuple):
    classes: tuple[Gaussian, Gaussian] | None  # of labels 0 and 1
    slope: float
    offset: float  # the log-odds at no difference; the only part used without both classes

    def difference(self, x: np.ndarray) -> np.ndarray:
        return self.classes[1].log_density(x) - self.classes[0].log_density(x)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.offset)
        if self.classes:
            odds = odds + self.slope * squeeze(self.difference(x))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit_gaussians(sums: dict[int, np.ndarray], to_pooled: float, to_sphere: float) -> tuple[Gaussian, Gaussian]:
    counts = {y: s[0, 0] for y, s in sums.items()}
    means = {y: s[0, 1:] / s[0, 0] for y, s in sums.items()}
    covs = {y: s[1:, 1:] / s[0, 0] - np.outer(means[y], means[y]) for y, s in sums.items()}
    total = sum(counts.values())
    pooled = sum(counts[y] / total * covs[y] for y in covs)
    # one scale for all classes, so that the identity means the same for every statistic
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    found = []
    for y in (0, 1):
        cov = covs[y] / np.outer(scale, scale)
        cov = (1 - to_pooled) * cov + to_pooled * pooled / np.outer(scale, scale)
        cov = (1 - to_sphere) * cov + to_sphere * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        chol = np.linalg.cholesky(cov) * scale[:, None]
        found.append(Gaussian(means[y], np.linalg.inv(chol),
                              float(-np.log(np.diag(chol)).sum() - 0.5 * len(cov) * np.log(2 * np.pi))))
    return found[0], found[1]


def squeeze(d: np.ndarray) -> np.ndarray:
    """Differences of log-densities have long tails: a root beyond one unit."""
    return np.sign(d) * (np.sqrt(1 + 2 * np.abs(d)) - 1)


def fit_curve(at: np.ndarray, n0: np.ndarray, n1: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts of both labels, by Newton steps."""
    w = np.array([0.1, float(np.log((n1.sum() + 1) / (n0.sum() + 1)))])
    x = np.column_stack([at, np.ones(len(at))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (n1 - (n0 + n1) * p) - np.array([1e-3, 0]) * w
        hess = (x * ((n0 + n1) * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -1, 1)
    return max(float(w[0]), 1e-6), float(w[1])


def histogram(batches, model: Model):
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        d = np.clip(squeeze(model.difference(matrix(batch.column(1)))), -40, 40)
        cells, n = np.unique(np.stack([y, np.rint(d * BINS / 80)], 1).astype(np.int64), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0], pa.int32()), pa.array(cells[:, 1], pa.int32()),
                                          pa.array(n, pa.int64())], ["label", "bin", "n"])


def train(stats: DataFrame, labels: DataFrame, to_pooled: float, to_sphere: float) -> Model:
    """``stats``: id, stats of the rows that may train; ``labels``: id, label (0 or 1).
    Only sums come to the driver: a number per label and pair of statistics or per bin."""
    rows = stage(stats.join(labels, "id").select("label", "stats"), "quality-train")
    d = N_STATS + 1
    cells = (rows.mapInArrow(moments, "label int, cell int, value double")
             .groupBy("label", "cell").agg(F.sum("value")).collect())
    sums: dict[int, np.ndarray] = {}
    for label, cell, value in cells:
        sums.setdefault(label, np.zeros((d, d)))[divmod(cell, d)] = value
    if len(sums) < 2:
        one = 0.5 if not sums else float(next(iter(sums)))
        return Model(None, 0.0, {0.0: -60.0, 0.5: 0.0, 1.0: 60.0}[one])
    model = Model(fit_gaussians(sums, to_pooled, to_sphere), 1.0, 0.0)
    bins = (rows.mapInArrow(partial(histogram, model=model), "label int, bin int, n long")
            .groupBy("label", "bin").agg(F.sum("n")).collect())
    n = np.zeros((2, BINS + 1))
    for label, b, k in bins:
        n[label, b + BINS // 2] = k
    slope, offset = fit_curve((np.arange(BINS + 1) - BINS // 2) * 80 / BINS, n[0], n[1])
    return Model(model.classes, slope, offset)


def score_batches(batches, model: Model):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(model.score(matrix(batch.column(2))), pa.float64())],
            ["id", "held_out", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", to_pooled: float = TO_POOLED,
                  to_sphere: float = TO_SPHERE) -> DataFrame:
    """One row per document: id, held_out, score.

    Held out: crc32 of the id as text is divisible by 5; the others train where labelled."""
    held = id_remainder(F.col(id_col), 5) == 0
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"),
                       F.col(text_col).cast("binary").alias("text"))
    stats = stage(rows.mapInArrow(measure, "id long, held_out boolean, stats array<double>"), "quality-stats")
    truth = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")) \
        .filter("id IS NOT NULL AND label IN (0, 1)")
    model = train(stats.filter("NOT held_out").select("id", "stats"), truth, to_pooled, to_sphere)
    return stats.mapInArrow(partial(score_batches, model=model), "id long, held_out boolean, score double") \
        .withColumnRenamed("id", id_col)


@register("op11_gauss_quality")
def op11(spark, sf_dir):
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
