"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class moments are sums over all labelled training rows. Each class covariance is shrunk toward the pooled one and
then toward a multiple of the identity; the score comes from the difference of Mahalanobis log-densities by cached
Cholesky factors, put on the probability scale by a logistic curve fitted to its histogram on the training rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, staged

STATISTICS = ("log_bytes", "log_words", "upper", "digits", "marks", "bars", "symbols", "wide", "lines", "repeated_line", "repeated_word", "adjacent_word", "word_length", "longest_word", "entropy", "deflated", "mark_runs")
BIN = 0.25
"""Width of a bin of the log-density difference; differences beyond ``BIN * 2000`` share the end bins."""


def byte_classes() -> np.ndarray:
    """Class of each byte: upper, digit, sentence mark, bar, other symbol, non-ASCII, line feed, or none."""
    kinds = np.full(256, 7)
    for b in range(128):
        c = chr(b)
        kinds[b] = 0 if c.isupper() else 1 if c.isdigit() else 2 if c in ".,;:'\"-()?" else 3 if c == "|" else 6 if c == "\n" else 7 if c.isalpha() or c.isspace() else 4
    kinds[128:] = 5
    return kinds


CLASSES = byte_classes()


def statistics(text: str) -> list[float]:
    """``STATISTICS`` of a whole text: logarithms of sizes, square roots of shares. An empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(CLASSES, counts, 8)
    n, words, lines = len(data), text.split(), text.split("\n")
    n_words = max(1, len(words))
    p = counts[counts > 0] / n
    symbol = CLASSES[raw] == 4
    shares = np.sqrt([*(kinds[:7] / n), 1 - len(set(lines)) / len(lines), 1 - len(set(words)) / n_words if words else 0.0, sum(map(eq, words, words[1:])) / n_words])
    packed = len(zlib.compress(data, 1)) / n
    runs = np.count_nonzero(symbol[1:] & symbol[:-1]) / n
    return [np.log1p(n), np.log1p(len(words)), *shares, np.log1p(len(text) / n_words), np.log1p(max(map(len, words), default=0)), float(-(p * np.log2(p)).sum()), np.log(packed), np.sqrt(runs)]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, over standardised statistics."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - self.shift) / self.scale
        density = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return density[1] - density[0]

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(stats) + self.intercept, -500, 500)))


def class_moments(rows: DataFrame, label: str) -> dict[int, np.ndarray]:
    """Per class the sums of 1, x and x x': (d + 1)^2 numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.array(batch.column(0).to_pylist())
            x = np.array([[1.0, *s] for s in batch.column(1).to_pylist()]).reshape(len(y), -1)
            for k in np.unique(y):
                sums[int(k)] = sums.get(int(k), 0) + x[y == k].T @ x[y == k]
        for k, total in sums.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["label", "at", "value"])

    summed = rows.select(label, "stats").mapInArrow(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    out: dict[int, dict[int, float]] = {}
    for row in summed.collect():  # two classes of (d + 1)^2 sums
        out.setdefault(row.label, {})[row.at] = row.value
    return {k: np.array([v[i] for i in range(len(v))]).reshape(int(len(v) ** 0.5), -1) for k, v in out.items()}


def fit_discriminant(rows: DataFrame, label: str = "label", pooling: float = 0.2, ridge: float = 0.02) -> Discriminant | None:
    """From (label 0 or 1, stats) rows; None unless both classes occur. ``pooling`` is the weight of the pooled
    covariance in each class's, ``ridge`` that of the identity."""
    moments = class_moments(rows, label)
    if not {0, 1} <= moments.keys():
        return None
    both = moments[0] + moments[1]
    count = both[0, 0]
    shift = both[0, 1:] / count
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / count - shift**2, 1e-12))
    means, covariances = [], []
    for k in (0, 1):
        n, mean = moments[k][0, 0], moments[k][0, 1:] / moments[k][0, 0]
        covariances.append((moments[k][1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - shift) / scale)
    weights = np.array([moments[k][0, 0] / count for k in (0, 1)])
    pooled = weights[0] * covariances[0] + weights[1] * covariances[1]
    whiten, offset, d = [], [], len(shift)
    for k in (0, 1):
        own = (1 - pooling) * covariances[k] + pooling * pooled
        own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(weights[k]) - np.log(np.diag(factor)).sum())
    raw = Discriminant(shift, scale, np.array(means), np.array(whiten), np.array(offset))
    return calibrated(raw, rows, label)


def calibrated(model: Discriminant, rows: DataFrame, label: str) -> Discriminant:
    """Logistic curve over the log-density difference, by Newton's steps on its histogram (4,001 bins a class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, len(model.shift))
            bins = np.clip(np.rint(model.difference(stats) / BIN), -2000, 2000)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(bins, pa.int32())], ["label", "bin"])

    counts = rows.select(label, "stats").mapInArrow(run, "label int, bin int").groupBy("label", "bin").count().collect()  # 8,002 rows at most
    y, z, n = (np.array([row[k] for row in counts], float) for k in range(3))
    z *= BIN
    beta = np.array([0.1, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    target = np.where(y == 1, (n[y == 1].sum() + 1) / (n[y == 1].sum() + 2), 1 / (n[y == 0].sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (n * (target - p)) - 1e-3 * beta)
        beta = beta + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Discriminant(model.shift, model.scale, model.means, model.whiten, model.offset, float(max(beta[0], 1e-6)), float(beta[1]))


def score_documents(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """Adds ``score`` to a frame with ``stats``; 0.5 without a model."""
    if model is None:
        return stats.withColumn("score", F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist()).reshape(batch.num_rows, len(model.shift))
            yield batch.append_column("score", pa.array(model.score(x)))

    return stats.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in stats.dtypes)}, score double")


def learned(stats: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str) -> Discriminant | None:
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where(F.col("label").isin(0, 1) & learn)
    return fit_discriminant(staged(stats.where(learn).join(marks, "doc_id").select("label", "stats"), "labelled"))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats, score) of every row of ``docs``; ``score`` near 1 where label 1 is likely.

    Learns from labels whose id satisfies ``learn`` (a condition on ``doc_id``); null labels and null ids are not
    learned from, a repeated label counts each time. Null and empty texts get a score like any other; repeated rows
    stay; extra columns are not read; an empty table gives no rows; without both classes every score is 0.5.
    """
    stats = staged(document_statistics(docs, id_col, text_col), "statistics")
    return score_documents(stats, learned(stats, labels, learn, label_col, id_col))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, that score ``threshold`` or more; all rows if nothing can be learned."""
    model = learned(document_statistics(docs, id_col, text_col), labels, learn, label_col, id_col)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), -1)
            yield batch.filter(pa.array(model.score(x) >= threshold)) if len(texts) else batch

    return docs.mapInArrow(run, docs.schema)
