"""Text quality by regularised quadratic discriminant analysis.

Each whole text gives a dozen statistics, transformed towards a normal shape. Each class has a
mean and a covariance that is shrunk towards the pooled one and towards a multiple of the
identity; its Cholesky factor is computed once. A text's score is the logistic of the
difference of the two Mahalanobis log-densities, tempered on the training sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bounded_batches, coded_words, fit_logistic, id_crc, labelled_sample, logistic, sums_by_text, text_slices

SAMPLE, MODULUS, HELD_OUT, THRESHOLD = 20_000, 5, 0, 0.3
#: Shrinkage of a class covariance towards the pooled one, and of that towards a multiple of the identity.
TO_POOLED, TO_IDENTITY = 0.15, 0.02

NAMES = ("words", "length", "length_spread", "short", "long", "symbols", "alone", "digits", "capital", "stops", "lines", "distinct", "top")


def word_row(word: str) -> tuple[float, ...]:
    n = len(word)
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    return n, n * n, n <= 3, n >= 9, n - letters - digits - (word[-1:] in (".", ",")), not letters, digits, word[:1].isupper(), word[-1:] in (".", ",")


def statistics(text: pa.Array, words: WordTable) -> np.ndarray:
    """One row of transformed statistics a text; a text without words has a fixed row."""
    codes, dictionary, offsets = coded_words(text)
    sums = sums_by_text(words.of(dictionary), codes, offsets)
    n = np.diff(offsets).astype(np.float64)
    m = np.maximum(n, 1)
    chars = np.maximum(sums[:, 0], 1)
    lines = pc.count_substring(text, "\n").to_numpy(zero_copy_only=False).astype(np.float64)
    distinct, top = np.zeros(len(text)), np.zeros(len(text))
    for i in range(len(text)):
        if n[i]:
            counts = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(counts), counts.max()
    mean = sums[:, 0] / m

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log((x + 0.5) / (np.maximum(of - x, 0) + 0.5 + 0.01 * of))

    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.sqrt(np.maximum(sums[:, 1] / m - mean**2, 0)), share(sums[:, 2], m), share(sums[:, 3], m), share(sums[:, 4], chars),
        share(sums[:, 5], m), share(sums[:, 6], chars), share(sums[:, 7], m), share(sums[:, 8], m), share(lines, m), np.log(np.maximum(distinct, 1)) / np.log(m + 1.5), share(top, m),
    ])


@dataclass
class Model:
    means: np.ndarray | None = None  # by class
    factors: np.ndarray | None = None  # inverse Cholesky factors, by class
    log_dets: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        x = x / self.scale
        d = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * g for m, f, g in zip(self.means, self.factors, self.log_dets, strict=True)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = np.arcsinh(self.log_ratio(x))
        return logistic(self.weights[0] * z + self.weights[1])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model(prior=float(y.mean()) if len(y) else 0.5)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return model
    model.scale = np.maximum(x.std(axis=0), 1e-6)
    z = x / model.scale
    groups = [z[y == k] for k in (0, 1)]
    model.means = np.array([g.mean(axis=0) for g in groups])
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own, strict=True)) / len(z)
    factors, dets = [], []
    for c in own:
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_IDENTITY) * c + TO_IDENTITY * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(factor))
        dets.append(2 * np.log(np.diag(factor)).sum())
    model.factors, model.log_dets = np.array(factors), np.array(dets)
    model.weights = fit_logistic(np.arcsinh(model.log_ratio(x))[:, None], y.astype(float))
    if model.weights[0] <= 0:  # the ratio must not be turned round
        model.weights = np.array([1.0, float(np.log(model.prior / (1 - model.prior)))])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out part. Without both labels, a model that always gives the prior."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_row, 9)
        for rows in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(list(statistics(rows.column("text"), words)), pa.list_(pa.float64()))], ["label", "x"])

    got = labelled_sample(docs, labels, "quality", modulus, held_out, sample).select("text", "label").mapInArrow(run, "label int, x array<double>").collect()
    return fit(np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), len(NAMES)), np.array([r["label"] > 0 for r in got], dtype=int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text.

    Null and empty texts score as texts without words; repeated rows and null ids are scored
    like any other; an empty table gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_row, 9)
        for rows in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(statistics(rows.column("text"), words)), pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least the threshold, with their columns as they are and no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_row, 9)
        for batch in batches:
            at = 0
            for rows in text_slices([batch]):
                keep = model.score(statistics(rows.column("text"), words)) >= threshold
                yield batch.slice(at, rows.num_rows).filter(pa.array(keep, pa.bool_()))
                at += rows.num_rows

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    docs = rows_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (id_crc() % MODULUS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
