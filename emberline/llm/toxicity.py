"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts, in a bounded sample of labelled rows, how many toxic and other texts hold
each word and each word beginning. An informative Dirichlet prior (the corpus itself, weighted)
turns counts into log-odds with a z-score; significant ones are the model. A word takes its own
log-odds, else those of its longest known beginning, else none, less a small drift.

A linear scan in the manner of Ruzzo and Tompa finds every maximal segment of a text. Chance
segments follow an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)), whose lambda and K
come from the sample's clean texts; a segment counts where its normalised score
lambda s - ln(K n) is high. The best segment and the sum over significant ones give the
probability by a logistic map.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bounded_batches, checkpointed, coded_words, fit_logistic, id_crc, labelled_sample, logistic, text_slices

#: Labelled rows in the sample, and word beginnings that are counted too.
SAMPLE, BEGINNINGS = 20_000, (4, 5, 6, 7)
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Weight of the prior, smallest z-score of a term, drift per word, p-value of a significant segment.
PRIOR, LEAST_Z, DRIFT, SIGNIFICANT = 0.05, 2.2, 0.05, 0.05
#: The normalised score that chance reaches with probability SIGNIFICANT.
BAR = float(-np.log(-np.log1p(-SIGNIFICANT)))


def normal(word: str) -> str:
    return word.lower().strip(string.punctuation)


def terms(word: str) -> list[str]:
    """A word and its beginnings (marked by *), the most telling first."""
    w = normal(word)
    return [w, *(w[:n] + "*" for n in reversed(BEGINNINGS) if len(w) > n)] if w else []


@dataclass
class Model:
    odds: dict[str, float]
    decay: float = 1.0
    log_k: float = 0.0
    weights: np.ndarray | None = None
    prior: float = 0.0

    def word_score(self, word: str) -> float:
        for term in terms(word):
            if (s := self.odds.get(term)) is not None:
                return s - DRIFT
        return -DRIFT


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, toxic, other): sampled texts that hold each term, pre-counted in each partition."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            seen = [Counter(), Counter()]
            codes, dictionary, offsets = coded_words(rows.column("text"))
            of_word = [terms(w) for w in dictionary.to_pylist()]
            for i, label in enumerate(rows.column("label").to_pylist()):
                seen[label > 0].update({t for c in np.unique(codes[offsets[i] : offsets[i + 1]]).tolist() for t in of_word[c]})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["term", "toxic", "other"])

    return sample.select("text", "label").mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def telling(counts: DataFrame) -> list:
    """(term, log-odds) of every significant term; as many as the bounded sample has."""
    n = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    n1, n0 = float(n["toxic"] or 0), float(n["other"] or 0)
    if not n1 or not n0:
        return []
    prior = (F.col("toxic") + F.col("other")) * PRIOR
    c1, c0 = F.col("toxic") + prior, F.col("other") + prior
    total = (n1 + n0) * PRIOR
    odds = F.log(c1 / (n1 + total - c1)) - F.log(c0 / (n0 + total - c0))
    z = odds / F.sqrt(1 / c1 + 1 / c0)
    return counts.where(F.col("toxic") + F.col("other") >= 2).select("term", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z).select("term", "odds").collect()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) of one text, left to right, in linear time.

    Only positive scores start or extend a segment, so the loop runs over those alone."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # start, end, sum before, sum through; sums before and through both rise on the stack's chains
    for i in np.flatnonzero(scores > 0).tolist():
        start, left, right = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = int(stack[j][4])  # the next earlier one with a smaller sum before it
            if j < 0 or stack[j][3] >= right:
                stack.append([start, i + 1, left, right, j])
                break
            start, left = int(stack[j][0]), stack[j][2]
            del stack[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in stack]


def features(scores: np.ndarray, model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(best normalised score, sum of the significant ones, significant segments) of one text."""
    found = segments(scores)
    shift = model.log_k + np.log(max(len(scores), 1))
    normalised = [model.decay * s - shift for _, _, s in found]
    great = [k for k, x in enumerate(normalised) if x >= BAR]
    return max(normalised, default=-shift), float(sum(normalised[k] for k in great)), [found[k] for k in great]


def _inputs(best: float, total: float) -> tuple[float, float, float]:
    p = -np.expm1(-np.exp(-np.clip(best, -30, 30)))  # chance of such a best segment in a clean text
    return float(np.clip(best, -10, 20)), float(-np.log10(max(p, 1e-12))), float(np.log1p(max(total, 0.0)))


def _scan(text: pa.Array, model: Model, words: WordTable) -> Iterator[np.ndarray]:
    codes, dictionary, offsets = coded_words(text)
    scores = words.of(dictionary)[:, 0].astype(np.float64)[codes]
    for i in range(len(text)):
        yield scores[offsets[i] : offsets[i + 1]]


def _table(model: Model) -> WordTable:
    return WordTable(model.word_score, 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Model:
    """Fits the model on a bounded sample of labelled rows outside the held-out part. Without both labels, a model that knows no term."""
    rows = checkpointed(labelled_sample(docs, labels, "toxic", modulus, held_out, sample).select("text", "label"))
    model = Model({r["term"]: float(r["odds"]) for r in telling(checkpointed(count_terms(rows)))})

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table(model)
        for part in text_slices(batches):
            best, lengths = [], []
            for scores in _scan(part.column("text"), model, words):
                best.append(max((s for _, _, s in segments(scores)), default=0.0))
                lengths.append(len(scores))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(lengths, pa.int64()), pa.array(best, pa.float64())], ["label", "n", "top"])

    def inputs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table(model)
        for part in text_slices(batches):
            x = [_inputs(*features(scores, model)[:2]) for scores in _scan(part.column("text"), model, words)]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    # a few numbers of each sampled text reach the driver
    seen = rows.mapInArrow(tops, "label int, n long, top double").toPandas()
    if not len(seen) or seen["label"].min() == seen["label"].max():
        model.prior = float(seen["label"].mean()) if len(seen) else 0.0
        return model
    # chance law from clean texts: moments of the maximum give the decay, then K from its mean
    clean = seen[seen["label"] == 0]
    spread = max(float(np.std(clean["top"])), 1e-3)
    model.decay = float(np.clip(np.pi / np.sqrt(6) / spread, 0.2, 5.0))
    model.log_k = float(model.decay * clean["top"].mean() - 0.5772156649015329 - np.log(clean["n"].clip(lower=1)).mean())
    got = rows.mapInArrow(inputs, "label int, x array<double>").toPandas()
    label = got["label"].to_numpy(dtype=np.float64)
    model.weights, model.prior = fit_logistic(np.array(got["x"].tolist(), dtype=np.float64), label), float(label.mean())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages array<struct<start,end,score>> (word positions of every significant segment).

    Null and empty texts score as texts without words; repeated rows and null ids are scored
    like any other; an empty table gives no rows; texts of any length are scanned whole."""
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table(model)
        for rows in text_slices(batches):
            probabilities, passages = [], []
            for scores in _scan(rows.column("text"), model, words):
                best, total, found = features(scores, model)
                probabilities.append(probability(best, total, model))
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(probabilities, pa.float64()), pa.array(passages, pa.list_(passage))], ["doc_id", "score", "passages"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")


def probability(best: float, total: float, model: Model) -> float:
    if model.weights is None:
        return model.prior
    return float(logistic(np.dot(model.weights, (*_inputs(best, total), 1.0))))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with their columns as they are and no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table(model)
        for batch in batches:
            at = 0
            for rows in text_slices([batch]):
                keep = [probability(*features(scores, model)[:2], model) < threshold for scores in _scan(rows.column("text"), model, words)]
                yield batch.slice(at, rows.num_rows).filter(pa.array(keep, pa.bool_()))
                at += rows.num_rows

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    docs = rows_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (id_crc() % MODULUS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
