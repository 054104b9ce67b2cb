"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its character n-grams with boundary marks, hashed into a fixed table of
embeddings. A text is the mean of its subwords' embeddings; a softmax over it is trained by
stochastic gradient descent in numpy on a bounded sample. A temperature fitted on a part of the
sample kept from training calibrates probabilities, and the rejection level is the quantile of
right answers there. As the model is linear, a text's logits are the mean of its words' own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bounded_batches, coded_words, id_crc, rows_of, sums_by_text, text_slices

#: Sampled texts of each language; all sampled texts, where there are so many languages that each gets fewer, but LEAST at least; buckets, embedding size, n-gram sizes.
SAMPLE, TOTAL, LEAST, BUCKETS, DIM, GRAMS = 800, 6_000, 20, 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, REJECT_SHARE = 6, 0.5, 0.01
MODULUS, HELD_OUT = 5, 0


def subwords(word: str) -> list[int]:
    """Hashed n-grams of a word's letters; a word without letters has none."""
    letters = "".join(c for c in word.lower() if c.isalpha())
    if not letters:
        return []
    marked = f"<{letters}>"
    return [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


#: By byte, the step of crc32; by code point, whether it is a letter (1), is none (2) or was not asked yet (0).
_CRC = np.array([zlib.crc32(bytes([255 ^ i])) ^ 0xFF000000 for i in range(256)], dtype=np.uint32)
_LETTER = np.zeros(0x110000, dtype=np.int8)
#: Letters of the words that are hashed at a time; a longer word comes alone.
CHUNK = 1 << 16


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & 255] ^ (state >> 8)


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words' letters between boundary marks, end to end, and each word's number of them (0 without letters)."""
    low = [w.lower() for w in words]
    points = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32)
    word = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), dtype=np.int64, count=len(low)))
    for c in np.unique(points[_LETTER[points] == 0]).tolist():
        _LETTER[c] = 1 if chr(c).isalpha() else 2
    real = _LETTER[points] == 1
    points, word = points[real], word[real]
    letters = np.bincount(word, minlength=len(low))
    size = np.where(letters > 0, letters + 2, 0)
    marked = np.full(int(size.sum()), ord("<"), dtype=np.uint32)
    marked[np.cumsum(size)[letters > 0] - 1] = ord(">")
    marked[np.arange(len(points)) + 2 * np.cumsum(letters > 0)[word] - 1] = points
    return marked, size


def _sums_by_word(words: list[str], columns: list[np.ndarray]) -> np.ndarray:
    """For each word the sums of the columns (by bucket, and 0 after the last) over its subwords, and their number; the same subwords as `subwords` has, hashed for all words at once."""
    out = np.zeros((len(words), len(columns) + 1))
    marked, size = _marked(words)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(marked))
    first = np.select([marked < 0x80, marked < 0x800, marked < 0x10000], [marked, 0xC0 | marked >> 6, 0xE0 | marked >> 12], 0xF0 | marked >> 18)
    further = [(at, 0x80 | marked[at] >> shift & 0x3F) for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)) if len(at := np.flatnonzero(marked >= least))]
    state, buckets = np.full(len(marked), 0xFFFFFFFF, dtype=np.uint32), []
    for k in range(min(max(GRAMS), len(marked))):  # the n-grams from each place on grow by a letter, a byte at a time
        state = _crc_step(state[: len(marked) - k], first[k:])
        for at, byte in further:
            skip = int(np.searchsorted(at, k))
            state[at[skip:] - k] = _crc_step(state[at[skip:] - k], byte[skip:])
        if k + 1 in GRAMS:
            bucket = np.full(len(marked), BUCKETS, dtype=np.int32)
            np.copyto(bucket[: len(state)], ~state % BUCKETS, where=left[: len(state)] > k, casting="unsafe")
            buckets.append(bucket)
            out[:, -1] += np.maximum(size - k, 0)
    for j, column in enumerate(columns):
        out[full, j] = np.add.reduceat(sum(column[b] for b in buckets), (ends - size)[full])
    return out


@dataclass
class Model:
    languages: list[str]
    #: Logits of each bucket (the embedding times the softmax weights) and the bias, already divided by the temperature. With more than DIM languages the embedding itself, and the weights beside it.
    logits: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    reject_below: float = 0.0

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Each word's sums of logits over its subwords, and the number of these."""
        columns = [np.append(c, 0.0) for c in self.logits.T]
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        rows, start = [np.zeros((0, len(columns) + 1))], 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, side="right")))
            rows.append(_sums_by_word(words[start:stop], columns))
            start = stop
        return np.concatenate(rows)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        z = (z if self.weights is None else z @ self.weights) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max())
    return z / z.sum()


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent over texts given as (buckets, counts)."""
    model = Model(sorted(set(labels)))
    if not model.languages:
        return model
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(model.languages))), np.zeros(len(model.languages))
    number = {x: i for i, x in enumerate(model.languages)}
    y = np.array([number[x] for x in labels])
    shares = [c / c.sum() for _, c in counts]
    order = rng.permutation(len(counts))
    held, learn = order[: len(order) // 10], order[len(order) // 10 :]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn).tolist():
            at, share = counts[i][0], shares[i]
            h = share @ table[at]
            error = _softmax(h @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(h, error)
            bias -= 0.1 * rate * error
            table[at] -= rate * np.outer(share * min(len(at), 200), back)
    wide = len(model.languages) > DIM
    logits = table if wide else table @ weights
    check = held if len(held) >= 20 else order
    z = np.array([(shares[i] @ logits[counts[i][0]] @ weights if wide else shares[i] @ logits[counts[i][0]]) + bias for i in check])
    losses = []
    temperatures = np.geomspace(0.05, 20, 60)
    for t in temperatures:
        e = z / t - (z / t).max(axis=1, keepdims=True)
        losses.append(float(np.mean(np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(check)), y[check]])))
    t = float(temperatures[int(np.argmin(losses))])
    model.logits, model.weights, model.bias = (logits, weights / t, bias / t) if wide else (logits / t, None, bias / t)
    p = np.array([_softmax(r / t) for r in z])
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    model.reject_below = float(np.quantile(right, REJECT_SHARE)) if len(right) else 0.0
    return model


def train(docs: DataFrame, sample: int = SAMPLE, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Model:
    """Learns from about `sample` texts of each language, drawn by a hash of the id, outside the held-out part.

    Null languages and texts, and texts without letters, teach nothing. Every language is
    learned, from fewer texts each if there are many; only hashed counts reach the driver, of at
    most TOTAL texts (or LEAST a language), six bytes for each of their buckets: all n-grams of a whole text count, and
    BUCKETS bounds them whatever its length."""
    rows = rows_of(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc() % modulus != held_out))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return Model([])
    range_ = 1 << 30
    each = min(sample, max(LEAST, TOTAL // len(known)))
    bound = docs.sparkSession.createDataFrame([(lang, int(min(1.0, each / n) * range_)) for lang, n in known.items()], "lang string, bound long")
    drawn = rows.join(F.broadcast(bound), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(range_)) < F.col("bound"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            codes, dictionary, offsets = coded_words(part.column("text"))
            of_word = [np.array(subwords(w), dtype=np.int64) for w in dictionary.to_pylist()]
            at, times = [], []
            for i in range(part.num_rows):
                words, repeats = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)
                total = np.bincount(np.concatenate([np.zeros(0, np.int64), *(of_word[w] for w in words)]), weights=np.concatenate([np.zeros(0), *(np.full(len(of_word[w]), r, float) for w, r in zip(words, repeats, strict=True))]), minlength=1)
                full = np.flatnonzero(total)
                at.append(full.astype(np.int16))  # BUCKETS fit
                times.append(total[full].astype(np.float32))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(at, pa.list_(pa.int16())), pa.array(times, pa.list_(pa.float32()))], ["lang", "at", "times"])

    got = drawn.select("lang", "text").mapInArrow(run, "lang string, at array<smallint>, times array<float>").where(F.size("at") > 0).toArrow()
    langs, at, times = (got.column(c).combine_chunks() for c in ("lang", "at", "times"))
    order = sorted(range(len(langs)), key=lambda i: (langs[i].as_py(), len(at[i]), at[i].values[:4].to_pylist()))
    return fit([(at[i].values.to_numpy(), times[i].values.to_numpy().astype(np.float64)) for i in order], [langs[i].as_py() for i in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every whole text.

    lang_pred is a learned language, or `und` (score 0) for a null text or one without a
    letter; `rejected` marks scores below the calibrated level. Repeated rows and null ids are
    predicted like any other; an empty table gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(model.word_rows, model.logits.shape[1] + 1, at_once=True) if model.languages else None
        for rows in text_slices(batches):
            if words is None:
                sums = np.zeros((rows.num_rows, 2))
                best, score = np.zeros(rows.num_rows, int), np.zeros(rows.num_rows)
            else:
                codes, dictionary, offsets = coded_words(rows.column("text"))
                sums = sums_by_text(words.of(dictionary), codes, offsets)
                p = model.probabilities(sums)
                best, score = p.argmax(axis=1), p.max(axis=1)
            none = sums[:, -1] == 0
            pred = ["und" if x else model.languages[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
            score = np.where(none, 0.0, score)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(none | (score < model.reject_below), pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = rows_of(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", (id_crc() % MODULUS == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
