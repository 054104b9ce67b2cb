"""What the operators of this subpackage share: shared-folder checkpoints, bounded
Arrow slices, dictionary-coded words and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: Bytes of text that one vectorised step holds at a time. A longer single text is one step.
SLICE_BYTES = 2 << 20
#: Bytes about that a worker process may fill with what words became; bounds its memory only.
CACHE_BYTES = 40 << 20
#: Bytes of rows in one batch between the JVM and a worker; both hold a few of them at a time.
BATCH_BYTES = 8 << 20
#: What a remembered word takes beside its letters and its arrays: string, dictionary entry, bounds.
ENTRY_BYTES = 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so a lost executor never forces a long recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches keep to BATCH_BYTES, unless its settings say otherwise.

    The default is eight times that, which the JVM holds outside its heap and seldom gives back."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def rows_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra ones with clashing names cannot interfere."""
    return df.select(*(F.col(c) for c in columns))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of text (a longer text comes alone); null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            # a copy from place 0 on: kernels that rewrite a slice's letters in place of the whole array misread its offsets
            text = part.column(at).take(pa.array(np.arange(part.num_rows)))
            yield part.set_column(at, column, pc.fill_null(text.cast(pa.large_string()), ""))
            start = stop
        del batch
        pa.default_memory_pool().release_unused()  # a worker lives on after its task; what it has freed goes back


def coded_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between runs of ASCII white space as (code of each word, dictionary, first word of each text and the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # a text without words is split into one empty string
        real = codes != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, coded.dictionary, offsets


def sums_by_text(rows: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the words' rows (by dictionary code) over each text, one column at a time; zero for a text without words."""
    out = np.zeros((len(offsets) - 1, rows.shape[1]), dtype=np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        for j in range(rows.shape[1]):
            out[full, j] = np.add.reduceat(np.ascontiguousarray(rows[:, j])[codes], offsets[:-1][full], dtype=np.float64)
    return out


class Pieces:
    """Growing arrays of different lengths in one flat buffer, gathered by index without a loop over words."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 12, dtype=dtype), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int32), 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Appends pieces that lie end to end in `flat`."""
        n, k = len(flat), len(lengths)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + k > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + n] = flat
        self.starts[self.count : self.count + k] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + k] = lengths
        self.used += n
        self.count += k

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces end to end, and where each ends."""
        lengths = self.lengths[index].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.starts[index] - (ends - lengths), lengths)
        return self.flat[at], ends

    @property
    def bytes(self) -> int:
        return self.used * self.flat.itemsize


class Memory:
    """What words became, one piece of each kind a word, in about `limit` or CACHE_BYTES: when full, words that
    only one slice had are forgotten first, and all of them if that is not enough."""

    def __init__(self, *dtypes, limit: int | None = None):
        self.dtypes, self.limit = dtypes, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.kinds = [Pieces(d) for d in self.dtypes]
        self.met = np.zeros(1 << 10, dtype=bool)  # by more than one slice
        self.letters = 0

    def full(self) -> bool:
        return self.letters + ENTRY_BYTES * len(self.at) + sum(k.bytes for k in self.kinds) > (self.limit or CACHE_BYTES)

    def trim(self) -> None:
        """Called between slices only, as places change."""
        if not self.full():
            return
        old, met = (self.at, self.kinds), self.met
        self.clear()
        if met[: len(old[0])].mean() < 0.5:
            words = [w for w, i in old[0].items() if met[i]]
            places = np.fromiter((old[0][w] for w in words), dtype=np.int64, count=len(words))
            parts = []
            for kind in old[1]:
                flat, ends = kind.gather(places)
                parts.append((flat, np.diff(ends, prepend=0)))
            self.add(words, *parts)

    def add(self, words: list[str], *parts: tuple[np.ndarray, np.ndarray]) -> None:
        """New words, and for each kind their pieces end to end with their lengths."""
        first = len(self.at)
        self.at.update(zip(words, range(first, first + len(words)), strict=True))
        self.letters += sum(map(len, words))
        while len(self.at) > len(self.met):
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        for kind, part in zip(self.kinds, parts, strict=True):
            kind.extend(*part)

    def places(self, words: list[str], before: int) -> np.ndarray:
        """Where the words' pieces are; those that were there before this slice (the first `before`) are marked as met again."""
        out = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        self.met[out[out < before]] = True
        return out


class WordTable:
    """Rows of floats by word, computed once a task for each distinct word that it remembers: one by one, or for a list of words `at_once`."""

    def __init__(self, compute, width: int, at_once: bool = False):
        self.compute = compute if at_once else lambda words: [compute(w) for w in words]
        self.width, self.memory = width, Memory(np.float32)

    def of(self, dictionary: pa.Array) -> np.ndarray:
        """The rows of a dictionary's words, in its order."""
        self.memory.trim()
        words, before = dictionary.to_pylist(), len(self.memory.at)
        new = [w for w in words if w not in self.memory.at]
        rows = np.asarray(self.compute(new), dtype=np.float32).reshape(-1)
        self.memory.add(new, (rows, np.full(len(new), self.width, dtype=np.int64)))
        return self.memory.kinds[0].flat.reshape(-1)[: len(self.memory.at) * self.width].reshape(-1, self.width)[self.memory.places(words, before)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """About `limit` labelled rows at most (doc_id, text, label), drawn by a hash of the id, without those held out.

    Null labels and ids teach nothing; of repeated labels for one id the largest counts. A
    share of the hash's range is kept, so no task sorts or gathers the labels, and the ids
    that are broadcast number `limit` within the small spread of a binomial draw."""
    ids = (
        rows_of(labels, "doc_id", label)
        .where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_crc() % modulus != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    share = min(1.0, limit / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return bounded_batches(rows_of(docs, "doc_id", "text")).join(F.broadcast(ids), "doc_id")


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for a ridge logistic model; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Group facts of at least this share of all rows are broadcast: there are at most HOT_GROUPS such groups.
HOT_GROUPS, HOT_LEAST = 10_000, 100


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one row of facts per key, however many rows a key has.

    Groups with at least total / HOT_GROUPS rows number HOT_GROUPS at most by arithmetic, so
    their facts are broadcast and their rows stay where they are; the others shuffle."""
    hot = F.col(size) >= max(HOT_LEAST, -(-total // HOT_GROUPS))
    few = F.broadcast(facts.where(hot))
    large = rows.join(few, key)
    small = rows.join(few.select(key), key, "left_anti").join(facts.where(~hot), key)
    return large.unionByName(small)
