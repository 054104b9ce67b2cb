"""Token packing: first-fit decreasing over a tournament tree of bin capacities.

Texts are tokenized where they are read and cut at multiples of the sequence length; only
piece lengths travel on. A piece of full length is a sequence by itself and stays where it is,
so each document has one shorter piece at most to pack. Documents are dealt at random into
groups of bounded size, and each group is packed on its own: pieces from long to short, each
into the leftmost bin with room, which a tournament tree over the bins' free capacities finds
in logarithmic time. A group leaves at most a bin or two partly empty, so padding falls with
the group size.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, bounded_batches, checkpointed, coded_words, text_slices

SEQUENCE, END_ID, GROUP_DOCS = 4096, 2, 4096
VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's own pre-tokenizer pattern.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words gathered into one id stream at a time; repeated documents that a task tells apart before it starts afresh; first sequence number of full pieces.
STREAM_WORDS, REPEATS, FULL = 1 << 18, 100_000, 1 << 62
#: Words without their punctuation that a worker remembers beside the chunks, bytes that chunks may take, bytes of text in a slice.
WORDS, MEMORY_BYTES, TEXT_BYTES = 50_000, 96 << 20, 6 << 20


class WordEncoder:
    """Ids of texts by a tokenizers file whose words end at white space, as the library gives them
    without added special tokens; what chunks between white space became is remembered.

    No word's ids depend on its neighbours, as the vocabulary splits at white space before it
    merges. Chunks beyond Latin letters, or with the string of a special token, which the library
    reads as that token, go through the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(WORD_PATTERN)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if any(c.isspace() for s in self.special for c in s) or not all("<" in s for s in self.special):
            raise ValueError("a special token holds white space, at which texts are cut, or no <, by which it is looked for")
        # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = "".join(chr(b if b in plain else next(rest)) for b in range(256))
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.memory, self.words = Memory(self.dtype, limit=MEMORY_BYTES), {}

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)  # visible ASCII stands for itself
            ids = self.words[word] = [t.id for t in self.model.tokenize(mapped)]
        return ids

    def _chunk(self, chunk: str) -> list[int]:
        # Latin: normalisation and lower case are the same in both libraries
        latin = chunk.isascii() or max(chunk) < "ɐ"
        if not latin or not chunk.isprintable() or ("<" in chunk and any(s in chunk for s in self.special)):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
        if low.isalpha():  # a run of letters is one match of the pattern
            return self._word(low)
        if low[-1] in ".," and low[:-1].isalpha():  # so are these marks
            return self._word(low[:-1]) + self._word(low[-1])
        return [i for w in self.pattern.findall(low) for i in self._word(w)]

    def streams(self, text: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        self.memory.trim()
        if len(self.words) > WORDS:
            self.words.clear()
        codes, dictionary, offsets = coded_words(text)
        chunks, before = dictionary.to_pylist(), len(self.memory.at)
        new = [c for c in chunks if c and c not in self.memory.at]
        lists = [self._word(c.lower()) if c.isascii() and c.isalpha() else self._chunk(c) for c in new]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.memory.add(new, (np.fromiter(chain.from_iterable(lists), dtype=self.dtype, count=int(counts.sum())), counts))
        index = np.zeros(len(chunks), dtype=np.int64)
        index[[i for i, c in enumerate(chunks) if c]] = self.memory.places([c for c in chunks if c], before)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STREAM_WORDS, side="right")) - 1)
            ids, ends = self.memory.kinds[0].gather(index[codes[offsets[first] : offsets[last]]])
            ends = np.concatenate([[0], ends])[offsets[first : last + 1] - offsets[first]]
            for i in range(last - first):
                yield ids[ends[i] : ends[i + 1]]
            first = last


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, path: str, groups: int, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, g): each text's ids and the end id, cut at multiples of `sequence`; g is the document's group."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        met: Counter = Counter()
        for rows in text_slices(batches, limit=TEXT_BYTES):
            out: list[tuple] = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encode.streams(rows.column("text")), strict=True):
                raw = memoryview(ids.astype("<u4").tobytes() + end)
                total = len(ids) + 1
                key = (doc_id, total, zlib.crc32(raw))
                met[key] += 1  # repeated rows are dealt apart
                g = zlib.crc32(f"{key}{met[key]}".encode()) % groups
                for start in range(0, total, sequence):
                    length = min(sequence, total - start)
                    out.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total, g))
            if len(met) > REPEATS:
                met.clear()
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "g"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, g long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in order of falling lengths (ties in the given order).

    The tree's leaves are the bins' free capacities and each inner node holds the larger of
    its two; going left wherever there is room finds the leftmost bin that fits."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Takes doc_id and text. A null text is empty and still holds its end id; null ids and
    repeated rows are packed like any other; an empty table gives no rows. A text of any
    length is cut into pieces of at most `sequence` ids, each in exactly one sequence.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))

    def fill(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(), sequence)
        return pieces.assign(sequence_id=pieces["g"] * (1 << 32) + bins, offset=offsets).drop(columns="g").astype({"doc_id": "Int64"})

    # written once, so that texts are tokenized once; full pieces need no group and do not shuffle
    pieces = checkpointed(cut_pieces(docs, path or vocabulary_path(), groups, sequence, end_id))
    full = F.col("length") == sequence
    packed = pieces.where(~full).groupBy("g").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    alone = pieces.where(full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    return pack(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
