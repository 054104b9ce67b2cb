"""Byte-level BPE by recursive DuckDB queries inside each partition.

A text falls into chunks at single spaces, which never cut a match of the splitting pattern;
chunks fall into words by the pattern. Each worker merges a distinct word once for as long as
it remembers it: rows (word, position, token) join the merge table, each word's leftmost pair
of minimum rank is contracted, and the recursion ends when no word has a pair left. An ordered
aggregation turns ids back into bytes. Ids and bytes of whole texts are then gathered by chunk.

There are two such queries. In that for short words a step contracts one pair of a word. In that
for long ones it contracts the pair's further occurrences too, from left to right, where that
is the same as one after another: where no longer token that a merged one can become part of
has a lower rank, so nothing can come between. So a word of any length takes at most a step for
each rank that occurs in it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, Pieces, bounded_batches, text_slices

RANKS = "byte_bpe_50k.tiktoken"
#: The part of a pattern that takes a run of letters, with a space before it, as one match, if the parts before it all start with an apostrophe.
LETTERS = r" ?\p{L}+"
#: Bytes of distinct words in one recursive query (a longer word comes alone), bytes of a long word, and chunks gathered at a time.
QUERY_BYTES, LONG_BYTES, STREAM_CHUNKS = 1 << 20, 64, 1 << 18
#: Bytes that a worker's memory of words and chunks may take, and bytes of text in a slice.
MEMORY_BYTES, TEXT_BYTES = 160 << 20, 6 << 20

#: The live rows of a word are contracted until it has no pair left; its last rows are marked done. A pair
#: is known by its rank and, in the lower 32 bits, its place.
MERGE_SQL = """
WITH RECURSIVE steps(word, pos, token, done) AS (
    SELECT word, pos, token, false FROM start
  UNION ALL
    (WITH pairs AS MATERIALIZED (
       SELECT t.word, t.pos, t.token, t.before, (m.merged::BIGINT << 32) | t.pos AS pair
       FROM (SELECT word, pos, token, lead((word::BIGINT << 32) | token) OVER w AS after, lag(pos) OVER w AS before FROM steps WHERE NOT done WINDOW w AS (ORDER BY pos)) t
       LEFT JOIN merges m ON m.first = t.token AND m.second = (t.after & 4294967295)::INTEGER AND (t.after >> 32) = t.word),
     least AS (SELECT word, min(pair) AS least FROM pairs GROUP BY word)
     SELECT word, pos, CASE WHEN pair = least THEN (least >> 32)::INTEGER ELSE token END, least IS NULL
     FROM pairs JOIN least USING (word)
     WHERE least IS NULL OR before IS NULL OR before <> least & 4294967295))
SELECT word, token FROM steps WHERE done ORDER BY pos
"""

#: The same for long words. `single` marks ranks that may be contracted only once a step. Of pairs that
#: overlap (only inside a word, as its last token has none) every other one is taken, by places over all live rows.
LONG_MERGE_SQL = """
WITH RECURSIVE steps(word, pos, token, done) AS (
    SELECT word, pos, token, false FROM start
  UNION ALL
    (WITH pairs AS MATERIALIZED (
       SELECT t.word, t.pos, t.token, t.place, m.merged, m.single
       FROM (SELECT word, pos, token, lead((word::BIGINT << 32) | token) OVER w AS after, row_number() OVER w AS place FROM steps WHERE NOT done WINDOW w AS (ORDER BY pos)) t
       LEFT JOIN merges m ON m.first = t.token AND m.second = (t.after & 4294967295)::INTEGER AND (t.after >> 32) = t.word),
     least AS (SELECT word, min(merged) AS rank, min((merged::BIGINT << 32) | pos) & 4294967295 AS leftmost FROM pairs GROUP BY word),
     chosen AS (
       SELECT word, pos, token, rank, CASE WHEN merged IS NULL OR merged <> rank THEN false WHEN single THEN pos = leftmost
         ELSE (place - coalesce(max(CASE WHEN merged IS NULL OR merged <> rank THEN place END) OVER (ORDER BY pos), 0)) % 2 = 1 END AS joins
       FROM pairs JOIN least USING (word))
     SELECT word, pos, CASE WHEN joins THEN rank ELSE token END, rank IS NULL
     FROM (SELECT *, lag(joins, 1, false) OVER (ORDER BY pos) AS joined FROM chosen) WHERE NOT joined))
SELECT word, token FROM steps WHERE done ORDER BY pos
"""

DECODE_SQL = """
SELECT t.word, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocabulary v USING (token) GROUP BY t.word ORDER BY t.word
"""


class Codec:
    """Encodes and decodes with one rank file; what words and chunks became is remembered by the worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        # white space by its Unicode property, without the control characters that Python adds
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        parts = pattern.split("|")
        self.takes_letters = LETTERS in parts and all(p.startswith("'") for p in parts[: parts.index(LETTERS)])
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.largest = max(ranks.values())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": "false", "temp_directory": ""})
        pairs = np.array([(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks], dtype=np.int32).reshape(-1, 3)
        lowest = np.full(self.largest + 1, self.largest + 1, dtype=np.int32)  # rank that a token can become part of
        for part in (0, 1):
            np.minimum.at(lowest, pairs[:, part], pairs[:, 2])
        self._load("merges", first=pairs[:, 0], second=pairs[:, 1], merged=pairs[:, 2], single=lowest[pairs[:, 2]] < pairs[:, 2])
        self._load("vocabulary", token=np.array(list(ranks.values()), dtype=np.int32), hex=[w.hex() for w in ranks])
        self.memory = Memory(np.uint16 if self.largest < 1 << 16 else np.uint32, np.uint8, limit=MEMORY_BYTES)

    def _load(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    @staticmethod
    def _parts(lengths: np.ndarray, limit: int = QUERY_BYTES) -> Iterator[slice]:
        """Consecutive items of about `limit` in all; a longer one comes alone."""
        ends, start = np.cumsum(lengths), 0
        while start < len(lengths):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
            yield slice(start, stop)
            start = stop

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end by the recursive queries, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths > LONG_BYTES, kind="stable")  # short ones first
        sizes, shorts = lengths[order], int((lengths <= LONG_BYTES).sum())
        found, counts = Pieces(np.int32), np.zeros(len(words), dtype=np.int64)
        for query, first, last in ((MERGE_SQL, 0, shorts), (LONG_MERGE_SQL, shorts, len(words))):
            for part in self._parts(sizes[first:last]):
                at = order[first + part.start : first + part.stop]
                flat = self.of_byte[np.frombuffer(b"".join([words[i] for i in at.tolist()]), dtype=np.uint8)]
                self._load("start", word=np.repeat(np.arange(len(at), dtype=np.int32), lengths[at]), pos=np.arange(len(flat), dtype=np.int32), token=flat)
                rows = self.db.execute(query).fetchnumpy()
                counts[at] = np.bincount(rows["word"], minlength=len(at))
                found.extend(rows["token"], counts[at])
        return found.gather(np.argsort(order))[0], counts

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of ids that lie end to end by an ordered aggregation, and how many each has; unknown ids raise."""
        if len(ids) and (ids.min() < 0 or ids.max() > self.largest):
            raise ValueError("an id is not in the vocabulary")
        out, sizes, start = [np.zeros(0, np.uint8)], np.zeros(len(counts), dtype=np.int64), 0
        for part in self._parts(counts):
            flat = ids[start : (start := start + int(counts[part].sum()))].astype(np.int32)
            self._load("tokens", word=np.repeat(np.arange(part.start, part.stop), counts[part]), pos=np.arange(len(flat)), token=flat)
            found = self.db.sql(DECODE_SQL).to_arrow_table()
            hex_ = found.column("hex").combine_chunks()
            out.append(np.frombuffer(bytes.fromhex("".join(hex_.to_pylist())), dtype=np.uint8))
            sizes[found.column("word").to_numpy()] = pc.binary_length(hex_).to_numpy(zero_copy_only=False) // 2
        return np.concatenate(out), sizes

    def _learn(self, chunks: Iterable[str]) -> None:
        """Remembers the chunks and the words that they fall into; a chunk of one word is that word."""
        at = self.memory.at
        new = [c for c in dict.fromkeys(chunks) if c not in at]
        found = self.pattern.findall
        rest = [c for c in new if not c.removeprefix(" ").isalpha()] if self.takes_letters else new  # the others are one match
        falls = {c: ws for c in rest if len(ws := found(c)) != 1}
        words = [w for w in dict.fromkeys([*(c for c in new if c not in falls), *(w for ws in falls.values() for w in ws)]) if w not in at]
        ids, counts = self.merge_words([w.encode() for w in words])
        self.memory.add(words, (ids, counts), self.decode_many(ids, counts))
        falls = {c: ws for c, ws in falls.items() if c not in at}
        places = np.fromiter((at[w] for ws in falls.values() for w in ws), dtype=np.int64)
        firsts = np.concatenate([[0], np.cumsum([len(ws) for ws in falls.values()], dtype=np.int64)])
        parts = []
        for kind in self.memory.kinds:
            flat, ends = kind.gather(places)
            parts.append((flat, np.diff(np.concatenate([[0], ends])[firsts])))
        self.memory.add(list(falls), *parts)

    def texts(self, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, decoded bytes) of each text."""
        self.memory.trim()
        before = len(self.memory.at)
        lists = pc.split_pattern(text, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        parts = coded.dictionary.to_pylist()
        # a cut at a space is safe only between two characters that are no white space
        unsafe = np.array([not p or p[0].isspace() or p[-1].isspace() for p in parts], dtype=bool)
        whole = np.zeros(len(text), dtype=bool)  # texts with an unsafe cut are one chunk each
        bad = unsafe[codes]
        if bad.any():
            whole = np.add.reduceat(bad, offsets[:-1]) > 0
        inner = [" " + p for p in parts]
        firsts = [parts[c] for c in codes[offsets[:-1]].tolist()]
        longs = {i: text[i].as_py() for i in np.flatnonzero(whole).tolist()}
        safe = [c for c, bad in zip(inner, unsafe.tolist(), strict=True) if not bad]
        self._learn([*safe, *(f for f, w in zip(firsts, whole.tolist(), strict=True) if not w), *longs.values()])
        index = np.zeros(len(parts), dtype=np.int64)
        index[~unsafe] = self.memory.places(safe, before)
        chunk = index[codes]
        starts = self.memory.places([longs.get(i, f) for i, f in enumerate(firsts)], before)
        chunk[offsets[:-1]] = starts
        single = np.flatnonzero(whole)
        keep = np.ones(len(chunk), dtype=bool)
        for i in single.tolist():
            keep[offsets[i] + 1 : offsets[i + 1]] = False
        chunk = chunk[keep]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        first = 0
        while first < len(text):
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STREAM_CHUNKS, side="right")) - 1)
            at = offsets[first : stop + 1] - offsets[first]
            (ids, ends), (data, data_ends) = (kind.gather(chunk[offsets[first] : offsets[stop]]) for kind in self.memory.kinds)
            ends, data_ends = np.concatenate([[0], ends])[at], np.concatenate([[0], data_ends])[at]
            for i in range(stop - first):
                yield ids[ends[i] : ends[i + 1]], data[data_ends[i] : data_ends[i + 1]]
            first = stop


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null text is empty and has no ids."""
    path, pattern = path or paths()[0], pattern or paths()[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, limit=TEXT_BYTES):
            ids = [i.astype(np.int32) for i, _ in codec(path, pattern).texts(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids); null lists are empty, unknown ids raise."""
    path, pattern = path or paths()[0], pattern or paths()[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in rows.column("ids").to_pylist()]
            data, sizes = codec(path, pattern).decode_many(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], dtype=np.int64))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([data[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256.

    Every row gives a row: null and empty texts have no tokens, repeated rows and null ids are
    kept, an empty table gives none, and a text of any length is encoded whole."""
    path, pattern = path or paths()[0], pattern or paths()[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, limit=TEXT_BYTES):
            n, ids_sha, data_sha = [], [], []
            for ids, data in codec(path, pattern).texts(rows.column("text")):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                data_sha.append(hashlib.sha256(data.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    return digests(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
