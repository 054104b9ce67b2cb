"""Exact dedup by two passes over a Bloom filter with two-bit counters.

Pass one sets every text hash's bits in each partition and merges the partitions' filters; a
bit that two partitions set, or that two rows of one partition set as repeats, counts as met
twice. Pass two looks every hash up: rows whose bits were not all met twice are certainly
unique and pass straight through; only the others shuffle, and are grouped by their full hash.

The filter has 16 bits a row up to FILTER_BITS, a proven bound for what is broadcast. Beyond
that more rows shuffle for nothing, but results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import bounded_batches, checkpointed, join_group_facts

#: Name of the added column; documents' own columns may have any name, as they travel in a struct.
MAYBE = "maybe"
#: Largest filter in bits (32 MB to broadcast), bits of a row and of a segment that is merged by itself, hash functions.
FILTER_BITS, BITS_A_ROW, SEGMENT_BITS, HASHES = 1 << 28, 16, 1 << 16, 3


def text_hash(text: str = "text") -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ").cast("binary"), 256))


def filter_bits(rows: int) -> int:
    return min(FILTER_BITS, max(SEGMENT_BITS, 1 << (max(1, rows) * BITS_A_ROW - 1).bit_length()))


def _positions(hashes: pa.Array, bits: int) -> np.ndarray:
    """Bit positions of each hash, a row each: double hashing over the first 16 bytes."""
    data = np.frombuffer(b"".join(h[:16] for h in hashes.to_pylist()), dtype="<u8").reshape(-1, 2)
    step = data[:, 1] | np.uint64(1)
    return np.stack([(data[:, 0] + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def _are_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def repeated_filter(hashed: DataFrame, rows: int, column: str = "sha") -> np.ndarray:
    """The merged filter of what may be repeated, as bytes of packed bits. A task holds two such filters, 64 MB at most."""
    bits = filter_bits(rows)

    def insert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = _positions(batch.column(0), bits)
            met = _are_set(once, at).all(axis=1)  # before this batch, or earlier in it:
            first = np.unique(at, axis=0, return_index=True)[1]
            met |= ~np.isin(np.arange(len(at)), first)
            _set(twice, at[met].ravel())
            _set(once, at.ravel())
        step = SEGMENT_BITS // 8
        for k in range(bits // SEGMENT_BITS):
            a, b = (np.flatnonzero(np.unpackbits(x[k * step : (k + 1) * step])).astype("<u2").tobytes() for x in (once, twice))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["segment", "once", "twice"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        met, twice = np.zeros(SEGMENT_BITS, dtype=np.int64), np.zeros(SEGMENT_BITS, dtype=bool)
        for a, b in zip(parts["once"], parts["twice"], strict=True):
            met[np.frombuffer(a, dtype="<u2")] += 1
            twice[np.frombuffer(b, dtype="<u2")] = True
        return pd.DataFrame({"segment": parts["segment"].iloc[:1], "bits": [np.packbits(twice | (met > 1)).tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    parts = bounded_batches(hashed.select(column)).mapInArrow(insert, "segment int, once binary, twice binary")
    for row in parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect():
        out[row["segment"] * SEGMENT_BITS // 8 : (row["segment"] + 1) * SEGMENT_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def mark_possible(hashed: DataFrame, filter_: np.ndarray, column: str = "sha") -> DataFrame:
    """The rows with MAYBE: whether their hash may be repeated. Rows stay in their partitions."""
    shared = hashed.sparkSession.sparkContext.broadcast(filter_)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            at = _positions(batch.column(batch.schema.get_field_index(column)), len(packed) * 8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_are_set(packed, at).all(axis=1))], [*batch.schema.names, MAYBE])

    return bounded_batches(hashed).mapInArrow(look, StructType([*hashed.schema.fields, StructField(MAYBE, BooleanType())]))


def group_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Of equal texts the smallest doc_id stays (a null id only among
    nulls); of repeated rows one stays. An empty table gives no rows."""
    hashed = checkpointed(docs.select(F.col("doc_id").cast("long"), text_hash().alias("sha"), F.monotonically_increasing_id().alias("row")))
    total = hashed.count()
    marked = mark_possible(hashed, repeated_filter(hashed, total))
    single = marked.where(~F.col(MAYBE)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = checkpointed(marked.where(MAYBE).drop(MAYBE))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    facts = checkpointed(maybe.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    grouped = join_group_facts(maybe, facts, "sha", "group_size", total).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "sha")
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with one row for each text, columns as they are, whatever their names and types:
    unique rows pass straight through, of the others the row with the smallest doc_id (null last)
    stays, of repeated ids the one that is read first."""
    own = docs.columns
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), text_hash().alias("sha"), F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("place"))
    marked = mark_possible(hashed, repeated_filter(hashed, docs.count()))
    first = F.struct(F.col("id").isNull(), "id", "place")
    kept = marked.where(MAYBE).groupBy("sha").agg(F.min_by("row", first).alias("row"))
    return marked.where(~F.col(MAYBE)).select("row").unionByName(kept.select("row")).select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    return group_copies(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
