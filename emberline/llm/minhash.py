"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

A text's set is its distinct word shingles. One permutation scatters shingles over a ring of
slots; a second gives every slot a rank, and coordinate k of the signature is the smallest rank
when that second permutation is shifted by k places, so two permutations give all coordinates.
Bands of coordinates name buckets.

Texts with equal sets are one class from the start. In every bucket each class is checked with
the bucket's smallest class; these stars join most of what belongs together. Only buckets that
then still hold several components compare their members across components: first each
member's few most similar ones by signature, which joins most of the rest, and then, in what is
still mixed, all that hang together by shared buckets, on full sets. Estimates only choose what
is checked first; every pair that shares a bucket is in the end either checked on full sets or in
one component. No bucket is capped: large ones are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded_batches, checkpointed, coded_words, join_group_facts, text_slices

WORDS, PERCENT = 5, 75
#: Coordinates, rows in a band, slots of the ring, seed of the permutations.
COORDINATES, ROWS, SLOTS, SEED = 128, 4, 1 << 20, 20240229
#: Equal coordinates (of 128, one byte each) that a pair in a mixed bucket needs before it is verified.
LEAST_EQUAL = 64
#: Most similar members of other components that each member of a mixed bucket is checked with first.
NEAREST = 3
#: Members of a chunk of signatures in a large bucket, of a block of full sets, partners that share one copy of a leader's text, buckets of the id filter.
BLOCK, SET_BLOCK, PARTNERS, ID_BUCKETS = 256, 256, 64, 1 << 18


@lru_cache(maxsize=1)
def _ring(slots: int, coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(slots).astype(np.int64)
    ranks = rng.permutation(slots).astype(np.int32)
    around = np.concatenate([ranks, ranks[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(text: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: ASCII letters lower-cased, words between runs of ASCII white space."""
    codes, dictionary, offsets = coded_words(pc.ascii_lower(text))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in dictionary.to_pylist()), dtype=np.uint64, count=len(dictionary))[codes]
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
        for k in range(words):
            rolled = rolled * factor + hashes[k : k + len(rolled)]
        rolled = _mixed(rolled + np.uint64(words))
        for i in range(len(text)):
            a, b = offsets[i], offsets[i + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.uint64(0)
                for h in hashes[a:b]:
                    whole = whole * factor + h
                yield _mixed(np.array([whole + np.uint64(b - a)]))
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    scatter, windows = _ring(SLOTS, coordinates, SEED)
    slots = scatter[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)]
    out = windows[slots[:1024]].min(axis=0)
    for start in range(1024, len(slots), 1024):
        np.minimum(out, windows[slots[start : start + 1024]].min(axis=0), out=out)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash binary, bands array<long>, sketch binary); the last three are null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            n, names, bands, bytes_ = [], [], [], []
            for shingles in shingle_sets(rows.column("text")):
                n.append(len(shingles))
                if not len(shingles):
                    names.append(None), bands.append(None), bytes_.append(None)
                    continue
                sig = signature(shingles)
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append([xxhash.xxh3_64_intdigest(part.tobytes(), seed=b) - (1 << 63) for b, part in enumerate(sig.reshape(-1, ROWS))])
                bytes_.append((sig & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
            )

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], step: int = 1 << 22) -> Iterator[np.ndarray]:
    """For each left set, how many elements it has in common with every right set: exact, by an
    inverted index of the right sets, of which about `step` entries are looked at a time."""
    flat = np.concatenate([np.zeros(0, np.uint64), *right])
    order = np.argsort(flat, kind="stable")
    owners = np.repeat(np.arange(len(right), dtype=np.int32), [len(s) for s in right])[order]
    keys, starts = np.unique(flat[order], return_index=True)
    lengths = np.diff(np.append(starts, len(flat)))
    for one in left:
        out = np.zeros(len(right), dtype=np.int64)
        at = np.searchsorted(keys, one)
        at = at[at < len(keys)] if not len(keys) else at[keys[np.minimum(at, len(keys) - 1)] == one]
        each = max(1, step // max(1, len(right)))  # a key has at most one entry for each right set
        for part in (at[i : i + each] for i in range(0, len(at), each)):
            n = lengths[part]
            ends = np.cumsum(n)
            out += np.bincount(owners[np.arange(ends[-1]) + np.repeat(starts[part] - (ends - n), n)], minlength=len(right))
        yield out


def needed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents that can be among `ids`: the others are left out before any
    shuffle, by ID_BUCKETS hash buckets, which bound this broadcast."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS))
    return docs.select(F.col("doc_id").alias("id"), "text").withColumn("part_of_ids", bucket).join(F.broadcast(ids.select(bucket.alias("part_of_ids")).distinct()), "part_of_ids", "left_semi").drop("part_of_ids")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose full sets reach the threshold.

    A leader's text travels once for up to PARTNERS of its partners, so one with very many
    partners is spread over many tasks."""
    total = pairs.count()
    counts = checkpointed(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    dealt = checkpointed(join_group_facts(pairs, counts, "a", "n", total).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PARTNERS).cast("long")).alias("part")))
    need = dealt.select(F.col("b").alias("id"), "a", "part").unionByName(dealt.select(F.col("a").alias("id"), "a", "part").distinct())

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        leader = rows["a"].iloc[0]
        ids = rows["id"].to_numpy()
        sets = list(shingle_sets(pa.array(rows["text"].fillna(""), pa.large_string())))
        own = [s for i, s in zip(ids, sets, strict=True) if i == leader]
        found = sorted({i for i, s in zip(ids, sets, strict=True) if i != leader and any(linked(o, s) for o in own)})
        return pd.DataFrame({"a": np.full(len(found), leader, dtype=np.int64), "b": np.array(found, dtype=np.int64)})

    return needed_texts(docs, need).join(need, "id").groupBy("a", "part").applyInPandas(check, "a long, b long")


def nearest_pairs(members: DataFrame, best: int = NEAREST) -> DataFrame:
    """(a, b), a < b: each member of a mixed bucket with the `best` most similar ones of other components that it meets.

    Takes (bucket, n, id, component, sketch). A bucket over BLOCK members is dealt at random into
    chunks, in every bucket anew, and members meet inside their chunk only: rows grow with the
    members, and what does not meet here is left to `settle`."""
    rows = members.withColumn("chunk", F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / BLOCK).cast("long")))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a, ids, comps = _sketches(block), block["id"].to_numpy(), block["component"].to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for row, one, comp in zip(a, ids, comps, strict=True):
            equal = np.where(comps != comp, (a == row).sum(axis=1), 0)
            fit = np.flatnonzero(equal >= LEAST_EQUAL)
            if len(fit) > best:
                fit = fit[np.lexsort((ids[fit], -equal[fit]))[:best]]
            out.append(np.column_stack([np.full(len(fit), one), ids[fit]]))
        pairs = np.concatenate(out)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).drop_duplicates()

    return rows.groupBy("bucket", "chunk").applyInPandas(compare, "a long, b long").distinct()


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    return (block, block) if i == j else (block[block["own"] == i], block[block["own"] == j])


def _sketches(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)


def settle(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between what shares buckets and is still in different components.

    Texts that hang together by shared buckets form a cluster. Their sets are made once and travel
    once for every block of their cluster, and all pairs of two blocks are checked where they
    meet, so no pair of texts is ever a row and no estimate decides."""
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.first("n").alias("n"))
    total = members.count()
    edges = join_group_facts(members.select("bucket", "id"), checkpointed(hubs), "bucket", "n", total).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    clusters = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    one = checkpointed(members.groupBy("id").agg(F.first("component").alias("component")).join(clusters, "id"))
    sizes = checkpointed(one.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    placed = join_group_facts(one, sizes, "cluster", "size", total).withColumn("blocks", F.ceil(F.col("size") / SET_BLOCK).cast("int"))

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            sets = [s.tobytes() for s in shingle_sets(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "component", "cluster", "blocks")), pa.array(sets, pa.binary())], ["id", "component", "cluster", "blocks", "shingles"])

    sets = placed.join(needed_texts(docs, one), "id").select("id", "component", "cluster", "blocks", "text").mapInArrow(to_sets, "id long, component long, cluster long, blocks int, shingles binary")
    rows = checkpointed(sets).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "shingles")

    def check(block: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(block)
        a, b = ([np.frombuffer(x, dtype=np.uint64) for x in side["shingles"]] for side in (left, right))
        ids, comps = right["id"].to_numpy(), right["component"].to_numpy()
        sizes = np.array([len(x) for x in b])
        found, joined = [], set()  # one link for two components is enough
        for own, one, comp, common in zip(a, left["id"], left["component"], shared_counts(a, b), strict=True):
            for m in np.flatnonzero((comps != comp) & (100 * common >= PERCENT * (sizes + len(own) - common))).tolist():
                if (pair := (min(comp, comps[m]), max(comp, comps[m]))) not in joined:
                    joined.add(pair)
                    found.append((one, ids[m]))
        return pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("cluster", "i", "j").applyInPandas(check, "a long, b long")


def _mixed_members(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, n, id, component, sketch) of the buckets that hold several components; a bucket of two was settled by its star."""
    now = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    facts = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") > 2))
    mixed = checkpointed(join_group_facts(now, checkpointed(facts.select("bucket", "n")), "bucket", "n", members.count()))
    return checkpointed(mixed.join(classes.select("id", "sketch"), "id").select("bucket", "n", "id", "component", "sketch"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and empty texts have an empty set and are linked with nothing; rows that repeat an id
    share its component, and where an id comes with several texts, all of them count as its
    own; a document without an id is linked with nothing and kept, its component null. An empty
    table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_ = checkpointed(sketches(docs))
    linked = F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()
    some = all_.where(linked)
    classes = checkpointed(some.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    members = classes.select("id", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    stars = checkpointed(stars)
    shared = checkpointed(join_group_facts(members, stars, "bucket", "n", classes.count()).select("bucket", "id", "a"))
    tried = checkpointed(shared.where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b")).distinct())
    links = checkpointed(verify(tried, docs).distinct())
    labels = components(links)
    members = _mixed_members(shared.select("bucket", "id"), labels, classes)
    if not members.isEmpty():
        more = checkpointed(nearest_pairs(members).join(tried, ["a", "b"], "left_anti"))
        links = checkpointed(links.unionByName(verify(more, docs).distinct()))
        labels = components(links)
        members = _mixed_members(members.select("bucket", "id"), labels, classes)
    if not members.isEmpty():
        links = checkpointed(links.unionByName(settle(members, docs)).distinct())
        labels = components(links)
    facts = checkpointed(classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_hash", "copies", F.coalesce("component", "id").alias("component_id")))
    joined = join_group_facts(some.select("doc_id", "n_shingles", "set_hash"), facts, "set_hash", "copies", all_.count()).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(all_.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies (the smallest doc_id), columns as they are."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    return near_duplicates(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
