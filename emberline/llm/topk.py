"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length, longest first. With the k-th best score so far, a bucket gets
a local cosine threshold for every query: the cosine that its longest vector would need. Above
1 the bucket and all shorter ones are skipped; a high threshold prunes by the coordinate in
which the query is largest, a lower one by length alone. What is left is verified with exact
integer products, so pruning never changes a result.

Every query meets every candidate group in blocks: the work is the stated query set times all
rows, and no task holds more than one block of queries and one group of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
#: Vectors in a norm bucket, queries in a block, most candidates in a group.
BUCKET, QUERY_BLOCK, GROUP = 1024, 4096, 32768
#: From this local cosine threshold on a bucket is pruned by coordinate.
COORDINATE_FROM = 0.5
#: The largest integer that a double holds with all below it.
EXACT = float(1 << 53)


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<bigint>, dim): floor(scale * x). Rows with a null id or vector, or with null or non-finite components, are left out."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return (
        df.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
        .where(fine)
        .select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))
        .withColumn("dim", F.size("v"))
    )


def _products(queries: np.ndarray, vectors: np.ndarray, small: bool) -> np.ndarray:
    """Integer products: by doubles where every partial sum is exact, else in 64-bit integers."""
    if small:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def search_group(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Top k of one candidate group for each query: (query row, candidate id, score), and counts of what was pruned."""
    norms = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((cid, -norms))
    cid, c, norms = cid[order], c[order], norms[order]
    q_norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    dim = q.shape[1]
    largest = float(max(np.abs(q).max(initial=0), 1)) * float(max(np.abs(c).max(initial=0), 1)) * max(dim, 1)
    small = largest < EXACT
    slack = 1e-9 * largest + 1e-6  # rounding in the bounds never prunes a tie
    focus = np.abs(q).argmax(axis=1) if dim else np.zeros(len(q), dtype=np.int64)
    unit = q[np.arange(len(q)), focus] / np.maximum(q_norms, 1e-300) if dim else np.zeros(len(q))
    best_score = np.zeros((len(q), 0), dtype=np.int64)
    best_id = np.zeros((len(q), 0), dtype=np.int64)
    floor = np.full(len(q), -np.inf)  # the k-th best score so far
    stats = {"length": 0, "coordinate": 0, "verified": 0}
    for start in range(0, len(c), bucket):
        vectors, ids, lengths = c[start : start + bucket], cid[start : start + bucket], norms[start : start + bucket]
        need = (floor - slack) / np.maximum(q_norms * lengths[0], 1e-300)
        alive = np.flatnonzero(need <= 1.0)
        stats["length"] += (len(q) - len(alive)) * len(ids)
        if not len(alive):
            continue
        scores = np.full((len(alive), len(ids)), np.iinfo(np.int64).min, dtype=np.int64)
        valid = np.zeros((len(alive), len(ids)), dtype=bool)
        by_coordinate = need[alive] >= COORDINATE_FROM
        rest = np.flatnonzero(~by_coordinate)
        if len(rest):
            rows = alive[rest]
            # length pruning: the prefix of the bucket that is long enough for any of these queries
            keep = int(np.searchsorted(-lengths, -np.min((floor[rows] - slack) / np.maximum(q_norms[rows], 1e-300)), side="right"))
            scores[rest, :keep] = _products(q[rows], vectors[:keep], small)
            valid[rest, :keep] = True
            stats["verified"] += len(rest) * keep
            stats["length"] += len(rest) * (len(ids) - keep)
        directions = vectors / np.maximum(lengths, 1e-300)[:, None]
        chosen = np.flatnonzero(by_coordinate)
        for f in np.unique(focus[alive[chosen]]) if len(chosen) else ():
            # cosine >= t needs the angles to axis f to differ by at most arccos(t)
            mine = chosen[focus[alive[chosen]] == f]
            angle, turn = np.arccos(np.clip(unit[alive[mine]], -1, 1)), np.arccos(np.minimum(need[alive[mine]], 1.0))
            low, high = np.cos(np.minimum(angle + turn, np.pi)) - 1e-9, np.cos(np.maximum(angle - turn, 0)) + 1e-9
            ranked = np.argsort(directions[:, f], kind="stable")
            line = directions[ranked, f]
            left, right = np.searchsorted(line, low, "left"), np.searchsorted(line, high, "right")
            a, b = int(left.min()), int(right.max())
            inside = ranked[a:b]
            stats["coordinate"] += len(mine) * (len(ids) - len(inside))
            stats["verified"] += len(mine) * len(inside)
            if len(inside):
                scores[np.ix_(mine, inside)] = _products(q[alive[mine]], vectors[inside], small)
                valid[np.ix_(mine, inside)] = True
        valid &= ids[None, :] != qid[alive][:, None]
        # merge with what each query has: highest score first, then the smaller id
        width = best_score.shape[1]
        all_scores = np.concatenate([best_score[alive], scores], axis=1)
        all_ids = np.concatenate([best_id[alive], np.broadcast_to(ids, scores.shape)], axis=1)
        known = np.concatenate([best_score[alive] > np.iinfo(np.int64).min, valid], axis=1)
        all_scores = np.where(known, all_scores, np.iinfo(np.int64).min)
        size = min(k, all_scores.shape[1])
        cut = np.partition(all_scores, all_scores.shape[1] - size, axis=1)[:, all_scores.shape[1] - size]
        top_s = np.full((len(alive), size), np.iinfo(np.int64).min, dtype=np.int64)
        top_i = np.zeros((len(alive), size), dtype=np.int64)
        for r in range(len(alive)):
            near = np.flatnonzero((all_scores[r] >= cut[r]) & known[r])
            near = near[np.lexsort((all_ids[r, near], -all_scores[r, near]))][:size]
            top_s[r, : len(near)], top_i[r, : len(near)] = all_scores[r, near], all_ids[r, near]
        if size > width:
            pad = size - width
            best_score = np.concatenate([best_score, np.full((len(q), pad), np.iinfo(np.int64).min, dtype=np.int64)], axis=1)
            best_id = np.concatenate([best_id, np.zeros((len(q), pad), dtype=np.int64)], axis=1)
        best_score[alive, :size], best_id[alive, :size] = top_s, top_i
        if best_score.shape[1] == k:
            last = best_score[:, k - 1]
            floor = np.where(last > np.iinfo(np.int64).min, last.astype(np.float64), -np.inf)
    rows, ranks = np.nonzero(best_score > np.iinfo(np.int64).min)
    return rows, best_id[rows, ranks], best_score[rows, ranks], stats


def top_k(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: int = SCALE, group_size: int = GROUP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query row its k highest integer inner products over all rows but those with its own id.

    Returns query_id, rank (from 1; ties to the smaller id), vec_id, score. Vectors meet only
    vectors of their own dimension. Rows with a null id, a null vector or null or non-finite
    components take no part, as query or candidate. Repeated rows are candidates each; a
    repeated query id is asked once (its smallest vector). Sums beyond 64 bits wrap.
    """
    candidates = quantised(vectors, id_column, vector_column, scale)
    asked = quantised(queries, id_column, vector_column, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = vectors.count()
    slots = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, math.ceil(n / max(BUCKET, min(group_size, math.ceil(n / slots)))))
    blocks = max(1, math.ceil(queries.count() / query_block))
    # groups are dealt by a hash, so each holds a like share of every length and no length can be hot
    candidates = candidates.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["g", "b", "dim"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        c, q = (np.array(x["v"].tolist(), dtype=np.int64).reshape(len(x), -1) for x in (left, right))
        row, ids, scores, _ = search_group(right["id"].to_numpy(), q, left["id"].to_numpy(), c, k)
        return pd.DataFrame({"query_id": right["id"].to_numpy()[row], "vec_id": ids, "score": scores})

    parts = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    vectors = rows_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
