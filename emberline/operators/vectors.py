"""Exact cosine search of a stated query set over all rows, block by block.

The work is the query set times all rows; no task holds more than one block of queries and one
group of candidates, and groups are dealt by a hash, so no level or vector can be hot."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, most and least candidates in a group, candidates scored at once, digits that scores are ranked by.
QUERY_BLOCK, GROUP, LEAST, STEP, DIGITS = 2048, 32768, 1024, 2048, 9
#: Lower ends of the strong and medium bands.
STRONG, MEDIUM = 0.70, 0.40
#: Stands for NaN below all cosines while ranking.
NONE = -2.0


def _unit(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, ties to the smaller id; -inf is never taken."""
    at = scores.shape[1] - min(k, scores.shape[1])
    row, col = np.nonzero((scores >= np.partition(scores, at, axis=1)[:, at, None]) & (scores > -np.inf))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], col[keep]


def neighbours(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int, level_column: str | None = None, group_size: int = GROUP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query row the k rows of highest cosine among all rows but itself; with a level column, k of each level.

    Returns query_id, level (if asked for; null is a level), rank from 1 (ties to the smaller id),
    vec_id, score, and over all scored rows of the query (and level): total, strong (>= .70),
    medium and weak. Ids are unique; rows with a null id or component or a null or empty vector are left out, and
    vectors meet only those of their own length. A vector of no length scores NaN: weak, ranked last."""

    def fine(df: DataFrame) -> DataFrame:
        v = F.col(vector_column).cast("array<double>")
        level = F.col(level_column) if level_column else F.lit(None)
        return df.where(F.col(id_column).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())).select(F.col(id_column).cast("long").alias("id"), v.alias("v"), level.cast("string").alias("level"), F.size(v).alias("dim"))

    slots = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    n = vectors.count()
    groups = max(1, math.ceil(n / max(LEAST, min(group_size, math.ceil(n / slots)))))
    blocks = max(1, math.ceil(queries.count() / query_block))
    candidates = fine(vectors).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = fine(queries).drop("level").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = ["query_id", "level", "vec_id", "score", "total", "strong", "medium"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            q, qid = _unit(right["v"]), right["id"].to_numpy()
            for level, own in left.groupby("level", dropna=False, sort=False):
                for start in range(0, len(own), STEP):
                    some = own.iloc[start : start + STEP]
                    ids = some["id"].to_numpy()
                    with np.errstate(invalid="ignore"):
                        scores = q @ _unit(some["v"]).T
                    other = ids[None, :] != qid[:, None]
                    scores = np.where(np.isnan(scores), NONE, np.round(scores, DIGITS))
                    total, strong, medium = (x.sum(axis=1) for x in (other, other & (scores >= STRONG), other & (scores >= MEDIUM) & (scores < STRONG)))
                    scores[~other] = -np.inf
                    row, col = _best(scores, ids, k)
                    first = np.r_[True, row[1:] != row[:-1]][: len(row)]  # counts go with a query's first row
                    parts.append(pd.DataFrame({"query_id": qid[row], "level": None if pd.isna(level) else level, "vec_id": ids[col], "score": scores[row, col], "total": total[row] * first, "strong": strong[row] * first, "medium": medium[row] * first}))
        return pd.concat(parts)[columns] if parts else pd.DataFrame({c: [] for c in columns})

    found = candidates.groupBy("g", "b", "dim").cogroup(asked.groupBy("g", "b", "dim")).applyInPandas(search, "query_id long, level string, vec_id long, score double, total long, strong long, medium long")
    own = Window.partitionBy("query_id", "level")
    counts = [F.sum(c).over(own).alias(c) for c in ("total", "strong", "medium")]
    ranked = found.select("query_id", "level", "vec_id", "score", *counts, F.row_number().over(own.orderBy(F.col("score").desc(), "vec_id")).alias("rank")).where(F.col("rank") <= k)
    level = [F.col("level").cast(vectors.schema[level_column].dataType).alias("level")] if level_column else []
    score = F.when(F.col("score") > NONE, F.col("score")).otherwise(F.lit(float("nan"))).alias("score")
    return ranked.select("query_id", *level, "rank", "vec_id", score, "total", "strong", "medium", (F.col("total") - F.col("strong") - F.col("medium")).alias("weak"))
