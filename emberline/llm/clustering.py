"""Exact k-means over integer vectors by Exponion search.

Every vector carries its centroid, an upper bound u of the distance to it and a lower bound l of the
distance to any other. When centroids move, u grows by its centroid's move and l shrinks by
the largest move of the others. A vector whose u stays below l, or below half the distance s
from its centroid to the nearest other one, keeps its centroid unseen. For the rest u is made exact,
and if that does not settle it, only centroids within 2u + s of its own one are scanned, a prefix of
that centroid's list of the others sorted by distance. The nearest two lie in that ball: the nearest within
2u, the second within 2u + s. The radius is inclusive and bounds are compared with slack, so
a centroid at the same distance is always scanned, and the smaller number wins.

A round is one pass over the vectors where they lie; only sums by centroid are shuffled, and
only centroids, k of them, come to the driver and go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Rounds
from .common import bounded_batches

#: The contract's run: clusters, rounds, components and their scale.
K, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Components beyond this count as this, so that every distance fits into 64 bits.
LARGEST = 1 << 27
#: Products below this are exact in doubles.
EXACT = float(1 << 53)
#: Bounds are held in doubles and compared with this relative slack.
SLACK = 1e-9
#: Vectors that are scanned at a time.
STEP = 8192


def kept_vectors(df: DataFrame, id_column: str, vector_column: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of vectors with exactly `dim` components, none null or non-finite."""
    x = F.col(vector_column).cast("array<double>")
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.least(F.floor(c * F.lit(float(scale))), F.lit(LARGEST)), F.lit(-LARGEST))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: held(c).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """Vectors with the k smallest sha256 of `2:<id>` (a null id as nothing), in that order; ties to the smaller vector."""
    drawn = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all rows of c."""
    width = max(v.shape[1], 1) * 4.0 * float(max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))) ** 2
    if width < EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (v @ c.T)


class Centroids:
    """Centroids with the sorted lists of distances between them, and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        k = len(now)
        self.now = now
        between = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable").astype(np.int64)
        for j in range(k):  # a centroid is first in its own list, also if others coincide with it
            self.order[j] = np.concatenate([[j], self.order[j][self.order[j] != j]])
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((now - before).astype(np.float64) ** 2).sum(axis=1))
        ranked = np.sort(self.moved)[::-1]
        self.other_moved = np.where(np.arange(k) == int(self.moved.argmax()), ranked[1] if k > 1 else 0.0, ranked[0])

    def assign(self, v: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """(centroid, upper, lower) of each vector, and counts of what was done; without bounds all centroids are scanned."""
        n, k = len(v), len(self.now)
        stats = {"kept": 0, "tightened": 0, "scanned": 0, "all": n * k}
        if own is None:
            own, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros(n)
            self._scan(v, np.arange(n), np.arange(k), own, upper, lower)
            stats["scanned"] = n * k
            return own, upper, lower, stats
        own, upper, lower = own.astype(np.int64), upper + self.moved[own], np.maximum(lower - self.other_moved[own], 0.0)
        floor = np.maximum(lower, self.nearest[own] / 2) * (1 - SLACK)
        open_ = np.flatnonzero(upper * (1 + SLACK) >= floor)
        stats["kept"] = n - len(open_)
        for at in (open_[i : i + STEP] for i in range(0, len(open_), STEP)):
            apart = (v[at] - self.now[own[at]]).astype(np.float64)
            upper[at] = np.sqrt((apart * apart).sum(axis=1))
            still = at[upper[at] * (1 + SLACK) >= floor[at]]
            stats["tightened"] += len(at) - len(still)
            radius = (2 * upper[still] + self.nearest[own[still]]) * (1 + SLACK) + SLACK
            inside = np.array([np.searchsorted(self.sorted[a], r, side="right") for a, r in zip(own[still].tolist(), radius.tolist(), strict=True)], dtype=np.int64)
            # lists grow by doubling, so vectors of one centroid are scanned in a few products
            sizes = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64), k)
            group = own[still] * (2 * k + 1) + sizes
            order = np.argsort(group, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else ():
                a, m = int(own[still[part[0]]]), int(sizes[part[0]])
                stats["scanned"] += len(part) * m
                self._scan(v, still[part], np.sort(self.order[a][:m]), own, upper, lower)
        return own, upper, lower, stats

    def _scan(self, v: np.ndarray, at: np.ndarray, among: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        for rows in (at[i : i + STEP] for i in range(0, len(at), STEP)):
            d = squared(v[rows], self.now[among])
            best = d.argmin(axis=1)  # the first of equals is the smallest number
            own[rows] = among[best]
            upper[rows] = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64))
            if len(among) > 1:
                lower[rows] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
            else:  # nothing else within 2u + s, and s is infinite only for a single centroid
                lower[rows] = np.inf


def assign(table: DataFrame, now: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """(id, v, cluster, upper, lower) of vectors or, with centroids from before, of rows that already have bounds."""
    sent = table.sparkSession.sparkContext.broadcast((now, before))  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(*sent.value)
        for rows in batches:
            v = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            bounds = (None, None, None) if before is None else (rows.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            own, upper, lower, _ = centroids.assign(v, *bounds)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], ["id", "v", "cluster", "upper", "lower"])

    return bounded_batches(table).mapInArrow(run, "id long, v array<bigint>, cluster int, upper double, lower double")


def moved(table: DataFrame, now: np.ndarray) -> np.ndarray:
    """Componentwise exact floor(sum / count) of each cluster's vectors; an empty cluster's centroid stays."""
    sums = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("v")[i]) for i in range(now.shape[1]))).alias("total")).collect()  # k rows at most
    out = now.copy()
    for r in sums:
        out[r["cluster"]] = np.array(r["total"], dtype=np.int64) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, v, cluster, distance), centroids): `rounds` rounds of assignment and update from the first centroids, and a last assignment.

    Takes what `kept_vectors` gives. Null ids and repeated rows are vectors like others, ties go to the
    smaller centroid number, fewer vectors than k give fewer clusters, and no vectors give no rows. Sums
    beyond 64 bits raise (a cluster would need over 2^36 vectors of the largest components)."""
    kept = Rounds(vectors.sparkSession)
    table = kept.keep(vectors)
    now, before = first_centroids(table, k), None
    if not len(now):
        return kept.result(table.selectExpr("id", "v", "0 AS cluster", "0L AS distance")), now
    table = kept.keep(assign(table, now, None))
    for _ in range(rounds):
        now, before = moved(table, now), now
        table = kept.keep(assign(table, now, before))
    centroid = F.element_at(F.array(*(F.array(*(F.lit(int(x)) for x in c)) for c in now)), F.col("cluster") + 1).cast("array<bigint>")
    distance = F.aggregate(F.zip_with("v", centroid, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return kept.result(table.select("id", "v", "cluster", distance.alias("distance"))), now


def summary(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, with its cluster's and all clusters' inertia (null where beyond 64 bits) and the digest of its centroid."""
    sums = [(r["cluster"], r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()]  # k rows at most
    fits = lambda x: int(x) if x < 1 << 63 else None
    total = fits(sum(s for _, s in sums))
    facts = [(j, fits(s), total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums]
    few = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return summary(*cluster(kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")))


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """Every round in full: all distances, the least, exact means."""
    parts = [f"""WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, v, list_dot_product(v, v) AS vv FROM fine),
c0 AS MATERIALIZED (
  SELECT v AS c, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j FROM v QUALIFY j < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, s.j AS j, s.d AS d FROM (
    SELECT vec_id, any_value(v) AS v, min({{'d': vv + list_dot_product(c, c) - 2 * list_dot_product(v, c), 'j': j}}) AS s FROM v, c{r} GROUP BY vec_id))""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT j, i, floor(sum(x) / count(*)) AS x FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, i),
c{r + 1} AS MATERIALIZED (
  SELECT coalesce(n.c, o.c) AS c, o.j AS j FROM c{r} o LEFT JOIN (SELECT j, list(x ORDER BY i) AS c FROM m{r} GROUP BY j) n ON n.j = o.j)""")
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""
    )


OP12_SQL = _oracle()
