"""Vectors that are alike: exact joins, counts and clusters over cells, and clusters by random hyperplanes.

All work on distinct vectors; rows that share one are members of its class, so copies never
make pairs. No task holds more than two blocks of vectors, whatever a cell or bucket holds: large ones are cut."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import Rounds, bounded_batches
from . import graph

#: Most vectors in a block and, where fewer tasks than cores would work otherwise, least; most cells, vectors that cells are fitted on, rows scored at once.
BLOCK, LEAST, MOST_CELLS, SAMPLE, STEP = 32768, 2048, 1024, 4096, 256
#: Pairs that are scored exactly at once, rows dealt at once.
EXACT, DEALT = 1 << 16, 1 << 14
#: Vectors of a bucket that are one block, and rows of it scored at once.
BUCKET, BUCKET_STEP = 4096, 512
#: Rounding never decides: bounds are held with this slack, scores compared at this many digits.
SLACK, DIGITS = 1e-9, 9


def _matrix(column, n: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else pa.array(np.concatenate(column.to_numpy()) if n else [])
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def directions(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(rep, id, v, dim): rows with a direction, and the smallest id whose vector is the same. Null ids, vectors or components,
    non-finite ones and vectors of no length are left out."""
    v = F.col(vector_column).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))
    reps = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return rows.join(reps, "key").select("rep", "id", "v", F.size("v").alias("dim"), "copies")


def _sample(reps: DataFrame, limit: int) -> np.ndarray:
    """Unit vectors of at most `limit` rows, drawn by a hash of their ids."""
    rows = [r["v"] for r in reps.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(limit).select("v").collect()]
    x = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Cells:
    """Centroids; a bounded sample decides where they lie, never what is found."""

    def __init__(self, sample: np.ndarray, n: int, block: int):
        m = max(1, min(MOST_CELLS, math.ceil(n / block), len(sample)))
        self.centroids = sample[np.linspace(0, len(sample) - 1, m).astype(int)]

    def unit(self, v: np.ndarray) -> np.ndarray:
        return v / np.sqrt((v * v).sum(axis=1))[:, None]

    def angles(self, u: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(u @ self.centroids.T, -1.0, 1.0))


def _hits(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, row, score, how many were scored in full) of pairs that reach the threshold; if both blocks are the same, of each pair once.

    Products of single precision, which for unit vectors err by no more than their length times the unit of rounding, leave the
    pairs that may reach it; these are scored row by row in double precision, so that equal rows have equal scores."""
    least = np.float32(threshold - (left.shape[1] + 8) * 2.0**-24 - SLACK)
    single = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    buffer = np.empty((min(STEP, len(left)), len(right)), dtype=np.float32)
    for i in range(0, len(left), STEP):
        some = single[0][i : i + STEP]
        near = np.flatnonzero((np.matmul(some, single[1], out=buffer[: len(some)]) >= least).ravel())
        for j in range(0, len(near), EXACT):
            a, b = np.divmod(near[j : j + EXACT], len(right))
            a += i
            if same:
                keep = a < b
                a, b = a[keep], b[keep]
            score = np.round(np.einsum("ij,ij->i", left[a], right[b]), DIGITS)
            keep = score >= round(threshold, DIGITS)
            yield a[keep], b[keep], score[keep], len(a)


def threshold_join(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (a, b, score) of classes a < b whose cosine, to DIGITS digits, reaches the threshold; members (id, rep, copies); counts).

    Exact over all rows. Vectors lie in cells around centroids. Two vectors at an angle of at most t can only lie in
    cells c and d if the centroids' angle is at most r_c + r_d + t, and a vector meets only cells whose centroid is
    within r_d + t of it. In two blocks that meet, products of single precision leave the pairs that are scored in full.
    `counts` has, for each length of vectors, all pairs, those that met in a block and those that were scored in full.
    `threshold` lies in (0, 1]."""
    rounds = Rounds(vectors.sparkSession)
    members = rounds.keep(directions(vectors, id_column, vector_column))

    def pairs_of(home: _Block, guest: _Block, same: bool) -> Iterator[list]:
        scored = 0
        for a, b, score, n in _hits(home.u, guest.u, same, threshold):
            scored += n
            x, y = home.rep[a], guest.rep[b]
            yield [np.minimum(x, y), np.maximum(x, y), score, None, None]
        yield [None, None, None, np.array([len(home.rep) * (len(home.rep) - 1) // 2 if same else len(home.rep) * len(guest.rep)]), np.array([scored])]

    schema = "a long, b long, score double, met long, scored long"
    found, counts = [], []
    for dim, n, reps in _by_length(members):
        met = rounds.keep(_join(rounds, reps, n, threshold, pairs_of, schema))
        found.append(met.where("a IS NOT NULL").select("a", "b", "score"))
        counts.append(met.where("a IS NULL").agg(F.lit(dim).alias("dim"), F.lit(n * (n - 1) // 2).alias("pairs"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")))
    spark = vectors.sparkSession
    pairs = spark.createDataFrame([], "a long, b long, score double")
    facts = spark.createDataFrame([], "dim int, pairs long, met long, scored long")
    for p, c in zip(found, counts, strict=True):
        pairs, facts = pairs.unionByName(p), facts.unionByName(c)
    return pairs, members.select("id", "rep", "copies"), facts


def _by_length(members: DataFrame) -> Iterator[tuple[int, int, DataFrame]]:
    """(length, classes, (rep, v, copies)) for each length of vectors."""
    for dim, n in sorted(tuple(r) for r in members.where("id = rep").groupBy("dim").count().collect()):  # as many as there are lengths
        yield dim, n, members.where((F.col("id") == F.col("rep")) & (F.col("dim") == dim)).dropDuplicates(["rep"]).select("rep", "v", "copies")


class _Block:
    """Unit vectors of classes, their names and how many rows have them."""

    def __init__(self, rows: pa.Table):
        self.u = np.concatenate([_matrix(x.column("u"), x.num_rows) for x in rows.to_batches() if x.num_rows])
        self.rep, self.copies = (rows.column(c).to_numpy() for c in ("rep", "copies"))


def _join(rounds: Rounds, reps: DataFrame, n: int, threshold: float, meet: Callable[[_Block, _Block, bool], Iterator[list]], schema: str) -> DataFrame:
    """What `meet` makes of every two blocks that may hold pairs over the threshold, and of each block with itself."""
    spark = bounded_batches(reps).sparkSession
    block = min(BLOCK, max(LEAST, math.ceil(n / math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))))
    sent = spark.sparkContext.broadcast(Cells(_sample(reps, SAMPLE), n, block))  # MOST_CELLS centroids at most
    turn = math.acos(min(threshold, 1.0)) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for rows in batches:
            u = cells.unit(_matrix(rows.column("v"), rows.num_rows))
            angle = cells.angles(u)
            own = angle.argmin(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1]), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("copies"), lists, pa.array(own.astype(np.int32)), pa.array(angle[np.arange(len(own)), own])], ["rep", "copies", "u", "cell", "angle"])

    placed = rounds.keep(reps.mapInArrow(place, "rep long, copies long, u array<double>, cell int, angle double"))
    facts = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row a cell
    m = len(sent.value.centroids)
    radius, blocks = np.full(m, -np.inf), np.zeros(m, dtype=np.int64)
    for r in facts:
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["n"] // block)
    between = sent.value.angles(sent.value.centroids)
    near = (between <= radius[:, None] + radius[None, :] + turn) & (blocks[:, None] > 0) & (blocks[None, :] > 0)
    bounds = spark.sparkContext.broadcast((radius, blocks, near))

    def dealt(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Each row once for every pair of blocks in which it may be needed: in its own block, or as a guest of another."""
        radius, blocks, near = bounds.value
        u, own, rep = _matrix(rows.column("u"), rows.num_rows), rows.column("cell").to_numpy(), rows.column("rep").to_numpy()
        fits = sent.value.angles(u) <= radius[None, :] + turn
        sub = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[own]
        for c in np.unique(own).tolist():
            mine = np.flatnonzero(own == c)
            for d in np.flatnonzero(near[c]).tolist():
                # the block with the smaller number is at home, the other's rows are guests
                at = mine if d >= c else mine[fits[mine, d]]
                for t in range(int(blocks[d])) if len(at) else ():
                    s, other = sub[at], np.full(len(at), t)
                    first, last = (np.minimum(s, t), np.maximum(s, t)) if d == c else (s, other) if d > c else (other, s)
                    yield np.full(len(at), min(c, d)), first, np.full(len(at), max(c, d)), last, s > t if d == c else np.full(len(at), d < c), at

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is dealt, in batches of some DEALT rows: a row goes to as many pairs as there are blocks, so a batch of all would not fit."""
        for rows in batches:
            held, n = [], 0
            for part in itertools.chain(dealt(rows), [None]):
                if part is not None:
                    held.append(part)
                    n += len(part[5])
                if held and (part is None or n >= DEALT):
                    cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                    at = pa.array(cols[5].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in cols[:4]), pa.array(cols[4].astype(bool)), *(rows.column(x).take(at) for x in ("rep", "copies", "u"))], ["c", "s", "d", "t", "guest", "rep", "copies", "u"])
                    held, n = [], 0

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        same = rows.column("c")[0].as_py() == rows.column("d")[0].as_py() and rows.column("s")[0].as_py() == rows.column("t")[0].as_py()
        guests = rows.column("guest")
        left = rows.filter(pc.invert(guests))
        right = left if same else rows.filter(guests)
        if not left.num_rows or not right.num_rows:  # no guest fits
            return
        home = _Block(left)
        guest = home if same else _Block(right)
        del rows, left, right
        for cols in meet(home, guest, same):
            n = max(len(x) for x in cols if x is not None)
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in zip(cols, kind.types, strict=True)], schema=kind)

    pairs = int((near & np.triu(np.ones((m, m), dtype=bool))).astype(np.int64).dot(blocks).dot(blocks))
    parts = max(1, min(2 * pairs, 4000))
    placed = placed.mapInArrow(deal, "c int, s int, d int, t int, guest boolean, rep long, copies long, u array<double>").repartition(parts, "c", "s", "d", "t")
    return placed.groupBy("c", "s", "d", "t").applyInArrow(score, schema)


def link_counts(vectors: DataFrame, thresholds: tuple[float, ...], id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, rep, links, best) of every row with a direction: its class, for each threshold how many other rows reach it, and their best
    cosine that reaches the least. Exact, as the join is; pairs are counted where they are found and are no rows."""
    rounds = Rounds(vectors.sparkSession)
    members = rounds.keep(directions(vectors, id_column, vector_column))
    least = min(thresholds)

    def counted(home: _Block, guest: _Block, same: bool) -> Iterator[list]:
        links, best = [np.zeros((len(x.rep), len(thresholds)), dtype=np.int64) for x in (home, guest)], [np.full(len(x.rep), -np.inf) for x in (home, guest)]
        if same:
            links[1], best[1] = links[0], best[0]
        for a, b, score, _ in _hits(home.u, guest.u, same, least):
            for side, at, copies in ((0, a, guest.copies[b]), (1, b, home.copies[a])):
                np.maximum.at(best[side], at, score)
                for k, t in enumerate(thresholds):
                    np.add.at(links[side][:, k], at, np.where(score >= round(t, DIGITS), copies, 0))
        for side, x in ((0, home),) if same else ((0, home), (1, guest)):
            found = np.isfinite(best[side])
            yield [x.rep[found], list(links[side][found]), best[side][found]]

    own = vectors.sparkSession.createDataFrame([], "rep long, links array<long>, best double")
    for _, n, reps in _by_length(members):
        own = own.unionByName(_join(rounds, reps, n, least, counted, "rep long, links array<long>, best double"))
    summed = rounds.keep(own.groupBy("rep").agg(F.array(*(F.sum(F.col("links")[k]) for k in range(len(thresholds)))).alias("links"), F.max("best").alias("best")))
    more = F.col("copies") - 1
    links = F.transform(F.coalesce("links", F.array_repeat(F.lit(0).cast("long"), len(thresholds))), lambda x: x + more)
    return rounds.result(members.join(summed, "rep", "left").select("id", "rep", links.alias("links"), F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("best")))


def exact_clusters(vectors: DataFrame, thresholds: tuple[float, ...], id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, clusters): rows with a direction, and for each threshold the smallest id that rows at that cosine at least lead to.

    Every pair is met once for all thresholds, and of the pairs that are alike only a spanning forest leaves two blocks."""
    rounds = Rounds(vectors.sparkSession)
    members = rounds.keep(directions(vectors, id_column, vector_column))

    def forest(home: _Block, guest: _Block, same: bool) -> Iterator[list]:
        ids = home.rep if same else np.concatenate([home.rep, guest.rep])
        roots = [np.arange(len(ids)) for _ in thresholds]
        for a, b, score, _ in _hits(home.u, guest.u, same, min(thresholds)):
            b = b if same else b + len(home.rep)
            for k, t in enumerate(thresholds):
                root = roots[k]
                x, y = root[a], root[b]
                new = np.flatnonzero((score >= round(t, DIGITS)) & (x != y))
                if not len(new):
                    continue
                _, first = np.unique(np.stack([np.minimum(x[new], y[new]), np.maximum(x[new], y[new])]), axis=1, return_index=True)
                edges = [i for i in new[first].tolist() if _hook(root, int(a[i]), int(b[i]))]
                while len(np.flatnonzero(root[root] != root)):
                    root = root[root]
                roots[k] = root
                p, q = ids[a[edges]], ids[b[edges]]
                yield [np.full(len(edges), k, dtype=np.int32), np.minimum(p, q), np.maximum(p, q)]

    links = vectors.sparkSession.createDataFrame([], "k int, a long, b long")
    for _, n, reps in _by_length(members):
        links = links.unionByName(_join(rounds, reps, n, min(thresholds), forest, "k int, a long, b long"))
    links = rounds.keep(links.distinct())
    out = members.select("id", "rep")
    for k in range(len(thresholds)):
        labels = graph.components(links.where(F.col("k") == k).select("a", "b"))
        out = out.join(labels.select(F.col("node").alias("rep"), F.col("component").alias(f"c{k}")), "rep", "left")
    return rounds.result(out.select("id", F.array(*(F.coalesce(f"c{k}", "rep") for k in range(len(thresholds)))).alias("clusters")))


def _hook(root: np.ndarray, a: int, b: int) -> bool:
    """Whether two nodes were apart; they are under the smaller root then."""

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    x, y = top(a), top(b)
    root[max(x, y)] = min(x, y)
    return x != y


def linked_counts(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, rep, links, best) of every row with a direction: its class, how many other rows reach the threshold, and their best cosine."""
    counted = link_counts(vectors, (threshold,), id_column, vector_column)
    return counted.select("id", "rep", F.col("links")[0].alias("links"), "best")


def bands_for(threshold: float, bits: int, recall: float) -> int:
    """Bands of `bits` hyperplanes by which a pair at the threshold meets with at least this chance."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def similar_links(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = 0.97, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), members): links of classes with a cosine of at least the threshold, enough to span every cluster that shares buckets.

    Signs of `bits` random hyperplanes are a band's bucket, bits growing with the logarithm of the rows so that buckets of
    unlike vectors stay small; there are as many bands as a pair at the very threshold needs to share one with chance `recall`
    (closer pairs share more). In a bucket cosines are exact, and of the pairs that are alike only a spanning
    forest leaves it. A bucket beyond a block is cut into blocks that meet two at a time."""
    rounds = Rounds(vectors.sparkSession)
    members = rounds.keep(directions(vectors, id_column, vector_column))
    reps = members.where("id = rep").dropDuplicates(["rep"]).select("rep", "v", "dim")
    n = max(1, reps.count())
    bits = max(4, min(24, math.ceil(math.log2(n / 64)) if n > 64 else 4))
    bands = bands_for(threshold, bits, recall)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for rows in batches:
            dims, at = rows.column("dim").to_numpy(), np.arange(rows.num_rows)
            for dim in np.unique(dims).tolist():
                own = at[dims == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bands * bits))
                some = rows.take(pa.array(own))
                keys = (_matrix(some.column("v"), len(own)) @ planes[dim] > 0).reshape(len(own), bands, bits) @ weights
                for b in range(bands):
                    yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("v"), some.column("dim"), pa.array(np.full(len(own), b, dtype=np.int32)), pa.array(keys[:, b])], ["rep", "v", "dim", "band", "key"])

    signed = rounds.keep(reps.mapInArrow(sign, "rep long, v array<double>, dim int, band int, key long"))
    bucket = ["dim", "band", "key"]
    sizes = signed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / min(BLOCK, BUCKET)).cast("int"))
    rows = signed.join(sizes, bucket)
    sub = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    paired = rows.withColumn("s", sub).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(*bucket, F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), "rep", "v", "s")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["v"], len(rows))
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        ids, root = rows["rep"].to_numpy(), np.arange(len(rows))
        edges = []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = int(root[i])
            return i

        for i in range(0, len(x), BUCKET_STEP):
            a, b = np.nonzero(np.round(x[i : i + BUCKET_STEP] @ x.T, DIGITS) >= round(threshold, DIGITS))
            for p, q in zip((a + i).tolist(), b.tolist(), strict=True):
                if p < q and (r := top(p)) != (s := top(q)):
                    root[max(r, s)] = min(r, s)
                    edges.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    links = paired.groupBy(*bucket, "lo", "hi").applyInPandas(link, "a long, b long").distinct()
    return rounds.keep(links), members


def similar_clusters(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = 0.97) -> DataFrame:
    """(id, cluster): rows with a direction, and the smallest id that similar rows lead to."""
    links, members = similar_links(vectors, threshold, id_column, vector_column, recall)
    labels = graph.components(links)
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("cluster"))
