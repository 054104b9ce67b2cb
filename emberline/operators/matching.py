"""Matching of predicted to true rows, best candidates, retrieval accuracy and bootstrap intervals."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import match as M
from ..functions import stats
from ..functions import text as T
from .relational import map_groups


def greedy_pairs(gold: DataFrame, predicted: DataFrame, instance: str, file: str, order: str) -> DataFrame:
    """(instance, n_gold, n_predicted, tp): each predicted row in order takes the first gold row that is left and names the same file.

    Rows can only match rows of their instance and base name, so each such group is matched by
    itself; files of one group are told apart by their last two segments, and a bare base name
    goes with any. Where a group has no bare names, order cannot change how many match: they are counted by
    their segments, in any number. A group with bare names goes through one task, in order, a queue of gold rows for each of its
    names."""
    path = T.bare_path(F.col(file))
    parts = F.split(path, "/")
    columns = [F.col(instance).alias("instance"), F.element_at(parts, -1).alias("base"), F.when(F.size(parts) > 1, F.array_join(T.last_two(path), "/")).otherwise("").alias("two"), F.col(order).alias("at")]
    both = gold.where(F.col(file) != "").select(*columns, F.lit(True).alias("gold")).unionByName(predicted.where(F.col(file) != "").select(*columns, F.lit(False).alias("gold")))

    def match(rows: list[tuple]) -> list[tuple]:
        free = [two for *_, two, _, is_gold, _ in rows if is_gold]
        taken, queues = bytearray(len(free)), defaultdict(deque)
        for i, two in enumerate(free):
            queues[two].append(i)

        def head(queue: deque) -> int:
            while queue and taken[queue[0]]:
                queue.popleft()
            return queue[0] if queue else len(free)

        every = deque(range(len(free)))
        for *_, two, _, is_gold, _ in rows:
            if not is_gold and (hit := head(every) if two == "" else min(head(queues[two]), head(queues[""]))) < len(free):
                taken[hit] = 1
        return [(rows[0][0], sum(taken))]

    # groups with one side only have no match
    sides = both.groupBy("instance", "base").agg(F.count_if("gold").alias("g"), F.count_if(~F.col("gold")).alias("p"), F.bool_or(F.col("two") == "").alias("bare"))
    told = both.groupBy("instance", "base", "two").agg(F.count_if("gold").alias("g"), F.count_if(~F.col("gold")).alias("p"))
    plain = told.join(sides.where("g > 0 AND p > 0 AND NOT bare").select("instance", "base"), ["instance", "base"], "left_semi").select("instance", F.least("g", "p").alias("tp"))
    mixed = both.join(sides.where("g > 0 AND p > 0 AND bare").select("instance", "base"), ["instance", "base"], "left_semi")
    keyed = mixed.select("instance", "base", "two", "at", "gold", F.struct("instance", "base").alias("own"))
    ordered = map_groups(keyed, "own", ["at"], match, f"instance {dict(gold.dtypes)[instance]}, tp long")
    found = plain.unionByName(ordered).groupBy("instance").agg(F.sum("tp").alias("tp"))
    counts = gold.select(F.col(instance).alias("instance"), F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(F.col(instance).alias("instance"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    counts = counts.groupBy("instance").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_predicted"))
    return counts.join(found, "instance", "left").select("instance", "n_gold", "n_predicted", F.coalesce("tp", F.lit(0)).alias("tp"))


def pair_cosines(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, text: str) -> DataFrame:
    """(group, left id, right id, cosine) of a group's texts that share a term; the others' cosine is 0.

    TF-IDF over words and word pairs where the two texts are the whole corpus: a term of both has
    idf 1, one of a single text ln(3/2) + 1. So a norm follows from a text's sum of squares and
    the shared terms' part of it, and only shared terms are joined."""
    rare = (math.log(1.5) + 1) ** 2

    def counted(df: DataFrame, id_: str, name: str) -> DataFrame:
        c = df.select(group, id_, F.explode(M.terms(F.col(text))).alias("term")).groupBy(group, id_, "term").agg(F.count(F.lit(1)).cast("double").alias(name))
        return c

    def squares(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.groupBy(group, id_).agg(F.sum(F.col(name) * F.col(name)).alias(f"all_{name}"))

    a, b = counted(left, left_id, "x"), counted(right, right_id, "y")
    shared = a.join(b, [group, "term"]).groupBy(group, left_id, right_id).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    j = shared.join(squares(a, left_id, "x"), [group, left_id]).join(squares(b, right_id, "y"), [group, right_id])
    norm = lambda whole, part: rare * F.col(whole) - (rare - 1) * F.col(part)
    return j.select(group, left_id, right_id, (F.col("dot") / F.sqrt(norm("all_x", "xx") * norm("all_y", "yy"))).alias("cosine"))


def best_candidate(pairs: DataFrame, record: list[str], score: Column, place: str, least) -> DataFrame:
    """Of each record's candidates the one with the highest score, the first of equals; none below `least`. No group is sorted."""
    scored = pairs.withColumn("__score", score)
    best = scored.groupBy(*record).agg(F.max_by(F.struct(*(c for c in scored.columns if c not in record)), F.struct("__score", -F.col(place))).alias("__b"))
    return best.where(F.col("__b.__score") >= least).select(*record, "__b.*").withColumnRenamed("__score", "score")


def retrieval_accuracy(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of counts and percentages from (id, files) predictions and (id, gold) lists, null gold where nothing is known.

    Predictions without files do not count; precision's denominator has all predicted files, also of rows that are not evaluated."""
    p = predictions.where(F.size("files") > 0).join(gold, "id", "left")
    known = F.coalesce(F.size("gold") > 0, F.lit(False))
    files, first, three = F.array_distinct("files"), F.element_at("files", 1), F.slice("files", 1, 3)
    rows = p.select(
        known.alias("known"), F.size(files).alias("n"), F.when(known, F.size(F.array_intersect(files, "gold"))).otherwise(0).alias("hits"),
        (known & (F.array_sort(files) == F.array_sort(F.array_distinct("gold")))).alias("exact"), (known & F.array_contains("gold", first)).alias("top1"), (known & F.arrays_overlap(three, "gold")).alias("top3"),
    )
    c = rows.agg(F.count(F.lit(1)).alias("generated"), F.count_if("known").alias("evaluated"), F.count_if("exact").alias("exact"), F.count_if("top1").alias("top1"), F.count_if("top3").alias("top3"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("predicted"))
    pct = lambda a, b: F.round(100 * stats.ratio(F.col(a), F.col(b)), 2)
    return c.select("*", pct("exact", "evaluated").alias("exact_pct"), pct("top1", "evaluated").alias("top1_pct"), pct("top3", "evaluated").alias("top3_pct"), pct("hits", "predicted").alias("precision_pct"))


#: Modulus of the draws, and multipliers of their steps.
PRIME, STEPS = 2147483647, (48271, 69621, 16807)


#: Of x < PRIME, at least how much makes one more copy: e^-1 times the sums of 1 / k!, so a number of copies is Poisson with mean 1.
COPIES = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(9))
#: Clusters that are weighted at once.
WEIGHED = 128


def cluster_bootstrap(rows: DataFrame, cluster: str, seed: int = 20261111, resamples: int = 10_000) -> DataFrame:
    """(measure, low, high): percentile intervals of precision, recall, F1 and accuracy over resampled clusters.

    Takes (tp, fp, fn, tn) a cluster, clusters named by unique texts. A resample takes each cluster a number of times that
    is Poisson with mean 1, drawn from its name, so a task weighs its own clusters and hands on `resamples` rows of
    sums, however many clusters there are. Of each measure's sorted values the 2.5 and 97.5 % places are
    taken. No clusters give no rows."""
    names = ["tp", "fp", "fn", "tn"]
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(cluster), F.lit(""))), 1, 8), 16, 10).cast("long")
    keyed = rows.select(place.alias("place"), *(F.col(c).cast("long") for c in names))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = np.arange(resamples, dtype=np.int64)[:, None] * 1000003 + seed
        sums, any_ = np.zeros((resamples, len(names)), dtype=np.int64), False
        for batch in batches:
            for i in range(0, len(batch), WEIGHED):
                part = batch.iloc[i : i + WEIGHED]
                x = (start + part["place"].to_numpy()[None, :] * 7919) % PRIME
                for m in STEPS:
                    x = x * (x % 65521 + m) % PRIME
                times = np.searchsorted(np.array(COPIES), x.ravel(), side="right").reshape(x.shape)
                sums += times @ part[names].to_numpy()
                any_ = True
        if any_:
            yield pd.DataFrame(sums, columns=names).assign(rep=np.arange(resamples))[["rep", *names]]

    drawn = keyed.mapInPandas(weigh, "rep long, tp long, fp long, fn long, tn long")
    sums = drawn.groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))
    measures = sums.select(*stats.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    long = measures.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("precision", "recall", "f1", "accuracy")))).alias("x")).select("x.*")
    # a few measures of `resamples` rows each
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("measure").orderBy("value")))
    low, high = resamples * 25 // 1000, resamples * 975 // 1000
    return ranked.groupBy("measure").agg(F.max(F.when(F.col("rank") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("rank") == high, F.col("value"))).alias("high"))
