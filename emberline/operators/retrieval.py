"""Retrieval over memories: TF-IDF ranking, applicability, evidence, dependency expansion, clustering and a staged pipeline."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import map_groups

#: Words of two letters at least.
WORD = r"[\p{L}\p{N}_]{2,}"


def tfidf_search(corpus: DataFrame, query: str, k: int, features: int = 1000, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(level, rank, id, score): the k texts of each level with the highest TF-IDF cosine to the query.

    Takes (level, id, text); ids are unique in a level. The query is one more text of the corpus:
    idf is ln((1 + n) / (1 + df)) + 1 over all of them, and the vocabulary the `features` terms
    that occur most often (ties by the term). Ties in score go to the smaller id; texts without a
    shared term score 0."""
    spark = corpus.sparkSession
    asked = spark.range(1).select(F.lit(None).cast("string").alias("level"), F.lit(None).cast(dict(corpus.dtypes)["id"]).alias("id"), F.lit(query).alias("text"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    texts = corpus.select("level", "id", "text").unionByName(asked)
    n = texts.count()
    counts = texts.select("level", "id", F.explode(words).alias("term")).where(~F.col("term").isin(*stop_words)).groupBy("level", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.col("total").desc(), "term").limit(features)
    idf = vocabulary.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))  # at most `features` rows
    own = weights.where("level IS NULL").select("term", F.col("w").alias("q"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    dot = weights.where("level IS NOT NULL").join(F.broadcast(own), "term", "left").groupBy("level", "id").agg(F.coalesce(F.sum(F.col("w") * F.col("q")), F.lit(0.0)).alias("dot"), norm.alias("norm"))
    length = own.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))  # one row
    scored = dot.join(F.broadcast(length)).select("level", "id", F.coalesce(F.col("dot") / (F.col("norm") * F.col("length")), F.lit(0.0)).alias("score"))
    everything = corpus.select("level", "id").join(scored, ["level", "id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    best = Window.partitionBy("level").orderBy(F.col("score").desc(), "id")
    return everything.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("level", "rank", "id", "score")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def same_repo(a: Column, b: Column) -> Column:
    """Equal, or the same base name where one has no owner; a blank one is no repository."""
    short = ~F.contains(a, F.lit("/")) | ~F.contains(b, F.lit("/"))
    return F.coalesce((a != "") & (b != "") & ((a == b) | (short & (base_name(a) == base_name(b)))), F.lit(False))


def names_repo(name: Column, owner: Column, full: Column, wanted: tuple[str, ...]) -> Column:
    """Whether a record is of a wanted repository: a filter with a slash inside any full form, another one inside the name or the name inside it."""
    n, o, f = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, owner, full))
    out = F.lit(False)
    filters = [w.strip().lower() for w in wanted if w and w.strip()]
    for w in filters:
        if "/" in w:
            out = out | F.contains(n, F.lit(w)) | F.contains(f, F.lit(w)) | F.contains(F.concat(o, F.lit("/"), n), F.lit(w))
        else:
            out = out | F.contains(n, F.lit(w)) | F.contains(F.lit(w), n)
    return out if filters else F.lit(True)


#: Rows of queries and of memory that a block holds where all have one repository and workflow; tasks for each core that blocks meet in, rows of a batch.
QUERY_BLOCK, MEMORY_BLOCK, TASKS, PAIRS = 8192, 32768, 16, 1 << 17


def applicable(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """Memory rows of a query's repository and workflow; a memory without a workflow fits any.

    Takes queries (query, repo, workflow) and memory (memory, repo, workflow). Rows of one repository and workflow are cut into blocks;
    blocks meet by base name, the owners compared once for two blocks, and pairs of blocks are dealt anew before
    they become rows, so a frequent repository is the work of many tasks."""

    def blocks(df: DataFrame, name: str, size: int) -> DataFrame:
        parts = max(1, -(-df.count() // size))
        keyed = df.where("repo IS NOT NULL").select("repo", "workflow", F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("block"), F.struct(name).alias("row"))  # a struct, as lists leave out nulls
        return keyed.groupBy("repo", "workflow", "block").agg(F.collect_list("row").alias(name))

    q = blocks(queries, "query", QUERY_BLOCK).select("query", F.col("repo").alias("q_repo"), F.col("workflow").alias("q_workflow"), base_name(F.col("repo")).alias("base"), F.col("block").alias("q_block"))
    m = blocks(memory, "memory", MEMORY_BLOCK).withColumn("base", base_name(F.col("repo")))
    fits = same_repo(F.col("q_repo"), F.col("repo")) & (F.col("workflow").isNull() | (F.col("workflow") == "") | (F.col("workflow") == F.col("q_workflow")))
    tasks = TASKS * queries.sparkSession.sparkContext.defaultParallelism
    met = q.join(m, "base").where(fits).repartition(tasks, "q_repo", "q_workflow", "q_block", "repo", "workflow", "block")
    kinds = dict(queries.dtypes)["query"], dict(memory.dtypes)["memory"]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # nested explodes would hold all rows of two blocks in one buffer of compiled code; here a batch is at hand
        for rows in batches:
            for left, right in zip(rows.column(0), rows.column(1), strict=True):
                q, m = left.values.flatten()[0], right.values.flatten()[0]
                step = max(1, min(PAIRS // len(q), len(m)))
                every, at = q.take(pa.array(np.tile(np.arange(len(q)), step))), pa.array(np.repeat(np.arange(step), len(q)))
                for start in range(0, len(m), step):
                    some = m.slice(start, step)
                    n = len(some) * len(q)
                    yield pa.RecordBatch.from_arrays([every.slice(0, n), some.take(at.slice(0, n))], ["query", "memory"])

    return met.select("query", "memory").mapInArrow(cross, f"query {kinds[0]}, memory {kinds[1]}")


def evidence_status(kind: Column, files: Column, failure: Column, tool: Column, signals: Column, seen_files: Column, seen_types: Column, seen_tools: Column, seen_text: Column) -> Column:
    """observed for problems of the failure itself, confirmed_in_target_failure for recalled ones whose file, tool or type, and a signal the failure shows; else null."""
    ends = lambda a, b: F.endswith(a, b) | F.endswith(b, a)
    file = F.exists(files, lambda f: F.exists(seen_files, lambda s: ends(f, s)))
    known = F.coalesce(F.array_contains(seen_types, F.lower(failure)), F.lit(False)) | F.coalesce(F.array_contains(seen_tools, F.lower(tool)), F.lit(False))
    signal = F.exists(signals, lambda s: F.contains(F.lower(seen_text), F.lower(s)))
    return F.when(kind == "ci_failure", "observed").when(file & known & signal, "confirmed_in_target_failure")


def expand_depth_first(memory: DataFrame, hits: DataFrame, group: str, decay: float = 0.9) -> DataFrame:
    """(group, problem, score, source, place): hits and what they enable or are enabled by, depth first; the first visit decides the score.

    Takes memory (group, problem, enables, enabled_by) and hits (group, problem, score, place).
    Each step costs `decay`. The visit order is a stack, so a group must fit a task."""
    both = memory.select(group, "problem", "enables", "enabled_by", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("place")).unionByName(
        hits.select(group, "problem", F.lit(None).cast("array<bigint>").alias("enables"), F.lit(None).cast("array<bigint>").alias("enabled_by"), F.col("score").cast("double"), F.col("place").cast("int"))
    )

    def walk(rows: list[tuple]) -> list[tuple]:
        links = {p: [*((x, "dependency_enabled") for x in e), *((x, "dependency_enabler") for x in b)] for _, p, e, b, _, place in rows if place is None}
        hits = sorted((place, p, s) for _, p, _, _, s, place in rows if place is not None)
        seen, out = set(), []
        for _, p, score in hits:
            stack = [(p, score, "direct")]
            while stack:
                at, s, source = stack.pop()
                if at in seen or at not in links:
                    continue
                seen.add(at)
                out.append((rows[0][0], at, s, source, len(out) + 1))
                stack += [(x, s * decay, why) for x, why in reversed(links[at])]
        return out

    t = dict(memory.dtypes)
    return map_groups(both, group, [], walk, f"{group} {t[group]}, problem {t['problem']}, score double, source string, place int")


def merge_similar(problems: DataFrame, group: str, least_text: float = 0.8, least_files: float = 0.5) -> DataFrame:
    """(group, problem, merged_from, files): problems of a group in order; each takes the later ones whose fix reads alike or whose files overlap.

    Takes (group, problem, fix, files, place). Order decides, so a group must fit a task; texts
    that cannot reach the ratio by their lengths or letters are not compared."""

    def merge(rows: list[tuple]) -> list[tuple]:
        items = [(p, (f or "").lower(), set(x)) for _, p, f, x, _ in rows]
        used: set[int] = set()
        out = []
        for i, (p, fix, files) in enumerate(items):
            if i in used:
                continue
            like, every = [p], set(files)
            for j in range(i + 1, len(items)):
                if j in used:
                    continue
                q, other, theirs = items[j]
                near = len(files & theirs) / max(len(files | theirs), 1) > least_files
                if not near:
                    m = SequenceMatcher(None, fix, other)
                    near = m.real_quick_ratio() > least_text and m.quick_ratio() > least_text and m.ratio() > least_text
                if near:
                    used.add(j)
                    like.append(q)
                    every |= theirs
            out.append((rows[0][0], p, like, sorted(every)))
        return out

    t = dict(problems.dtypes)
    return map_groups(problems.select(group, "problem", "fix", "files", "place"), group, ["place"], merge, f"{group} {t[group]}, problem {t['problem']}, merged_from array<{t['problem']}>, files array<string>")


def alike(texts: DataFrame, column: str, least: float = 0.68) -> DataFrame:
    """(a, b), a < b: different texts whose trigrams of letters have a Jaccard similarity of at least `least`.

    A text's rarest trigrams, as many as any text that similar must share one of, name its
    candidates, so frequent ones join nothing; candidates are checked on all trigrams."""
    t = F.col(column)
    names = texts.select(t.alias("t")).where("t IS NOT NULL").distinct().select("t", F.array_distinct(F.transform(F.when(F.length("t") >= 3, F.sequence(F.lit(1), F.length("t") - 2)).otherwise(F.array(F.lit(1))), lambda i: F.substr(F.col("t"), i, F.lit(3)))).alias("grams"))
    each = names.select("t", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    known = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("t").orderBy("df", "g")
    prefix = each.join(known, "g").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1)
    a, b = (prefix.select(F.col("t").alias(x), "g", F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    near = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))).select("a", "b").distinct()
    sets = [names.select(F.col("t").alias(x), F.col("grams").alias(f"g_{x}")) for x in ("a", "b")]
    j = near.join(sets[0], "a").join(sets[1], "b")
    common = F.size(F.array_intersect("g_a", "g_b"))
    return j.where(common >= F.lit(least) * (F.size("g_a") + F.size("g_b") - common)).select("a", "b")


#: Stages of retrieval that each named ablation takes out.
ABLATIONS = {"no_dependency_expansion": ("expand",), "no_recurring_recall": ("recall",), "no_applicability_filter": ("filter",), "no_ordering": ("order",), "no_hidden_problems": ("expand", "recall")}


def without(name: str | None) -> tuple[str, ...]:
    """The stages that an ablation leaves out; none for None, an unknown name raises."""
    if name is None:
        return ()
    if name not in ABLATIONS:
        raise ValueError(f"unknown ablation {name!r}; known: {sorted(ABLATIONS)}")
    return ABLATIONS[name]


def levels(text: str | None) -> tuple[str, ...]:
    """Memory levels of a mode: none for `baseline`, one level, or L1 to L2 or L3; others raise."""
    mode = (text or "").strip().lower().replace("_", "+").replace(" ", "")
    known = {"baseline": (), "l1": ("L1",), "l2": ("L2",), "l3": ("L3",), "l1+l2": ("L1", "L2"), "l1+l2+l3": ("L1", "L2", "L3")}
    if mode not in known:
        raise ValueError(f"unsupported levels {text!r}")
    return known[mode]
