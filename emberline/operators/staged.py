"""Retrieval as a plan of named stages: each is a table in and a table out of one schema, and an ablation leaves stages out.

    search   the memories of each level most like a query, by TF-IDF cosine
    filter   keeps those that apply to the query's repository and workflow
    expand   adds the problems that they enable or are enabled by, depth first
    recall   adds problems of recurring patterns that the query's own failure confirms
    order    gives each query's problems their places

Queries are a stated set; their rows meet the whole memory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Rounds
from . import relational as R
from . import retrieval as V
from .termsearch import top_by_terms

#: What every stage takes and returns.
MATCHES = "query bigint, level string, memory bigint, score double, source string, place int"
#: Priority of a problem by where it comes from.
PRIORITY = {"direct": 1, "dependency_enabler": 2, "dependency_enabled": 3, "recurring": 4}


@dataclass(frozen=True)
class Asked:
    """Queries (query, repo, workflow, kind, text); memory (level, memory, repo, workflow, kind, signal, issue, text, enables,
    enabled_by), memory ids unique over all levels; the levels to search and how many of each."""

    queries: DataFrame
    memory: DataFrame
    levels: tuple[str, ...] = ("L1", "L2", "L3")
    k: int = 5
    features: int = 1000
    stop_words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame, Asked], DataFrame]


def tfidf_top(memory: DataFrame, queries: DataFrame, k: int, features: int = 1000, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query, level, memory, score): of each level the k memories most like each query's text, ties to the smaller id.

    Takes (level, memory, text) and (query, text). Idf is ln((1 + n) / (1 + df)) + 1 over the memories, the vocabulary their
    `features` most frequent terms (ties by the term), scores are rounded to 9 digits and memories without a shared term
    are no match."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(V.WORD), F.lit(0))
    return top_by_terms(memory, queries, words, k, features, stop_words)


def search(_: DataFrame, a: Asked) -> DataFrame:
    memory = a.memory.where(F.col("level").isin(*a.levels))
    found = tfidf_top(memory, a.queries, a.k, a.features, a.stop_words)
    return found.select("query", "level", "memory", "score", F.lit("direct").alias("source"), F.lit(None).cast("int").alias("place"))


def applicable(matches: DataFrame, a: Asked) -> DataFrame:
    """Memories of a failure apply to its repository and workflow, those of a repository to it, patterns everywhere."""
    known = matches.join(a.memory.select("memory", F.col("repo").alias("m_repo"), F.col("workflow").alias("m_flow")), "memory")
    asked = known.join(a.queries.select("query", F.col("repo").alias("q_repo"), F.col("workflow").alias("q_flow")), "query")
    repo = V.same_repo(F.col("q_repo"), F.col("m_repo"))
    flow = F.col("m_flow").isNull() | (F.col("m_flow") == "") | F.coalesce(F.col("m_flow") == F.col("q_flow"), F.lit(False))
    fits = F.when(F.col("level") == "L1", repo & flow).when(F.col("level") == "L2", repo).otherwise(True)
    return asked.where(fits).select(*matches.columns)


def linked(memory: DataFrame) -> DataFrame:
    """(memory, to, issue): what each memory enables or is enabled by, where that is there, and its issue."""
    ends = memory.where("issue IS NOT NULL").select("memory", F.explode(F.concat("enables", "enabled_by")).alias("to")).distinct()
    return ends.join(memory.where("issue IS NOT NULL").select(F.col("memory").alias("to"), "issue"), "to").select("memory", "to", "issue")


def expand(matches: DataFrame, a: Asked, links: DataFrame | None = None) -> DataFrame:
    """Adds what the matches' own issues link to them. What a query's matches reach along links inside these issues is one group.

    Links are followed round by round first, so that a walk reads no problem that it does not visit, however large the issues are.
    `links` are those of the memory, where they are known."""
    rounds = Rounds(matches.sparkSession)
    links = rounds.keep(linked(a.memory)) if links is None else links
    start = rounds.keep(matches.select("query", "memory").distinct().join(a.memory.where("issue IS NOT NULL").select("memory", "issue"), "memory"))
    issues = start.select("query", "issue").distinct()
    seen = frontier = start.select("query", "memory")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, "memory").join(issues, ["query", "issue"], "left_semi").select("query", F.col("to").alias("memory")).distinct()
        frontier = rounds.keep(step.join(seen, ["query", "memory"], "left_anti"))
        seen = seen.unionByName(frontier)
        seen = rounds.keep(seen) if depth % 16 == 0 else seen
    near = seen.join(a.memory, "memory").select("query", F.col("memory").alias("problem"), "enables", "enabled_by")
    place = F.row_number().over(Window.partitionBy("query").orderBy("level", F.col("score").desc(), "memory"))
    hits = matches.select("query", F.col("memory").alias("problem"), "score", place.alias("place"))
    walked = V.expand_depth_first(near, hits, "query").select("query", F.col("problem").alias("memory"), F.round("score", 9).alias("score"), "source")
    return rounds.result(walked.join(a.memory.select("memory", "level"), "memory").select("query", "level", "memory", "score", "source", F.lit(None).cast("int").alias("place")))


def confirmed(a: Asked) -> DataFrame:
    """The first problem of each signal that enough issues show, where a query's failure confirms it by place, kind and signal."""
    frequent = R.recurring(a.memory.where("signal <> ''"), "signal", "issue")
    first = a.memory.join(frequent, "signal").groupBy("signal", "repo", "kind").agg(F.min(F.struct("memory", "level")).alias("m"))
    # a confirmed problem has the query's kind and repository, so these are the join's keys
    asked = a.queries.select("query", F.col("repo"), "kind", F.coalesce("text", F.lit("")).alias("seen"))
    none = F.array().cast("array<string>")
    status = V.evidence_status(F.lit("common"), F.array("repo"), F.col("kind"), F.lit(None).cast("string"), F.array("signal"), F.array("repo"), F.array(F.lower("kind")), none, F.col("seen"))
    return asked.join(first, ["repo", "kind"]).where(status == "confirmed_in_target_failure").select("query", "m.level", "m.memory", F.lit(0.0).alias("score"), F.lit("recurring").alias("source"), F.lit(None).cast("int").alias("place"))


def recall(matches: DataFrame, a: Asked, found: DataFrame | None = None) -> DataFrame:
    """Adds the problems that are confirmed, or those of them that are given as found."""
    found = confirmed(a) if found is None else found
    return matches.unionByName(found.join(matches.select("query", "memory"), ["query", "memory"], "left_anti"))


def order(matches: DataFrame, a: Asked) -> DataFrame:
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair)), F.col("source"))
    return matches.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(rank, F.col("score").desc(), "memory")))


STAGES = (Stage("search", search), Stage("filter", applicable), Stage("expand", expand), Stage("recall", recall), Stage("order", order))


@dataclass(frozen=True)
class Plan:
    """Stages in their order."""

    stages: tuple[Stage, ...] = STAGES

    def without(self, ablation: str | None) -> Plan:
        """The plan without an ablation's stages; an unknown name raises."""
        gone = V.without(ablation)
        return Plan(tuple(s for s in self.stages if s.name not in gone))

    def run(self, asked: Asked) -> DataFrame:
        """The last stage's table. A stage whose columns or types are others than MATCHES raises; no levels give no rows."""
        spark = asked.queries.sparkSession
        out = none = spark.createDataFrame([], MATCHES)
        if not asked.levels:
            return none
        for stage in self.stages:
            out = stage.run(out, asked)
            if (got := [(f.name, f.dataType) for f in out.schema]) != [(f.name, f.dataType) for f in none.schema]:
                raise TypeError(f"stage {stage.name} returns {got}")
        return out


#: Named configurations: levels, ablation, and whether it is run anew or its results are there.
CONFIGURATIONS = {
    "baseline": ("baseline", None, False), "full_recap": ("L1+L2+L3", None, False),
    **{name: ("L1+L2+L3", name, True) for name in V.ABLATIONS},
}


def configurations(run_new: bool | None = None) -> dict[str, tuple[tuple[str, ...], str | None]]:
    """Levels and ablation of each configuration, or only of those that are run anew or not."""
    return {name: (V.levels(levels), ablation) for name, (levels, ablation, new) in CONFIGURATIONS.items() if run_new in (None, new)}
