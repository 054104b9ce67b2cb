"""Operators over event logs, threads and edges: sessions, batches, lineage, job claims and topological order."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Rounds
from .relational import map_groups


def isolated_batches(df: DataFrame, group: str, alone: Column, *order: str) -> DataFrame:
    """Adds batch from 1: rows in order, where each `alone` row is a batch of its own and ends the one before it."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(alone | F.coalesce(F.lag("__alone").over(w), F.lit(True)), 1).otherwise(0)
    return df.withColumn("__alone", alone).withColumn("__new", new).withColumn("batch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__alone", "__new")


def turn_spans(df: DataFrame, group: str, kind: str, start: str, ends: tuple[str, ...], *order: str) -> tuple[DataFrame, DataFrame]:
    """(turns, errors) of a log with explicit starts and ends.

    A turn runs from its start to the first end after it, and is lost at a start inside it. Rows
    outside a turn wait and belong to the next start, unless an end comes before. A start inside
    a turn and an end outside one are errors. Turns: the rows of closed turns with `turn` (a
    number in the group) and `outcome` (the end's kind)."""
    w = Window.partitionBy(group).orderBy(*order)
    is_start, is_end = F.col(kind) == start, F.col(kind).isin(*ends)
    mark = F.when(is_start | is_end, F.col(kind))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    starts = F.sum(F.when(is_start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = df.withColumn("__in", F.coalesce(before == start, F.lit(False))).withColumn("__next", after).withColumn("__n", starts)
    errors = d.where((is_start & F.col("__in")) | (is_end & ~F.col("__in"))).drop("__in", "__next", "__n")
    waits = ~F.col("__in") & ~is_start & ~is_end & (F.col("__next") == start)
    turn = F.when(is_start | F.col("__in"), F.col("__n")).when(waits, F.col("__n") + 1)
    rows = d.withColumn("turn", turn).where(F.col("turn").isNotNull())
    closed = rows.withColumn("outcome", F.max(F.when(is_end, F.col(kind))).over(Window.partitionBy(group, "turn")))
    return closed.where(F.col("outcome").isNotNull()).drop("__in", "__next", "__n"), errors


def lineage(metas: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, failures): each requested thread's chain of bases, the root first.

    Takes (thread, base, cutoff): a thread's base and the ordinal at which its own part begins.
    Segments: requested, place (from 0 at the root), thread, ends (exclusive cutoff in that
    segment; null for the requested thread itself). Failures: requested and why (`cycle` or
    `missing`). All chains climb at once, a round a step."""
    rounds = Rounds(metas.sparkSession)
    metas = rounds.keep(metas.select("thread", "base", "cutoff"))
    at = rounds.keep(requested.select(F.col("thread").alias("requested"), "thread", F.lit(None).cast("long").alias("ends"), F.lit(0).alias("depth"), F.array("thread").alias("seen")))
    segments, failures = None, None
    while not at.isEmpty():
        known = rounds.keep(at.join(metas.withColumn("__there", F.lit(True)), "thread", "left"))
        here = known.where("__there").select("requested", "thread", "ends", "depth")
        up = known.where("__there AND base IS NOT NULL")
        lost = known.where("__there IS NULL").select("requested", F.lit("missing").alias("why"))
        again = up.where(F.array_contains("seen", F.col("base"))).select("requested", F.lit("cycle").alias("why"))
        failed = lost.unionByName(again)
        segments = here if segments is None else segments.unionByName(here)
        failures = failed if failures is None else failures.unionByName(failed)
        at = rounds.keep(up.where(~F.array_contains("seen", F.col("base"))).select("requested", F.col("base").alias("thread"), F.col("cutoff").alias("ends"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("base")).alias("seen")))
    if segments is None:
        segments, failures = at.select("requested", "thread", "ends", "depth"), at.select("requested", F.lit("").alias("why"))
    bad = Rounds(metas.sparkSession).result(failures.distinct())
    good = segments.join(bad, "requested", "left_anti")
    placed = good.withColumn("place", F.max("depth").over(Window.partitionBy("requested")) - F.col("depth")).drop("depth")
    return rounds.result(placed), bad


def topological_order(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, node, place from 1): an order in which edges go forward and, among what is ready, the lower rank comes first.

    Takes nodes (group, node, rank) and edges (group, origin, target); what lies on a cycle comes
    last by rank. A queue per group: one group must fit a task."""
    t = dict(nodes.dtypes)
    rows = nodes.select(group, "node", "rank", F.lit(None).cast(t["node"]).alias("target"))
    links = edges.where(F.col("origin") != F.col("target")).select(group, F.col("origin").alias("node"), F.lit(None).cast(t["rank"]).alias("rank"), "target").distinct()

    def sort(part: list[tuple]) -> list[tuple]:
        rank = {n: r for _, n, r, target in part if target is None}
        out: dict = {n: [] for n in rank}
        waits = dict.fromkeys(rank, 0)
        for _, a, _, b in part:
            if b is not None and a in rank and b in rank:
                out[a].append(b)
                waits[b] += 1
        ready = [(rank[n], n) for n, w in waits.items() if not w]
        heapq.heapify(ready)
        order = []
        while ready:
            _, n = heapq.heappop(ready)
            order.append(n)
            for x in out[n]:
                waits[x] -= 1
                if not waits[x]:
                    heapq.heappush(ready, (rank[x], x))
        done = set(order)
        order += sorted((n for n in rank if n not in done), key=lambda n: (rank[n], n))
        return [(part[0][0], n, k) for k, n in enumerate(order, 1)]

    return map_groups(rows.unionByName(links), group, [], sort, f"{group} {t[group]}, node {t['node']}, place int")


def claim(now: Column, lease: int) -> Column:
    """What a try to claim a job ends in, from output_at, source_at, status, leased_at, retry_at and retries; null times are none."""
    fresh = F.coalesce(F.col("output_at") >= F.col("source_at"), F.lit(False))
    running = (F.col("status") == "running") & (F.col("leased_at") > now - lease)
    return (
        F.when(fresh, "up_to_date").when(F.coalesce(running, F.lit(False)), "running").when(F.col("retries") <= 0, "retry_exhausted")
        .when(F.coalesce(F.col("retry_at") > now, F.lit(False)), "retry_backoff").otherwise("claimed")
    )


def startup_claims(jobs: DataFrame, now: int, lease: int, scan_limit: int, max_claimed: int, max_age: int, min_idle: int, sources: tuple[str, ...]) -> DataFrame:
    """(id, outcome) of the jobs that a start looks at: of allowed sources, whose source changed at most `max_age` and at least
    `min_idle` ago, the `scan_limit` newest. The first `max_claimed` that may be claimed are; those after them are left.

    Takes what `claim` takes, with id and source; null sources and times fit nothing. Both limits are the feature."""
    fits = F.col("source").isin(*sources) & (F.col("source_at") >= now - max_age) & (F.col("source_at") <= now - min_idle)
    scanned = jobs.where(fits).orderBy(F.col("source_at").desc(), "id").limit(scan_limit).withColumn("outcome", claim(F.lit(now), lease))
    rank = F.row_number().over(Window.partitionBy("outcome").orderBy(F.col("source_at").desc(), "id"))  # over scan_limit rows
    return scanned.select("id", F.when((F.col("outcome") == "claimed") & (rank > max_claimed), "left").otherwise(F.col("outcome")).alias("outcome"))


def leases(now: Column, seconds: int) -> Column:
    """Whether a run may be claimed: not complete, and not running under a lease that still holds."""
    return (F.col("status") != "complete") & ((F.col("status") != "running") | (F.col("updated_at") <= now - seconds))


def first_uses(df: DataFrame, client: str, keys: list[str], limit: int, *order: str) -> DataFrame:
    """Rows whose key a client has not sent yet, and all rows with a null key. The client's memory is emptied when it holds `limit` keys.

    The memory is a sequence of its own, so each client's rows go through one task in order, in batches."""
    places = [df.columns.index(k) for k in keys]

    def keep(part: list[tuple]) -> list[tuple]:
        seen: set = set()
        wanted = []
        for row in part:
            key = tuple(row[i] for i in places)
            if any(k is None for k in key):
                wanted.append(row)
                continue
            if len(seen) >= limit:
                seen.clear()
            if key not in seen:
                wanted.append(row)
                seen.add(key)
        return wanted

    return map_groups(df, client, list(order), keep, ", ".join(f"{n} {t}" for n, t in df.dtypes))


# Kinds of log items that are kept always, and in one history mode only.
KEPT = ("message", "agent_message", "reasoning", "local_shell_call", "function_call", "tool_search_call", "function_call_output", "tool_search_output", "custom_tool_call", "custom_tool_call_output", "web_search_call", "image_generation_call", "compaction", "context_compaction")
KEPT_LINES = ("inter_agent_communication", "inter_agent_communication_metadata", "compacted", "turn_context", "world_state", "session_meta")
KEPT_EVENTS = ("token_count", "thread_goal_updated", "thread_rolled_back", "turn_aborted", "turn_started", "turn_complete", "thread_settings_applied")
LEGACY_EVENTS = ("user_message", "agent_message_event", "agent_reasoning", "agent_reasoning_raw_content", "entered_review_mode", "exited_review_mode", "patch_apply_end", "context_compacted", "mcp_tool_call_end", "web_search_end", "image_generation_end", "sub_agent_activity")
MEMORY = ("agent_message", "local_shell_call", "function_call", "tool_search_call", "function_call_output", "tool_search_output", "custom_tool_call", "custom_tool_call_output", "web_search_call")


def is_persisted(variant: Column, mode: Column, plan: Column) -> Column:
    """Whether a log item is kept: completed items in paginated mode or if they are plans, legacy events in legacy mode, others by kind."""
    always = variant.isin(*KEPT, *KEPT_LINES, *KEPT_EVENTS)
    return F.when(variant == "item_completed", (mode == "paginated") | plan).when(variant.isin(*LEGACY_EVENTS), mode == "legacy").otherwise(always)


def is_for_memories(variant: Column, role: Column) -> Column:
    """Messages of all roles but developer, agent messages, tool calls and their outputs, and web searches."""
    return F.when(variant == "message", role != "developer").otherwise(variant.isin(*MEMORY))


def commands_after(lines: Column, step: Column, window: int = 160, most: int = 8) -> Column:
    """Commands of a log as one line: from the first line that names the step (or the first of all) on, lines of `Run ` or in the mark of a shown command."""
    from ..functions.text import alnum_fold

    wanted = alnum_fold(step)
    at = F.when(wanted == "", 0).otherwise(F.array_position(F.transform(lines, lambda x: F.contains(alnum_fold(x), wanted)), True))
    part = F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), window)

    def command(x: Column) -> Column:
        clean = F.trim(F.regexp_replace(x, "\x1b\\[[0-9;]*[A-Za-z]", ""))
        return F.when(F.startswith(clean, F.lit("Run ")), F.trim(F.substring(clean, 5, 1 << 30))).when((clean != "") & F.contains(x, F.lit("\x1b[36;1m")), clean)

    return F.array_join(F.slice(F.array_compact(F.transform(part, command)), 1, most), " && ")


def prompt_size(tokens: Column, problems: Column, most_files: Column, limit: int = 150_000, target: int = 80_000, sample: int = 30_000) -> Column:
    """struct<tokens, needs_sampling, needs_chunking, chunk_size>: chunks of 5 problems, or of what fits the target (1 to 10) if the record is too large."""
    cut = (tokens > limit) & (problems > 1)
    size = F.when(cut, F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.lit(target) / F.floor(tokens / problems))))).otherwise(5)
    return F.struct(tokens.cast("long").alias("tokens"), ((tokens > sample) | (most_files > 10)).alias("needs_sampling"), cut.alias("needs_chunking"), size.cast("long").alias("chunk_size"))


def sampled_files(files: Column, most: int = 10, shown: int = 5) -> Column:
    """struct<files, pattern>: all files, or of many the first few and a pattern for the first one's folder."""
    many = F.size(files) > most
    first = F.try_element_at(files, F.lit(1))
    folder = F.regexp_extract(first, r"\A(.*)/[^/]*\z", 1)
    return F.struct(F.when(many, F.slice(files, 1, shown)).otherwise(files).alias("files"), F.when(many, F.when(folder != "", F.concat(folder, F.lit("/**/*"))).otherwise("*")).alias("pattern"))


def replay_start(df: DataFrame) -> DataFrame:
    """(thread, start): the line from which a replay can begin, -1 for the whole log.

    Takes (thread, line, kind). Read from the end, a replay may stop at the first turn context
    after it has met a compaction, unless it meets a rollback before that."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("line")))
    marks = df.groupBy("thread").agg(last("compaction").alias("compacted"), last("rollback").alias("rolled"))
    cut = df.where("kind = 'turn_context'").join(marks.select("thread", "compacted"), "thread").where("line < compacted").groupBy("thread").agg(F.max("line").alias("cut"))
    j = marks.join(cut, "thread", "left")
    fine = F.col("cut").isNotNull() & (F.col("rolled").isNull() | (F.col("rolled") < F.col("cut")))
    return j.select("thread", F.when(fine, F.col("cut")).otherwise(-1).alias("start"))
