"""Queries over logs, threads, edges and jobs. The log is events (a thread a user), threads are conversations, parts or customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import relational as R
from ..sources.io import read_table
from .base import query
from .diffs import _PATH
from .selection import _SPOT

_MARK = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'aborted' ELSE 'item' END"
_LOG = f"SELECT event_id, user_id, ts, {_MARK} AS kind, event_type <> 'click' AS kept, strlen(props) AS bytes FROM events"


def _log(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "aborted").otherwise("item")
    return read_table(spark, d, "events").select("event_id", "user_id", "ts", kind.alias("kind"), (F.col("event_type") != "click").alias("kept"), F.octet_length("props").alias("bytes"))


_SPANS = "w AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'item' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start', false) AS inside, first_value(CASE WHEN kind <> 'item' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS upcoming, count(*) FILTER (kind = 'start') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM l)"


@query(f"WITH l AS ({_LOG}), {_SPANS}, t AS (SELECT *, CASE WHEN kind = 'start' OR inside THEN n WHEN kind = 'item' AND upcoming = 'start' THEN n + 1 END AS turn FROM w) SELECT user_id, turn, max(kind) FILTER (kind IN ('complete', 'aborted')) AS outcome, count(*) AS items, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (kept) AS kept_items, CAST(coalesce(sum(bytes) FILTER (kept), 0) AS BIGINT) AS kept_bytes FROM t WHERE turn IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (kind IN ('complete', 'aborted')) > 0")
def turn_sizes(spark, d):
    """Items and bytes of every closed turn, before and after the policy that drops rows, with the rows that waited for its start."""
    turns, _ = H.turn_spans(_log(spark, d), "user_id", "kind", "start", ("complete", "aborted"), "ts", "event_id")
    return turns.groupBy("user_id", "turn", "outcome").agg(F.count(F.lit(1)).alias("items"), F.sum("bytes").cast("long").alias("bytes"), F.count_if("kept").alias("kept_items"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).cast("long").alias("kept_bytes"))


@query(f"WITH l AS ({_LOG}), {_SPANS} SELECT event_id, kind FROM w WHERE (kind = 'start' AND inside) OR (kind IN ('complete', 'aborted') AND NOT inside)")
def turn_errors(spark, d):
    """Starts inside a turn and ends outside one."""
    return H.turn_spans(_log(spark, d), "user_id", "kind", "start", ("complete", "aborted"), "ts", "event_id")[1].select("event_id", "kind")


@query("WITH e AS (SELECT event_id, user_id, event_type = 'error' AS alone, lag(event_type = 'error', 1, true) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events) SELECT event_id, CAST(sum(CASE WHEN alone OR after THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch FROM e")
def event_batches(spark, d):
    """events in request batches; an error goes alone and ends the batch before it."""
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type")
    return H.isolated_batches(e, "user_id", F.col("event_type") == "error", "event_id").select("event_id", "batch")


@query()
def first_tool_uses(spark, d):
    """Events whose turn and tool a client has not sent yet, or without a tool; a client remembers 40 keys here, then starts afresh."""
    e = read_table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 500).alias("turn"), F.when(F.col("value") >= 5, F.coalesce("event_type", F.lit("remote"))).alias("tool"))
    return H.first_uses(e, "user_id", ["turn", "tool"], 40, "event_id").select("event_id")


_ITEMS = "SELECT conv_id AS thread, turn AS item, CASE role WHEN 'user' THEN 'userMessage' WHEN 'assistant' THEN 'agentMessage' ELSE 'other' END AS kind, CASE WHEN (conv_id + turn) % 4 = 1 THEN 'final_answer' WHEN (conv_id + turn) % 4 = 3 THEN 'draft' END AS phase, CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'inProgress' ELSE 'failed' END AS status, text FROM conversations"


@query(f"WITH i AS ({_ITEMS}), s AS (SELECT thread, min(item) FILTER (kind = 'userMessage') AS first_user, coalesce(max(item) FILTER (kind = 'agentMessage' AND phase = 'final_answer'), CASE WHEN any_value(status) IN ('completed', 'interrupted', 'failed') THEN max(item) FILTER (kind = 'agentMessage' AND phase IS NULL) END) AS final_agent FROM i GROUP BY 1) SELECT s.thread, i.item, CASE WHEN i.item = s.first_user THEN 'first_user' ELSE 'final_agent' END AS part, md5(coalesce(i.text, '')) AS text FROM s JOIN i ON i.thread = s.thread AND (i.item = s.first_user OR i.item = s.final_agent)")
def summary_items(spark, d):
    """The first user item of a turn, and its last final answer, or once the turn has ended the last agent item without a phase; with their texts."""
    i = spark.sql(_ITEMS.replace("FROM conversations", "FROM {conversations}"), conversations=read_table(spark, d, "conversations"))
    agent, ended = F.col("kind") == "agentMessage", F.first("status").isin("completed", "interrupted", "failed")
    best = lambda cond: F.max(F.when(cond, F.col("item")))
    s = i.groupBy("thread").agg(F.min(F.when(F.col("kind") == "userMessage", F.col("item"))).alias("first_user"), F.coalesce(best(agent & (F.col("phase") == "final_answer")), F.when(ended, best(agent & F.col("phase").isNull()))).alias("final_agent"))
    wanted = s.select("thread", F.explode(F.array(F.struct(F.lit("first_user").alias("part"), F.col("first_user").alias("item")), F.struct(F.lit("final_agent").alias("part"), F.col("final_agent").alias("item")))).alias("x")).select("thread", "x.part", "x.item").where("item IS NOT NULL")
    return wanted.join(i.select("thread", "item", F.md5(F.coalesce("text", F.lit(""))).alias("text")), ["thread", "item"]).select("thread", "item", "part", "text")


_EDGES = "e AS (SELECT o_custkey AS child, arg_max(o_orderkey % 97, o_orderkey) AS parent, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'closed' ELSE 'open' END AS status FROM orders GROUP BY 1)"


def spawn_edges(spark, d) -> DataFrame:
    """(child, parent, status): each child's latest parent, then status updates by child; an update of no edge does nothing."""
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("child"), (F.col("o_orderkey") % 97).alias("parent"), F.lit("open").alias("status"), "o_orderkey")
    edges = R.latest_by(o, "child", "o_orderkey", "parent", "status")
    updates = read_table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("child"), F.lit("closed").alias("new"))
    return edges.join(updates, "child", "left").select("child", "parent", F.coalesce("new", "status").alias("status"))


@query(f"WITH {_EDGES} SELECT parent, string_agg(child, ',' ORDER BY child) AS children, count(*) FILTER (status = 'closed') AS closed FROM e GROUP BY 1")
def spawn_children(spark, d):
    """Edges with one parent a child (the last one wins) and updated status; the direct children of every parent, by id."""
    g = spawn_edges(spark, d).groupBy("parent").agg(F.sort_array(F.collect_list("child")).alias("c"), F.count_if(F.col("status") == "closed").alias("closed"))
    return g.select("parent", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("children"), "closed")


_METAS = "SELECT p_partkey AS thread, CASE WHEN p_partkey IN (33, 34) THEN 67 - p_partkey WHEN p_partkey % 41 = 5 THEN 1000000000 WHEN p_partkey > 1 THEN p_partkey // 2 END AS base, CAST(p_size AS BIGINT) AS cutoff FROM part"


@query(f"WITH RECURSIVE m AS ({_METAS}), c(requested, thread, ends, depth, seen, base, cutoff) AS (SELECT thread, thread, CAST(NULL AS BIGINT), 0, [thread], base, cutoff FROM m WHERE thread % 3 = 0 UNION ALL SELECT c.requested, c.base, c.cutoff, c.depth + 1, list_append(c.seen, c.base), m.base, m.cutoff FROM c LEFT JOIN m ON m.thread = c.base WHERE c.base IS NOT NULL AND NOT list_contains(c.seen, c.base)), bad AS (SELECT DISTINCT requested FROM c WHERE (base IS NOT NULL AND list_contains(seen, base)) OR thread NOT IN (SELECT thread FROM m)) SELECT requested, CAST(max(depth) OVER (PARTITION BY requested) - depth AS INTEGER) AS place, thread, ends FROM c WHERE requested NOT IN (SELECT requested FROM bad)")
def thread_lineage(spark, d):
    """Each requested thread's chain of bases from the root on, with the ordinal where the next one takes over; chains with a cycle or a gap are left out."""
    k = F.col("p_partkey")
    base = F.when(k.isin(33, 34), 67 - k).when(k % 41 == 5, 1000000000).when(k > 1, F.floor(k / 2))
    metas = read_table(spark, d, "part").select(k.alias("thread"), base.alias("base"), F.col("p_size").cast("long").alias("cutoff"))
    return H.lineage(metas, metas.where("thread % 3 = 0").select("thread"))[0].select("requested", "place", "thread", "ends")


@query(f"WITH RECURSIVE m AS ({_METAS}), c(requested, thread, seen, base) AS (SELECT thread, thread, [thread], base FROM m WHERE thread % 3 = 0 UNION ALL SELECT c.requested, c.base, list_append(c.seen, c.base), m.base FROM c LEFT JOIN m ON m.thread = c.base WHERE c.base IS NOT NULL AND NOT list_contains(c.seen, c.base)) SELECT DISTINCT requested, CASE WHEN base IS NOT NULL THEN 'cycle' ELSE 'missing' END AS why FROM c WHERE (base IS NOT NULL AND list_contains(seen, base)) OR thread NOT IN (SELECT thread FROM m)")
def lineage_failures(spark, d):
    """Requested threads whose chain has a cycle or misses a thread."""
    k = F.col("p_partkey")
    base = F.when(k.isin(33, 34), 67 - k).when(k % 41 == 5, 1000000000).when(k > 1, F.floor(k / 2))
    metas = read_table(spark, d, "part").select(k.alias("thread"), base.alias("base"), F.col("p_size").cast("long").alias("cutoff"))
    return H.lineage(metas, metas.where("thread % 3 = 0").select("thread"))[1]


_PAGES = " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS page, event_id, {more} AS has_more, row_number() OVER (ORDER BY event_id {way}) = 7 AS next, row_number() OVER (ORDER BY event_id {way}) = 1 AS back FROM events WHERE event_type = 'view' AND event_id {op} 400 ORDER BY event_id {way} LIMIT 7)" for name, op, way, more in (("after", ">", "ASC", "count(*) OVER () > 7"), ("from", ">=", "ASC", "count(*) OVER () > 7"), ("before", "<", "DESC", "count(*) OVER () > 7"), ("until", "<=", "DESC", "count(*) OVER () > 7")))


@query(_PAGES)
def anchor_pages(spark, d):
    """Ids of seven filtered rows on either side of an anchor, with and without it, whether there is more, and which rows the next and the backward cursor name."""
    e = read_table(spark, d, "events").where("event_type = 'view'").select("event_id")
    out = None
    for name, up, with_anchor in (("after", True, False), ("from", True, True), ("before", False, False), ("until", False, True)):
        page = R.keyset_page(e, "event_id", 400, 7, up, with_anchor)
        k = F.row_number().over(Window.orderBy(F.col("event_id").asc() if up else F.col("event_id").desc()))  # over seven rows
        page = page.select(F.lit(name).alias("page"), "event_id", "has_more", (k == 7).alias("next"), (k == 1).alias("back"))
        out = page if out is None else out.unionByName(page)
    return out


_NAMES = "n AS (SELECT event_id AS line, user_id AS id, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'n' || (event_id % 9) END AS name FROM events WHERE event_type <> 'error')"


@query(f"WITH {_NAMES}, l AS (SELECT id, arg_max(name, line) AS name FROM n WHERE trim(name) <> '' AND id % 10 <> 3 GROUP BY 1), c AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey < 200) SELECT c.id, coalesce(l.name, c.c_name) AS shown, l.name = 'n3' AS is_n3 FROM c LEFT JOIN l ON l.id = c.id")
def thread_names(spark, d):
    """A listing with each thread's latest non-blank name, if it has one; rows of a removed thread are gone, and only latest names are compared."""
    n = read_table(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("line"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("n"), (F.col("event_id") % 9).cast("string"))).alias("name"))
    removed = spark.range(1000).where("id % 10 = 3").select("id")
    latest = R.latest_by(n.join(removed, "id", "left_anti").where(F.trim("name") != ""), "id", "line", "name")
    c = read_table(spark, d, "customer").where("c_custkey < 200").select(F.col("c_custkey").alias("id"), "c_name")
    return c.join(latest, "id", "left").select("id", F.coalesce("name", "c_name").alias("shown"), (F.col("name") == "n3").alias("is_n3"))


_JOBS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 5 END AS output_at, c_custkey + c_nationkey AS source_at, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'idle' END AS status, 1000 - c_custkey % 7 * 100 AS leased_at, CASE WHEN c_custkey % 5 = 0 THEN 900 + c_custkey % 300 END AS retry_at, c_nationkey % 4 AS retries FROM customer"


@query(f"SELECT id, CASE WHEN output_at >= source_at THEN 'up_to_date' WHEN status = 'running' AND leased_at > 1000 - 300 THEN 'running' WHEN retries <= 0 THEN 'retry_exhausted' WHEN retry_at > 1000 THEN 'retry_backoff' ELSE 'claimed' END AS outcome FROM ({_JOBS})")
def job_claims(spark, d):
    """What a try to claim each job ends in."""
    jobs = spark.sql(_JOBS.replace("FROM customer", "FROM {customer}"), customer=read_table(spark, d, "customer"))
    return jobs.select("id", H.claim(F.lit(1000), 300).alias("outcome"))


@query(f"""
WITH j AS (SELECT *, (id % 3) AS kind FROM ({_JOBS})),
s AS (SELECT * FROM j WHERE kind IN (0, 2) AND source_at >= 4000 - 3800 AND source_at <= 4000 - 50 ORDER BY source_at DESC, id LIMIT 500),
o AS (SELECT id, source_at, CASE WHEN output_at >= source_at THEN 'up_to_date' WHEN status = 'running' AND leased_at > 4000 - 3300 THEN 'running' WHEN retries <= 0 THEN 'retry_exhausted' WHEN retry_at > 4000 THEN 'retry_backoff' ELSE 'claimed' END AS outcome FROM s)
SELECT id, CASE WHEN outcome = 'claimed' AND row_number() OVER (PARTITION BY outcome ORDER BY source_at DESC, id) > 100 THEN 'left' ELSE outcome END AS outcome FROM o
""")
def startup_claims(spark, d):
    """Jobs that a start looks at, by allowed sources, age, idle time and a limit on what is scanned, and the first of them that it claims."""
    jobs = spark.sql(_JOBS.replace("FROM customer", "FROM {customer}"), customer=read_table(spark, d, "customer"))
    return H.startup_claims(jobs.withColumn("source", (F.col("id") % 3).cast("string")), 4000, 3300, 500, 100, 3800, 50, ("0", "2"))


@query("WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' ELSE 'idle' END AS status, s_suppkey * 10 AS updated_at, CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_suppkey END AS given, 'old' AS kept FROM supplier) SELECT id, status <> 'complete' AND (status <> 'running' OR updated_at <= 1000 - 600) AS claimed, CASE WHEN status <> 'complete' AND (status <> 'running' OR updated_at <= 1000 - 600) THEN coalesce(given, kept) ELSE kept END AS watermark FROM s")
def backfill_claims(spark, d):
    """Whether a backfill may be claimed, and its watermark after: the given one, else the old one."""
    k = F.col("s_suppkey")
    s = read_table(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "complete").otherwise("idle").alias("status"), (k * 10).alias("updated_at"), F.when(k % 2 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("given"), F.lit("old").alias("kept"))
    claimed = H.leases(F.lit(1000), 600)
    return s.select("id", claimed.alias("claimed"), F.when(claimed, F.coalesce("given", "kept")).otherwise(F.col("kept")).alias("watermark"))


@query("WITH f AS (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) AS k FROM pages WHERE url > 'http://e') SELECT page_id, CAST((k - 1) // 200 AS BIGINT) AS batch FROM f")
def watermark_batches(spark, d):
    """Files beyond a watermark in path order, in batches of 200."""
    p = read_table(spark, d, "pages").where(F.col("url") > "http://e").select("page_id", "url")
    return R.global_rank(p, "k", "url", "page_id").select("page_id", F.floor((F.col("k") - 1) / 200).alias("batch"))


@query("WITH b AS (SELECT user_id, count(*) AS scanned, count(*) FILTER (event_type <> 'error') AS upserted, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1) SELECT *, CASE WHEN failed = 0 THEN 'success' WHEN upserted = 0 THEN 'failed' ELSE 'partial_failure' END AS status FROM b")
def backfill_stats(spark, d):
    """Rows scanned, written and failed, and what that makes of a run."""
    bad = F.col("event_type") == "error"
    b = read_table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~bad).alias("upserted"), F.count_if(bad).alias("failed"))
    return b.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("upserted") == 0, "failed").otherwise("partial_failure"))


@query("WITH m AS (SELECT o_custkey AS id, arg_min(o_orderkey % 300, o_orderkey) AS base FROM orders GROUP BY 1) SELECT base AS id, count(*) AS n FROM m WHERE base <> id GROUP BY 1")
def reference_counts(spark, d):
    """How many threads build on each; of a thread's records the first counts, and none on itself."""
    o = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min_by(F.col("o_orderkey") % 300, "o_orderkey").alias("base"))
    return o.where("base <> id").groupBy(F.col("base").alias("id")).agg(F.count(F.lit(1)).alias("n"))


_USAGE = "SELECT p_partkey AS id, p_size % 6 AS uses, CASE WHEN p_partkey % 3 > 0 THEN 1000 - p_partkey % 90 END AS last_usage, 950 + p_size AS generated_at FROM part"


@query(f"WITH u AS ({_USAGE}), e AS (SELECT *, coalesce(last_usage, generated_at) AS recent FROM u WHERE coalesce(last_usage, generated_at) >= 1000 - 30) SELECT id, uses, recent FROM e ORDER BY uses DESC, recent DESC, id LIMIT 40")
def recent_memories(spark, d):
    """Memories used, or if never used made, within 30 days: the 40 most used, then most recent."""
    u = spark.sql(_USAGE.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))
    return u.select("id", "uses", F.coalesce("last_usage", "generated_at").alias("recent")).where(F.col("recent") >= 970).orderBy(F.col("uses").desc(), F.col("recent").desc(), "id").limit(40)


@query("WITH e AS (SELECT user_id % 7 AS url, user_id % 3 AS account, coalesce(nullif(event_type, 'view'), '') AS client, event_id AS server, event_id % 2 = 0 AS enabled, event_id AS seq FROM events) SELECT url, account, client, max(server) AS server, arg_min(enabled, seq) AS enabled, min(seq) AS first_seen FROM e GROUP BY ALL")
def enrollments(spark, d):
    """The latest values by a key of three parts (a missing client is blank), the flag and the first time as first given."""
    e = read_table(spark, d, "events").select((F.col("user_id") % 7).alias("url"), (F.col("user_id") % 3).alias("account"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("")).alias("client"), "event_id", (F.col("event_id") % 2 == 0).alias("flag"))
    return e.groupBy("url", "account", "client").agg(F.max("event_id").alias("server"), F.min_by("flag", "event_id").alias("enabled"), F.min("event_id").alias("first_seen"))


_VARIANTS = ("message", "agent_message", "reasoning", "local_shell_call", "function_call_output", "web_search_call", "image_generation_call", "compaction", "additional_tools", "other", "item_completed", "user_message", "turn_started", "error", "session_meta")
_ITEM = f"SELECT event_id, user_id % 4 = 0 AS developer, CASE WHEN user_id % 2 = 0 THEN 'paginated' ELSE 'legacy' END AS mode, event_id % 5 = 0 AS plan, CASE event_id % 15 {' '.join(f'WHEN {i} THEN {chr(39)}{v}{chr(39)}' for i, v in enumerate(_VARIANTS))} END AS variant FROM events"


@query(f"SELECT event_id, CASE WHEN variant = 'item_completed' THEN mode = 'paginated' OR plan WHEN variant = 'user_message' THEN mode = 'legacy' ELSE variant NOT IN ('additional_tools', 'other', 'error') END AS persisted, CASE WHEN variant = 'message' THEN NOT developer ELSE variant IN ('agent_message', 'local_shell_call', 'function_call_output', 'web_search_call') END AS memory FROM ({_ITEM})")
def persisted_items(spark, d):
    """Log items that are kept, by kind and history mode, and those that memories are made from."""
    i = spark.sql(_ITEM.replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events"))
    return i.select("event_id", H.is_persisted(F.col("variant"), F.col("mode"), F.col("plan")).alias("persisted"), H.is_for_memories(F.col("variant"), F.when(F.col("developer"), "developer").otherwise("user")).alias("memory"))


_NODES = f"SELECT l_orderkey AS key, {_SPOT} AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)"


@query()
def dependency_order(spark, d):
    """H7: an issue's problems so that dependencies come first and then the requested order; what a cycle holds comes last."""
    nodes = spark.sql(_NODES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    a, b = (nodes.select("key", F.col("node").alias(n), F.col("rank").alias(r)) for n, r in (("origin", "ra"), ("target", "rb")))
    edges = a.join(b, "key").where("origin <> target AND (origin + 3 * target) % 5 = 0").select("key", "origin", "target")
    return H.topological_order(nodes, edges, "key")


_REASONS = "SELECT l_orderkey AS key, l_linenumber AS n, 'Issue ' || l_orderkey || ', Problem ' || l_linenumber AS ref, min(l_partkey % 7) AS repair_order FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1, 2"


@query(f"WITH p AS (SELECT DISTINCT l_orderkey AS key, l_linenumber AS n FROM lineitem), r AS ({_REASONS}) SELECT p.key, p.n, CASE WHEN p.key % 9 = 0 THEN NULL WHEN r.repair_order = 0 THEN 999 ELSE r.repair_order END AS repair_order, CAST(p.n - 1 AS VARCHAR) AS depends_on, p.n = 1 AS must_fix_first, CASE WHEN p.n > 1 THEN 'validation_' || (p.n - 1) || '_passed' END AS revealed_after FROM p LEFT JOIN r ON r.key = p.key AND r.n = p.n")
def applied_dependencies(spark, d):
    """H8, H9: dependency notes found by 'Issue x, Problem y' and written to their problems (none to issues with an error; 999 without an order), and each step's place in the chain."""
    lines = read_table(spark, d, "lineitem")
    p = lines.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n")).distinct()
    notes = spark.sql(_REASONS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    ref = r"Issue\s*(\d+)\s*,\s*Problem\s*(\d+)"
    found = notes.where(F.rlike("ref", F.lit(ref))).select(F.regexp_extract("ref", ref, 1).cast("long").alias("key"), F.regexp_extract("ref", ref, 2).cast("int").alias("n"), F.coalesce(F.nullif("repair_order", F.lit(0)), F.lit(999)).alias("repair_order"))
    j = p.join(found, ["key", "n"], "left")
    before = (F.col("n") - 1).cast("string")
    return j.select("key", "n", F.when(F.col("key") % 9 != 0, F.col("repair_order")).alias("repair_order"), before.alias("depends_on"), (F.col("n") == 1).alias("must_fix_first"), F.when(F.col("n") > 1, F.concat(F.lit("validation_"), before, F.lit("_passed"))).alias("revealed_after"))


_GROUPED = f"SELECT l_orderkey % 50 AS grp, l_returnflag AS kind, {_SPOT} AS spot, {_PATH} AS file, 'reason ' || (l_suppkey % 4) AS reason, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'cmd' || (l_partkey % 5) END AS command FROM lineitem"


@query(f"WITH g AS ({_GROUPED}), f AS (SELECT grp, kind, file, min(spot) AS first FROM g GROUP BY ALL) SELECT grp, kind, coalesce((SELECT arg_min(reason, spot) FROM g WHERE g.grp = f.grp AND g.kind = f.kind), '') AS reason, string_agg(file, ',' ORDER BY first) AS files FROM f GROUP BY grp, kind")
def merged_groups(spark, d):
    """Groups of one key merged: their files each once, as first seen, and the first reason."""
    g = spark.sql(_GROUPED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    files = g.groupBy("grp", "kind", "file").agg(F.min("spot").alias("first"), F.min_by("reason", "spot").alias("reason"))  # one row a file before it is gathered
    out = files.groupBy("grp", "kind").agg(F.min_by("reason", "first").alias("reason"), F.sort_array(F.collect_list(F.struct("first", "file"))).alias("x"))
    return out.select("grp", "kind", "reason", F.array_join(F.transform("x", lambda x: x["file"]), ",").alias("files"))


@query(f"WITH g AS ({_GROUPED}), k AS (SELECT *, coalesce(command, 'unknown') || '|' || coalesce(kind, 'unknown') AS k FROM g WHERE grp % 11 <> 0) SELECT k, count(*) AS n, count(DISTINCT grp) AS issues FROM k GROUP BY 1")
def similar_groups(spark, d):
    """Problems by command and type, `unknown` where one is missing; issues with an error are left out."""
    g = spark.sql(_GROUPED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem")).where("grp % 11 <> 0")
    key = F.concat_ws("|", F.coalesce("command", F.lit("unknown")), F.coalesce("kind", F.lit("unknown")))
    return g.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("issues"))


_BY_FILE = f"SELECT grp, CASE WHEN kind = 'N' THEN '_global_' ELSE file END AS file, reason, command, spot FROM ({_GROUPED})"


@query(f"WITH g AS ({_BY_FILE}), r AS (SELECT grp, file, reason, min(spot) AS first FROM g GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY grp, file ORDER BY first) AS i FROM r), t AS (SELECT grp, file, string_agg(i || '. ' || reason, chr(10) ORDER BY i) AS reasons FROM m GROUP BY ALL), n AS (SELECT grp, file, count(*) AS problems, min(spot) AS first, coalesce(string_agg(DISTINCT command, ', ' ORDER BY command), '') AS commands FROM g GROUP BY ALL) SELECT n.grp, n.file, problems, reasons, commands, CAST(row_number() OVER (PARTITION BY n.grp ORDER BY problems DESC, first) AS INTEGER) AS place, problems >= 2 AS high FROM n JOIN t ON t.grp = n.grp AND t.file = n.file")
def problems_by_file(spark, d):
    """Problems gathered by file (those without one under `_global_`): numbered distinct reasons, sorted distinct commands, files by their number of problems, and which are of high priority."""
    g = spark.sql(_BY_FILE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    reasons = g.groupBy("grp", "file", "reason").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"), F.collect_set("command").alias("commands"))
    f = reasons.groupBy("grp", "file").agg(F.sum("n").alias("problems"), F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("first", "reason"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("commands")))).alias("c"))
    numbered = F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["reason"]))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("problems").desc(), "first"))
    return f.select("grp", "file", "problems", F.array_join(numbered, "\n").alias("reasons"), F.array_join("c", ", ").alias("commands"), place.alias("place"), (F.col("problems") >= 2).alias("high"))


_PATTERNS = f"SELECT l_suppkey AS pattern, l_linestatus AS side, {_SPOT} AS spot, CASE WHEN l_partkey % 8 = 0 THEN '' ELSE {_PATH} || (l_partkey % 3) END AS file, 'change ' || (l_partkey % 15) AS change, l_orderkey FROM lineitem"


@query(f"WITH p AS (SELECT *, CASE side WHEN 'F' THEN 0 ELSE 1 END AS o FROM ({_PATTERNS})), f AS (SELECT pattern, file, min(struct_pack(o := o, spot := spot, k := l_orderkey)) AS first FROM p WHERE file <> '' GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY first) AS i FROM f), c AS (SELECT pattern, change, min(struct_pack(o := o, spot := spot, k := l_orderkey)) AS first FROM p GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY first) AS i FROM c) SELECT d.pattern, any_value(x.examples) AS examples, string_agg(change, ',' ORDER BY i) FILTER (i <= 10) AS changes FROM d LEFT JOIN (SELECT pattern, string_agg(file, ',' ORDER BY i) AS examples FROM e WHERE i <= 10 GROUP BY 1) x USING (pattern) GROUP BY d.pattern")
def merged_patterns(spark, d):
    """old and new records of a pattern merged: examples by file and dependent changes, each once, old ones first, ten at most."""
    p = spark.sql(_PATTERNS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem")).withColumn("at", F.struct(F.when(F.col("side") == "F", 0).otherwise(1).alias("o"), "spot", "l_orderkey"))

    def ten(df: DataFrame, value: str, name: str) -> DataFrame:
        once = df.groupBy("pattern", value).agg(F.min("at").alias("at"))
        kept = once.withColumn("i", F.row_number().over(Window.partitionBy("pattern").orderBy("at"))).where("i <= 10")  # a group's first ten are taken before it is gathered
        return kept.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("i", value))).alias("x")).select("pattern", F.array_join(F.transform("x", lambda x: x[value]), ",").alias(name))

    return ten(p, "change", "changes").join(ten(p.where("file <> ''"), "file", "examples"), "pattern", "left").select("pattern", "examples", "changes")


@query(f"WITH p AS (SELECT l_suppkey AS chunk, {_SPOT} AS spot, l_orderkey % 40 AS run, 'sign ' || (l_partkey % 30) AS sign FROM lineitem), s AS (SELECT run, sign, min(struct_pack(c := chunk, s := spot)) AS first FROM p GROUP BY ALL) SELECT p.run, count(*) AS steps, CAST(max(p.n) AS BIGINT) AS last_step, any_value(x.signs) AS signs FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY chunk, spot) AS n FROM p) p JOIN (SELECT run, string_agg(sign, ',' ORDER BY first) AS signs FROM s GROUP BY 1) x ON x.run = p.run GROUP BY p.run")
def merged_strategies(spark, d):
    """results of chunks merged: distinct signs in order, and steps numbered on from 1."""
    p = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chunk"), F.expr(_SPOT).alias("spot"), (F.col("l_orderkey") % 40).alias("run"), F.concat(F.lit("sign "), (F.col("l_partkey") % 30).cast("string")).alias("sign"))
    once = p.groupBy("run", "sign").agg(F.min(F.struct("chunk", "spot")).alias("first"))
    signs = once.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("first", "sign"))).alias("x")).select("run", F.array_join(F.transform("x", lambda x: x["sign"]), ",").alias("signs"))
    steps = p.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("chunk", "spot"))).groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.max("n").cast("long").alias("last_step"))
    return steps.join(signs, "run").select("run", "steps", "last_step", "signs")
