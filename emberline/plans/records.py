"""Queries over issue records, outcomes and usage: projections, joins of sides, and summaries. Issues are orders, their problems line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..sources.io import read_table
from .base import query
from .diffs import _PATH
from .selection import _SPOT

_RAW = f"SELECT l_orderkey AS issue, {_SPOT} AS spot, l_linenumber AS id, CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'why ' || l_partkey END AS why, 'older why' AS older_why, CASE WHEN l_suppkey % 3 > 0 THEN {_PATH} END AS file, 'plan.py' AS other_file, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'pytest ' || (l_suppkey % 7) END AS cmd, 'make' AS other_cmd, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'did ' || l_suppkey END AS how, l_linestatus = 'O' AS cascading, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_partkey % 5 END AS place, CASE l_suppkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS relevance, l_returnflag AS flag FROM lineitem"


def issues(spark: SparkSession, d: str) -> DataFrame:
    """(issue, problems): each issue's problem records in order, nested."""
    raw = spark.sql(_RAW.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    record = F.struct("spot", "id", "why", "older_why", F.when(F.col("file").isNull(), F.array().cast("array<string>")).otherwise(F.array("file")).alias("affected_files"), F.array("other_file").alias("files"), "cmd", "other_cmd", "how", "cascading", "place", "relevance", "flag")
    return raw.groupBy("issue").agg(F.sort_array(F.collect_list(record)).alias("problems"))


def given(*values) -> F.Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


@query(f"SELECT issue, spot, coalesce(nullif(why, ''), nullif(older_why, ''), '') AS why_fix_works, CASE WHEN file IS NULL THEN 'plan.py' ELSE file END AS files, coalesce(nullif(cmd, ''), other_cmd) AS verification_cmd FROM ({_RAW})")
def problem_fields(spark, d):
    """The fields that problems keep, each with its older names to fall back on."""
    files = lambda p: F.when(F.size(p["affected_files"]) > 0, p["affected_files"]).otherwise(p["files"])
    kept = F.transform("problems", lambda p: F.struct(p["spot"].alias("spot"), given(p["why"], p["older_why"]).alias("why_fix_works"), F.array_join(files(p), ",").alias("files"), given(p["cmd"], p["other_cmd"]).alias("verification_cmd")))
    return issues(spark, d).select("issue", F.inline(kept))


@query(f"WITH r AS (SELECT *, 'owner' || (issue % 3) || '/repo' AS repo FROM ({_RAW})) SELECT issue, spot, CASE WHEN issue % 4 = 0 THEN NULL ELSE 'owner' || (issue % 3) END AS repo_owner, CASE WHEN how = '' THEN '' ELSE trim(how || chr(10) || chr(10) || 'Why this works: ' || coalesce(why, ''), ' ' || chr(10)) END AS fix_strategy, CASE WHEN cascading AND id > 1 THEN CAST(id - 1 AS VARCHAR) ELSE '' END AS enabled FROM r")
def memory_problems(spark, d):
    """Issues as memory entries: the owner of a full repository name, a fix strategy of two fields, and what a cascading problem builds on."""
    how, why = lambda p: F.coalesce(p["how"], F.lit("")), lambda p: F.coalesce(p["why"], F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    entry = F.transform("problems", lambda p: F.struct(p["spot"].alias("spot"), F.when(how(p) == "", "").otherwise(strip(F.concat(how(p), F.lit("\n\nWhy this works: "), why(p)))).alias("fix_strategy"), F.when(p["cascading"] & (p["id"] > 1), (p["id"] - 1).cast("string")).otherwise("").alias("enabled")))
    repo = F.when(F.col("issue") % 4 == 0, "repo").otherwise(F.concat(F.lit("owner"), (F.col("issue") % 3).cast("string"), F.lit("/repo")))
    owner = F.when(F.contains(repo, F.lit("/")), F.substring_index(repo, "/", 1))
    return issues(spark, d).select("issue", owner.alias("repo_owner"), F.inline(entry)).select("issue", "spot", "repo_owner", "fix_strategy", "enabled")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY spot, id) AS k FROM ({_RAW})) SELECT issue, spot, CASE WHEN relevance = 'high' OR flag = 'A' OR relevance IS NOT NULL THEN 'primary' ELSE 'hidden' END AS problem_type, coalesce(nullif(cmd, ''), other_cmd) AS validation_cmd, CAST(coalesce(nullif(place, 0), k) AS BIGINT) AS validation_order, CAST(k AS INTEGER) AS repair_sequence_index FROM r")
def normal_problems(spark, d):
    """Problems in one structure: primary if CI shows them in any way, their command by its newer or older name, their order or else their place."""
    ci = lambda p: p["relevance"].isNotNull() | (p["flag"] == "A")
    p = F.transform("problems", lambda p, i: F.struct(p["spot"].alias("spot"), F.when(ci(p), "primary").otherwise("hidden").alias("problem_type"), given(p["cmd"], p["other_cmd"]).alias("validation_cmd"), F.coalesce(F.nullif(p["place"], F.lit(0)), (i + 1).cast("long")).cast("long").alias("validation_order"), (i + 1).alias("repair_sequence_index")))
    return issues(spark, d).select("issue", F.inline(p))


@query("WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'i' || event_id END AS a, CASE WHEN event_id % 3 = 0 THEN 'd' || event_id END AS b, CASE WHEN event_id % 2 = 0 THEN 'o' || event_id END AS c FROM events) SELECT event_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '') AS id, CASE WHEN coalesce(nullif(a, ''), nullif(b, '')) IS NULL THEN 'missing' ELSE 'ok' END AS checked, lower(CASE WHEN event_id % 4 = 0 THEN 'Repo' ELSE 'Base' || event_id % 3 END) AS repo FROM events JOIN e USING (event_id)")
def record_ids(spark, d):
    """A record's id by four names, whether one of the first two is there, and its repository's name or else the end of a full one."""
    k = F.col("event_id")
    text = k.cast("string")
    a = F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.concat(F.lit("i"), text))
    b, c = F.when(k % 3 == 0, F.concat(F.lit("d"), text)), F.when(k % 2 == 0, F.concat(F.lit("o"), text))
    own, full = F.when(k % 4 == 0, "Repo"), F.concat(F.lit("Owner/Base"), (k % 3).cast("string"))
    two = F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    repo = T.named_repo(own, full)
    return read_table(spark, d, "events").select("event_id", given(a, b, c).alias("id"), F.when(two.isNull(), "missing").otherwise("ok").alias("checked"), repo.alias("repo"))


@query("WITH m AS (SELECT o_custkey AS repo FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey % 3 = 0 AND o_custkey NOT IN (SELECT repo FROM m WHERE repo % 2 = 0)) SELECT o_orderkey AS id FROM p ORDER BY o_orderdate, o_orderkey LIMIT 50")
def filtered_issues(spark, d):
    """Issues of wanted ids and repositories that are not in memory, the first 50 in order of time."""
    o = read_table(spark, d, "orders")
    ids = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey")
    seen = o.where("o_orderstatus = 'F' AND o_custkey % 2 = 0").select("o_custkey").distinct()
    kept = o.where("o_custkey % 3 = 0").join(ids, "o_orderkey", "left_semi").join(seen, "o_custkey", "left_anti")
    return kept.orderBy("o_orderdate", "o_orderkey").limit(50).select(F.col("o_orderkey").alias("id"))


_CACHE = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'boom' END AS error, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'diff ' || event_id END AS diff, CASE WHEN event_id % 9 = 0 THEN 'not json' ELSE 'ok' END AS line, event_id % 6 AS n FROM events"


@query(f"WITH c AS ({_CACHE}) SELECT count(*) FILTER (line = 'ok') AS total, count(*) FILTER (line = 'ok' AND trim(coalesce(diff, '')) <> '') AS kept, count(*) FILTER (line = 'ok' AND trim(coalesce(diff, '')) = '') AS empty, count(*) FILTER (line <> 'ok') AS malformed, count(*) FILTER (line = 'ok' AND error IS NOT NULL) AS errors, count(*) FILTER (line = 'ok' AND error IS NULL AND n > 0) AS complete, CAST(sum(n) FILTER (line = 'ok') AS BIGINT) AS problems, round(sum(n) FILTER (line = 'ok') / count(*) FILTER (line = 'ok'), 9) AS mean_problems FROM c")
def cache_counts(spark, d):
    """Lines of a cache: read and malformed ones (which count nowhere else), those with and without a diff, with an error, complete, and their problems in all and on average."""
    c = spark.sql(_CACHE.replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events"))
    fine, full = F.col("line") == "ok", F.trim(F.coalesce("diff", F.lit(""))) != ""
    problems = F.sum(F.when(fine, F.col("n")))
    return c.agg(
        F.count_if(fine).alias("total"), F.count_if(fine & full).alias("kept"), F.count_if(fine & ~full).alias("empty"), F.count_if(~fine).alias("malformed"), F.count_if(fine & F.col("error").isNotNull()).alias("errors"),
        F.count_if(fine & F.col("error").isNull() & (F.col("n") > 0)).alias("complete"), problems.alias("problems"), F.round(problems / F.count_if(fine), 9).alias("mean_problems"),
    )


@query("SELECT conv_id AS issue, turn, coalesce(role, '') AS job_name, md5(coalesce(text, '')[1:500]) AS failure_reason, CASE WHEN turn % 2 = 0 THEN 'lint' ELSE '' END AS error_type FROM conversations")
def essential_context(spark, d):
    """Failed jobs with three fields and reasons cut at 500 characters; logs, copied sequences and other heavy fields are dropped."""
    job = F.struct("turn", F.coalesce("role", F.lit("")).alias("job_name"), F.coalesce("text", F.lit("")).alias("failure_reason"), F.when(F.col("turn") % 2 == 0, "lint").otherwise("").alias("error_type"), F.col("text").alias("log"))
    context = read_table(spark, d, "conversations").groupBy(F.col("conv_id").alias("issue")).agg(F.collect_list(job).alias("failed_jobs"), F.count(F.lit(1)).alias("total_failed_jobs"))
    entry = context.withColumn("ci", F.struct("failed_jobs", F.lit("copy").alias("validation_sequence"), F.lit("wf").alias("workflow_path"))).drop("failed_jobs", "total_failed_jobs")
    slim = entry.withColumn("ci", F.col("ci").dropFields("validation_sequence")).withColumn("jobs", F.transform("ci.failed_jobs", lambda j: j.dropFields("log").withField("failure_reason", F.md5(F.substring(j["failure_reason"], 1, 500)))))
    return slim.select("issue", F.inline("jobs"))


@query("WITH f AS (SELECT doc_id AS id, source AS repo, CASE doc_id % 3 WHEN 0 THEN 'success' ELSE 'failure' END AS c FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id, source AS repo, CASE doc_id % 5 WHEN 0 THEN 'success' ELSE 'failure' END AS c FROM documents WHERE doc_id % 7 <> 1), i AS (SELECT doc_id AS id, source AS repo, CASE WHEN doc_id % 4 < 2 THEN 'success' ELSE 'failure' END AS c FROM documents WHERE doc_id % 5 <> 2), j AS (SELECT coalesce(f.id, b.id, i.id) AS id, coalesce(f.repo, b.repo, i.repo, '') AS repo, f.c AS fc, b.c AS bc, i.c AS ic FROM f FULL JOIN b ON f.id = b.id FULL JOIN i ON i.id = coalesce(f.id, b.id)), s AS (SELECT *, coalesce(fc = 'success', false) AS fs, coalesce(bc = 'success', false) AS bs, coalesce(ic = 'success', false) AS s3 FROM j) SELECT id, repo, coalesce(fc, 'not_run') AS forward_status, coalesce(bc, 'not_run') AS backward_status, coalesce(ic, 'not_run') AS bidirectional_status, CAST(fs AS INT) + CAST(bs AS INT) + CAST(s3 AS INT) AS success_count, CASE WHEN fs AND bs AND s3 THEN 'All 3 Solved' WHEN fs AND bs THEN 'Fwd+Back Only (Bidir MISSED)' WHEN fs AND s3 THEN 'Fwd+Bidir Only (Back MISSED)' WHEN bs AND s3 THEN 'Back+Bidir Only (Fwd MISSED)' WHEN fs THEN 'ONLY Forward' WHEN bs THEN 'ONLY Backward' WHEN s3 THEN 'ONLY Bidirectional' ELSE 'All Failed' END AS category, CASE WHEN CAST(fs AS INT) + CAST(bs AS INT) + CAST(s3 AS INT) IN (1, 2) THEN concat_ws(' + ', CASE WHEN fs THEN 'Forward' END, CASE WHEN bs THEN 'Backward' END, CASE WHEN s3 THEN 'Bidirectional' END) END AS solved_by, CASE WHEN CAST(fs AS INT) + CAST(bs AS INT) + CAST(s3 AS INT) IN (1, 2) THEN concat_ws(' + ', CASE WHEN NOT fs THEN 'Forward' END, CASE WHEN NOT bs THEN 'Backward' END, CASE WHEN NOT s3 THEN 'Bidirectional' END) END AS failed_in FROM s")
def direction_table(spark, d):
    """Three sides' outcomes by id in one wide row, `not_run` where a side has none, the category, and for partial success which sides solved it and which failed."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo"))
    won = lambda cond: F.when(cond, "success").otherwise("failure").alias("c")
    k = F.col("id")
    sides = {"forward": docs.where(k % 2 == 0).select("id", "repo", won(k % 3 == 0)), "backward": docs.where(k % 7 != 1).select("id", "repo", won(k % 5 == 0)), "bidirectional": docs.where(k % 5 != 2).select("id", "repo", won(k % 4 < 2))}
    return R.three_sides(sides, "id", "repo", "c")


@query("WITH o AS (SELECT source, doc_id, coalesce(quality = 1, false) AS q, coalesce(toxic = 1, false) AS t FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT source, CASE WHEN q AND t THEN 'both' WHEN q THEN 'quality' ELSE 'toxic' END AS category, count(*) AS n FROM o WHERE q OR t GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM c) SELECT source, category, n, CAST(total AS BIGINT) AS total FROM k WHERE total >= 2")
def success_matrix(spark, d):
    """Successes by repository and category, of whatever categories there are, for repositories with two at least."""
    good, bad = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    o = read_table(spark, d, "documents").select("doc_id", "source").join(read_table(spark, d, "labels"), "doc_id").where(good | bad)
    c = o.groupBy("source", F.when(good & bad, "both").when(good, "quality").otherwise("toxic").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("total", F.sum("n").over(Window.partitionBy("source"))).where("total >= 2").select("source", "category", "n", "total")


_KINDS = "CASE event_type WHEN 'view' THEN [] WHEN 'click' THEN ['ui', 'click'] ELSE [event_type] END"


@query(f"WITH t AS (SELECT event_id, unnest(CASE WHEN len({_KINDS}) = 0 THEN ['Unknown'] ELSE {_KINDS} END) AS kind FROM events), j AS (SELECT t.kind, coalesce(t.event_id % 3 = 0, false) AND t.event_id % 2 = 0 AS a, coalesce(t.event_id % 4 = 0, false) AND t.event_id % 5 <> 0 AS b FROM t) SELECT kind, count(*) AS total, count(*) FILTER (a) AS base, count(*) FILTER (b) AS memory, count(*) FILTER (a AND NOT b) AS only_base, count(*) FILTER (b AND NOT a) AS only_memory, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither, round(100.0 * (count(*) FILTER (b) - count(*) FILTER (a)) / count(*), 6) AS gain FROM j GROUP BY 1")
def failure_types(spark, d):
    """Outcomes of two sides by failure type, an issue counting under each of its types, or `Unknown`; missing outcomes are failures."""
    e = read_table(spark, d, "events").select("event_id", "event_type")
    none = F.array().cast("array<string>")
    kinds = F.when(F.col("event_type") == "view", none).when(F.col("event_type") == "click", F.array(F.lit("ui"), F.lit("click"))).otherwise(F.array("event_type"))
    t = e.select("event_id", F.explode(F.when(F.size(kinds) == 0, F.array(F.lit("Unknown"))).otherwise(kinds)).alias("kind"))
    a = e.where("event_id % 2 = 0").select("event_id", (F.col("event_id") % 3 == 0).alias("a"))
    b = e.where("event_id % 5 <> 0").select("event_id", (F.col("event_id") % 4 == 0).alias("b"))
    j = t.join(a, "event_id", "left").join(b, "event_id", "left").fillna(False, ["a", "b"])
    x, y, n = F.col("a"), F.col("b"), F.count(F.lit(1))
    return j.groupBy("kind").agg(n.alias("total"), F.count_if(x).alias("base"), F.count_if(y).alias("memory"), F.count_if(x & ~y).alias("only_base"), F.count_if(y & ~x).alias("only_memory"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"), F.round(100.0 * (F.count_if(y) - F.count_if(x)) / n, 6).alias("gain"))


_FLOW = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' ELSE 'old.yml' END AS flow FROM customer"


@query(f"WITH m AS ({_FLOW}), k AS (SELECT o_custkey AS id, max('wf' || (o_orderkey % 4) || '.yml') AS flow FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT m.id, CASE WHEN m.flow IS NOT NULL AND m.flow NOT IN ('', 'None') THEN m.flow ELSE coalesce(k.flow, m.flow) END AS flow, CASE WHEN m.flow IS NOT NULL AND m.flow NOT IN ('', 'None') THEN 'had' WHEN k.flow IS NOT NULL THEN 'patched' ELSE 'not_found' END AS what FROM m LEFT JOIN k ON k.id = m.id")
def patched_workflows(spark, d):
    """Workflows filled in from a lookup where they are null, blank or `None`, and what happened to each."""
    m = spark.sql(_FLOW.replace("FROM customer", "FROM {customer}"), customer=read_table(spark, d, "customer"))
    o = read_table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey", F.concat(F.lit("wf"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".yml")).alias("found"))
    known = R.key_bridge(o.groupBy("o_custkey").agg(F.max("found").alias("found")).withColumn("sha", F.concat(F.lit("s"), F.col("o_custkey").cast("string"))), "found", "o_custkey", "sha")
    have = F.coalesce(~F.col("flow").isin("", "None"), F.lit(False))
    j = m.withColumn("key", F.col("id").cast("string")).join(known, "key", "left")
    return j.select("id", F.when(have, F.col("flow")).otherwise(F.coalesce("found", "flow")).alias("flow"), F.when(have, "had").when(F.col("found").isNotNull(), "patched").otherwise("not_found").alias("what"))


@query("WITH t AS (SELECT DISTINCT c_nationkey AS repo FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 40), l1 AS (SELECT c_custkey AS id, c_nationkey AS repo FROM customer), kept AS (SELECT * FROM l1 WHERE repo NOT IN (SELECT repo FROM t)), l2 AS (SELECT o_orderkey AS id, o_custkey AS issue FROM orders WHERE o_custkey IN (SELECT id FROM kept)) SELECT (SELECT count(*) FROM l1) AS before, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM l2) AS lineage, (SELECT count(*) FROM t) AS targets, (SELECT count(*) FROM kept WHERE repo IN (SELECT repo FROM t)) AS overlap, (SELECT count(*) = count(DISTINCT id) FROM kept) AS unique_ids, (SELECT count(*) = 0 FROM l2 WHERE issue NOT IN (SELECT id FROM kept)) AS lineage_holds")
def cross_repo_manifest(spark, d):
    """Memory of all but the target repositories, what descends from it, and the checks: counts, no overlap, unique ids, no strays."""
    c = read_table(spark, d, "customer")
    targets = c.where("c_mktsegment = 'BUILDING' AND c_custkey < 40").select(F.col("c_nationkey").alias("repo")).distinct()
    one = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("repo"))
    kept = one.join(targets, "repo", "left_anti")
    two = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(kept, "id", "left_semi")
    n = lambda df, name, what=None: df.agg((what if what is not None else F.count(F.lit(1))).alias(name))
    parts = [n(one, "before"), n(kept, "kept"), n(two, "lineage"), n(targets, "targets"), n(kept.join(targets, "repo", "left_semi"), "overlap"), n(kept, "unique_ids", F.count("id") == F.count_distinct("id")), n(two.join(kept, "id", "left_anti"), "lineage_holds", F.count(F.lit(1)) == 0)]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out


@query("WITH u AS (SELECT conv_id, turn, text, 'user' AS part FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1), a AS (SELECT c.conv_id, c.turn, c.text, 'agent' AS part FROM conversations c JOIN f USING (conv_id, turn) WHERE c.role = 'assistant'), b AS (SELECT * FROM u UNION ALL SELECT * FROM a) SELECT conv_id, turn, part, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS INTEGER) AS place FROM b WHERE contains(lower(text), 'an') AND turn >= 1")
def thread_occurrences(spark, d):
    """User messages and each thread's final answer from a cursor on that hold a word, in order."""
    c = read_table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", "text", F.lit("user").alias("part"))
    final = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    agent = c.where("role = 'assistant'").join(final, ["conv_id", "turn"]).select("conv_id", "turn", "text", F.lit("agent").alias("part"))
    both = user.unionByName(agent).where(F.contains(F.lower("text"), F.lit("an")) & (F.col("turn") >= 1))
    return both.select("conv_id", "turn", "part", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part")).alias("place"))


@query("WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS preview, CASE WHEN c_custkey % 3 = 1 THEN 'first ' || c_custkey ELSE '' END AS first FROM customer), g AS (SELECT o_custkey AS id, max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'goal ' || o_orderkey END) AS objective FROM orders GROUP BY 1) SELECT t.id, CASE WHEN preview <> '' THEN preview WHEN first <> '' THEN first WHEN g.objective <> '' THEN g.objective ELSE '' END AS preview FROM t LEFT JOIN g ON g.id = t.id")
def previews(spark, d):
    """A thread's preview, else its first message, else its goal if that is not blank."""
    k = F.col("c_custkey")
    t = read_table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("preview"), F.when(k % 3 == 1, F.concat(F.lit("first "), k.cast("string"))).otherwise("").alias("first"))
    g = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("goal "), F.col("o_orderkey").cast("string")))).alias("objective"))
    return t.join(g, "id", "left").select("id", given(F.col("preview"), F.col("first"), F.col("objective")).alias("preview"))


_SIGNALS = f"SELECT l_orderkey AS key, {_SPOT} AS spot, {_PATH} AS file, l_partkey % 60 AS line, 'signal in ' || {_PATH} AS signal FROM lineitem"


@query(f"WITH s AS ({_SIGNALS}), h AS (SELECT DISTINCT key, file, 10 AS a, 40 AS b FROM s), e AS (SELECT h.key, h.file, s.spot, 0 AS part, s.signal AS text FROM h JOIN s ON s.key = h.key AND s.spot % 3 = 0 AND contains(s.signal, string_split(h.file, '/')[-1]) UNION ALL SELECT h.key, h.file, s.spot, 1, 'tool: line ' || s.line FROM h JOIN s ON s.key = h.key AND s.file = h.file AND s.line BETWEEN h.a AND h.b AND s.line > 0) SELECT h.key, h.file, coalesce(string_agg(e.text, ' | ' ORDER BY part, spot, e.text), 'No direct evidence') AS evidence FROM h LEFT JOIN e ON e.key = h.key AND e.file = h.file GROUP BY h.key, h.file")
def hunk_evidence(spark, d):
    """Signals that name a hunk's file, then findings inside its lines, as one text."""
    s = spark.sql(_SIGNALS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    h = s.select("key", "file").distinct()
    named = h.join(s.where("spot % 3 = 0").select("key", "spot", "signal"), "key").where(F.contains("signal", F.element_at(F.split("file", "/"), -1))).select("key", "file", F.lit(0).alias("part"), "spot", F.col("signal").alias("text"))
    inside = h.join(s.select("key", "file", "spot", "line"), ["key", "file"]).where("line > 0 AND line BETWEEN 10 AND 40").select("key", "file", F.lit(1).alias("part"), "spot", F.concat(F.lit("tool: line "), F.col("line").cast("string")).alias("text"))
    told = named.unionByName(inside).groupBy("key", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "spot", "text"))), lambda x: x["text"]), " | ").alias("evidence"))
    return h.join(told, ["key", "file"], "left").select("key", "file", F.coalesce("evidence", F.lit("No direct evidence")).alias("evidence"))


@query("WITH j AS (SELECT event_id, 'failed_job' AS source, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'c' || event_id END AS first, 'f' || event_id AS second, 'job ' || event_type AS text FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'relevant_files', 'f' || event_id, 'c' || event_id, 'tool type reason' FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'validation_sequence', CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'v' || event_id END, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'inst' || event_id END, 'validates' FROM events WHERE event_type = 'view') SELECT event_id, source, coalesce(nullif(first, ''), nullif(second, '')) AS command, text FROM j WHERE coalesce(nullif(first, ''), nullif(second, '')) IS NOT NULL")
def command_candidates(spark, d):
    """Commands of failed jobs, relevant files and validation steps, each with its own order of names; rows without any are no candidates."""
    e = read_table(spark, d, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("k"))
    c, f = F.concat(F.lit("c"), F.col("k")), F.concat(F.lit("f"), F.col("k"))
    job = F.array(F.struct(F.when(F.col("event_id") % 3 == 0, "").otherwise(c).alias("command"), f.alias("failed_cmd")))
    rows = e.select("event_id", "event_type", "k", F.when(F.col("event_type") == "error", job).alias("failed_job"), F.when(F.col("event_type") == "click", F.array(F.struct(c.alias("command"), f.alias("failed_cmd")))).alias("relevant_files"))
    jobs = rows.select("event_id", F.lit("failed_job").alias("source"), F.inline("failed_job"), F.concat(F.lit("job "), F.col("event_type")).alias("text")).select("event_id", "source", given(F.col("command"), F.col("failed_cmd")).alias("command"), "text")
    files = rows.select("event_id", F.lit("relevant_files").alias("source"), F.inline("relevant_files")).select("event_id", "source", given(F.col("failed_cmd"), F.col("command")).alias("command"), F.lit("tool type reason").alias("text"))
    steps = e.where("event_type = 'view'").select("event_id", F.lit("validation_sequence").alias("source"), given(F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("v"), F.col("k"))), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("inst"), F.col("k")))).alias("command"), F.lit("validates").alias("text"))
    return jobs.unionByName(files).unionByName(steps).where("command <> ''")


@query("WITH r AS (SELECT o_custkey AS id, arg_max('repo' || (o_orderkey % 11), o_orderkey) AS repo FROM orders WHERE o_orderkey % 9 <> 4 GROUP BY 1) SELECT r.id, r.repo FROM r WHERE r.id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def instance_repos(spark, d):
    """The repository of each selected instance, by base name, from many files: the last line wins and bad lines count nowhere."""
    o = read_table(spark, d, "orders").where("o_orderkey % 9 <> 4").select(F.col("o_custkey").alias("id"), T.basename(F.concat(F.lit("Owner/repo"), (F.col("o_orderkey") % 11).cast("string"))).alias("repo"), "o_orderkey")
    wanted = read_table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    return R.latest_by(o.join(wanted, "id", "left_semi"), "id", "o_orderkey", "repo")


@query(f"WITH s AS (SELECT l_orderkey AS key, {_PATH} AS file, l_returnflag AS kind FROM lineitem), r AS (SELECT DISTINCT key, file FROM s WHERE kind = 'A') SELECT s.key, s.file, count(*) FILTER (s.kind = 'A') AS added, count(*) FILTER (s.kind = 'R') AS removed, count(*) FILTER (s.kind = 'N') AS modified FROM s JOIN r ON r.key = s.key AND r.file = s.file GROUP BY 1, 2")
def relevant_changes(spark, d):
    """Changes of the relevant files only: with an after side alone, a before side alone, or both."""
    s = spark.sql(f"SELECT l_orderkey AS key, {_PATH} AS file, CASE WHEN l_returnflag IN ('R', 'N') THEN 'x' END AS before, CASE WHEN l_returnflag IN ('A', 'N') THEN 'y' END AS after FROM {{lineitem}}", lineitem=read_table(spark, d, "lineitem"))
    relevant = s.where("before IS NULL").select("key", "file").distinct()
    per = s.join(relevant, ["key", "file"], "left_semi").groupBy("key", "file")
    b, a = F.col("before").isNotNull(), F.col("after").isNotNull()
    return per.agg(F.count_if(a & ~b).alias("added"), F.count_if(b & ~a).alias("removed"), F.count_if(a & b).alias("modified"))


@query("WITH m AS (SELECT user_id, count(*) AS calls, sum(value) AS cost, count(*) FILTER (event_type = 'error') = 0 AS ok FROM events GROUP BY 1), e AS (SELECT event_id % 40 AS id, sum(value) AS cost, count(*) AS tokens, max(event_type) <> 'view' AND min(event_id) % 3 > 0 AS ok FROM events GROUP BY 1) SELECT count(*) AS instances, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, round(coalesce(sum(cost) FILTER (ok), 0), 6) AS total_cost, CAST(coalesce(sum(tokens) FILTER (ok), 0) AS BIGINT) AS total_tokens, round(CASE WHEN count(*) FILTER (ok) > 0 THEN sum(cost) FILTER (ok) / count(*) FILTER (ok) ELSE 0 END, 6) AS mean_cost, round(CASE WHEN count(*) FILTER (ok) > 0 THEN sum(cost) FILTER (ok) / count(*) FILTER (ok) ELSE 0 END * 157, 2) AS projected_cost FROM e")
def batch_metrics(spark, d):
    """A batch's instances by outcome, totals and means over the completed ones, and what 157 instances would cost."""
    e = read_table(spark, d, "events").groupBy((F.col("event_id") % 40).alias("id")).agg(F.sum("value").alias("cost"), F.count(F.lit(1)).alias("tokens"), ((F.max("event_type") != "view") & (F.min("event_id") % 3 > 0)).alias("ok"))
    ok = F.col("ok")
    cost, n = F.sum(F.when(ok, F.col("cost"))), F.count_if(ok)
    mean = F.when(n > 0, cost / n).otherwise(0.0)
    return e.agg(F.count(F.lit(1)).alias("instances"), n.alias("successful"), F.count_if(~ok).alias("failed"), F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("total_cost"), F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("total_tokens"), F.round(mean, 6).alias("mean_cost"), F.round(mean * 157, 2).alias("projected_cost"))


_CALLS = "SELECT event_id, user_id, event_type AS phase, 1000 + event_id % 700 AS i, event_id % 300 AS c, event_id % 450 AS o, event_id % 90 AS r, value AS seconds FROM events"


@query(f"WITH c AS ({_CALLS}) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS sequence, i - c AS uncached, i + o + r AS total, round((i - c) * 3e-7 + c * 1.5e-7 + (o + r) * 1.1e-6, 8) AS cost, round(seconds, 3) AS seconds FROM c")
def usage_calls(spark, d):
    """Each call's place, tokens and cost at prices for input, cached input and output."""
    c = spark.sql(_CALLS.replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events"))
    i, k, o, r = (F.col(x) for x in "icor")
    cost = T.usage_cost(i, k, o, r, 0.0000003, 0.00000015, 0.0000011)
    return c.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("sequence"), (i - k).alias("uncached"), (i + o + r).alias("total"), F.round(cost, 8).alias("cost"), F.round("seconds", 3).alias("seconds"))


@query("WITH p AS (SELECT user_id, event_type AS phase, sum(value) AS cost FROM events GROUP BY ALL), w AS (SELECT user_id, coalesce(nullif(sum(cost) FILTER (phase = 'view'), 0), sum(cost) FILTER (phase = 'click'), 0) AS endpoint, coalesce(sum(cost) FILTER (phase = 'purchase'), 0) AS reconciliation FROM p WHERE user_id % 13 <> 5 GROUP BY 1), l AS (SELECT 'endpoint' AS stage, endpoint AS cost FROM w UNION ALL SELECT 'reconciliation', reconciliation FROM w) SELECT stage, round(max(cost), 6) AS most, round(avg(cost), 6) AS mean, round(sum(cost), 4) AS total FROM l GROUP BY 1")
def stage_costs(spark, d):
    """Costs of stages by instance, under a newer or older phase name, zero where there is none; instances without usage are left out."""
    p = read_table(spark, d, "events").where("user_id % 13 <> 5").groupBy("user_id")
    of = lambda name: F.sum(F.when(F.col("event_type") == name, F.col("value")))
    w = p.agg(F.coalesce(F.nullif(of("view"), F.lit(0.0)), of("click"), F.lit(0.0)).alias("endpoint"), F.coalesce(of("purchase"), F.lit(0.0)).alias("reconciliation"))
    long = w.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("cost")) for s in ("endpoint", "reconciliation")))).alias("x")).select("x.*")
    return long.groupBy("stage").agg(F.round(F.max("cost"), 6).alias("most"), F.round(F.avg("cost"), 6).alias("mean"), F.round(F.sum("cost"), 4).alias("total"))


@query(f"WITH i AS (SELECT l_orderkey AS key, count(*) AS problems, count(DISTINCT {_PATH}) AS files, CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN count(*) FILTER (l_returnflag = 'A') END AS commits FROM lineitem GROUP BY 1), c AS (SELECT *, coalesce(nullif(commits, 0), greatest(1, problems)) AS n FROM i) SELECT round(avg(n), 6) AS mean_commits, median(n) AS median_commits, round(coalesce(stddev_samp(n), 0), 6) AS spread_commits, round(avg(files), 6) AS mean_files, max(files) AS most_files, count(*) FILTER (problems = 1) AS single_problem, count(*) FILTER (problems > 1) AS multi_problem, round(avg(nullif(files - 1, 0)), 6) AS mean_further_files FROM c")
def issue_statistics(spark, d):
    """Commits by issue through a chain of fallbacks, distinct files, issues with one and with several problems, and a mean that zeros do not enter."""
    i = spark.sql(f"SELECT l_orderkey AS key, {_PATH} AS file, l_returnflag = 'A' AS commit FROM {{lineitem}}", lineitem=read_table(spark, d, "lineitem")).groupBy("key").agg(F.count(F.lit(1)).alias("problems"), F.count_distinct("file").alias("files"), F.count_if("commit").alias("commits"))
    commits = F.when(F.col("key") % 4 == 1, F.nullif("commits", F.lit(0)))
    c = i.withColumn("n", F.coalesce(commits, F.greatest(F.lit(1), "problems")))
    return c.agg(F.round(F.avg("n"), 6).alias("mean_commits"), F.median("n").alias("median_commits"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("spread_commits"), F.round(F.avg("files"), 6).alias("mean_files"), F.max("files").alias("most_files"), F.count_if(F.col("problems") == 1).alias("single_problem"), F.count_if(F.col("problems") > 1).alias("multi_problem"), F.round(F.avg(F.when(F.col("files") > 1, F.col("files") - 1)), 6).alias("mean_further_files"))


@query("WITH s AS (SELECT c_nationkey AS repo, c_custkey AS id, c_custkey % 4 AS rec FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 5 <> 1), e AS (SELECT c_nationkey AS repo, c_custkey AS id, c_custkey % 3 AS rec, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS sim FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey % 7 <> 2), p AS (SELECT e.repo, count(*) AS peers, count(*) FILTER (o_custkey IN (SELECT id FROM s)) AS hits FROM e JOIN orders ON o_custkey = e.id + 1 GROUP BY 1), a AS (SELECT repo, rec, NULL AS sim, 1 AS seeded FROM s UNION ALL SELECT repo, rec, sim, 0 FROM e) SELECT a.repo, count(*) AS issues, round(100.0 * count(*) FILTER (rec > 1) / count(*), 2) AS recurring_percent, round(coalesce(100.0 * any_value(p.hits) / any_value(p.peers), 0), 2) AS precision_percent, round(coalesce(avg(sim), 0), 4) AS avg_similarity, CAST(sum(seeded) AS BIGINT) AS seeded, CAST(sum(1 - seeded) AS BIGINT) AS evaluated FROM a LEFT JOIN p ON p.repo = a.repo GROUP BY a.repo")
def recurrence_summary(spark, d):
    """By repository of either side: issues, share of recurring ones, share of retrieved peers that are seeds, mean similarity over evaluations that have one."""
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("repo"), F.col("c_acctbal").alias("sim"))
    seeds = c.where("id % 2 = 0 AND repo % 5 <> 1")
    evals = c.where("id % 2 = 1 AND repo % 7 <> 2")
    peers = evals.select("repo", (F.col("id") + 1).alias("peer")).join(read_table(spark, d, "orders").select(F.col("o_custkey").alias("peer")), "peer")
    hits = peers.join(seeds.select(F.col("id").alias("peer"), F.lit(1).alias("hit")), "peer", "left").groupBy("repo").agg(F.count(F.lit(1)).alias("peers"), F.count("hit").alias("hits"))
    every = seeds.select("repo", (F.col("id") % 4).alias("rec"), F.lit(None).cast("double").alias("sim"), F.lit(1).alias("s")).unionByName(evals.select("repo", (F.col("id") % 3).alias("rec"), F.when(F.col("id") % 5 > 0, F.col("sim")).alias("sim"), F.lit(0).alias("s")))
    g = every.groupBy("repo").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("rec") > 1).alias("r"), F.avg("sim").alias("sim"), F.sum("s").alias("seeded"))
    j = g.join(hits, "repo", "left")
    return j.select("repo", "issues", F.round(100.0 * F.col("r") / F.col("issues"), 2).alias("recurring_percent"), F.round(F.coalesce(100.0 * F.col("hits") / F.col("peers"), F.lit(0.0)), 2).alias("precision_percent"), F.round(F.coalesce("sim", F.lit(0.0)), 4).alias("avg_similarity"), "seeded", (F.col("issues") - F.col("seeded")).alias("evaluated"))


@query("WITH j AS (SELECT CASE WHEN n_chars > 2000 THEN 'history' ELSE 'cold' END AS grp, coalesce(quality = 1, false) AS a, coalesce(quality = 1 OR toxic = 1, false) AS b FROM documents LEFT JOIN labels USING (doc_id)) SELECT CASE WHEN grouping(grp) = 1 THEN 'overall' ELSE grp END AS grp, count(*) AS n, round(100.0 * count(*) FILTER (a) / count(*), 4) AS base, round(100.0 * count(*) FILTER (b) / count(*), 4) AS recap, round(100.0 * (count(*) FILTER (b) - count(*) FILTER (a)) / count(*), 4) AS gain FROM j GROUP BY ROLLUP (grp)")
def pass_gain(spark, d):
    """Pass rates of two sides by group and overall, a missing outcome being a failure, and the gain in points."""
    j = read_table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, "history").otherwise("cold").alias("grp")).join(read_table(spark, d, "labels"), "doc_id", "left")
    a, b = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce((F.col("quality") == 1) | (F.col("toxic") == 1), F.lit(False))
    n = F.count(F.lit(1))
    pct = lambda x: F.round(100.0 * x / n, 4)
    return R.rollup_total(j, "grp", n.alias("n"), pct(F.count_if(a)).alias("base"), pct(F.count_if(b)).alias("recap"), pct(F.count_if(b) - F.count_if(a)).alias("gain"), label="overall")


_MESSAGES = """SELECT event_id, CAST(event_id % 6 AS INT) AS k, CASE event_id % 6 WHEN 0 THEN 'error: src/n' || user_id || '.py: does not exist in index' WHEN 1 THEN 'error: patch failed: a/b' || user_id || '.py:7' || chr(10) || 'error: a/b' || user_id || '.py: patch does not apply'
  WHEN 2 THEN 'error: corrupt patch at line ' || event_id WHEN 3 THEN 'error: repository lacks the necessary blob' WHEN 4 THEN 'error: c' || user_id || '.py: does not match index' ELSE coalesce(props, '') END AS m, 'own' || (user_id % 9) || '.py' AS own, user_id FROM events WHERE event_type <> 'view'"""


@query(f"""
WITH f AS ({_MESSAGES}),
d AS (
  SELECT *, ['missing_file', 'context_mismatch', 'corrupt_patch', 'missing_blob', 'index_mismatch', 'unknown'][k + 1] AS kind,
    CASE k WHEN 0 THEN 'src/n' || user_id || '.py' WHEN 1 THEN 'a/b' || user_id || '.py' WHEN 2 THEN own WHEN 4 THEN 'c' || user_id || '.py' END AS file FROM f)
SELECT kind, count(DISTINCT file) AS n_files, md5(coalesce(string_agg(DISTINCT file, ',' ORDER BY file), '')) AS files, count(*) AS n, md5(string_agg(event_id, ',' ORDER BY event_id)) AS ids, CAST(row_number() OVER (ORDER BY count(*) DESC, kind) AS INTEGER) AS place FROM d GROUP BY kind
""")
def patch_failures(spark, d):
    """Failed patches by the first kind of error that their message fits, with the files that the messages name, most frequent first."""
    f = spark.sql(_MESSAGES.replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events")).withColumn("kind", T.patch_error(F.col("m")))
    named = f.select("kind", F.explode(T.patch_error_files(F.col("kind"), F.col("m"), F.array("own"))).alias("file")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.md5(F.array_join(F.sort_array(F.collect_list("file")), ",")).alias("files"))
    ids = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ","))
    g = f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))  # a handful of kinds
    j = g.join(named, "kind", "left")
    return j.select("kind", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("files", F.md5(F.lit("").cast("binary"))).alias("files"), "n", "ids", F.row_number().over(Window.orderBy(F.col("n").desc(), "kind")).alias("place"))


@query("WITH old AS (SELECT c_custkey AS id, 's' || (c_custkey % 700) AS sha, 'old' AS v FROM customer), new AS (SELECT CAST(CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS BIGINT) AS id, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 's' || (o_custkey % 900) END AS sha, 'new' AS v FROM orders WHERE o_orderkey % 37 = 0 GROUP BY ALL) SELECT coalesce(id, -1) AS id, sha, v FROM old WHERE id NOT IN (SELECT id FROM new WHERE id IS NOT NULL) AND sha NOT IN (SELECT sha FROM new WHERE sha <> '') UNION ALL SELECT coalesce(id, -1), sha, v FROM new")
def cache_upserts(spark, d):
    """Entries that a new one matches by id or by sha give way to it; blank keys match nothing."""
    old = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("s"), (F.col("c_custkey") % 700).cast("string")).alias("sha"), F.lit("old").alias("v"))
    k = F.col("o_custkey")
    new = read_table(spark, d, "orders").where("o_orderkey % 37 = 0").select(F.when(k % 5 > 0, k.cast("string")).alias("id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("s"), (k % 900).cast("string"))).alias("sha"), F.lit("new").alias("v")).distinct()
    return R.upsert_either(old, new, "id", "sha").select(F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), "sha", "v")


@query("WITH o AS (SELECT doc_id, text, 0 AS src FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text, 1 FROM documents WHERE doc_id % 3 = 0), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src) AS k FROM o) SELECT doc_id, src, CASE WHEN src = 0 THEN 'existing' ELSE 'added' END AS what FROM d WHERE k = 1 AND trim(text) <> '' AND doc_id IN (SELECT doc_id FROM labels)")
def appended_predictions(spark, d):
    """existing rows first, then those not there yet, without empty ones and only of evaluated ids; which were there and which are added."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    both = docs.where("doc_id % 2 = 0").withColumn("src", F.lit(0)).unionByName(docs.where("doc_id % 3 = 0").withColumn("src", F.lit(1)))
    first = R.first_by(both, ["doc_id"], F.col("src")).where(F.length(F.trim("text")) > 0)
    kept = first.join(read_table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return kept.select("doc_id", "src", F.when(F.col("src") == 0, "existing").otherwise("added").alias("what"))
