"""Queries that check records: files, labels, alignments, references, items and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import relational as R
from ..shared import Rounds
from ..sources import io
from ..sources.io import read_table
from .base import query
from .diffs import _PATH
from .paths import _RESOLVED, dependency_tables, resolved_edges
from .selection import _SPOT

_PROBLEM = f"SELECT l_orderkey AS key, {_SPOT} AS spot, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE {_PATH} END AS file, l_returnflag = 'A' AS fixed, l_linestatus = 'O' AS conflict FROM lineitem"


@query(f"WITH p AS ({_PROBLEM}), c AS (SELECT *, file <> '' AND (contains(file, 'node_modules') OR file = 'setup.cfg') AS gone FROM p) SELECT key, spot, CASE WHEN gone THEN file ELSE '' END AS missing, CASE WHEN gone THEN 'Missing files' WHEN fixed THEN 'already fixed' ELSE '' END AS reason, conflict AND (key + spot) % 2 = 0 AS warned FROM c")
def validated_problems(spark, d):
    """Files of problems that a checkout does not have (texts or records; none given is fine), the reason for leaving a problem out, the second check only where the first holds, and a conflict, which only warns."""
    p = spark.sql(_PROBLEM.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    checkout = p.select("file").distinct().where("file <> '' AND file NOT LIKE '%node_modules%' AND file <> 'setup.cfg'").select("file", F.lit(True).alias("there"))  # one row a file
    # files come as texts or as records with a path or a file
    entry = F.when(F.col("spot") % 2 == 0, F.to_json(F.struct(F.col("file").alias("path")))).otherwise(F.to_json(F.struct(F.col("file").alias("file"))))
    named = p.withColumn("file", F.coalesce(F.nullif(F.get_json_object(entry, "$.path"), F.lit("")), F.get_json_object(entry, "$.file")))
    j = named.join(checkout, "file", "left")
    gone = (F.col("file") != "") & F.col("there").isNull()
    warned = F.col("conflict") & ((F.col("key") + F.col("spot")) % 2 == 0)
    return j.select("key", "spot", F.when(gone, F.col("file")).otherwise("").alias("missing"), F.when(gone, "Missing files").when(F.col("fixed"), "already fixed").otherwise("").alias("reason"), warned.alias("warned"))


_LABELS = "SELECT event_id AS row, event_id % 40 AS episode, 'p' || (user_id % 7) AS problem, 'h' || (event_id % 90) AS hunk, CASE event_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'odd' ELSE 'Direct' END AS label, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'ann' END AS annotator FROM events"


@query(f"WITH r AS ({_LABELS}), c AS (SELECT *, row_number() OVER (PARTITION BY episode, problem, hunk ORDER BY row) AS k FROM r) SELECT count(*) FILTER (trim(label) = '') AS missing_labels, count(*) FILTER (trim(label) <> '' AND lower(trim(label)) NOT IN ('direct', 'shared', 'unrelated', 'uncertain')) AS invalid_labels, count(*) FILTER (annotator = '') AS missing_annotators, count(*) FILTER (problem = 'p6') AS unknown_problems, count(*) FILTER (k > 1) AS duplicates, CAST(min(row) FILTER (trim(label) = '') AS BIGINT) AS first_missing FROM c")
def label_errors(spark, d):
    """Reference labels that are missing, invalid, without an annotator, of an unknown problem or given twice."""
    r = spark.sql(_LABELS.replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events"))
    known = r.select("episode", "problem").where("problem <> 'p6'").distinct().withColumn("known", F.lit(True))
    j = r.join(known, ["episode", "problem"], "left").withColumn("label", F.lower(F.trim("label")))
    sizes = r.groupBy("episode", "problem", "hunk").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("duplicates"))  # one row
    none = F.col("label") == ""
    counts = j.agg(F.count_if(none).alias("missing_labels"), F.count_if(~none & ~F.col("label").isin("direct", "shared", "unrelated", "uncertain")).alias("invalid_labels"), F.count_if(F.col("annotator") == "").alias("missing_annotators"), F.count_if(F.col("known").isNull()).alias("unknown_problems"), F.min(F.when(none, F.col("row"))).alias("first_missing"))
    return counts.join(F.broadcast(sizes)).select("missing_labels", "invalid_labels", "missing_annotators", "unknown_problems", "duplicates", "first_missing")


_ALIGN = "SELECT event_id AS row, event_type AS method, event_id % 60 AS episode, user_id % 9 AS predicted, CASE event_id % 8 WHEN 0 THEN '' ELSE 'Reviewed' END AS status, CASE event_id % 7 WHEN 0 THEN 'unmapped' WHEN 1 THEN '' WHEN 2 THEN 'zz' ELSE 'c' || (user_id % 5) END AS canonical FROM events"


@query(f"WITH a AS ({_ALIGN}), s AS (SELECT *, CASE WHEN status = '' OR canonical = '' THEN 'missing' WHEN upper(canonical) = 'UNMAPPED' THEN 'mapped' WHEN canonical = 'zz' THEN 'unknown' ELSE 'mapped' END AS what FROM a), m AS (SELECT *, row_number() OVER (PARTITION BY method, episode, predicted ORDER BY row) AS k FROM s WHERE what = 'mapped') SELECT row, CASE WHEN k > 1 THEN 'duplicate' ELSE 'mapped' END AS what, CASE WHEN k > 1 OR upper(canonical) = 'UNMAPPED' THEN '' ELSE canonical END AS canonical FROM m UNION ALL SELECT row, what, '' FROM s WHERE what <> 'mapped'")
def alignment_errors(spark, d):
    """Reviewed alignments by prediction, an unmapped one being blank; those not reviewed, of an unknown problem, or given again are errors."""
    a = spark.sql(_ALIGN.replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events"))
    unmapped = F.upper("canonical") == "UNMAPPED"
    known = a.select("canonical").where("canonical NOT IN ('', 'zz')").distinct().withColumn("known", F.lit(True))
    j = a.join(known, "canonical", "left")
    what = F.when((F.col("status") == "") | (F.col("canonical") == ""), "missing").when(~unmapped & F.col("known").isNull(), "unknown").otherwise("mapped")
    s = j.withColumn("what", what)
    k = F.row_number().over(Window.partitionBy("method", "episode", "predicted").orderBy("row"))
    mapped = s.where("what = 'mapped'").withColumn("k", k).select("row", F.when(F.col("k") > 1, "duplicate").otherwise("mapped").alias("what"), F.when((F.col("k") > 1) | unmapped, "").otherwise(F.col("canonical")).alias("canonical"))
    return mapped.unionByName(s.where("what <> 'mapped'").select("row", "what", F.lit("").alias("canonical")))


_DEPENDENT = f"SELECT l_orderkey AS key, {_SPOT} AS spot, CASE l_suppkey % 6 WHEN 0 THEN 'pytest' WHEN 1 THEN ' /' || {_PATH} WHEN 2 THEN 'make all' WHEN 3 THEN '' ELSE {_PATH} END AS path, ' because ' || l_partkey || ' ' AS reason FROM lineitem"


@query(f"WITH f AS ({_DEPENDENT}), c AS (SELECT key, spot, ltrim(trim(path), '/') AS path, trim(reason) AS reason FROM f WHERE trim(path) <> '' AND path NOT IN ('pytest', 'make all')), r AS (SELECT *, row_number() OVER (PARTITION BY key, path ORDER BY spot, reason) AS k FROM c) SELECT key, path, reason FROM r WHERE k = 1")
def dependent_files(spark, d):
    """Files that a failure depends on, each once with its first reason; what is no path in a repository is dropped."""
    f = spark.sql(_DEPENDENT.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    path = F.ltrim(F.trim("path"), F.lit("/"))
    kept = f.select("key", "spot", path.alias("path"), F.trim("reason").alias("reason")).where(P.is_file_reference(F.col("path")))
    return kept.groupBy("key", "path").agg(F.min_by("reason", F.struct("spot", "reason")).alias("reason"))


@query("WITH i AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn % 3 AS k FROM conversations) SELECT conv_id, turn, md5(CASE WHEN k < 2 THEN trim(text, ' ' || chr(10)) ELSE text || ' tail' END) AS text FROM i WHERE CASE WHEN k < 2 THEN trim(text, ' ' || chr(10)) <> '' ELSE role IN ('user', 'assistant') END")
def item_texts(spark, d):
    """What a search reads of each log item: messages, and the text parts of users' and assistants' items; none for other items."""
    text = F.coalesce("text", F.lit(""))
    k = F.col("turn") % 3
    kind = F.when(k == 0, "user_message").when(k == 1, "agent_message").otherwise("message")
    part = lambda t, c: F.struct(F.lit(t).alias("type"), c.alias("text"))
    parts = F.array(part("input_text", text), part("input_image", F.lit("picture")), part("output_text", F.lit("tail")))
    i = read_table(spark, d, "conversations").select("conv_id", "turn", T.item_text(kind, F.col("role"), text, parts).alias("text"))
    return i.where("text IS NOT NULL").select("conv_id", "turn", F.md5("text").alias("text"))


@query(f"WITH {_RESOLVED}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY origin, target, via) AS i, count(*) OVER (PARTITION BY key) AS total FROM r), s AS (SELECT key, any_value(total) AS total, string_agg(origin || '>' || target, ',' ORDER BY i) FILTER (i <= 3) AS edges FROM k GROUP BY 1), f AS (SELECT key, count(*) AS total_nodes FROM n GROUP BY 1) SELECT f.key, total_nodes, coalesce(s.total, 0) AS total_edges, coalesce(s.edges, '') AS edges, coalesce(s.total, 0) > 3 AS truncated FROM f LEFT JOIN s ON s.key = f.key")
def bounded_graph(spark, d):
    """H6: each issue's edges, the first three, with totals of nodes and edges and whether any were left out; nodes are not bounded."""
    nodes, raw = dependency_tables(spark, d)
    kept = Rounds(spark)
    edges = kept.keep(resolved_edges(nodes, raw))  # read twice
    totals = edges.groupBy("key").agg(F.count(F.lit(1)).alias("total_edges"))
    shown = R.top_k(edges, ["key"], 3, F.col("origin"), F.col("target"), F.col("via")).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat("origin", F.lit(">"), "target").alias("e")))), lambda x: x["e"]), ",").alias("edges"))
    files = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("total_nodes"))
    j = files.join(totals, "key", "left").join(shown, "key", "left")
    n = F.coalesce("total_edges", F.lit(0))
    return kept.result(j.select("key", "total_nodes", n.alias("total_edges"), F.coalesce("edges", F.lit("")).alias("edges"), (n > 3).alias("truncated")))


@query("WITH n AS (SELECT c_custkey AS k FROM customer) SELECT 'sha' || k AS sha, CASE WHEN k % 4 = 1 THEN 'kept' ELSE 'wf' || (k % 2) END AS l1_name, CASE WHEN k % 4 = 1 THEN '' WHEN k % 3 = 0 THEN 'own.yml' ELSE 'path' || k END AS l1_path, CASE WHEN k % 4 = 1 THEN '' ELSE 'path' || k END AS l2_path FROM n WHERE k % 4 <> 2")
def converted_cache(spark, d):
    """A cache of two shapes in one: lists stay, old entries give their problems with the workflow filled in (name and path for level 1, the path alone for level 2, the copied sequence dropped), others are skipped; a corrupt file counts as none."""
    files = Rounds(spark)
    k = F.col("c_custkey")
    key = k.cast("string")
    query_ = F.struct(F.struct(F.when(k % 3 == 0, "own.yml").otherwise("").alias("workflow_path")).alias("l1"), F.struct(F.lit("x").alias("workflow_name")).alias("l2"))
    old = F.struct(F.array(F.struct(F.lit("seq").alias("validation_sequence"), query_.alias("query"))).alias("problems"), F.struct(F.concat(F.lit("wf"), (k % 2).cast("string")).alias("workflow_name"), F.concat(F.lit("path"), key).alias("workflow_path")).alias("query"))
    entry = F.when(k % 4 == 1, F.lit('[{"query":{"l1":{"workflow_name":"kept"}}}]')).when(k % 4 == 2, F.lit('{"odd":1}')).otherwise(F.to_json(old))
    # one list a hundred customers, an element a line
    own = read_table(spark, d, "customer").select(F.floor(k / 100).alias("part"), k.alias("at"), F.concat(F.when(k % 100 != 0, ",").otherwise("["), F.to_json(F.struct(F.concat(F.lit("sha"), key).alias("sha"), entry.alias("entry")))).alias("value"))
    first = own.groupBy("part").agg(F.min("at").alias("at"), F.min_by("value", "at").alias("value"))
    opened = own.join(first.select("part", "at", F.lit(True).alias("leads")), ["part", "at"], "left").withColumn("value", F.when(F.col("leads"), F.regexp_replace("value", "\\A[,\\[]", "[")).otherwise(F.regexp_replace("value", "\\A\\[", ","))).drop("leads")
    rows = opened.unionByName(first.select("part", F.lit(1 << 60).alias("at"), F.lit("]").alias("value")))
    rows.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(f"{files.base}/cache")
    spark.createDataFrame([('[{"sha": "lost"',)], "value string").write.mode("append").text(f"{files.base}/cache/part=bad")
    cache = io.read_list(spark, f"{files.base}/cache", "sha string, entry string")
    problem = "array<struct<query:struct<l1:struct<workflow_name:string,workflow_path:string>,l2:struct<workflow_name:string,workflow_path:string>>>>"
    listed = cache.where(F.startswith("entry", F.lit("["))).select("sha", F.explode(F.from_json("entry", problem)).alias("p"))
    shaped = cache.where(F.startswith("entry", F.lit("{"))).select("sha", F.from_json("entry", f"struct<problems:{problem},query:struct<workflow_name:string,workflow_path:string>>").alias("e")).where("e.problems IS NOT NULL")
    fill = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other, F.lit(""))
    converted = shaped.select("sha", F.explode(F.transform("e.problems", lambda p: F.struct(F.struct(F.struct(fill(p["query"]["l1"]["workflow_name"], F.col("e.query.workflow_name")).alias("workflow_name"), fill(p["query"]["l1"]["workflow_path"], F.col("e.query.workflow_path")).alias("workflow_path")).alias("l1"), F.struct(F.lit(None).cast("string").alias("workflow_name"), fill(p["query"]["l2"]["workflow_path"], F.col("e.query.workflow_path")).alias("workflow_path")).alias("l2")).alias("query")))).alias("p"))
    both = listed.unionByName(converted)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return files.result(both.select("sha", blank("p.query.l1.workflow_name").alias("l1_name"), blank("p.query.l1.workflow_path").alias("l1_path"), blank("p.query.l2.workflow_path").alias("l2_path")))
