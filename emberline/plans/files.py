"""Queries that write files of the reference's shapes to the shared folder and read them back by its rules. Their rows come from the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..operators import relational as R
from ..operators import retrieval as V
from ..shared import Rounds
from ..sources import io, listing, ranges
from ..sources.io import read_table
from ..sources.versioned import VersionedTable
from .base import query
from .records import direction_table


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'l' ELSE 'a' END || user_id AS id, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS won FROM events) SELECT id, CAST(arg_max(won, event_id) AS INTEGER) AS won FROM e GROUP BY 1")
def file_outcomes(spark, d):
    """Outcomes by id from files of JSON lines (with blank ones) and files with a JSON list each; the last row of an id counts."""
    files = Rounds(spark)
    e = read_table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", "success").otherwise("failure").alias("conclusion"), (F.col("event_id") % 7 == 0).alias("verification_passed"))
    row = lambda letter: F.to_json(F.struct(F.concat(F.lit(letter), F.col("user_id").cast("string")).alias("id"), "conclusion", "verification_passed"))
    # files in the order of their events, by name, so that a file's later rows come after
    part = F.lpad(F.floor(F.col("event_id") / 5000).cast("string"), 12, "0").alias("part")
    lines = e.where("event_id % 2 = 0").select(part, "event_id", F.concat(row("l"), F.when(F.col("event_id") % 10 == 0, "\n  ").otherwise("")).alias("value"))
    marked = e.where("event_id % 2 = 1").select(part, "event_id", F.concat(F.lit(","), row("a")).alias("value"))
    parts = marked.select("part").distinct()
    ends = parts.select("part", F.lit(-1).cast("long").alias("event_id"), F.lit('[{"id": null}').alias("value")).unionByName(parts.select("part", F.lit(1 << 60).alias("event_id"), F.lit("]").alias("value")))
    for name, rows in (("lines", lines), ("list", marked.unionByName(ends))):
        rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(f"{files.base}/{name}")
    return files.result(io.read_outcomes(spark, f"{files.base}/*"))


@query("SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance FROM customer WHERE c_custkey % 3 = 1")
def csv_selection(spark, d):
    """Rows of a CSV file with a header (all columns text) whose id, under whichever of its names, is in a list with comments and blank lines; written as CSV and read again."""
    files = Rounds(spark)
    c = read_table(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    io.write_csv(c.select(F.when(even, F.col("c_custkey")).alias("ID"), F.when(~even, F.col("c_custkey")).alias("instance_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), f"{files.base}/in")
    ids = c.where("c_custkey % 3 = 1").select(F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "\n\n# note").otherwise("")).alias("value"))
    ids.write.text(f"{files.base}/ids")
    rows = io.read_csv(spark, f"{files.base}/in").withColumn("id_key", F.coalesce("ID", "instance_id"))
    kept = rows.join(io.read_ids(spark, f"{files.base}/ids").withColumnRenamed("id", "id_key"), "id_key", "left_semi")
    io.write_csv(kept.select(F.col("id_key").alias("id"), "name", "balance"), f"{files.base}/out")
    return files.result(io.read_csv(spark, f"{files.base}/out").select(F.col("id").cast("long"), "name", "balance"))


_PREDICTED = "'{{\"at\":\"' || strftime({0}, '%Y-%m-%d') || '\",\"sums\":[' || CAST(CAST({1} AS DOUBLE) AS VARCHAR) || ',0.5],\"of\":{{\"k\":' || {2} || '}}}}'"


@query(f"""
SELECT 'o' || o_orderkey AS key, o_orderstatus AS name, {_PREDICTED.format('o_orderdate', 'o_orderkey % 7', 'o_custkey')} AS extra FROM orders
UNION ALL
SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'i' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'n' || s_suppkey ELSE 's' || s_suppkey END, s_name, NULL FROM supplier WHERE s_suppkey % 5 <> 4
""")
def prediction_files(spark, d):
    """Predictions from JSON objects by key, with dates, decimals and nested values as JSON has them, and from lists whose rows are known by one of three names (some have none)."""
    files = Rounds(spark)
    o, k = read_table(spark, d, "orders"), F.col("s_suppkey")
    extra = F.struct(F.col("o_orderdate").cast("date").alias("at"), F.array((F.col("o_orderkey") % 7).cast("decimal(9,2)"), F.lit(0.5).cast("decimal(9,2)")).alias("sums"), F.struct(F.col("o_custkey").alias("k")).alias("of"))
    entry = F.to_json(F.create_map(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.struct(F.col("o_orderstatus").alias("name"), extra.alias("extra"))))
    keyed = o.select(F.floor(F.col("o_orderkey") / 2000).cast("string").alias("part"), F.col("o_orderkey").alias("at"), F.concat(F.lit(","), F.substring(entry, F.lit(2), F.length(entry) - 2)).alias("value"))
    names = F.struct(F.when(k % 3 == 0, F.concat(F.lit("i"), k.cast("string"))).when(k % 3 == 1, "").alias("id"), F.when((k % 3 == 1) & (k % 5 != 4), F.concat(F.lit("n"), k.cast("string"))).alias("instance_id"), F.when((k % 3 == 2) & (k % 5 != 4), F.concat(F.lit("s"), k.cast("string"))).alias("sha_fail"), F.col("s_name").alias("name"))
    listed = read_table(spark, d, "supplier").where("s_suppkey % 5 <> 4 OR s_suppkey % 3 <> 0").select(F.floor(k / 50).cast("string").alias("part"), k.alias("at"), F.concat(F.lit(","), F.to_json(names)).alias("value"))

    def framed(rows: DataFrame, opening: str, closing: str, name: str) -> None:
        """Files of one value each: an opening line with an entry that is nothing, the rows, and a closing line."""
        parts = rows.select("part").distinct()
        ends = [parts.select("part", F.lit(at).cast("long").alias("at"), F.lit(text).alias("value")) for at, text in ((-1, opening), (1 << 60, closing))]
        rows.unionByName(ends[0]).unionByName(ends[1]).repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(f"{files.base}/{name}")

    framed(keyed, '{"none": null', "}", "object")
    framed(listed, "[null", "]", "list")
    p = io.read_predictions(spark, f"{files.base}/*", "struct<id:string,instance_id:string,sha_fail:string,name:string,extra:string>")
    return files.result(p.select("key", "row.name", "row.extra"))


@query("WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'memory' ELSE 'evaluation' END AS role, CASE WHEN doc_id % 4 = 0 THEN 'split lang' END AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1000000000 + n_nationkey, 'memory', 'x' FROM nation) SELECT s.doc_id, s.role, coalesce(d.lang, s.lang, '') AS lang, md5(CASE WHEN s.role = 'memory' THEN coalesce(d.text, '') ELSE '' END) AS diff, d.doc_id IS NULL AS missing, 'diff' AS unsaved FROM s LEFT JOIN (SELECT * FROM documents WHERE contains(lower(coalesce(source, '')), 'c1') OR contains('c1', lower(coalesce(source, ''))) OR contains(lower(coalesce(source, '')), 'src2') OR contains('src2', lower(coalesce(source, '')))) d USING (doc_id)")
def enriched_split(spark, d):
    """Rows of two split files joined to those of the dataset whose repositories are wanted: its fields first, then the split's, the
    diff for memory only, and which keys the dataset misses; a third split is not there, and the sink names the required fields that its rows lack."""
    files = Rounds(spark)
    source = F.col("source")
    docs = read_table(spark, d, "documents")
    dataset = docs.where(V.names_repo(source, F.lit(""), source, (" C1", "src2")))
    far = read_table(spark, d, "nation").select((F.lit(1000000000) + F.col("n_nationkey")).cast("long").alias("doc_id"), F.lit("memory").alias("role"), F.lit("x").alias("lang"))
    rows = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "memory").otherwise("evaluation").alias("role"), F.when(F.col("doc_id") % 4 == 0, "split lang").alias("lang")).unionByName(far)
    for role in ("memory", "evaluation"):
        lacking = io.write_jsonl(rows.where(F.col("role") == role), f"{files.base}/{role}_set", ("doc_id", "role", "diff"))
    split = None
    for role in ("memory", "evaluation", "absent"):
        part = io.read_or_none(spark, f"{files.base}/{role}_set", "doc_id long, role string, lang string", lambda s, p, schema: s.read.schema(schema).json(p))
        split = part if split is None else split.unionByName(part)
    wanted = dataset.join(split.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("known"), "text", F.lit(True).alias("there"))
    j = split.join(wanted, "doc_id", "left")
    return files.result(j.select("doc_id", "role", F.coalesce("known", "lang", F.lit("")).alias("lang"), F.md5(F.when(F.col("role") == "memory", F.coalesce("text", F.lit(""))).otherwise("")).alias("diff"), F.col("there").isNull().alias("missing"), F.lit(",".join(lacking)).alias("unsaved")))


@query("WITH n AS (SELECT user_id AS run, event_id AS id, round(value, 4) AS cost FROM events WHERE user_id % 3 = 0), l AS (SELECT user_id AS run, event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN round(value, 4) END, 0.0) AS cost, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'exit' END AS status FROM events WHERE user_id % 6 <> 0) SELECT CAST(run AS BIGINT) AS run, id, cost, 'new' AS format, 'run ' || run AS status FROM n UNION ALL SELECT CAST(run AS BIGINT), id, cost, 'legacy', status FROM l WHERE run % 3 <> 0")
def cost_reports(spark, d):
    """Costs by run folder: new reports with their instances, and trajectories of an older shape only where the run has no new report."""
    files = Rounds(spark)
    e = read_table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.round("value", 4).alias("cost"))
    report = e.where("run % 3 = 0").groupBy("run").agg(F.collect_list(F.struct("id", "cost")).alias("instances")).select("run", F.concat(F.lit("run "), F.col("run").cast("string")).alias("name"), "instances")
    report.repartition("run").write.partitionBy("run").json(f"{files.base}/new")
    info = F.struct(F.struct(F.when(F.col("id") % 2 == 0, F.col("cost")).alias("total")).alias("cost_tracking"), F.when(F.col("id") % 4 == 0, "done").alias("attempt_status"), F.lit("exit").alias("exit_status"))
    e.where("run % 6 <> 0").select("run", "id", info.alias("info")).repartition("run").write.partitionBy("run").json(f"{files.base}/legacy")
    run = F.regexp_extract("path", "run=([^/]*)", 1).cast("long").alias("run")

    def rows(part: str, schema: str) -> DataFrame:
        lines = listing.read_files(listing.list_files(spark, f"{files.base}/{part}"))
        return lines.select(run, F.from_json("value", schema).alias("r")).select("run", "r.*")

    new = rows("new", "name string, instances array<struct<id:long,cost:double>>").select("run", "name", F.explode("instances").alias("i")).select("run", "i.id", "i.cost", F.lit("new").alias("format"), F.col("name").alias("status"))
    old = rows("legacy", "id long, info struct<cost_tracking:struct<total:double>,attempt_status:string,exit_status:string>").select("run", "id", F.coalesce("info.cost_tracking.total", F.lit(0.0)).alias("cost"), F.lit("legacy").alias("format"), F.coalesce("info.attempt_status", "info.exit_status").alias("status"))
    return files.result(new.unionByName(old.join(new.select("run").distinct(), "run", "left_anti")))


@query("WITH r AS (SELECT user_id AS folder, max(event_id) AS last, count(*) AS n FROM events WHERE user_id % 4 <> 2 GROUP BY 1), p AS (SELECT user_id AS folder, max(props) AS patch FROM events WHERE user_id % 3 <> 1 GROUP BY 1) SELECT CAST(r.folder AS VARCHAR) AS folder, r.last, r.n, coalesce(p.patch, '') AS patch, p.patch IS NOT NULL AS has_patch FROM r LEFT JOIN p ON p.folder = r.folder")
def consolidated_patches(spark, d):
    """Results and patch texts of several directories joined by folder; a result without a patch has an empty one."""
    files = Rounds(spark)
    e = read_table(spark, d, "events")

    def written(rows: DataFrame, part: str, file: str, value: F.Column) -> DataFrame:
        """A file in a folder of its own for each row, and the listing of them."""
        name = F.concat(listing.bucket(F.col("folder")), F.lit("/folder="), F.col("folder").cast("string"), F.lit(f"/{file}"))
        listing.write_files(rows.select(name.alias("name"), F.concat(value, F.lit("\n")).alias("value")), f"{files.base}/{part}")
        return files.keep(listing.list_files(spark, f"{files.base}/{part}"))

    found = e.where("user_id % 4 <> 2").groupBy(F.col("user_id").alias("folder")).agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))
    texts = e.where("user_id % 3 <> 1").groupBy(F.col("user_id").alias("folder")).agg(F.max("props").alias("value"))
    listed = written(found, "result", "result.json", F.to_json(F.struct("last", "n"))), written(texts.where("value IS NOT NULL"), "patch", "patch.diff", F.col("value"))
    name = F.regexp_extract("path", "folder=([^/]*)", 1).alias("folder")
    results = listing.read_files(listed[0]).select(name, F.from_json("value", "last long, n long").alias("r")).select("folder", "r.*")
    patches = listing.read_files(listed[1], whole=True).select(name, F.col("value").alias("patch"))
    j = results.join(patches, "folder", "left")
    return files.result(j.select("folder", "last", "n", F.coalesce("patch", F.lit("")).alias("patch"), F.col("patch").isNotNull().alias("has_patch")))


@query("WITH t AS (SELECT doc_id AS id, CAST(coalesce(doc_id % 2 = 0 AND doc_id % 3 = 0, false) AS INT) + CAST(doc_id % 7 <> 1 AND doc_id % 5 = 0 AS INT) + CAST(doc_id % 5 <> 2 AND doc_id % 4 < 2 AS INT) AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 7 <> 1 OR doc_id % 5 <> 2) SELECT n AS success_count, count(*) AS rows_n, min(id) AS least, max(id) AS most FROM t WHERE n > 0 GROUP BY 1")
def category_files(spark, d):
    """Outcome rows in one CSV folder a category, without those that failed everywhere, and sorted id lists a success count, read again."""
    files = Rounds(spark)
    t = direction_table(spark, d).where("category <> 'All Failed'")
    io.write_by(t, f"{files.base}/categories", "category", fmt="csv")
    io.write_id_lists(t, f"{files.base}/ids", "success_count", "id")
    ids = spark.read.option("recursiveFileLookup", True).text(f"{files.base}/ids").select(F.regexp_extract(io.folder_of(), "success_count=(.*)", 1).cast("int").alias("success_count"), F.col("value").cast("long").alias("id"))
    rows = spark.read.schema("id long, repo string, forward_status string, backward_status string, bidirectional_status string, success_count int, solved_by string, failed_in string").option("recursiveFileLookup", True).csv(f"{files.base}/categories")
    counted = rows.groupBy("success_count").agg(F.count(F.lit(1)).alias("rows_n"))
    return files.result(ids.groupBy("success_count").agg(F.min("id").alias("least"), F.max("id").alias("most")).join(counted, "success_count").select("success_count", "rows_n", "least", "most"))


_CACHE = "c AS (SELECT p_partkey AS pos, md5(CAST(p_partkey AS VARCHAR)) AS sha, p_name AS v FROM part WHERE p_partkey % 2 = 0), q AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN md5(CAST(p_partkey AS VARCHAR)) WHEN 1 THEN md5(CAST(p_partkey - 1 AS VARCHAR))[1:9] WHEN 2 THEN md5(CAST(p_partkey AS VARCHAR)) || 'ff' ELSE '' END AS asked FROM part)"


@query(f"WITH {_CACHE}, x AS (SELECT q.id, arg_min(c.v, c.pos) AS v FROM q JOIN c ON c.sha = q.asked GROUP BY 1), y AS (SELECT q.id, arg_min(c.v, c.pos) AS v FROM q JOIN c ON q.asked <> '' AND c.sha[1:9] = q.asked[1:9] AND (starts_with(c.sha, q.asked) OR starts_with(q.asked, c.sha)) GROUP BY 1) SELECT q.id, coalesce(x.v, y.v) AS found, x.v IS NULL AND y.v IS NULL AS miss FROM q LEFT JOIN x ON x.id = q.id LEFT JOIN y ON y.id = q.id")
def cache_lookups(spark, d):
    """Lookups in a cache of versions that two writers upserted at once: by the full key, else by the first entry where one is a beginning of the other; misses are marked."""
    files = Rounds(spark)
    p = read_table(spark, d, "part")
    sha = F.md5(F.col("p_partkey").cast("string"))
    entries = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("pos"), sha.alias("sha"), F.col("p_name").alias("v"))
    table = VersionedTable(spark, f"{files.base}/cache", "pos long, sha string, v string", "sha", 8)
    table.upsert(entries.where("pos < 100").withColumn("v", F.lit("stale")))
    # another writer commits while this one is between reading and committing; it reads again and loses nothing
    other = lambda attempt: attempt or VersionedTable(spark, table.path, table.schema, "sha", 8).upsert(entries.where("pos < 50"))
    table.upsert(entries.where("pos >= 50"), other)
    cache = table.read()
    k = F.col("p_partkey")
    asked = F.when(k % 4 == 0, sha).when(k % 4 == 1, F.substring(F.md5((k - 1).cast("string")), 1, 9)).when(k % 4 == 2, F.concat(sha, F.lit("ff"))).otherwise("")
    return files.result(R.prefix_lookup(p.select(k.alias("id"), asked.alias("asked")), cache, "asked", "sha", "pos", 9).select("id", F.col("v").alias("found"), F.col("v").isNull().alias("miss")))


@query("WITH n AS (SELECT user_id AS id, event_type AS phase, count(*) AS calls, round(sum(value), 4) AS cost FROM events WHERE event_id % 2 = 0 GROUP BY ALL), o AS (SELECT user_id AS id, event_type AS phase, count(*) AS calls, round(sum(value), 4) AS cost FROM events WHERE event_id % 3 = 0 GROUP BY ALL) SELECT * FROM o WHERE id NOT IN (SELECT id FROM n WHERE id % 2 = 0) UNION ALL SELECT * FROM n WHERE id % 2 = 0")
def usage_reports(spark, d):
    """Usage by phase saved into a report: an instance's rows replace its old ones in one new version of the report."""
    files = Rounds(spark)
    e = read_table(spark, d, "events")
    by = lambda df: df.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("phase")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"))
    table = VersionedTable(spark, f"{files.base}/report", "id long, phase string, calls long, cost double", "id", 8)
    table.replace(by(e.where("event_id % 3 = 0")))
    new = by(e.where("event_id % 2 = 0 AND user_id % 2 = 0"))
    old = table.read()
    table.replace(old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new))
    return files.result(table.read().select("id", "phase", "calls", "cost"))


@query("""
WITH l AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, CASE WHEN event_id % 7 = 5 THEN ' ' WHEN event_id % 11 = 3 THEN '{"kind":' ELSE '{"kind":"' || event_type || '"}' END AS line, event_type, event_id % 11 = 3 AS bad FROM events),
b AS (
  SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY day ORDER BY event_id) - strlen(line) - 1 AS first, sum(strlen(line) + 1) OVER (PARTITION BY day) // 2 AS frozen, count(*) OVER (PARTITION BY day) AS newlines FROM l),
r AS (SELECT *, least(first + strlen(line), frozen) AS last FROM b WHERE first < frozen AND line <> ' ')
SELECT day, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, row_number() OVER (PARTITION BY day ORDER BY first DESC) AS back, bad OR last < first + strlen(line) AS rejected,
  CASE WHEN bad OR last < first + strlen(line) THEN '' ELSE event_type END AS kind, newlines
FROM r
""")
def reversed_log(spark, d):
    """Logs of JSON lines, a file a day, read from their ends by byte ranges: blank lines skipped, malformed ones rejected in
    place, as is the one that is cut where the log is frozen, at half of its bytes; and the newlines of each file."""
    files = Rounds(spark)
    k = F.col("event_id")
    value = F.when(k % 7 == 5, " ").when(k % 11 == 3, '{"kind":').otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"))))
    rows = read_table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "event_id", value.alias("value"))
    rows.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(f"{files.base}/log")
    day = F.regexp_extract("file", "day=([^/]*)", 1).alias("day")
    r = ranges.read_backward(spark, f"{files.base}/log", "kind string", {"*": 0.5}).select(day, "first", "last", F.col("back").cast("long").alias("back"), "rejected", F.coalesce("row.kind", F.lit("")).alias("kind"))
    return files.result(r.join(ranges.newline_counts(spark, f"{files.base}/log").select(day, "newlines"), "day"))


@query("WITH i AS (SELECT user_id AS thread, event_id, event_type AS kind, event_id % 13 = 4 AS bad, CASE WHEN event_type = 'signup' THEN 'mode' || (event_id % 3) END AS mode, props FROM events WHERE user_id % 9 <> 4) SELECT CAST(thread AS BIGINT) AS thread, count(*) FILTER (NOT bad) AS items, count(*) FILTER (bad) AS parse_errors, min(event_id) FILTER (NOT bad) AS first_item, coalesce(arg_max(mode, event_id) FILTER (NOT bad AND mode IS NOT NULL), '') AS memory_mode FROM i GROUP BY 1 HAVING count(*) FILTER (NOT bad) > 0")
def rollout_metadata(spark, d):
    """Files of a tree found by pattern, each folded into one row: items, parse errors, the first item and the last session's mode; files without an item are errors and left out."""
    files = Rounds(spark)
    k = F.col("event_id")
    item = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.when(F.col("event_type") == "signup", F.concat(F.lit("mode"), (k % 3).cast("string"))).alias("mode")))
    e = read_table(spark, d, "events").where("user_id % 9 <> 4").select(F.col("user_id").alias("thread"), "event_id", F.when(k % 13 == 4, "{").otherwise(item).alias("value"))
    e.repartition("thread").sortWithinPartitions("thread", "event_id").select("thread", "value").write.partitionBy("thread").text(f"{files.base}/sessions")
    found = listing.list_files(spark, f"{files.base}/sessions").where(F.rlike("path", F.lit("/part-[^/]*$")))
    lines = listing.read_files(found).select(F.regexp_extract("path", "thread=([^/]*)", 1).cast("long").alias("thread"), "value", T.is_json(F.col("value")).alias("fine"))
    rows = lines.withColumn("r", F.from_json("value", "event_id long, kind string, mode string"))
    fine = F.col("fine")
    folded = rows.groupBy("thread").agg(F.count_if(fine).alias("items"), F.count_if(~fine).alias("parse_errors"), F.min(F.when(fine, F.col("r.event_id"))).alias("first_item"), F.coalesce(F.max_by("r.mode", F.when(F.col("r.mode").isNotNull(), F.col("r.event_id"))), F.lit("")).alias("memory_mode"))
    return files.result(folded.where("items > 0"))


@query("WITH a AS (SELECT event_id, strlen('{\"id\":' || event_id || '}') + 1 AS bytes FROM events WHERE event_id % 2 = 0 OR event_id > 500), r AS (SELECT *, sum(bytes) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY event_id DESC) AS k FROM a), t AS (SELECT sum(bytes) AS total FROM a) SELECT event_id FROM r, t WHERE total <= 4000 OR k = 1 OR used <= 3200")
def appended_history(spark, d):
    """Payloads appended one a line in two runs, then cut from the oldest on to four fifths of 4000 bytes if there are more; the newest line always stays."""
    files = Rounds(spark)
    e = read_table(spark, d, "events").select(F.col("event_id").alias("id"))
    for part in ("id % 2 = 0 AND id <= 500", "id > 500"):
        e.where(part).write.mode("append").json(f"{files.base}/history")
    rows = spark.read.text(f"{files.base}/history").select(F.get_json_object("value", "$.id").cast("long").alias("event_id"), (F.octet_length("value") + 1).alias("bytes"))
    return files.result(R.suffix_within(rows, "event_id", "bytes", 4000, 3200).select("event_id"))


def toy_embedding(texts: pd.Series) -> pd.Series:
    """Stands for a model: letters and words of a text."""
    return texts.map(lambda t: [float(len(t)), float(len(t.split(" ")))])


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(turn AS DOUBLE) ELSE CAST(length(coalesce(text, '')) AS DOUBLE) END AS first, CASE WHEN turn % 2 = 0 THEN 1.0::DOUBLE ELSE CAST(len(string_split(coalesce(text, ''), ' ')) AS DOUBLE) END AS second, CAST(0 AS BIGINT) AS computed_again FROM conversations WHERE conv_id IS NOT NULL")
def materialized_vectors(spark, d):
    """Stored vectors are scanned, rows without one get theirs from a callable that is handed in (a model plays no part here) and
    are stored beside them; a second run computes none again."""
    files = Rounds(spark)
    rows = read_table(spark, d, "conversations").where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    stored = f"{files.base}/vectors"
    rows.where("turn % 2 = 0").select("conv_id", "turn", F.array(F.col("turn").cast("double"), F.lit(1.0)).alias("vector")).write.parquet(stored)
    counted = 0
    for _ in range(2):
        known = spark.read.parquet(stored)
        missing = files.keep(rows.join(known.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").withColumn("vector", F.lit(None).cast(ArrayType(DoubleType()))))
        counted = missing.count()
        R.fill_by(missing, "vector", "text", toy_embedding, ArrayType(DoubleType())).select("conv_id", "turn", "vector").write.mode("append").parquet(stored)
    v = rows.join(spark.read.parquet(stored), ["conv_id", "turn"])
    return files.result(v.select("conv_id", "turn", F.col("vector")[0].alias("first"), F.col("vector")[1].alias("second"), F.lit(counted).cast("long").alias("computed_again")))
