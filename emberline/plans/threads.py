"""Queries over thread listings, replays and prompts, and streams. Threads are customers, their files orders, logs conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import history as H
from ..operators import relational as R
from ..shared import Rounds
from ..sources.io import read_table
from ..streaming import projection
from .base import query
from .history import spawn_edges
from .paths import _pick

_EDGES = "e AS (SELECT o_custkey AS child, arg_max(o_orderkey % 97, o_orderkey) AS parent FROM orders GROUP BY 1), open AS (SELECT * FROM e WHERE child NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))"
_BELOW = "d(node) AS (SELECT child FROM open WHERE parent = 5 UNION SELECT open.child FROM open JOIN d ON open.parent = d.node)"
_THREADS = "t AS (SELECT c_custkey AS id, c_mktsegment AS source, c_nationkey % 2 = 0 AS archived, floor(c_acctbal) AS updated, c_name AS name FROM customer)"


@query(f"WITH RECURSIVE {_EDGES}, {_BELOW}, {_THREADS}, f AS (SELECT * FROM t WHERE NOT archived AND source IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND (updated < 9000 OR (updated = 9000 AND id > 0)) AND id IN (SELECT node FROM d)), p AS (SELECT * FROM f ORDER BY updated DESC, id LIMIT 26) SELECT id, CAST(updated AS BIGINT) AS updated, name, (SELECT count(*) FROM p) > 25 AS has_more FROM (SELECT * FROM p ORDER BY updated DESC, id LIMIT 25) WHERE id % 10 <> 9")
def thread_page(spark, d):
    """Descendants of a thread under all listing filters, beyond an anchor, newest first, 25 with look-ahead; rows whose file has gone are dropped from the page."""
    edges = spawn_edges(spark, d).where("status = 'open'").select("parent", "child")
    below = graph.descendants(edges, spark.range(1).select(F.lit(5).cast("long").alias("node"))).select(F.col("node").alias("id")).distinct()
    c = read_table(spark, d, "customer")
    t = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source"), (F.col("c_nationkey") % 2 == 0).alias("archived"), F.floor("c_acctbal").alias("updated"), F.col("c_name").alias("name"))
    beyond = (F.col("updated") < 9000) | ((F.col("updated") == 9000) & (F.col("id") > 0))
    page = t.where(~F.col("archived") & F.col("source").isin("BUILDING", "MACHINERY", "HOUSEHOLD") & beyond).join(below, "id", "left_semi").orderBy(F.col("updated").desc(), "id").limit(26)
    k = F.row_number().over(Window.orderBy(F.col("updated").desc(), "id"))  # over 26 rows
    numbered = page.select("id", "updated", "name", k.alias("k"), (F.count(F.lit(1)).over(Window.partitionBy()) > 25).alias("has_more")).where("k <= 25")
    there = c.where("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("id"))
    return numbered.join(there, "id", "left_semi").select("id", "updated", "name", "has_more")


@query("WITH m AS (SELECT conv_id AS id, arg_min(turn, turn) AS turn, min(turn) AS first FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'an') GROUP BY 1), l AS (SELECT DISTINCT conv_id AS id FROM conversations), s AS (SELECT id FROM l ORDER BY id DESC LIMIT 256), j AS (SELECT s.id, m.first FROM s JOIN m ON m.id = s.id), p AS (SELECT * FROM j ORDER BY id DESC LIMIT 21) SELECT id, first, (SELECT count(*) FROM p) > 20 AS has_more FROM (SELECT * FROM p ORDER BY id DESC LIMIT 20)")
def search_page(spark, d):
    """Threads whose text holds a word, joined into the newest 256 of the listing (eight pages, 256 at least), one page with look-ahead."""
    c = read_table(spark, d, "conversations")
    found = c.where(F.col("role").isin("user", "assistant") & F.contains(F.lower("text"), F.lit("an"))).groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("first"))
    size = 20
    scan = min(max(8 * size, 256), 2048)
    listing = c.select(F.col("conv_id").alias("id")).distinct().orderBy(F.col("id").desc()).limit(scan)
    page = listing.join(found, "id").orderBy(F.col("id").desc()).limit(size + 1)
    k = F.row_number().over(Window.orderBy(F.col("id").desc()))
    return page.select("id", "first", k.alias("k"), (F.count(F.lit(1)).over(Window.partitionBy()) > size).alias("has_more")).where(F.col("k") <= size).drop("k")


_SEGMENTS = "m AS (SELECT p_partkey AS thread, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS base, CAST(p_size AS BIGINT) AS cutoff FROM part), c(requested, thread, ends, depth, base, cutoff) AS (SELECT thread, thread, CAST(NULL AS BIGINT), 0, base, cutoff FROM m WHERE thread % 50 = 7 UNION ALL SELECT c.requested, c.base, c.cutoff, c.depth + 1, m.base, m.cutoff FROM c JOIN m ON m.thread = c.base)"


@query(f"WITH RECURSIVE {_SEGMENTS}, s AS (SELECT requested, thread, ends, max(depth) OVER (PARTITION BY requested) - depth AS place FROM c), r AS (SELECT s.requested, s.place, l.l_partkey AS thread, l.l_orderkey AS ordinal, l.l_linenumber AS n FROM s JOIN lineitem l ON l.l_partkey = s.thread AND (s.ends IS NULL OR l.l_orderkey < s.ends * 300)), k AS (SELECT DISTINCT requested, place, thread, ordinal FROM r WHERE ordinal > 100), o AS (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY place, ordinal) AS i, count(*) OVER (PARTITION BY requested) AS total FROM k) SELECT requested, CAST(place AS INTEGER) AS place, thread, ordinal, total > 5 AS has_more FROM o WHERE i <= 5")
def lineage_page(spark, d):
    """The first five turns beyond an anchor of a thread and the threads that it builds on, each up to its cutoff, in order of the chain."""
    k = F.col("p_partkey")
    metas = read_table(spark, d, "part").select(k.alias("thread"), F.when(k > 1, F.floor(k / 2)).alias("base"), F.col("p_size").cast("long").alias("cutoff"))
    segments, _ = H.lineage(metas, metas.where("thread % 50 = 7").select("thread"))
    turns = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("thread"), F.col("l_orderkey").alias("ordinal")).where("ordinal > 100").distinct()
    rows = segments.join(turns, "thread").where(F.col("ends").isNull() | (F.col("ordinal") < F.col("ends") * 300))
    top = R.top_k(rows.select("requested", "place", "thread", "ordinal").distinct(), ["requested"], 6, F.col("place"), F.col("ordinal"))
    more = F.max("rank").over(Window.partitionBy("requested")) > 5
    return top.withColumn("has_more", more).where("rank <= 5").select("requested", "place", "thread", "ordinal", "has_more")


@query("WITH l AS (SELECT conv_id AS id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), s AS (SELECT id, coalesce(min(i) FILTER (turn = 2), 0) AS start FROM l GROUP BY 1), w AS (SELECT l.id, l.turn, l.i, row_number() OVER (PARTITION BY l.id ORDER BY l.i) AS k FROM l JOIN s ON s.id = l.id AND l.i >= s.start AND l.i < s.start + 160 WHERE l.turn % 3 < 2), c AS (SELECT id, string_agg(CASE turn % 3 WHEN 0 THEN 'pytest -k ' || turn ELSE 'make ' || turn END, ' && ' ORDER BY i) AS command FROM w WHERE k <= 8 GROUP BY 1) SELECT s.id, coalesce(c.command, '') AS command FROM s LEFT JOIN c ON c.id = s.id")
def log_commands(spark, d):
    """The commands in the 160 lines of a job's log from the line that names a step on (or from the first), eight at most, as one line."""
    turn = F.col("turn").cast("string")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Run pytest -k "), turn)).when(F.col("turn") % 3 == 1, F.concat(F.lit("\x1b[36;1mmake "), turn, F.lit("\x1b[0m"))).otherwise(F.concat(F.lit("noise "), turn))
    logs = read_table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    return logs.select("id", H.commands_after(F.col("lines"), F.lit("Noise 2")).alias("command"))


_PARTS = ("bad import", "", "type error in x", "lint F401")


@query(f"WITH p AS (SELECT p_brand AS brand, p_partkey AS id, {_pick(_PARTS, 'p_partkey % 4')} AS problem, p_name AS name, p_type AS kind, p_size AS n FROM part), t AS (SELECT brand, id, 'pattern:' || id || CASE WHEN kind <> 'ECONOMY' THEN ' | type:' || kind ELSE '' END || CASE WHEN problem <> '' THEN ' | problem:' || repeat(problem, 30)[1:200] ELSE '' END || CASE WHEN n > 0 THEN ' | signals:' || array_to_string(list_transform(range(1, least(n, 3) + 1), lambda i: 's' || i), ' | ') ELSE '' END AS part FROM p) SELECT brand, md5(string_agg(part, ' || ' ORDER BY id)) AS document, any_value((SELECT string_agg(x, ',' ORDER BY f) FROM (SELECT name AS x, min(id) AS f FROM p q WHERE q.brand = t.brand GROUP BY 1))) AS files FROM t GROUP BY brand")
def search_documents(spark, d):
    """A record's patterns as one search text without empty parts, and its files, plain or in records, each once in order."""
    k = F.col("p_partkey")
    p = read_table(spark, d, "part").withColumn("problem", F.expr(_pick(_PARTS, "p_partkey % 4")))
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c))
    signals = F.when(F.col("p_size") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.col("p_size"), F.lit(3))), lambda i: F.concat(F.lit("s"), i.cast("string"))), " | ")).otherwise("")
    kind = F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).otherwise("")
    part = F.concat_ws(" | ", tagged("pattern:", k.cast("string")), tagged("type:", kind), tagged("problem:", F.substring(F.repeat("problem", F.lit(30)), 1, 200)), tagged("signals:", signals))
    # files are texts in some rows and records in others; both become one list of texts
    item = F.when(k % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("path")))).otherwise(F.to_json(F.struct(F.col("p_name").alias("file"))))
    name = F.coalesce(F.get_json_object(item, "$.file"), F.get_json_object(item, "$.file_path"), F.get_json_object(item, "$.path"))
    files = p.select("p_brand", name.alias("f"), k.alias("k")).groupBy("p_brand", "f").agg(F.min("k").alias("k")).groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]), ",").alias("files"))
    texts = p.select("p_brand", k.alias("k"), part.alias("t")).groupBy("p_brand").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), " || ")).alias("document"))
    return texts.join(files, "p_brand").select(F.col("p_brand").alias("brand"), "document", "files")


@query("WITH l AS (SELECT l_orderkey AS key, count(*) AS n, sum(l_quantity * 1000)::BIGINT AS chars FROM lineitem GROUP BY 1), s AS (SELECT *, chars // 4 AS tokens FROM l) SELECT key, tokens, tokens > 30000 OR n > 10 AS needs_sampling, tokens > 40000 AND n > 1 AS needs_chunking, CAST(CASE WHEN tokens > 40000 AND n > 1 THEN least(10, greatest(1, 20000 // (tokens // n))) ELSE 5 END AS BIGINT) AS chunk_size, CASE WHEN n > 10 THEN 'src/**/*' END AS pattern, least(n, CASE WHEN n > 10 THEN 5 ELSE n END) AS showing FROM s")
def prompt_sizes(spark, d):
    """A record's tokens, whether it must be sampled or cut and into how large chunks (limits scaled down), and for many files five of them with the rest's pattern."""
    l = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity") * 1000).cast("long").alias("chars"), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("src/"), x["l_partkey"].cast("string"), F.lit(".py"))).alias("files"))
    size = H.prompt_size(F.floor(F.col("chars") / 4), F.col("n"), F.size("files"), 40_000, 20_000)
    shown = H.sampled_files(F.col("files"))
    return l.select("key", size.alias("s"), shown.alias("f")).select("key", "s.tokens", "s.needs_sampling", "s.needs_chunking", "s.chunk_size", "f.pattern", F.size("f.files").cast("long").alias("showing"))


_REPLAY = "SELECT user_id AS thread, event_id AS line, CASE event_id % 40 WHEN 7 THEN 'compaction' WHEN 9 THEN 'rollback' ELSE CASE event_type WHEN 'view' THEN 'turn_context' WHEN 'click' THEN 'user' ELSE 'item' END END AS kind FROM events"


@query(f"WITH r AS ({_REPLAY}), c AS (SELECT thread, max(line) FILTER (kind = 'compaction') AS compacted, max(line) FILTER (kind = 'rollback') AS rolled FROM r GROUP BY 1), t AS (SELECT r.thread, max(r.line) AS cut FROM r JOIN c ON c.thread = r.thread AND r.line < c.compacted AND r.kind = 'turn_context' GROUP BY 1) SELECT c.thread, CASE WHEN t.cut IS NOT NULL AND (c.rolled IS NULL OR c.rolled < t.cut) THEN t.cut ELSE -1 END AS start FROM c LEFT JOIN t ON t.thread = c.thread")
def replay_starts(spark, d):
    """Where a replay from the end may stop: at a turn's context before the last compaction; a rollback met on the way, or none of both, means the whole log (-1)."""
    k = F.col("event_id") % 40
    kind = F.when(k == 7, "compaction").when(k == 9, "rollback").when(F.col("event_type") == "view", "turn_context").when(F.col("event_type") == "click", "user").otherwise("item")
    return H.replay_start(read_table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("line"), kind.alias("kind")))


@query("WITH t AS (SELECT c_custkey AS id, '/old/' || c_custkey AS path, 'c:\\w' || (c_custkey % 5) AS cwd, c_nationkey % 2 = 0 AS archived, floor(c_acctbal) AS updated FROM customer), p AS (SELECT o_custkey AS id, '/new/' || max(o_orderkey) AS path, max(o_orderkey) % 2 = 1 AS archived FROM orders GROUP BY 1) SELECT t.id, coalesce(p.path, t.path) AS path, replace(t.cwd, '\\', '/') AS cwd, coalesce(p.archived, t.archived) AS archived, CAST(greatest(t.updated, CASE WHEN p.id IS NULL THEN t.updated ELSE 5000 END) AS BIGINT) AS updated, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.path <> t.path OR p.archived <> t.archived THEN 'repaired' ELSE 'same' END AS what FROM t LEFT JOIN p ON p.id = t.id")
def repaired_threads(spark, d):
    """Thread rows brought up to date with their newest file: path, normal working folder, archived flag and time; threads without a file keep theirs."""
    t = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/old/"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("c:\\w"), (F.col("c_custkey") % 5).cast("string")).alias("cwd"), (F.col("c_nationkey") % 2 == 0).alias("archived"), F.floor("c_acctbal").alias("updated"))
    p = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("k")).select("id", F.concat(F.lit("/new/"), F.col("k").cast("string")).alias("new_path"), (F.col("k") % 2 == 1).alias("new_archived"))
    j = t.join(p, "id", "left")
    there = F.col("new_path").isNotNull()
    changed = (F.col("new_path") != F.col("path")) | (F.col("new_archived") != F.col("archived"))
    return j.select("id", F.coalesce("new_path", "path").alias("path"), F.replace("cwd", F.lit("\\"), F.lit("/")).alias("cwd"), F.coalesce("new_archived", "archived").alias("archived"), F.when(there, F.greatest("updated", F.lit(5000))).otherwise(F.col("updated")).cast("long").alias("updated"), F.when(~there, "missing").when(changed, "repaired").otherwise("same").alias("what"))


@query("""
WITH e AS (
  SELECT user_id AS thread, event_id, event_type AS kind, strlen(props) + 1 AS bytes FROM events WHERE event_id > 100)
SELECT thread, CAST(row_number() OVER w - 1 AS BIGINT) AS ordinal, event_id, kind, CAST(sum(bytes) OVER w - bytes AS BIGINT) AS first, CAST(sum(bytes) OVER w AS BIGINT) AS next
FROM e WINDOW w AS (PARTITION BY thread ORDER BY event_id)
""")
def streamed_log(spark, d):
    """Each thread's log followed from an id on, in two polls, and projected exactly once: keyed state holds a thread's next
    byte and ordinal, and every chunk must start where the last one ended; a third poll finds nothing new."""
    files = Rounds(spark)
    thread = Window.partitionBy("thread").orderBy("event_id")
    e = read_table(spark, d, "events").where("event_id > 100").select(F.col("user_id").alias("thread"), "event_id", F.col("event_type").alias("kind"), (F.octet_length("props") + 1).cast("long").alias("bytes"))
    e = e.select("thread", (F.row_number().over(thread) - 1).cast("long").alias("ordinal"), "event_id", "kind", "bytes", F.sum("bytes").over(thread).alias("next"))
    line = F.struct("ordinal", "event_id", "kind", (F.col("next") - F.col("bytes")).alias("first"), "next")
    chunks = e.groupBy("thread", F.floor(F.col("ordinal") / 8).alias("chunk")).agg(F.sort_array(F.collect_list(line)).alias("lines"))  # eight lines at most
    chunks = chunks.select((F.col("chunk") > 0).cast("int").alias("poll"), "thread", F.col("lines")[0]["first"].alias("start_offset"), F.element_at("lines", -1)["next"].alias("next_offset"), "lines")
    chunks = files.keep(chunks)
    for poll in (0, 1, None):
        if poll is not None:
            chunks.where(F.col("poll") == poll).drop("poll").write.mode("append").parquet(f"{files.base}/log")
        log = projection.tail(spark, f"{files.base}/log", chunks.drop("poll").schema)
        projection.project(log, f"{files.base}/out", f"{files.base}/offsets").awaitTermination()
    return files.result(spark.read.parquet(f"{files.base}/out").select("thread", "ordinal", "event_id", "kind", "first", "next"))
