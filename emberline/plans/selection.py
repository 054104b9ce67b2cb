"""Queries that order, sample, budget and window rows. Issues are orders, repositories sources or customers, memories line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import relational as R
from ..sources.io import read_table
from .base import query
from .diffs import _PATH

_SPOT = "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey"
_PROBLEM = f"SELECT l_orderkey AS key, {_SPOT} AS spot, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 END AS place, {_PATH} AS file, l_returnflag = 'A' AS depends, l_linestatus = 'O' AS cascading, CASE WHEN l_partkey % 5 = 0 THEN ' ' WHEN l_partkey % 5 = 1 THEN 'pip install' ELSE 'pytest' END AS command FROM lineitem"


def problems(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PROBLEM.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))


@query(f"SELECT key, spot, CAST(row_number() OVER (PARTITION BY key ORDER BY coalesce(place, 999), CASE WHEN regexp_matches(file, 'pyproject\\.toml|setup\\.(py|cfg)|requirements\\.txt|package\\.json') THEN 0 ELSE 1 END, CASE WHEN depends THEN 0 ELSE 1 END, CASE WHEN cascading THEN 1 ELSE 0 END, spot) AS INTEGER) AS problem_id FROM ({_PROBLEM})")
def problem_order(spark, d):
    """An issue's problems by CI order, configuration first, dependencies first, cascading last, then as they came; numbered anew."""
    keys = [F.coalesce("place", F.lit(999)), F.when(P.is_config(F.col("file")), 0).otherwise(1), F.when(F.col("depends"), 0).otherwise(1), F.when(F.col("cascading"), 1).otherwise(0), F.col("spot")]
    return problems(spark, d).select("key", "spot", F.row_number().over(Window.partitionBy("key").orderBy(*keys)).alias("problem_id"))


@query(f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY spot) AS pos FROM ({_PROBLEM})) SELECT key, spot, CAST(row_number() OVER (PARTITION BY key ORDER BY coalesce(place, pos), pos) AS INTEGER) AS step FROM p WHERE trim(command) <> ''")
def validation_steps(spark, d):
    """Steps with a command, by their order or else their place, numbered anew."""
    own = Window.partitionBy("key")
    p = problems(spark, d).withColumn("pos", F.row_number().over(own.orderBy("spot")))
    kept = p.where(F.trim("command") != "")
    return kept.select("key", "spot", F.row_number().over(own.orderBy(F.coalesce("place", "pos"), "pos")).alias("step"))


_SIZES = "SELECT source, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY 1"


@query(f"WITH s AS (SELECT *, row_number() OVER (ORDER BY n DESC, seen) AS r FROM ({_SIZES})), t AS (SELECT *, CASE WHEN r <= 30 THEN 1 ELSE 0 END AS one, least(2, n - CASE WHEN r <= 30 THEN 1 ELSE 0 END) AS want FROM s), u AS (SELECT *, 50 - sum(one) OVER () - coalesce(sum(want) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t), q AS (SELECT source, one + greatest(0, least(want, room)) AS quota FROM u), d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM d JOIN q USING (source) WHERE k <= quota")
def quota_instances(spark, d):
    """One of each of the 30 largest repositories, then up to two more each, 50 in all."""
    return R.quota_sample(read_table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 30, None, 50).select("doc_id")


@query(f"WITH s AS (SELECT *, row_number() OVER (ORDER BY n DESC, seen) AS r FROM ({_SIZES})), t AS (SELECT *, CASE WHEN r <= 30 THEN 1 ELSE 0 END AS one, CASE WHEN r <= 10 THEN least(2, n - 1) ELSE 0 END AS want FROM s), u AS (SELECT *, 50 - sum(one) OVER () - coalesce(sum(want) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t), q AS (SELECT source, one + greatest(0, least(want, room)) AS quota FROM u), d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM d JOIN q USING (source) WHERE k <= quota")
def quota_fifty(spark, d):
    """One of each of the 30 largest repositories, then up to two more of the ten largest, 50 at most."""
    return R.quota_sample(read_table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 30, 10, 50).select("doc_id")


@query("WITH r AS (SELECT doc_id, source, md5('42/' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round, min(doc_id) OVER (PARTITION BY source) AS seen FROM documents) (SELECT 'seeded' AS sample, doc_id FROM r ORDER BY h, doc_id LIMIT 25) UNION ALL (SELECT 'diverse', doc_id FROM r ORDER BY round, seen LIMIT 30) UNION ALL (SELECT 'head', doc_id FROM r ORDER BY doc_id LIMIT 100)")
def samples(spark, d):
    """A seeded sample of 25, 30 rows that take each repository in turn, and the first 100."""
    r = read_table(spark, d, "documents").select("doc_id", "source")
    seeded = r.orderBy(F.md5(F.concat(F.lit("42/"), F.col("doc_id").cast("string"))), "doc_id").limit(25)
    seen = r.groupBy("source").agg(F.min("doc_id").alias("seen"))
    # no repository can give more than 30 of 30 rows
    first = R.top_k(r, ["source"], 30, F.col("doc_id")).withColumnRenamed("rank", "round").join(seen, "source").orderBy("round", "seen").limit(30)
    parts = {"seeded": seeded, "diverse": first, "head": r.orderBy("doc_id").limit(100)}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("sample"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH c AS (SELECT o_custkey AS repo, bool_or(o_orderstatus = 'F') AS m, bool_or(o_orderstatus = 'O') AS e FROM orders GROUP BY 1), k AS (SELECT repo, CASE WHEN m AND e THEN 'both' WHEN m THEN 'memory' WHEN e THEN 'eval' END AS kind FROM c), r AS (SELECT kind, repo, row_number() OVER (PARTITION BY kind ORDER BY repo) AS p, count(*) OVER (PARTITION BY kind) AS n FROM k WHERE kind IS NOT NULL), f AS (SELECT count(DISTINCT kind) FILTER (kind <> 'both' AND n >= 10) = 2 AS disjoint FROM r) SELECT 'random_overlap' AS strategy, CASE WHEN p <= 15 THEN 'source' ELSE 'target' END AS side, repo FROM r WHERE kind = 'both' AND n >= 30 AND p <= 30 UNION ALL SELECT 'disjoint_pure', CASE kind WHEN 'memory' THEN 'source' ELSE 'target' END, repo FROM r, f WHERE kind <> 'both' AND p <= 15 AND disjoint UNION ALL SELECT 'mixed', CASE WHEN kind = 'memory' OR (kind = 'both' AND p <= 5) THEN 'source' ELSE 'target' END, repo FROM r WHERE p <= 10")
def split_strategies(spark, d):
    """Repositories for source and target: from both sides' overlap (30 at least), from one side only (ten at least each), and mixed."""
    kind = F.when(F.col("m") & F.col("e"), "both").when(F.col("m"), "memory").when(F.col("e"), "eval")
    c = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("m"), F.bool_or(F.col("o_orderstatus") == "O").alias("e")).select("repo", kind.alias("kind")).where("kind IS NOT NULL")
    # only the first 30 of a kind matter, so each is a top-k
    heads = None
    for k in ("both", "memory", "eval"):
        part = c.where(F.col("kind") == k).orderBy("repo").limit(30)
        heads = part if heads is None else heads.unionByName(part)
    r = heads.withColumn("p", F.row_number().over(Window.partitionBy("kind").orderBy("repo")))  # over 90 rows
    n = F.max("p").over(Window.partitionBy("kind"))
    r = r.withColumn("n", n).withColumn("enough", F.count_if((F.col("kind") != "both") & (F.col("p") == 10)).over(Window.partitionBy()) == 2)
    both = F.col("kind") == "both"
    first = F.when(both & (F.col("n") >= 30), F.struct(F.lit("random_overlap").alias("strategy"), F.when(F.col("p") <= 15, "source").otherwise("target").alias("side")))
    second = F.when(~both & (F.col("p") <= 15) & F.col("enough"), F.struct(F.lit("disjoint_pure").alias("strategy"), F.when(F.col("kind") == "memory", "source").otherwise("target").alias("side")))
    third = F.when(F.col("p") <= 10, F.struct(F.lit("mixed").alias("strategy"), F.when((F.col("kind") == "memory") | (both & (F.col("p") <= 5)), "source").otherwise("target").alias("side")))
    return r.select("repo", F.explode(F.array_compact(F.array(first, second, third))).alias("x")).select("x.strategy", "x.side", "repo")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders WHERE o_orderdate IS NOT NULL), s AS (SELECT *, CASE WHEN k <= greatest(1, floor(n * 0.3::DOUBLE)) THEN 'memory' ELSE 'evaluation' END AS role FROM r) SELECT role, count(*) AS n, min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM s GROUP BY 1")
def global_split(spark, d):
    """The earliest 30 % of all rows with a time as memory, the rest for evaluation, with the dates of both; the last memory date is the cutoff."""
    o = read_table(spark, d, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", "o_orderdate")
    n = o.count()
    ranked = R.global_rank(o, "k", "o_orderdate", "o_orderkey")
    role = F.when(F.col("k") <= max(1, int(n * 0.3)), "memory").otherwise("evaluation")
    return ranked.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"))


_STAMPED = "SELECT event_id, user_id, coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 1 DAY END, CASE WHEN event_id % 7 = 2 THEN ts END, TIMESTAMP '0001-01-01') AS t FROM events"


@query(f"WITH s AS ({_STAMPED}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT event_id, CASE WHEN n > 1 AND k <= least(n - 1, greatest(1, floor(n * 0.3::DOUBLE))) THEN 'memory' ELSE 'evaluation' END AS role FROM r")
def stamped_split(spark, d):
    """Each repository's earliest 30 % as memory, by the first time that is there; rows without any come first."""
    s = spark.sql(_STAMPED.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("FROM events", "FROM {events}"), events=read_table(spark, d, "events"))
    return R.chronological_split(s, "user_id", "t", "event_id").select("event_id", "role")


_MATCHES = f"SELECT l_orderkey AS q, CASE WHEN l_orderkey % 5 = 0 THEN 3 ELSE 1 + l_suppkey % 3 END AS level, {_SPOT} AS spot, {_PATH} AS file, repeat('x', CAST(l_partkey % 40 AS INT)) AS diff, l_returnflag AS solution FROM lineitem"
_SIZE = "length('[{\"changed_files\": [\"' || file || '\"], \"diff\": \"' || diff || '\"}]')"


def matches(spark: SparkSession, d: str) -> DataFrame:
    """(q, level, spot, file, diff, solution, size): size is the length of the match as a JSON list."""
    m = spark.sql(_MATCHES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    return m.withColumn("size", F.expr(_SIZE).cast("long"))


_SIGN = "file || '||' || (diff || solution)[1:200]"


@query(f"WITH m AS (SELECT *, {_SIGN} AS sign, {_SIZE} AS size FROM ({_MATCHES})), a AS (SELECT *, bool_or(level < 3) OVER (PARTITION BY q) AS near FROM m), l3 AS (SELECT *, sum(size) OVER (PARTITION BY q ORDER BY spot ROWS UNBOUNDED PRECEDING) AS used FROM a WHERE level = 3 AND NOT near) SELECT q, level, spot FROM a WHERE level < 3 UNION ALL SELECT q, level, spot FROM l3 WHERE used <= 150")
def optimized_memories(spark, d):
    """Levels 1 and 2 whole; only where both are empty level 3, without what they already show, as far as 150 characters go."""
    m = matches(spark, d)
    sign = F.concat(F.array_join(F.array_sort(F.array("file")), "|"), F.lit("||"), F.substring(F.concat("diff", "solution"), 1, 200))
    near = m.where("level < 3")
    far = m.where("level = 3").withColumn("sign", sign).join(near.select("q", sign.alias("sign")).distinct(), ["q", "sign"], "left_anti").join(near.select("q").distinct(), "q", "left_anti")
    return near.select("q", "level", "spot").unionByName(R.budget_prefix(far, "q", "size", 150, "spot").select("q", "level", "spot"))


@query(f"WITH m AS (SELECT *, {_SIZE} AS size FROM ({_MATCHES})), t AS (SELECT *, sum(size) OVER (PARTITION BY q, level ORDER BY spot ROWS UNBOUNDED PRECEDING) AS used, coalesce(sum(CASE WHEN level = 1 THEN size END) OVER (PARTITION BY q), 0) AS s1, coalesce(sum(CASE WHEN level = 2 THEN size END) OVER (PARTITION BY q), 0) AS s2 FROM m), k AS (SELECT *, level = 2 AND s1 <= 400 * 0.8 AND (s2 <= (400 - s1) * 0.6 OR used <= floor((400 - s1) * 0.6)) AS second FROM t), g AS (SELECT *, 400 - s1 - coalesce(sum(CASE WHEN second THEN size END) OVER (PARTITION BY q), 0) AS room FROM k) SELECT q, level, spot FROM g WHERE level = 1 OR second OR (level = 3 AND s1 <= 400 * 0.8 AND room >= 100 AND used <= room)")
def tiered_memories(spark, d):
    """All of level 1; level 2 within 60 % of what is left, and level 3 in the rest if that is enough; level 1 alone if it takes over 80 %. Here of 400 characters, 100 being enough."""
    return R.tiered_budget(matches(spark, d), "q", "level", "size", 400, 100, "spot").select("q", "level", "spot")


@query()
def item_chunks(spark, d):
    """Messages of a thread in chunks of at most 40 tokens, the largest first."""
    c = read_table(spark, d, "conversations").select("conv_id", F.struct(T.estimate_tokens(F.col("text")).alias("tokens"), F.col("turn").cast("int").alias("pos")).alias("x"))
    whole = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("x.pos", "x.tokens"))).alias("x"))
    chunks = R.next_fit(F.transform("x", lambda e: F.struct(e["tokens"].alias("tokens"), e["pos"].alias("pos"))), 40)
    return whole.select("conv_id", F.posexplode(chunks).alias("chunk", "turns")).select("conv_id", "chunk", F.array_join(F.transform("turns", lambda t: t.cast("string")), ",").alias("turns"))


_LINES = "SELECT doc_id, idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS idx FROM documents)"
_FLAGS = f"l AS (SELECT doc_id, idx, contains(lower(line), 'th') AS a, contains(lower(line), 'qu') AS b FROM ({_LINES}))"


@query(f"WITH {_FLAGS}, n AS (SELECT *, min(CASE WHEN a THEN idx END) OVER w AS na, min(CASE WHEN b THEN idx END) OVER w AS nb FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), c AS (SELECT doc_id, idx AS s, greatest(na, nb) AS e FROM n WHERE (a OR b) AND na IS NOT NULL AND nb IS NOT NULL AND greatest(na, nb) < idx + 3) SELECT 'within' AS mode, c.doc_id, c.s AS first, c.e AS last FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.s >= c.s AND o.e <= c.e AND (o.s <> c.s OR o.e <> c.e)) UNION ALL SELECT 'same', doc_id, idx, idx FROM l WHERE a AND b UNION ALL SELECT 'any', doc_id, idx, idx FROM l WHERE a OR b")
def search_windows(spark, d):
    """Lines with any search word, with all of them, and the smallest windows of at most three lines that have all."""
    lines = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).withColumn("idx", (F.col("idx") + 1).cast("long"))
    flags = lines.select("doc_id", "idx", F.contains(F.lower("line"), F.lit("th")).alias("a"), F.contains(F.lower("line"), F.lit("qu")).alias("b"))
    own = Window.partitionBy("doc_id").orderBy("idx")
    ahead = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = flags.withColumn("na", F.min(F.when(F.col("a"), F.col("idx"))).over(ahead)).withColumn("nb", F.min(F.when(F.col("b"), F.col("idx"))).over(ahead))
    found = both.where((F.col("a") | F.col("b")) & F.col("na").isNotNull() & F.col("nb").isNotNull()).withColumn("last", F.greatest("na", "nb")).where(F.col("last") < F.col("idx") + 3)
    # ends never fall, so a window holds another one only if the next ends where it does
    following = F.lead("last").over(own)
    within = found.withColumn("next", following).where(F.col("next").isNull() | (F.col("next") > F.col("last"))).select(F.lit("within").alias("mode"), "doc_id", F.col("idx").alias("first"), "last")
    single = lambda mode, cond: flags.where(cond).select(F.lit(mode).alias("mode"), "doc_id", F.col("idx").alias("first"), F.col("idx").alias("last"))
    return within.unionByName(single("same", F.col("a") & F.col("b"))).unionByName(single("any", F.col("a") | F.col("b")))


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents), r AS (SELECT doc_id, len(l) AS n, array_to_string(l[2:3], chr(10)) || CASE WHEN len(l) > 3 THEN chr(10) ELSE '' END AS part FROM s), c AS (SELECT *, (SELECT max(k) FROM range(0, 101) r(k) WHERE strlen(part[1:k]) <= 100) AS head, (SELECT max(k) FROM range(0, 101) r(k) WHERE strlen(reverse(part)[1:k]) <= 100) AS tail FROM r) SELECT doc_id, CASE WHEN n < 2 THEN NULL WHEN strlen(part) <= 200 THEN part ELSE part[1:head] || '…' || ((strlen(part) - 200 + 3) // 4) || ' tokens truncated…' || reverse(reverse(part)[1:tail]) END AS content, CASE WHEN n < 2 THEN NULL ELSE n > 3 OR strlen(part) > 200 END AS truncated FROM c")
def memory_reads(spark, d):
    """Two lines from the second on, cut in their middle to 50 tokens, and whether anything is missing; null where there is no second line."""
    lines = F.split("text", "\n")
    part = F.concat(F.array_join(F.slice(lines, 2, 2), "\n"), F.when(F.size(lines) > 3, "\n").otherwise(""))
    p = read_table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), part.alias("part"))
    cut = T.cut_middle(F.col("part"), 50)
    return p.select("doc_id", F.when(F.col("n") >= 2, cut).alias("content"), F.when(F.col("n") >= 2, (F.col("n") > 3) | (F.octet_length("part") > 200)).alias("truncated"))


@query("WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_type, event_id) AS k, count(*) OVER () AS n FROM events WHERE value > 10) SELECT event_id, k AS place, CASE WHEN 40 + 25 < n THEN '65' END AS next FROM r WHERE k > 40 AND k <= 65")
def offset_page(spark, d):
    """25 rows from place 40 on in a sorted listing, and the next place if there is more."""
    e = read_table(spark, d, "events").where("value > 10").select("event_type", "event_id")
    head = e.orderBy("event_type", "event_id").limit(40 + 25 + 1)  # a page deep in the listing costs its depth, as every offset does
    n = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy("event_type", "event_id"))
    return head.select("event_id", k.cast("long").alias("place"), F.when(n > 65, "65").alias("next")).where("place > 40 AND place <= 65")


@query("WITH t AS (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20), m AS (SELECT max(event_id) AS last FROM t) SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS shown, last FROM t, m")
def log_tail(spark, d):
    """The last 20 log rows, shown in ascending order, with the id to go on from."""
    t = read_table(spark, d, "events").where("event_type = 'error'").orderBy(F.col("event_id").desc()).limit(20)
    return t.select("event_id", F.row_number().over(Window.orderBy("event_id")).alias("shown"), F.max("event_id").over(Window.partitionBy()).alias("last"))


_BUCKETS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 't' || user_id WHEN event_id % 3 = 1 THEN 'p' || (user_id % 5) ELSE '' END AS bucket, strlen(props) + 20 AS bytes FROM events"


@query(f"WITH b AS ({_BUCKETS}), r AS (SELECT *, row_number() OVER w AS k, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM b WINDOW w AS (PARTITION BY bucket ORDER BY event_id DESC)) SELECT event_id FROM r WHERE k <= 30 AND used <= 800")
def log_retention(spark, d):
    """The newest log rows of each thread, else of each process, else of the one bucket without either, within 30 rows and 800 bytes."""
    e = read_table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("thread"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))).alias("process"), (F.octet_length("props") + 20).alias("bytes"))
    bucket = F.coalesce("thread", "process", F.lit(""))
    return R.newest_within(e.withColumn("bucket", bucket), "bucket", "event_id", "bytes", 30, 800).select("event_id")
