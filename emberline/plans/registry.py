"""Queries over the driver tables, one or more survey operators each, with DuckDB SQL where SQL can say it.

Repositories are played by documents.source, outcomes by labels, usage calls by events, threads
by conversations, memory and query vectors by embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import graph, relational as R, vectors
from ..sources.io import read_table
from .base import QUERIES, SQL, query



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase_costs(spark, sf_dir)


def n():
    return F.count(F.lit(1))


# Aggregations (D)


@query("SELECT event_type AS phase, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1")
def phase_costs(spark, d):
    """Usage by phase."""
    v = F.col("value")
    return read_table(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(n().alias("calls"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"))


@query("SELECT count(*) AS rows_n, coalesce(round(sum(o_totalprice), 2), 0) AS total, coalesce(round(avg(o_totalprice), 4), 0) AS mean, coalesce(min(o_totalprice), 0) AS least, coalesce(max(o_totalprice), 0) AS most, count(*) FILTER (o_orderstatus = 'P') AS unpriced FROM orders")
def cost_totals(spark, d):
    """Global totals, zeros for an empty table."""
    p = F.col("o_totalprice")
    z = F.lit(0.0)
    return read_table(spark, d, "orders").agg(n().alias("rows_n"), F.coalesce(F.round(F.sum(p), 2), z).alias("total"), F.coalesce(F.round(F.avg(p), 4), z).alias("mean"), F.coalesce(F.min(p), z).alias("least"), F.coalesce(F.max(p), z).alias("most"), F.count_if(F.col("o_orderstatus") == "P").alias("unpriced"))


@query("SELECT coalesce(d.source, 'unknown') AS source, count(*) AS total, count(*) FILTER (l.quality = 1) AS passed, count(*) FILTER (l.quality = 0) AS failed, count(*) FILTER (l.doc_id IS NULL) AS missing, round(100.0 * count(*) FILTER (l.quality = 1) / count(*), 4) AS pass_pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def pass_rates(spark, d):
    """Outcomes by group; missing ones stay in the denominator."""
    docs = read_table(spark, d, "documents").select("doc_id", "source").join(read_table(spark, d, "labels"), "doc_id", "left")
    passed = F.count_if(F.col("quality") == 1)
    return docs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(n().alias("total"), passed.alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("missing"), F.round(100.0 * passed / n(), 4).alias("pass_pct"))


@query("SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def totals_by_source(spark, d):
    """Rollup with a total row."""
    return R.rollup_total(read_table(spark, d, "documents"), "source", n().alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT o_custkey AS repo, count(*) FILTER (o_orderstatus = 'F') / count(*) AS fail_rate, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3 AND abs(count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O')) / count(*) > 0.3")
def repo_spread(spark, d):
    """Groups of at least three whose rates differ by over 0.3."""
    g = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(n().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return g.where((F.col("n") >= 3) & (F.abs(F.col("f") - F.col("o")) / F.col("n") > 0.3)).select("repo", (F.col("f") / F.col("n")).alias("fail_rate"), "n")


@query("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents), m AS (SELECT source, n_chars AS upper_median FROM r WHERE rn = n // 2 + 1), l AS (SELECT source, lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY ALL), k AS (SELECT source, string_agg(lang || ':' || c, ',' ORDER BY c DESC, lang) AS modes FROM l GROUP BY 1), a AS (SELECT source, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1) SELECT * FROM a JOIN m USING (source) LEFT JOIN k USING (source)")
def upper_medians(spark, d):
    """Mean, least, most and the upper middle (not the interpolated median), and values by frequency."""
    t = read_table(spark, d, "documents")
    a = t.groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    modes = t.where("lang IS NOT NULL").groupBy("source", "lang").agg(n().alias("c")).groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), "lang"))), lambda x: F.concat(x["lang"], F.lit(":"), (-x["o"]).cast("string"))), ",").alias("modes"))
    return a.join(R.upper_median(t, "source", "n_chars"), "source").join(modes, "source", "left").select("source", "mean", "least", "most", "upper_median", "modes")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS middle, round(stddev_samp(o_totalprice), 3) AS spread, round(stddev_pop(o_totalprice), 3) AS spread_pop FROM orders GROUP BY 1")
def price_spread(spark, d):
    """Interpolated median, sample and population deviation."""
    p = F.col("o_totalprice")
    return read_table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(p), 3).alias("mean"), F.round(F.median(p), 3).alias("middle"), F.round(F.stddev_samp(p), 3).alias("spread"), F.round(F.stddev_pop(p), 3).alias("spread_pop"))


@query("SELECT max(ts) AS last_ts, max(event_id) AS last_id, max(event_id) FILTER (event_type = 'error') AS last_error, count(DISTINCT user_id) AS users FROM events")
def log_maxima(spark, d):
    """Plain and filtered maxima."""
    return read_table(spark, d, "events").agg(F.max("ts").alias("last_ts"), F.max("event_id").alias("last_id"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"), F.count_distinct("user_id").alias("users"))


@query("WITH c AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS n, sum(strlen(props))::BIGINT AS bytes, min(k) AS low, max(k) AS high FROM (SELECT e.event_type, e.props, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k FROM events e) GROUP BY 1")
def event_bytes(spark, d):
    """Byte sums and values from JSON."""
    e = read_table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(n().alias("n"), F.sum(F.octet_length(F.coalesce("props", F.lit("")))).alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM c) SELECT source, string_agg(lang || '(' || n || ')', ', ' ORDER BY rank) AS top, sum(n)::BIGINT AS n FROM r WHERE rank <= 3 GROUP BY source")
def top_categories(spark, d):
    """The three most frequent categories as text."""
    c = read_table(spark, d, "documents").groupBy("source", "lang").agg(n().alias("n"))
    top = R.top_k(c, ["source"], 3, F.col("n").desc(), F.col("lang"))
    item = F.struct("rank", F.concat(F.col("lang"), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    return top.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), ", ").alias("top"), F.sum("n").alias("n"))


# Joins and paired statistics (C, D)


@query("WITH b AS (SELECT d.doc_id, coalesce(l.quality, 0) AS a, coalesce(l.toxic, 0) AS b FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither FROM b) SELECT *, CASE WHEN only_a + only_b > 0 THEN pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b) ELSE 0.0 END AS chi2 FROM c")
def paired_outcomes(spark, d):
    """Contingency with missing as failure, and the corrected chi-square."""
    labels = read_table(spark, d, "labels")
    cells = R.contingency(read_table(spark, d, "documents").select("doc_id"), labels.select("doc_id", F.col("quality").alias("x")), labels.select("doc_id", F.col("toxic").alias("x")), "doc_id", "x")
    return cells.withColumn("chi2", stats.mcnemar_chi2(F.col("only_a"), F.col("only_b")))


@query()
def paired_p_values(spark, d):
    """Chi-square and exact two-sided p over pairs with both outcomes; a test holds both against plain sums."""
    l = read_table(spark, d, "labels").where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    c = l.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("only_a"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("only_b"))
    return c.select("only_a", "only_b", stats.chi2_p(stats.mcnemar_chi2(F.col("only_a"), F.col("only_b"))).alias("p_chi2"), stats.exact_two_sided(F.col("only_a"), F.col("only_b")).alias("p_exact"))


@query("WITH c AS (SELECT count(*) FILTER (n_chars > 500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 500 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 500 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 500 AND quality = 0) AS tn FROM documents JOIN labels USING (doc_id)), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM p")
def rule_accuracy(spark, d):
    """Precision, recall, F1 and accuracy, zero for an empty denominator."""
    j = read_table(spark, d, "documents").select("doc_id", "n_chars").join(read_table(spark, d, "labels"), "doc_id")
    said, good, bad = F.col("n_chars") > 500, F.col("quality") == 1, F.col("quality") == 0
    c = j.agg(F.count_if(said & good).alias("tp"), F.count_if(said & bad).alias("fp"), F.count_if((F.col("n_chars") <= 500) & good).alias("fn"), F.count_if((F.col("n_chars") <= 500) & bad).alias("tn"))
    measures = stats.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return c.select("tp", "fp", "fn", "tn", *measures).select("tp", "fp", "fn", "tn", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "accuracy")))


@query("WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 1), c AS (SELECT doc_id FROM documents WHERE lang = 'en'), m AS (SELECT d.doc_id, concat_ws('+', CASE WHEN a.doc_id IS NOT NULL THEN 'good' END, CASE WHEN b.doc_id IS NOT NULL THEN 'toxic' END, CASE WHEN c.doc_id IS NOT NULL THEN 'en' END) AS r FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)) SELECT CASE WHEN r = '' THEN 'none' ELSE r END AS region, count(*) AS n FROM m GROUP BY 1")
def outcome_regions(spark, d):
    """regions of three sets."""
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    return R.venn_regions({"good": labels.where("quality = 1"), "toxic": labels.where("toxic = 1"), "en": docs.where("lang = 'en'")}, docs.select("doc_id"), "doc_id")


@query("SELECT e.o_orderkey AS order_id, (SELECT count(*) FROM orders m WHERE m.o_custkey = e.o_custkey AND m.o_orderpriority = '1-URGENT' AND m.o_orderdate > e.o_orderdate) AS n_later FROM orders e WHERE e.o_orderpriority = '2-HIGH'")
def temporal_leaks(spark, d):
    """Memory rows later than an evaluation row, by a running count instead of a range join."""
    o = read_table(spark, d, "orders")
    part = lambda p: o.where(F.col("o_orderpriority") == p).select("o_orderkey", "o_custkey", "o_orderdate")
    return R.later_memory(part("2-HIGH"), part("1-URGENT"), "o_custkey", "o_orderdate").select(F.col("o_orderkey").alias("order_id"), "n_later")


@query("SELECT c.c_custkey, coalesce(n.n_name, r.r_name, '') AS place FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 0 LEFT JOIN region r ON r.r_regionkey = c.c_nationkey % 5")
def first_known_place(spark, d):
    """The first side that knows a key."""
    c = read_table(spark, d, "customer")
    # nation and region have 25 and 5 rows by definition
    nation, region = F.broadcast(read_table(spark, d, "nation")), F.broadcast(read_table(spark, d, "region"))
    j = c.join(nation, (nation.n_nationkey == c.c_nationkey) & (c.c_acctbal > 0), "left").join(region, region.r_regionkey == c.c_nationkey % 5, "left")
    return j.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("")).alias("place"))


@query("SELECT o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'A')")
def candidates_only_in_b(spark, d):
    """Semi and anti join."""
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return o.join(l.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(l.where("l_returnflag = 'A'"), "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"))


@query("WITH k AS (SELECT 'c' || client_id AS key, client_id FROM clients UNION ALL SELECT 'm' || master_id, client_id FROM clients UNION ALL SELECT email, client_id FROM clients) SELECT key, max(client_id) AS id FROM k WHERE key <> '' AND client_id IS NOT NULL GROUP BY 1")
def key_bridge(spark, d):
    """A5, C11: every key of a row (its own, its master's, its address) leads to it; of rows that share a key the last one counts."""
    k = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    rows = read_table(spark, d, "clients").where("client_id IS NOT NULL").select(k("c", "client_id").alias("a"), k("m", "master_id").alias("b"), "email", F.col("client_id").alias("id"), F.col("client_id").alias("place"))
    return R.key_bridge(rows, "id", "a", "b", "email", order="place")


@query("WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, min(turn) AS first_user FROM u GROUP BY 1), l AS (SELECT conv_id, max(turn) AS final_agent FROM a GROUP BY 1) SELECT f.conv_id, f.first_user, l.final_agent FROM f FULL JOIN l ON f.conv_id = l.conv_id WHERE f.conv_id IS NOT NULL UNION ALL SELECT l.conv_id, NULL, l.final_agent FROM l WHERE l.conv_id NOT IN (SELECT conv_id FROM f)")
def turn_summaries(spark, d):
    """First user and last agent turn of each thread, by number."""
    c = read_table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("final_agent"))
    return g.where(F.col("first_user").isNotNull() | F.col("final_agent").isNotNull())


# Windows, ranking, limits (E)


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_orderkey, CASE WHEN n > 1 AND rn <= least(n - 1, greatest(1, floor(n * 0.3::DOUBLE))) THEN 'memory' ELSE 'evaluation' END AS role FROM r")
def chronological_split(spark, d):
    """E1, E2, E3."""
    return R.chronological_split(read_table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "role")


@query("WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT user_id, CAST(rank AS INTEGER) AS rank, event_id FROM r WHERE rank <= 3")
def best_per_user(spark, d):
    """Top k of each group."""
    return R.top_k(read_table(spark, d, "events"), ["user_id"], 3, F.col("value").desc(), F.col("event_id")).select("user_id", "rank", "event_id")


@query("WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE used <= 2000")
def budget_prefix(spark, d):
    """A prefix under a budget."""
    c = read_table(spark, d, "conversations").withColumn("size", F.length("text").cast("long"))
    return R.budget_prefix(c, "conv_id", "size", 2000, "turn").select("conv_id", "turn", "used")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER w AS rn, sum(strlen(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn FROM r WHERE rn = 1 OR (rn <= 3 AND used <= 1500)")
def newest_under_caps(spark, d):
    """Newest rows under caps, the newest always."""
    c = read_table(spark, d, "conversations").withColumn("bytes", F.octet_length("text").cast("long"))
    return R.newest_suffix(c, "conv_id", "bytes", 3, 1500, F.col("turn").desc()).select("conv_id", "turn")


@query("WITH t AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM t) SELECT event_id, CAST(rn + max(t - rn) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS monotone FROM r")
def monotone_times(spark, d):
    """Strictly rising times without recursion."""
    e = read_table(spark, d, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    return R.monotone(e, "user_id", "t", "event_id").select("event_id", F.col("monotone").cast("long").alias("monotone"))


@query("WITH p AS (SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 26) SELECT event_id, (SELECT count(*) FROM p) > 25 AS has_more FROM p ORDER BY event_id LIMIT 25")
def keyset_page(spark, d):
    """A page beyond an anchor with look-ahead."""
    return R.keyset_page(read_table(spark, d, "events").select("event_id"), "event_id", 500, 25)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_event(spark, d):
    """Last value of each key."""
    return R.latest_by(read_table(spark, d, "events"), "user_id", "event_id", "event_id", "event_type", "value")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations")
def turn_batches(spark, d):
    """Slices of two turns."""
    return R.fixed_batches(read_table(spark, d, "conversations"), "conv_id", 2, "turn").select("conv_id", "turn", "batch")


@query("WITH p AS (SELECT DISTINCT event_type, user_id FROM events), t AS (SELECT count(DISTINCT user_id) AS total FROM events) SELECT event_type, count(*) AS frequency FROM p, t GROUP BY event_type, total HAVING count(*) >= CASE WHEN total < 5 THEN 2 ELSE 3 END AND count(*) * 100 >= total * CASE WHEN total < 5 THEN 40 ELSE 30 END")
def recurring_types(spark, d):
    """Patterns that enough issues show."""
    return R.recurring(read_table(spark, d, "events"), "event_type", "user_id")


# Set operations and upserts (F, I)


@query("WITH o AS (SELECT doc_id, n_chars FROM documents), n AS (SELECT doc_id, -1::BIGINT AS n_chars FROM labels WHERE quality = 0) SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def replace_rows(spark, d):
    """Delete by key, then insert."""
    return R.upsert(read_table(spark, d, "documents").select("doc_id", "n_chars"), read_table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit(-1).cast("long").alias("n_chars")), ["doc_id"])


@query("WITH u AS (SELECT doc_id, text, 0 AS src FROM documents UNION ALL SELECT doc_id, '' AS text, 1 AS src FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src) AS rn FROM u) SELECT doc_id, src FROM r WHERE rn = 1 AND length(trim(text)) > 0")
def merge_first_wins(spark, d):
    """Dedupe before the filter of empty ones."""
    u = read_table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("src")).unionByName(read_table(spark, d, "labels").select("doc_id", F.lit("").alias("text"), F.lit(1).alias("src")))
    return R.first_by(u, ["doc_id"], F.col("src")).where(F.length(F.trim("text")) > 0).select("doc_id", "src")


@query("SELECT l_orderkey AS key, min(l_linenumber) AS first_seq, coalesce(arg_min(l_returnflag, l_linenumber) FILTER (l_returnflag IN ('R', 'A')), arg_max(l_returnflag, l_linenumber)) AS l_returnflag, coalesce(min(l_linenumber) FILTER (l_returnflag IN ('R', 'A')), max(l_linenumber)) AS last_seq FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def frozen_turns(spark, d):
    """A terminal state is never overwritten."""
    l = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return R.frozen_upsert(l.withColumnRenamed("l_orderkey", "key"), "key", "l_linenumber", "l_returnflag", ("R", "A"))


@query("WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY 1, 2")
def sessions(spark, d):
    """Sessions from start events."""
    e = R.sessions(read_table(spark, d, "events"), "user_id", F.col("event_type") == "signup", "ts", "event_id")
    return e.groupBy("user_id", "session").agg(n().alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


# Predicates and projections (B)


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND contains(props, '7') AND event_id > 100")
def log_filter(spark, d):
    """Conjunctive log filter, pushed to the scan."""
    e = read_table(spark, d, "events")
    return e.where(F.col("event_type").isin("error", "purchase") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & F.contains("props", F.lit("7")) & (F.col("event_id") > 100)).select("event_id")


@query("WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '%%%') THEN 'marks' END, CASE WHEN contains(text, ' | ') THEN 'menu' END], lambda x: x IS NOT NULL) AS reasons FROM documents) SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def quality_rules(spark, d):
    """Named rules that a row breaks."""
    q = R.quality_flags(read_table(spark, d, "documents"), short=F.col("n_chars") < 200, marks=F.contains("text", F.lit("%%%")), menu=F.contains("text", F.lit(" | ")))
    return q.where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT page_id, lower(list_extract(string_split(trim(url), '/'), -1)) AS base, CASE WHEN contains(url, '/en/') THEN 'match' ELSE 'other' END AS matched FROM pages")
def page_names(spark, d):
    """Base names and substring matches."""
    p = read_table(spark, d, "pages")
    return p.select("page_id", T.basename(F.col("url")).alias("base"), F.when(F.contains("url", F.lit("/en/")), "match").otherwise("other").alias("matched"))


# Text (G)


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS by_chars, CAST((strlen(text) + 3) // 4 AS BIGINT) AS by_bytes, CASE WHEN length(text) // 4 < 1000 THEN 'full' WHEN length(text) // 4 < 5000 THEN 'chunked' ELSE 'summarized' END AS band FROM documents")
def token_estimates(spark, d):
    """Token estimates and bands."""
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", T.estimate_tokens(t).alias("by_chars"), T.approx_tokens_bytes(t).alias("by_bytes"), T.chunk_band(T.estimate_tokens(t), 1000, 5000).alias("band"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 37) || '...' ELSE text END AS cut, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents")
def folded_text(spark, d):
    """Truncation and folding."""
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", T.truncate(t, 40).alias("cut"), T.alnum_fold(t).alias("folded"))


@query("SELECT conv_id, turn, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_.-]{2,}'), lambda x: lower(x)))) - len(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_.-]{2,}'), lambda x: lower(x))), lambda x: x IN ('added','changed','fixed','removed','updated','using','with','from','that','this','which','file','code','error','function','method'))) AS n_tokens FROM conversations")
def explanation_tokens(spark, d):
    """Distinct content words of every message, without the reference's 16 stop words; none for a null text."""
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.size(T.content_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query("WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role IN ('user', 'assistant')), m AS (SELECT *, strpos(lower(t), 'que') AS at FROM c WHERE strpos(lower(t), 'que') > 0) SELECT conv_id, turn, CASE WHEN m.at > 50 THEN '... ' ELSE '' END || trim(t[greatest(m.at - 49, 1):least(m.at + 98, length(t))]) || CASE WHEN m.at + 98 < length(t) THEN ' ...' ELSE '' END AS snippet FROM m")
def search_snippets(spark, d):
    """Text around the first match of a search word in every message, on collapsed white space."""
    c = read_table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select("conv_id", "turn", T.snippet(F.col("text"), F.lit("que")).alias("snippet")).where("snippet is not null")


_CLEAN = "regexp_replace(nfc_normalize(replace(regexp_replace(replace(replace(replace(replace(replace(replace({0}, '<|endoftext|>', ''), '<|startoftext|>', ''), '<|end|>', ''), '<|start|>', ''), '<|im_start|>', ''), '<|im_end|>', ''), '^\\x{{FEFF}}?(?:\\x{{EF}}\\x{{BB}}\\x{{BF}})?[\\x{{FEFF}}\\x{{FFFE}}\\x{{FFFF}}]*', ''), chr(0), '')), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"


@query(f"WITH d AS (SELECT doc_id, {_CLEAN.format('text')} AS t, {_CLEAN.format(chr(39) + chr(39) + ' || coalesce(text, ' + chr(39) + chr(39) + ')')} AS j FROM documents) SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '([^\\n])[ \\t]{{2,}}', '\\1 ', 'g'), '\\n+$', chr(10))) AS sha1, sha1(j) AS json_sha1 FROM d")
def normalized_documents(spark, d):
    """Every document's text normalised, and as a JSON-safe text that keeps its white space."""
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.sha1(T.normalize_text(t)).alias("sha1"), F.sha1(T.safe_json_string(t)).alias("json_sha1"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), e AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l) SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha1(encode('file-line-v1') || '\\x00'::BLOB || encode('line') || '\\x00'::BLOB || encode(line)) AS fingerprint FROM e WHERE strlen(line) > 3 AND regexp_matches(line, '[\\p{L}\\p{N}_]')")
def accepted_lines(spark, d):
    """Fingerprints of every effective line."""
    lines = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = lines.withColumn("line", T.effective_line(F.col("line"))).where("line is not null")
    return kept.select("doc_id", "pos", T.fingerprint("line", F.col("line")).alias("fingerprint"))


_SCORES = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)), m AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v), s AS (SELECT q.vec_id AS query_id, c.label, c.vec_id, CASE WHEN q.norm > 0 AND c.norm > 0 THEN round(list_dot_product(q.v, c.v) / (q.norm * c.norm), 9) ELSE 'NaN'::DOUBLE END AS score FROM m q JOIN m c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)), f AS (SELECT *, NOT isnan(score) AS fine FROM s)"


@query(_SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fine DESC, score DESC, vec_id) AS rank, count(*) OVER w AS total, count(*) FILTER (fine AND score >= 0.7) OVER w AS strong, count(*) FILTER (fine AND score >= 0.4 AND score < 0.7) OVER w AS medium FROM f WINDOW w AS (PARTITION BY query_id)) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score, total, strong, medium, total - strong - medium AS weak FROM r WHERE rank <= 5")
def vector_matches(spark, d):
    """The five best of all other rows for the stated query set, with the counts of strong, medium and weak matches."""
    v = read_table(spark, d, "embeddings")
    return vectors.neighbours(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query(_SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY fine DESC, score DESC, vec_id) AS rank FROM f) SELECT query_id, label AS level, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10")
def level_neighbours(spark, d):
    """The ten best of every level, not only the query's own, for the stated query set."""
    v = read_table(spark, d, "embeddings")
    return vectors.neighbours(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, "label").drop("total", "strong", "medium", "weak")


# Graph (H)


@query("WITH RECURSIVE t(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT p.p_partkey, t.depth + 1 FROM part p JOIN t ON p.p_partkey // 2 = t.node WHERE p.p_size <> 7) SELECT node, depth FROM t WHERE depth > 0")
def descendants(spark, d):
    """Breadth-first descendants; the filter cuts the edges themselves."""
    edges = read_table(spark, d, "part").where("p_size <> 7").select(F.floor(F.col("p_partkey") / 2).alias("parent"), F.col("p_partkey").alias("child"))
    roots = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return graph.descendants(edges, roots).select("node", "depth")


@query()
def order_components(spark, d):
    """H2: components of orders that share a part and supplier."""
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.concat_ws("/", F.col("l_partkey"), F.col("l_suppkey")).alias("k"))
    hub = l.groupBy("k").agg(F.min("a").alias("b"))
    return graph.components(l.join(hub, "k").where("a <> b").select("a", "b"))


from . import checks, diffs, files, history, markup, matching, paths, records, retrieval, scalars, selection, threads  # noqa: E402, F401  the other families register themselves
