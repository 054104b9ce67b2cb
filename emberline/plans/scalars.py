"""Queries over texts, replies and plain values, one or more functions each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import read_table
from .base import query
from .paths import _pick


@query("WITH p AS (SELECT doc_id, n_chars AS used, 20000 + (doc_id % 5) * 30000 AS context, 4000 + (doc_id % 3) * 30000 AS safe FROM documents), q AS (SELECT *, greatest(0, context - safe - least(10000, floor(context * 0.02::DOUBLE))) AS room FROM p) SELECT doc_id, CAST(least(safe, greatest(0, context - used - greatest(16000, floor(context * 0.1::DOUBLE)))) AS BIGINT) AS output_tokens, CAST(room AS BIGINT) AS input_tokens, used + safe <= context AS fits, used > room AS chunk, CAST(greatest(used // 2, 1000) AS BIGINT) AS fallback FROM q")
def token_budgets(spark, d):
    """What a model's context leaves for output and input, whether a text fits or must be cut, and the size to fall back to."""
    p = read_table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("used"), (20000 + (F.col("doc_id") % 5) * 30000).alias("context"), (4000 + (F.col("doc_id") % 3) * 30000).alias("safe"))
    context, used, safe = F.col("context"), F.col("used"), F.col("safe")
    room = T.input_limit(context, safe)
    return p.select("doc_id", T.output_limit(context, used, safe).alias("output_tokens"), room.alias("input_tokens"), (used + safe <= context).alias("fits"), (used > room).alias("chunk"), T.fallback_chunk(used).alias("fallback"))


@query("WITH t AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, text) AS texts, any_value(conv_id) AS c FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(list_sum(list_transform(texts, lambda x: length(x) // 4)) AS BIGINT) AS list_tokens, CAST(1 + list_sum(list_transform(texts, lambda x: length(x) // 4)) + length(CAST(conv_id AS VARCHAR)) // 4 AS BIGINT) AS record_tokens FROM t")
def item_tokens(spark, d):
    """Token estimates of a list of texts (each rounded down), and of a record {texts, id} with its keys."""
    t = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    listed = T.item_tokens(F.col("texts"))
    keys = T.estimate_tokens(F.lit("texts")) + T.estimate_tokens(F.lit("id"))
    return t.select("conv_id", listed.alias("list_tokens"), (keys + listed + T.estimate_tokens(F.col("conv_id").cast("string"))).cast("long").alias("record_tokens"))


_ID = "lower({0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32])"
_UUID = _ID.format("md5(CAST(page_id AS VARCHAR))")


@query(f"WITH p AS (SELECT page_id, {_UUID} AS id, url FROM pages), s AS (SELECT *, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(id, ''), lambda x: CAST(ord(x) AS HUGEINT))), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616) AS h FROM p) SELECT page_id, CAST(h % 100 AS INTEGER) AS bucket, array_to_string(regexp_extract_all(url || ' ' || id || '/' || upper(id), '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}'), ',') AS uuids, CASE WHEN page_id % 10 = 0 THEN 'unspecified' ELSE regexp_replace(regexp_replace(url, '[^A-Za-z0-9._/-]', '_', 'g'), '^_+|_+$', '', 'g')[1:256] END AS tag FROM s")
def id_samples(spark, d):
    """An id's sampling bucket, the UUIDs in a text, and a value made fit for a metric's tag."""
    p = read_table(spark, d, "pages")
    h = F.md5(F.col("page_id").cast("string"))
    id_ = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    text = F.concat(F.col("url"), F.lit(" "), id_, F.lit("/"), F.upper(id_))
    return p.select("page_id", T.fnv_percent(id_).alias("bucket"), F.array_join(F.regexp_extract_all(text, F.lit(T.UUID), F.lit(0)), ",").alias("uuids"), T.metric_tag(F.when(F.col("page_id") % 10 == 0, F.lit("__é!")).otherwise(F.col("url"))).alias("tag"))


_PREFIX = "(SELECT max(k) FROM range(0, {1} + 1) r(k) WHERE strlen({0}[1:k]) <= {1})"


@query(f"WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), p AS (SELECT *, (SELECT max(k) FROM range(0, 41) r(k) WHERE strlen(t[1:k]) <= 40) AS head, (SELECT max(k) FROM range(0, 41) r(k) WHERE strlen(reverse(t)[1:k]) <= 40) AS tail, (SELECT max(k) FROM range(0, 26) r(k) WHERE strlen(t[1:k]) <= 25) AS short FROM c) SELECT conv_id, turn, CASE WHEN strlen(t) <= 25 THEN t ELSE t[1:short] END AS head, CASE WHEN strlen(t) <= 80 THEN t ELSE t[1:head] || '…' || ((strlen(t) - 80 + 3) // 4) || ' tokens truncated…' || reverse(reverse(t)[1:tail]) END AS middle, CASE WHEN suffix(t, chr(10)) THEN t ELSE t || chr(10) END AS closed FROM p")
def text_cuts(spark, d):
    """A beginning of 25 bytes that cuts no letter, a text without its middle within 20 tokens, and one with a newline at its end."""
    t = F.coalesce("text", F.lit(""))
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.head_bytes(t, F.lit(25)).alias("head"), T.cut_middle(t, 20).alias("middle"), F.when(F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n"))).alias("closed"))


@query("WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, (length(t) - length(replace(lower(t), 'que', ''))) // 3 AS n, CASE WHEN strpos(lower(t), 'que') > 0 THEN strlen(t[1:strpos(lower(t), 'que') - 1]) END AS first, CASE WHEN strpos(lower(t), 'que') > 0 THEN CASE WHEN strpos(lower(t), 'que') > 50 THEN 53 ELSE strpos(lower(t), 'que') - 1 END END AS place FROM c WHERE strpos(lower(t), 'que') > 0")
def literal_matches(spark, d):
    """How often a word occurs, ignoring case, the first match's byte, and its place in UTF-16 units within its snippet."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    # the escaped needle without its quotes, as a literal pattern, leaves out rows before any Python runs
    needle = F.regexp_replace(F.regexp_replace(F.to_json(F.struct(F.lit("QUE").alias("x"))), '\\A\\{"x":"', ""), '"\\}\\z', "")
    hit = c.where(F.rlike("t", F.concat(F.lit("(?iu)\\Q"), needle, F.lit("\\E")))).withColumn("r", T.literal_ranges(F.col("t"), F.lit("que")))
    first = F.col("r")[0]["start"]
    before = F.decode(F.substr(F.encode("t", "UTF-8"), F.lit(1), first.cast("int")), "UTF-8")
    shown = F.when(F.length(before) > 49, F.substr(before, F.length(before) - 48, F.lit(49))).otherwise(before)
    place = F.when(F.length(before) > 49, 4).otherwise(0) + (F.octet_length(F.encode(shown, "UTF-16BE")) / 2)
    return hit.select("conv_id", "turn", F.size("r").cast("long").alias("n"), first.alias("first"), place.cast("long").alias("place"))


@query()
def fuzzy_names(spark, d):
    """Parts whose names hold a needle's letters in order, the 64 best, by score and name."""
    p = read_table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))
    kept = p.where(~F.rlike("path", F.lit("\\ASTANDARD/")))  # an exclude glob
    # rows without the letters in order never reach Python
    m = kept.where(F.rlike(F.lower("path"), F.lit("(?s)b.*r.*i.*g"))).withColumn("m", T.fuzzy_match(F.col("path"), F.lit("bRig"))).where("m.score IS NOT NULL")
    return m.orderBy("m.score", "path", "p_partkey").limit(64).select("p_partkey", "path", "m.score", F.array_join(F.transform("m.places", lambda x: x.cast("string")), ",").alias("places"))


_REPLIES = """c AS (
  SELECT click_id, props AS p, CAST(click_id % 6 AS INT) AS k, CASE click_id % 6 WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Sure: ' || props || ' done' WHEN 3 THEN '[' || props || ']'
    WHEN 4 THEN left(props, length(props) - 1) WHEN 5 THEN 'text [1, 2] and ' || props ELSE props END AS t
  FROM clicks WHERE {0})"""


@query(f"""
WITH {_REPLIES.format("props IS NOT NULL AND json_valid(props) AND starts_with(props, '{')")},
x AS (SELECT *, regexp_extract(p, '\\[.*\\]', 0, 's') AS inner_list, regexp_extract(t, '\\[.*\\]', 0, 's') AS widest FROM c)
SELECT click_id, CASE WHEN k <> 4 THEN p END AS object,
  CASE WHEN k IN (0, 1) THEN p WHEN k = 3 THEN t WHEN widest <> '' THEN CASE WHEN json_valid(widest) THEN widest END WHEN k = 2 THEN p END AS whole,
  CASE WHEN k IN (0, 1) THEN p WHEN k = 3 THEN t END AS fenced
FROM x
""")
def json_replies(spark, d):
    """The JSON object, any JSON, and the fenced JSON that a reply holds: the clicks' properties bare, fenced, in prose, in a list, cut off, or after another list."""
    c = read_table(spark, d, "clicks").where(T.is_json(F.col("props")) & F.startswith("props", F.lit("{")))
    t = F.col("t")
    rows = spark.sql("SELECT * FROM (" + _REPLIES.removeprefix("c AS (").removesuffix(")").format("true").replace("FROM clicks", "FROM {clicks}") + ")", clicks=c)
    return rows.select("click_id", T.lenient_object(t).alias("object"), T.lenient_json(t).alias("whole"), T.fenced_json(t).alias("fenced"))


@query("SELECT item_id, md5(list_aggregate(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE '\\u' || lower(lpad(hex(unicode(x)), 4, '0')) END), 'string_agg', '')) AS ascii FROM benchmark WHERE text <> ''")
def ascii_items(spark, d):
    """Texts with every letter beyond ASCII escaped."""
    return read_table(spark, d, "benchmark").where("text <> ''").select("item_id", F.md5(T.ascii_json(F.col("text"))).alias("ascii"))


_TIMES = "CASE event_id % 5 WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 3 THEN 'never' END"


@query(f"WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id, CASE WHEN event_id % 5 < 3 THEN s ELSE -1 END AS either, CASE WHEN event_id % 5 IN (1, 2) THEN s ELSE -1 END AS iso, CASE WHEN event_id % 2 = 0 THEN s * 1000 ELSE s * 1000 END AS millis, CASE WHEN user_id % 7 = 0 THEN '0.00%' ELSE printf('%.2f', round_even(event_id % 50 / (user_id % 7) * 100, 2)) || '%' END AS share, coalesce(trim(json_extract_string(props, '$.job')), 'unknown') AS job, coalesce(json_extract_string(props, '$.k'), 'not specified') AS line, CASE WHEN length(repeat(props, 30)) > 200 THEN repeat(props, 30)[1:197] || '...' ELSE repeat(props, 30) END AS error FROM e")
def plain_values(spark, d):
    """Times from seconds or ISO texts, from ISO texts alone, and in milliseconds; a share as text; a failure's fields with defaults."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    given = F.when(k == 0, s.cast("string")).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+00:00"))).when(k == 3, "never")
    e = read_table(spark, d, "events").withColumn("given", given)
    props = F.coalesce("props", F.lit("{}"))
    field = lambda name, default: F.coalesce(F.get_json_object(props, f"$.{name}"), F.lit(default))
    return e.select(
        "event_id", F.coalesce(T.timestamp_any(F.col("given")), F.lit(-1)).alias("either"), F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.when(F.rlike("given", F.lit("\\A\\d{4}-")), F.col("given")))), F.lit(-1)).alias("iso"),
        T.epoch_millis(F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000)).cast("long").alias("millis"), T.percent(F.col("event_id") % 50, F.col("user_id") % 7).alias("share"),
        field("job", "unknown").alias("job"), field("k", "not specified").alias("line"), T.truncate(F.repeat("props", F.lit(30)), 200).alias("error"),
    )


_MODELS = """SELECT item_id AS id, name, brand, CASE item_id % 5 WHEN 0 THEN 'openrouter/' || coalesce(brand, '') || '/' || coalesce(name, '') || ' v2' WHEN 1 THEN ' ' || coalesce(kind, '') || '//' || coalesce(name, '') || '!' WHEN 2 THEN upper(coalesce(brand, '')) WHEN 3 THEN '-' || coalesce(name, '') || '-' ELSE '---' END AS m FROM items"""


@query(f"""
WITH p AS ({_MODELS}), a AS (SELECT min(lower(brand)) AS known FROM items), l AS (SELECT *, string_split(regexp_replace(m, '^openrouter/', ''), '/')[-1] AS last FROM p),
f AS (SELECT *, regexp_replace(regexp_replace(last, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS folder FROM l)
SELECT id, CASE WHEN lower(trim(m)) = known THEN 'vendor/' || known ELSE trim(m) END AS resolved, CASE WHEN folder = '' THEN 'model' ELSE folder END AS folder, coalesce(name, '') || ' ' || coalesce(brand, '') AS query_text FROM f, a
""")
def model_names(spark, d):
    """A model's name by an alias table, a folder name for it, and a query's text from two fields. Models are items by kind, brand and name."""
    items = read_table(spark, d, "items")
    p = spark.sql(_MODELS.replace("FROM items", "FROM {items}"), items=items)
    known = F.broadcast(items.agg(F.min(F.lower("brand")).alias("known")))  # one row
    resolved = F.when(F.lower(F.trim("m")) == F.col("known"), F.concat(F.lit("vendor/"), "known")).otherwise(F.trim("m"))
    return p.join(known).select("id", resolved.alias("resolved"), T.folder_name(F.col("m")).alias("folder"), F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("brand", F.lit(""))).alias("query_text"))


_FLAGS = ("Yes", "success", "✓", "1", " passed ", "no", "✗", "FAILED", "", "successes", "0")
_MARKS = f"SELECT c_custkey AS id, {_pick(_FLAGS, 'c_custkey % 12')} AS a, {_pick(_FLAGS, 'c_nationkey % 12')} AS b FROM customer"
_BOOL = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN NULL ELSE lower(trim({0})) IN ('1', 'true', 'success', 'successes', 'passed', 'pass', 'yes', 'y', '✓') END"


@query(f"WITH p AS (SELECT id, {_BOOL.format('a')} AS a, {_BOOL.format('b')} AS b FROM ({_MARKS})) SELECT count(a) AS a_known, count(b) AS b_known, count(*) FILTER (a) AS a_true, count(*) FILTER (b) AS b_true, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_known, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(DISTINCT id) FILTER (a IS NOT NULL AND b IS NOT NULL) AS ids FROM p")
def outcome_words(spark, d):
    """Outcomes read from words; known and true ones of each method, and pairs where both are known, by row and by id."""
    m = spark.sql(_MARKS.replace("FROM customer", "FROM {customer}"), customer=read_table(spark, d, "customer"))
    p = m.select("id", T.parse_success(F.col("a")).alias("a"), T.parse_success(F.col("b")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return p.agg(F.count("a").alias("a_known"), F.count("b").alias("b_known"), F.count_if("a").alias("a_true"), F.count_if("b").alias("b_true"), F.count_if(both).alias("both_known"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_distinct(F.when(both, F.col("id"))).alias("ids"))


@query("WITH p AS (SELECT p_partkey AS id, p_name, CASE p_partkey % 4 WHEN 0 THEN 'multiple related issues: change code' WHEN 1 THEN 'either edit it OR not' WHEN 2 THEN '1. x 2. Modify File' ELSE 'plain' END AS statement, CASE p_size % 3 WHEN 0 THEN 'update toml' WHEN 1 THEN 'add plugin; edit' ELSE '' END AS fix FROM part), q AS (SELECT id, id % 4 < 3 AND regexp_matches(lower(statement || ' ' || fix), 'change code|modify file|edit|replace type|fix annotation') AND regexp_matches(lower(statement || ' ' || fix), 'change config|modify pyproject|add plugin|update toml') AS conflict FROM p) SELECT id, conflict, conflict AND id % 5 = 0 AS split FROM q")
def conflicting_solutions(spark, d):
    """Problems with several solutions of which one changes code and one configuration, and merged ones that must be split for it."""
    k = F.col("p_partkey")
    statement = F.when(k % 4 == 0, "multiple related issues: change code").when(k % 4 == 1, "either edit it OR not").when(k % 4 == 2, "1. x 2. Modify File").otherwise("plain")
    fix = F.when(F.col("p_size") % 3 == 0, "update toml").when(F.col("p_size") % 3 == 1, "add plugin; edit").otherwise("")
    p = read_table(spark, d, "part").select(k.alias("id"), F.concat(F.when(k % 5 == 0, "merged_").otherwise("p"), k.cast("string")).alias("problem_id"), statement.alias("statement"), fix.alias("fix"))
    conflict = T.has_conflict(F.col("statement"), F.col("fix"))
    return p.select("id", conflict.alias("conflict"), (F.startswith("problem_id", F.lit("merged_")) & conflict).alias("split"))
