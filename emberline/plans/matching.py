"""Queries that match predictions with truth and score them. Instances are orders, problems line items, episodes sources, messages texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match as M
from ..functions import stats
from ..functions import text as T
from ..operators import matching as O
from ..operators import relational as R
from ..sources.io import read_table
from .base import query
from .diffs import _PATH
from .paths import _pick

_TYPES = ("Type check", "type error", "linting", "doc format", "rst_format", "code formatting", "test failure", "unit test error", "test", " Testing ", "assertion", "ci_config", "dependency", "package x", "pip install", "docs", "docstring", "runtime", "import", "build", "Weird", "", "Type", "testing it")
_LISTS = ("a.py,b.py", "a.py, b.py ,c.py", "nan", "", "b.py", "c.py,,a.py,a.py", "d.py")


def _family(x: str) -> str:
    t = f"lower(trim({x}))"
    return (
        f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN contains({t}, 'type') AND regexp_matches({t}, 'check|error') THEN 'Type Checking' WHEN contains({t}, 'lint') THEN 'Linting' WHEN contains({t}, 'format') THEN CASE WHEN regexp_matches({t}, 'doc|rst') THEN 'Documentation Formatting' ELSE 'Code Formatting' END "
        f"WHEN (contains({t}, 'test') AND regexp_matches({t}, 'fail|error')) OR {t} IN ('test', 'testing') THEN 'Test Failure' WHEN contains({t}, 'assert') THEN 'Assertion Error' WHEN contains({t}, 'config') THEN 'Configuration Error' WHEN regexp_matches({t}, 'depend|package|install') THEN 'Dependency Issues' "
        f"WHEN contains({t}, 'doc') THEN 'Doc/Docstring' WHEN contains({t}, 'runtime') THEN 'Runtime Error' WHEN contains({t}, 'import') THEN 'Import Error' WHEN contains({t}, 'build') THEN 'Build Error' ELSE {x} END"
    )


_PAIRS = f"SELECT p_partkey AS id, {_pick(_TYPES, 'p_partkey % 25')} AS t1, {_pick(_TYPES, 'p_size % 25')} AS t2, {_pick(_LISTS, 'p_partkey % 8')} AS f1, {_pick(_LISTS, 'p_size % 8')} AS f2 FROM part"
_SET = "list_distinct(list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x NOT IN ('', 'nan')))"
_SHARED = f"len(list_intersect({_SET.format('f1')}, {_SET.format('f2')}))"
_LAP = f"CASE WHEN f1 IS NULL OR f2 IS NULL OR len({_SET.format('f1')}) = 0 OR len({_SET.format('f2')}) = 0 THEN 0.0 ELSE {_SHARED} / least(len({_SET.format('f1')}), len({_SET.format('f2')})) END"
_GROUPS = "(a IN ('Configuration Error', 'Dependency Issues') AND b IN ('Configuration Error', 'Dependency Issues')) OR (a IN ('Code Formatting', 'Documentation Formatting') AND b IN ('Code Formatting', 'Documentation Formatting')) OR (a IN ('Test Failure', 'Assertion Error') AND b IN ('Test Failure', 'Assertion Error'))"


@query(f"WITH p AS ({_PAIRS}), c AS (SELECT *, {_family('t1')} AS a, {_family('t2')} AS b FROM p), m AS (SELECT id, a AS family, coalesce(t1 <> '' AND t2 <> '' AND (a = b OR {_GROUPS}), false) AS agree, {_LAP} AS overlap FROM c) SELECT id, family, agree, CASE WHEN agree THEN round(overlap, 9) ELSE 0.0 END AS overlap, CASE WHEN NOT agree THEN 'type_mismatch' WHEN overlap >= 0.65 THEN 'match' ELSE 'low_overlap' END AS reason FROM m")
def pair_verdicts(spark, d):
    """Families of types, whether two may stand for one another, overlap of file lists, and whether a pair matches (0.65 at least)."""
    p = spark.sql(_PAIRS.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))
    agree, overlap = M.types_agree(F.col("t1"), F.col("t2")), M.list_overlap(F.col("f1"), F.col("f2"))
    reason = F.when(~agree, "type_mismatch").when(overlap >= 0.65, "match").otherwise("low_overlap")
    return p.select("id", M.canonical_type(F.col("t1")).alias("family"), agree.alias("agree"), F.when(agree, F.round(overlap, 9)).otherwise(0.0).alias("overlap"), reason.alias("reason"))


_AT = "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey"
_GUESS = f"CASE l_suppkey % 4 WHEN 0 THEN regexp_replace({_PATH}, '^.*/', '') WHEN 1 THEN './src/' || {_PATH} ELSE {_PATH} END"


def associations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """True and predicted (key, file, at) rows."""
    lines = read_table(spark, d, "lineitem")
    return tuple(spark.sql(f"SELECT l_orderkey AS key, {path} AS file, {_AT} AS spot FROM {{lineitem}} WHERE l_linenumber % 2 = {odd}", lineitem=lines) for path, odd in ((_PATH, 0), (_GUESS, 1)))  # type: ignore[return-value]


def scored_instances(spark: SparkSession, d: str) -> DataFrame:
    m = O.greedy_pairs(*associations(spark, d), "key", "file", "spot")
    return m.select("instance", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))


@query()
def greedy_associations(spark, d):
    """Predictions of an instance take true rows of the same file one by one; its counts, precision, recall, F1 and whether it is perfect."""
    c = {x: F.col(x) for x in ("tp", "fp", "fn")}
    return scored_instances(spark, d).select("*", *stats.precision_recall(*c.values()), ((c["fp"] == 0) & (c["fn"] == 0) & (c["tp"] > 0)).alias("perfect"))


@query()
def attribution_totals(spark, d):
    """Micro averages over the instances that have true rows."""
    s = scored_instances(spark, d).where("tp + fn > 0")
    perfect = F.count_if((F.col("fp") == 0) & (F.col("fn") == 0) & (F.col("tp") > 0))
    t = s.agg(F.count(F.lit(1)).alias("instances"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), perfect.alias("perfect"))
    return t.select("*", *stats.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0)))


_LOOSE_SQL = "regexp_replace(lower(ltrim(replace(trim({0}), '\\', '/'), './')), '^(libs/agno/|libs/|src/)', '')"
_BASE = "string_split({0}, '/')[-1]"
_TWO = "array_to_string(string_split({0}, '/')[-2:], '/')"


@query(f"WITH g AS (SELECT l_orderkey AS key, {_PATH} AS file, {_AT} AS spot FROM lineitem WHERE l_linenumber % 2 = 0), p AS (SELECT l_orderkey AS key, {_GUESS} AS file, {_AT} AS spot FROM lineitem WHERE l_linenumber % 2 = 1), n AS (SELECT 'g' AS side, key, spot, {_LOOSE_SQL.format('file')} AS file FROM g UNION ALL SELECT 'p', key, spot, {_LOOSE_SQL.format('file')} FROM p), j AS (SELECT p.key, p.spot, arg_min(g.file, struct_pack(a := g.spot, f := g.file)) AS file FROM n p JOIN n g ON p.side = 'p' AND g.side = 'g' AND p.key = g.key AND (CASE WHEN contains(p.file, '/') AND contains(g.file, '/') THEN {_TWO.format('p.file')} = {_TWO.format('g.file')} ELSE {_BASE.format('p.file')} = {_BASE.format('g.file')} END) GROUP BY 1, 2) SELECT * FROM j")
def first_file_matches(spark, d):
    """Each problem's files, normalised, with the first file of the instance that is the same."""
    gold, predicted = (df.select("key", "spot", F.col("file").alias("raw"), T.bare_path(F.col("file")).alias("file")) for df in associations(spark, d))
    # only files of one base name can be the same
    base = F.element_at(F.split("file", "/"), -1).alias("base")
    j = predicted.select("key", "spot", F.col("raw").alias("mine"), base).join(gold.select("key", F.col("spot").alias("place"), F.col("raw").alias("theirs"), "file", base), ["key", "base"])
    same = j.where(T.files_match_loose(F.col("mine"), F.col("theirs")))
    return same.groupBy("key", "spot").agg(F.min_by("file", F.struct("place", "file")).alias("file"))


_KEYS = {"pred": "CASE l_orderkey % 4 WHEN 0 THEN 'i' || l_orderkey WHEN 1 THEN 's' || l_orderkey ELSE 'x' || l_orderkey END", "sha": "CASE WHEN l_orderkey % 5 <> 0 THEN 's' || l_orderkey END"}
_RANKED = f"SELECT l_orderkey AS key, {_PATH} AS file, l_linenumber % 2 AS side, min({_AT}) AS spot FROM lineitem GROUP BY 1, 2, 3"


@query(f"WITH r AS ({_RANKED}), p AS (SELECT key, list(file ORDER BY spot) AS files FROM r WHERE side = 1 GROUP BY 1), g AS (SELECT key, list(file) AS gold FROM r WHERE side = 0 AND NOT (key % 4 > 1 AND key % 5 = 0 AND key % 3 <> 0) GROUP BY 1), j AS (SELECT p.*, g.gold FROM p LEFT JOIN g USING (key)), c AS (SELECT count(*) AS generated, count(gold) AS evaluated, count(*) FILTER (list_sort(files) = list_sort(gold)) AS exact, count(*) FILTER (list_contains(gold, files[1])) AS top1, count(*) FILTER (list_has_any(gold, files[1:3])) AS top3, CAST(coalesce(sum(len(list_intersect(files, gold))), 0) AS BIGINT) AS hits, CAST(sum(len(files)) AS BIGINT) AS predicted FROM j) SELECT *, round(100 * exact / evaluated, 2) AS exact_pct, round(100 * top1 / evaluated, 2) AS top1_pct, round(100 * top3 / evaluated, 2) AS top3_pct, round(100 * hits / predicted, 2) AS precision_pct FROM c")
def retrieval_hits(spark, d):
    """Predicted files against the true ones, looked up by the prediction's key, else its sha, else its id; exact, first, first three and precision."""
    ranked = spark.sql(_RANKED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    listed = lambda side: ranked.where(F.col("side") == side).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("spot", "file"))), lambda x: x["file"]).alias("files"))
    keys = lambda expr: F.expr(expr.replace("l_orderkey", "key"))
    text = F.col("key").cast("string")
    gold = listed(0).select("files", F.concat(F.lit("i"), text).alias("i"), F.concat(F.lit("s"), text).alias("s"), F.when(F.col("key") % 3 == 0, F.concat(F.lit("d"), text)).alias("d"))
    bridge = R.key_bridge(gold.withColumn("row", F.to_json("files")), "row", "i", "s", "d")
    known = bridge.select("key", F.from_json("row", "array<string>").alias("gold"))
    preds = listed(1).select(text.alias("id"), "files", keys(_KEYS["pred"]).alias("k1"), keys(_KEYS["sha"]).alias("k2"), F.concat(F.lit("d"), text).alias("k3"))
    looked = preds
    for k in ("k1", "k2", "k3"):
        looked = looked.join(known.select(F.col("key").alias(k), F.col("gold").alias(f"g_{k}")), k, "left")
    found = looked.select("id", F.coalesce("g_k1", "g_k2", "g_k3").alias("gold"))
    return O.retrieval_accuracy(preds.select("id", "files"), found)


_EPISODES = "SELECT source, count(*) FILTER (n_chars > 500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 500 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 500 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 500 AND quality = 0) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY 1"
_COPIES = " + ".join(f"CASE WHEN x >= {c} THEN 1 ELSE 0 END" for c in O.COPIES)


@query(f"""
WITH e AS (SELECT *, CAST('0x' || md5(coalesce(source, ''))[1:8] AS BIGINT) AS place FROM ({_EPISODES})),
x0 AS (SELECT i.range AS rep, tp, fp, fn, tn, (i.range * 1000003 + place * 7919 + 20261111) % 2147483647 AS x FROM range(10000) i, e),
x1 AS (SELECT * REPLACE (x * (x % 65521 + 48271) % 2147483647 AS x) FROM x0),
x2 AS (SELECT * REPLACE (x * (x % 65521 + 69621) % 2147483647 AS x) FROM x1),
x3 AS (SELECT * REPLACE (x * (x % 65521 + 16807) % 2147483647 AS x) FROM x2),
w AS (SELECT *, {_COPIES} AS times FROM x3),
s AS (SELECT rep, sum(tp * times) AS tp, sum(fp * times) AS fp, sum(fn * times) AS fn, sum(tn * times) AS tn FROM w GROUP BY 1),
m AS (
  SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
    CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS a FROM s),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
SELECT 'precision' AS measure, list_sort(list(p))[250] AS low, list_sort(list(p))[9750] AS high FROM f
UNION ALL SELECT 'recall', list_sort(list(r))[250], list_sort(list(r))[9750] FROM f
UNION ALL SELECT 'f1', list_sort(list(f))[250], list_sort(list(f))[9750] FROM f
UNION ALL SELECT 'accuracy', list_sort(list(a))[250], list_sort(list(a))[9750] FROM f
""")
def bootstrap_intervals(spark, d):
    """95 % intervals of a rule's precision, recall, F1 and accuracy over 10,000 seeded resamples of the sources."""
    j = read_table(spark, d, "documents").select("doc_id", "source", "n_chars").join(read_table(spark, d, "labels"), "doc_id")
    said, true = F.col("n_chars") > 500, F.col("quality") == 1
    cells = {"tp": said & true, "fp": said & (F.col("quality") == 0), "fn": (F.col("n_chars") <= 500) & true, "tn": (F.col("n_chars") <= 500) & (F.col("quality") == 0)}
    return O.cluster_bootstrap(j.groupBy("source").agg(*(F.count_if(c).alias(n) for n, c in cells.items())), "source")


@query("WITH l AS (SELECT source, CASE quality WHEN 1 THEN 'correct' WHEN 0 THEN 'incorrect' ELSE 'partial' END AS label FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT source, label, count(*) AS n FROM l GROUP BY ALL) SELECT source, string_agg(label || ':' || n, ',' ORDER BY label) AS counts, round(coalesce(sum(n) FILTER (label = 'correct'), 0) / sum(n), 9) AS strict, round(coalesce(sum(n) FILTER (label IN ('correct', 'partial')), 0) / sum(n), 9) AS lenient FROM c GROUP BY source")
def quality_counts(spark, d):
    """Counts by label, sorted, with the rates of correct, and of correct or partial ones."""
    label = F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "incorrect").otherwise("partial")
    c = read_table(spark, d, "documents").select("doc_id", "source").join(read_table(spark, d, "labels"), "doc_id", "left").groupBy("source", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    some = lambda *names: F.round(F.coalesce(F.sum(F.when(F.col("label").isin(*names), F.col("n"))), F.lit(0)) / F.sum("n"), 9)
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "n"))), lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string"))), ",")
    return c.groupBy("source").agg(texts.alias("counts"), some("correct").alias("strict"), some("correct", "partial").alias("lenient"))


_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_.-]*[\\p{L}\\p{N}_])?')"
_GRAMS = f"w AS (SELECT conv_id, turn, role, {_TERMS} AS t FROM conversations), g AS (SELECT conv_id, turn, role, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w), n AS (SELECT conv_id, turn, role, term, count(*) AS c FROM g GROUP BY ALL)"
_FILE_OF = "CASE {0} % 3 WHEN 0 THEN 'src/a.py' WHEN 1 THEN './lib/a.py' ELSE 'a.py' END"


@query(f"WITH {_GRAMS}, q AS (SELECT u.conv_id, u.turn, a.turn AS other FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'), b AS (SELECT q.conv_id, q.turn, q.other, x.term, x.c AS cx, y.c AS cy FROM q JOIN n x ON x.conv_id = q.conv_id AND x.turn = q.turn LEFT JOIN n y ON y.conv_id = q.conv_id AND y.turn = q.other AND y.term = x.term UNION ALL SELECT q.conv_id, q.turn, q.other, y.term, NULL, y.c FROM q JOIN n y ON y.conv_id = q.conv_id AND y.turn = q.other WHERE NOT EXISTS (SELECT 1 FROM n x WHERE x.conv_id = q.conv_id AND x.turn = q.turn AND x.term = y.term)), v AS (SELECT conv_id, turn, other, sum(cx * cy) AS dot, sqrt(sum(pow(cx * CASE WHEN cy IS NULL THEN ln(1.5) + 1 ELSE 1 END, 2))) AS nx, sqrt(sum(pow(cy * CASE WHEN cx IS NULL THEN ln(1.5) + 1 ELSE 1 END, 2))) AS ny FROM b GROUP BY ALL), s AS (SELECT conv_id, turn, other, CASE WHEN nx > 0 AND ny > 0 THEN coalesce(dot, 0) / (nx * ny) ELSE 0 END AS cosine, regexp_replace({_FILE_OF.format('turn')}, '^\\./', '') = regexp_replace({_FILE_OF.format('other')}, '^\\./', '') AS same FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(cosine + CASE WHEN same THEN 0.45 ELSE 0 END, 9) DESC, other) AS k FROM s) SELECT conv_id, turn, other, round(cosine, 9) AS cosine, same, same OR cosine >= 0.08 AS mapped, CASE WHEN NOT (same OR cosine >= 0.08) THEN 'incorrect' WHEN cosine >= 0.15 THEN 'correct' ELSE 'partial' END AS validity FROM r WHERE k = 1")
def aligned_problems(spark, d):
    """Each user message's best answer of its thread by TF-IDF cosine, with 0.45 for the same file; whether it counts, and how well."""
    c = read_table(spark, d, "conversations").withColumn("file", F.expr(_FILE_OF.format("turn")))
    u = c.where("role = 'user'").select("conv_id", "turn", "text", F.col("file").alias("mine"))
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("other"), "text", F.col("file").alias("theirs"))
    cosines = O.pair_cosines(u, a, "conv_id", "turn", "other", "text")
    pairs = u.drop("text").join(a.drop("text"), "conv_id").withColumn("same", T.files_match_strict(F.col("mine"), F.col("theirs"))).drop("mine", "theirs")
    pairs = pairs.join(cosines, ["conv_id", "turn", "other"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    best = O.best_candidate(pairs, ["conv_id", "turn"], F.round(F.col("cosine") + F.when(F.col("same"), 0.45).otherwise(0.0), 9), "other", 0.0)
    mapped = F.col("same") | (F.col("cosine") >= 0.08)
    return best.select("conv_id", "turn", "other", F.round("cosine", 9).alias("cosine"), "same", mapped.alias("mapped"), F.when(~mapped, "incorrect").when(F.col("cosine") >= 0.15, "correct").otherwise("partial").alias("validity"))


@query("WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_.-]{2,}'), lambda x: lower(x)), lambda x: x NOT IN ('added','changed','fixed','removed','updated','using','with','from','that','this','which','file','code','error','function','method'))) AS w FROM conversations) SELECT u.conv_id, u.turn, CASE WHEN len(u.w) > 0 THEN round(len(list_intersect(u.w, a.w)) / len(u.w), 9) ELSE 0.0 END AS score, array_to_string(list_sort(list_intersect(u.w, a.w)), ' ') AS terms FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'")
def explanation_support(spark, d):
    """The share of a message's content words that the next message has, and these words."""
    c = read_table(spark, d, "conversations")
    u, a = c.where("role = 'user'").select("conv_id", "turn", "text"), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    s = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", M.support(F.col("text"), F.col("reply")).alias("s"))
    return s.select("conv_id", "turn", F.round("s.score", 9).alias("score"), F.array_join("s.terms", " ").alias("terms"))


_STEPS = ("Run unit tests", "Lint", "", "run-unit", "Type check mypy", "Build docs")
_JOBS = ("test (3.10)", "lint", "", "Test")
_RECORDS = f"SELECT p_partkey AS id, p_size % 25 AS g, {_pick(_STEPS, 'p_partkey % 7')} AS step, {_pick(_JOBS, 'p_size % 4')} AS job, {_pick(_STEPS, 'p_size % 6')} || ' on main branch' AS record, CASE WHEN p_partkey % 9 = 0 THEN 'make all' END AS own FROM part"
_CANDIDATES = f"SELECT s_suppkey AS place, s_suppkey % 25 AS g, {_pick(_STEPS, 's_suppkey % 6')} AS cstep, {_pick(_JOBS, '(s_suppkey // 5) % 4')} AS cjob, 'main branch of ' || {_pick(_STEPS, '(s_suppkey // 3) % 6')} AS ctext, ' pytest -k ' || s_suppkey || ' ' || chr(10) || chr(10) || 'echo done ' AS command FROM supplier"
_FOLD = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_LONG = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 2))"


@query(f"WITH r AS (SELECT *, {_FOLD.format('step')} AS s, {_FOLD.format('job')} AS j, {_FOLD.format('record')} AS t FROM ({_RECORDS})), c AS (SELECT *, {_FOLD.format('cstep')} AS cs, {_FOLD.format('cjob')} AS cj, {_FOLD.format('ctext')} AS ct FROM ({_CANDIDATES})), m AS (SELECT r.id, c.place, CASE WHEN s <> '' AND cs <> '' AND s = cs THEN 100 WHEN s <> '' AND cs <> '' AND (contains(s, cs) OR contains(cs, s)) THEN 70 ELSE 0 END + CASE WHEN j <> '' AND cj <> '' AND (contains(j, cj) OR contains(cj, j)) THEN 20 ELSE 0 END + least(40, 4 * len(list_intersect({_LONG.format('t')}, {_LONG.format('ct')}))) AS score FROM r JOIN c USING (g)), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS k FROM m) SELECT r.id, CASE WHEN own IS NOT NULL THEN own WHEN score >= 12 THEN 'pytest -k ' || place || ' && echo done' ELSE '' END AS command, CASE WHEN own IS NULL AND score >= 12 THEN CAST(least(score, 100) AS INTEGER) WHEN own IS NULL THEN 0 END AS confidence FROM r LEFT JOIN b ON b.id = r.id AND k = 1")
def resolved_commands(spark, d):
    """A failure's own command, else that of the best candidate of its group (a score of 12 at least), as one line, with the confidence."""
    records = spark.sql(_RECORDS.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part")).na.fill("", ["step", "job", "record"])
    candidates = spark.sql(_CANDIDATES.replace("//", "div").replace("FROM supplier", "FROM {supplier}"), supplier=read_table(spark, d, "supplier")).na.fill("", ["cstep", "cjob", "ctext"])
    # a score depends on texts alone: each different record of a group meets each different candidate of it once, and of candidates alike the first wins
    asked = ["g", "step", "job", "record"]
    first = candidates.groupBy("g", "cstep", "cjob", "ctext").agg(F.min_by("command", "place").alias("command"), F.min("place").alias("place"))
    score = M.step_score(F.col("step"), F.col("job"), F.col("record"), F.col("cstep"), F.col("cjob"), F.col("ctext"))
    best = O.best_candidate(records.select(*asked).distinct().join(first, "g"), asked, score, "place", 12).select(*asked, "place", "command", F.col("score").alias("points"))
    best = O.best_candidate(records.select("id", *asked).join(best, asked), ["id"], F.col("points"), "place", 12).select("id", T.compact_shell(F.col("command")).alias("found"), F.least("points", F.lit(100)).cast("int").alias("sure"))
    j = records.select("id", "own").join(best, "id", "left")
    return j.select("id", F.coalesce("own", "found", F.lit("")).alias("command"), F.when(F.col("own").isNull(), F.coalesce("sure", F.lit(0))).alias("confidence"))


_PROBLEMS = ("mypy type error in `run`", "unused import", "pytest fixture missing", "plain `gone` text", "no module named x", "unexpected indentation", "nothing", "ruff says")
_CHANGES = ("-> str", "import os", "assert x", "value = gone", "(a)", "", "from a")
_PLACES = f"SELECT p_partkey AS id, {_pick(_PROBLEMS, 'p_partkey % 8')} AS problem, {_pick(_CHANGES, 'p_size % 7')} AS changes, p_partkey % 3 > 0 AS affected, p_size % 2 = 0 AS evidence FROM part"
_P = "lower(problem)"
_FITS = (
    f"CASE WHEN regexp_matches({_P}, 'type|mypy|optional|union|str|int|none') AND regexp_matches(changes, 'Optional|Union|cast\\(|-> |: str|: int|isinstance') THEN 'type_checking' WHEN regexp_matches({_P}, 'lint|ruff|flake8|f-string|unused|import') AND regexp_matches(changes, '# noqa|import |from ') THEN 'linting' "
    f"WHEN regexp_matches({_P}, 'test|pytest|assert|mock|fixture') AND regexp_matches(changes, 'assert|mock|expected|actual') THEN 'testing' WHEN regexp_matches({_P}, 'import|module') AND regexp_matches(changes, 'import |from |__init__') THEN 'import' "
    f"WHEN regexp_matches({_P}, 'syntax|parsing|indentation|unexpected') AND regexp_matches(changes, '    |:|\\(|\\)|\\[|\\]') THEN 'syntax' WHEN (contains(problem, '`run`') AND contains(changes, 'run')) OR (contains(problem, '`gone`') AND contains(changes, 'gone')) THEN 'specific' END"
)


@query(f"WITH p AS ({_PLACES}), f AS (SELECT *, {_FITS} AS pattern FROM p) SELECT id, pattern, CASE WHEN NOT affected THEN 'unrelated' WHEN evidence AND pattern IS NOT NULL THEN 'direct' WHEN evidence THEN 'uncertain' WHEN pattern IS NULL THEN 'unrelated' WHEN regexp_matches({_P}, 'type|import') THEN 'shared' ELSE 'uncertain' END AS label, CASE WHEN NOT affected OR (evidence AND pattern IS NOT NULL) THEN 'high' WHEN NOT evidence AND pattern IS NOT NULL AND NOT regexp_matches({_P}, 'type|import') THEN 'low' ELSE 'medium' END AS confidence FROM f")
def hunk_labels(spark, d):
    """The fix pattern that a change shows, and how it belongs to a problem."""
    p = spark.sql(_PLACES.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part")).withColumn("pattern", M.fix_pattern(F.col("problem"), F.lit(""), F.col("changes")))
    a = M.association(F.col("affected"), F.col("evidence"), F.col("pattern"), F.col("problem"))
    return p.select("id", "pattern", a.alias("a")).select("id", "pattern", "a.label", "a.confidence")
