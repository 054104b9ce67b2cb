"""Queries that retrieve from memories. Levels are documents, messages and benchmark items; repositories and problems are made from parts and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import similarity as Y
from ..operators import staged as S
from ..operators.textindex import TextIndex
from ..shared import Rounds
from ..sources.io import read_table
from .base import query
from .diffs import _PATH
from .paths import _pick
from .selection import _SPOT

_QUESTION = "anand the then thonand therand lequ en letre theing and that"
_STOP = ("the", "and", "that", "of", "to", "in", "is")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(level, id, text): problems of level 1, steps of a trajectory of level 2, patterns of level 3 whose fixes are plain or records."""
    one = read_table(spark, d, "documents").select(F.lit("L1").alias("level"), F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("text"))
    steps = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("steps"))
    two = steps.select("conv_id", F.explode("steps").alias("s")).select(F.lit("L2"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("s.turn").cast("string")), F.concat_ws(" ", F.coalesce("s.text", F.lit("")), F.coalesce("s.role", F.lit(""))))
    # a pattern's fixes are texts in some rows and records in others
    fix = F.when(F.col("item_id") % 2 == 0, F.to_json(F.array("text"))).otherwise(F.to_json(F.array(F.struct(F.col("text").alias("approach")))))
    plain = F.from_json(fix, "array<string>")
    records = F.transform(F.from_json(fix, "array<struct<approach:string>>"), lambda x: x["approach"])
    three = read_table(spark, d, "benchmark").select(F.lit("L3"), F.col("item_id").cast("string"), F.concat(F.lit("pattern "), F.array_join(F.when(F.col("item_id") % 2 == 0, plain).otherwise(records), " ")))
    return one.union(two).union(three)


_CORPUS = "c AS (SELECT 'L1' AS level, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(source, '') AS text FROM documents UNION ALL SELECT 'L2', conv_id || '/' || turn, coalesce(text, '') || ' ' || coalesce(role, '') FROM conversations UNION ALL SELECT 'L3', CAST(item_id AS VARCHAR), 'pattern ' || text FROM benchmark)"
_STOPPED = ", ".join(f"'{w}'" for w in _STOP)


@query(f"WITH {_CORPUS}, a AS (SELECT level, id, text FROM c UNION ALL SELECT 'Q', '', '{_QUESTION}'), t AS (SELECT level, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM a), n AS (SELECT level, id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOPPED}) GROUP BY ALL), v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM n GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), w AS (SELECT n.level, n.id, n.term, n.tf * (ln((1.0 + (SELECT count(*) FROM a)) / (1 + v.df)) + 1) AS w FROM n JOIN v USING (term)), q AS (SELECT term, w FROM w WHERE level = 'Q'), s AS (SELECT w.level, w.id, coalesce(sum(w.w * q.w), 0) / (sqrt(sum(w.w * w.w)) * (SELECT sqrt(sum(w * w)) FROM q)) AS score FROM w LEFT JOIN q USING (term) WHERE w.level <> 'Q' GROUP BY 1, 2), e AS (SELECT c.level, c.id, round(coalesce(s.score, 0), 9) AS score FROM c LEFT JOIN s ON s.level = c.level AND s.id = c.id), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rank FROM e) SELECT level, CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= 10")
def memory_search(spark, d):
    """The ten texts of each level most like a question by TF-IDF over 1000 terms, whatever their repository; stop words are a parameter."""
    return V.tfidf_search(corpus(spark, d), _QUESTION, 10, 1000, _STOP)


@query(f"""
WITH {_CORPUS},
t AS (SELECT level, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM c),
n AS (SELECT level, id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOPPED}) GROUP BY ALL),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM n GROUP BY 1 ORDER BY total DESC, term LIMIT 1000),
w AS (SELECT level, id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY level, id)) AS w FROM n JOIN v USING (term)),
asked AS (SELECT term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower('{_QUESTION}'), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term) WHERE term NOT IN ({_STOPPED}) GROUP BY 1),
q AS (SELECT term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER ()) AS w FROM asked JOIN v USING (term)),
s AS (SELECT level, id, sum(w.w * q.w) AS score FROM w JOIN q USING (term) GROUP BY ALL),
e AS (SELECT c.level, c.id, round(coalesce(s.score, 0), 9) AS score FROM c LEFT JOIN s ON s.level = c.level AND s.id = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS rank FROM e)
SELECT level, CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= 10
""")
def indexed_search(spark, d):
    """The same by an inverted index over the corpus alone, of which a search reads the postings that can reach the tenth score."""
    files = Rounds(spark)
    index = TextIndex.build(files.keep(corpus(spark, d)), f"{files.base}/index", 1000, _STOP)
    return files.result(index.search(_QUESTION, 10))


_REPOS = ("quartz-lab/quartz", "quartz", "other/quartz", "meadow", "fern/meadow", "", "Owner/Repo", "repo")
_FLOWS = ("ci.yml", "test.yml", "")
_MEM = f"SELECT p_partkey AS id, {_pick(_REPOS, 'p_partkey % 8')} AS a, {_pick(_REPOS, 'p_size % 8')} AS b, {_pick(_FLOWS, 'p_partkey % 4')} AS flow, p_brand AS owner FROM part"
_SAME = "(a <> '' AND b <> '' AND (a = b OR ((NOT contains(a, '/') OR NOT contains(b, '/')) AND string_split(a, '/')[-1] = string_split(b, '/')[-1])))"


@query(f"WITH m AS ({_MEM}) SELECT id, {_SAME} AS same, contains(lower(a), 'fern/meadow') OR contains(lower(b), 'fern/meadow') OR contains(lower(owner) || '/' || lower(a), 'fern/meadow') OR contains(lower(a), 'quartz') OR contains('quartz', lower(a)) AS wanted FROM m")
def repo_matches(spark, d):
    """Whether two names mean one repository, and whether a record is of a wanted one."""
    m = spark.sql(_MEM.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))
    return m.select("id", V.same_repo(F.col("a"), F.col("b")).alias("same"), V.names_repo(F.col("a"), F.col("owner"), F.col("b"), ("fern/meadow", " Quartz ", "")).alias("wanted"))


@query(f"WITH m AS ({_MEM}), q AS (SELECT id AS query, b, 'ci.yml' AS flow FROM m WHERE id % 25 = 0), j AS (SELECT q.query, m.id AS memory, m.a, q.b, m.flow AS mf, q.flow AS qf FROM q, m) SELECT query, memory FROM j WHERE {_SAME} AND (mf IS NULL OR mf = '' OR mf = qf)")
def applicable_memories(spark, d):
    """Memories of a query's repository and workflow; those without a workflow fit any."""
    m = spark.sql(_MEM.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))
    q = m.where("id % 25 = 0").select(F.col("id").alias("query"), F.col("b").alias("repo"), F.lit("ci.yml").alias("workflow"))
    return V.applicable(q, m.select(F.col("id").alias("memory"), F.col("a").alias("repo"), F.col("flow").alias("workflow")))


_CASES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'ci_failure' ELSE 'common' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'libs/orbit/utils/a.py' WHEN 1 THEN 'utils/a.py' WHEN 2 THEN 'a.pyc' ELSE 'other/b.py' END AS file, CASE p_size % 3 WHEN 0 THEN 'Type Checking' WHEN 1 THEN 'linting' ELSE 'x' END AS failure, CASE p_size % 2 WHEN 0 THEN 'mypy' ELSE 'ruff' END AS tool, CASE p_size % 5 WHEN 0 THEN 'Expected dict' WHEN 1 THEN 'has type bytes' ELSE 'no such attribute' END AS signal FROM part"


@query(f"SELECT id, CASE WHEN kind = 'ci_failure' THEN 'observed' WHEN file IN ('libs/orbit/utils/a.py', 'utils/a.py') AND (failure = 'Type Checking' OR tool = 'mypy') AND signal <> 'no such attribute' THEN 'confirmed_in_target_failure' END AS status, NOT (kind = 'ci_failure' OR (file IN ('libs/orbit/utils/a.py', 'utils/a.py') AND (failure = 'Type Checking' OR tool = 'mypy') AND signal <> 'no such attribute')) AS rejected FROM ({_CASES})")
def evidence_gate(spark, d):
    """Problems that the failure at hand confirms by file, tool or type and signal, or shows itself, and those that it rejects."""
    p = spark.sql(_CASES.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))
    words = lambda *x: F.array(*(F.lit(w) for w in x))
    status = V.evidence_status(F.col("kind"), F.array("file"), F.col("failure"), F.col("tool"), F.array("signal"), words("orbit/utils/a.py"), words("type checking"), words("mypy"), F.lit("return value has type bytes, expected dict"))
    return p.select("id", status.alias("status")).select("id", "status", F.col("status").isNull().alias("rejected"))


_LINKED = "SELECT DISTINCT l_orderkey AS grp, CAST(l_linenumber AS BIGINT) AS problem FROM lineitem"


@query()
def expanded_problems(spark, d):
    """H1: an issue's first two hits with the problems that they enable or are enabled by, depth first, a tenth of the score lost at each step."""
    m = spark.sql(_LINKED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    k, g = F.col("problem"), F.col("grp")
    memory = m.select("grp", "problem", F.when((g + k) % 3 > 0, F.array((k * 2) % 8, k + 2)).otherwise(F.array().cast("array<bigint>")).alias("enables"), F.when(g % 2 == 0, F.array(k - 1)).otherwise(F.array().cast("array<bigint>")).alias("enabled_by"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("problem"))
    hits = m.withColumn("place", place).where("place <= 2").select("grp", "problem", (1 / F.col("place")).alias("score"), "place")
    return V.expand_depth_first(memory, hits, "grp").withColumn("score", F.round("score", 9))


_COSINES = """n AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM {0}) WHERE v IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id)"""


@query(f"""
WITH {_COSINES.format('embeddings')}
SELECT n.vec_id, count(*) FILTER (score >= 0.7) AS links_70, count(*) FILTER (score >= 0.4) AS links_40, max(score) FILTER (score >= 0.4) AS best
FROM n LEFT JOIN s ON s.a = n.vec_id GROUP BY 1
""")
def similar_issues(spark, d):
    """How many other vectors of the whole table reach a cosine of .70 with each, and, as the test tables' vectors lie at random, of .40."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    counted = Y.link_counts(rows, (0.7, 0.4))
    return counted.select(F.col("id").alias("vec_id"), F.col("links")[0].alias("links_70"), F.col("links")[1].alias("links_40"), "best")


def fix_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    p = spark.sql(f"SELECT l_orderkey AS grp, {_SPOT} AS problem, 'fix the ' || {_PATH} || ' by ' || l_returnflag AS fix, {_PATH} AS file FROM {{lineitem}}", lineitem=lines)
    return p.dropDuplicates(["grp", "problem"]).select("grp", "problem", "fix", F.array("file").alias("files"), F.col("problem").alias("place"))


@query()
def merged_problems(spark, d):
    """problems of an issue whose fixes read alike (ratio over 0.8) or whose files overlap (over a half), merged into the first of them."""
    m = V.merge_similar(fix_groups(spark, d), "grp")
    return m.select("grp", "problem", F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ",").alias("merged_from"), F.array_join("files", ",").alias("files"))


#: Each vector drawn towards that of its group of six: by half its own it stays, or by a third.
_DRAWN = """p AS (
  SELECT e.vec_id, list_transform(list_zip(g.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda x: CASE WHEN x[1] IS NULL OR x[2] IS NULL THEN NULL ELSE x[1] + x[2] / (2 + e.vec_id % 2) END) AS embedding, e.label
  FROM embeddings e JOIN embeddings g ON g.vec_id = e.vec_id - e.vec_id % 6 WHERE e.embedding IS NOT NULL AND g.embedding IS NOT NULL)"""


def _reach(t: float) -> str:
    """Smallest id that links of at least t lead to, found by spreading labels."""
    return f"WITH RECURSIVE {_DRAWN}, {_COSINES.format('p')}, r(a, top) AS (SELECT vec_id, vec_id FROM n UNION SELECT s.b, r.top FROM r JOIN s ON s.a = r.a AND s.score >= {t}) SELECT a AS vec_id, min(top) AS cluster FROM r GROUP BY 1"


@query(f"""
WITH strong AS ({_reach(0.85)}), broad AS ({_reach(0.68)}),
issues AS (SELECT count(DISTINCT label) AS n FROM embeddings),
f AS (SELECT cluster, count(DISTINCT label) AS frequency FROM broad JOIN embeddings USING (vec_id) GROUP BY 1)
SELECT vec_id, strong.cluster AS same, broad.cluster AS pattern, frequency,
  CASE WHEN n < 5 THEN frequency >= 2 AND frequency >= 0.4 * n ELSE frequency >= 3 AND frequency >= 0.3 * n END AS recurs
FROM strong JOIN broad USING (vec_id) JOIN f ON f.cluster = broad.cluster, issues
""")
def recurring_problems(spark, d):
    """problems' vectors clustered by cosine, at .85 as one problem and at .68 as one pattern; a pattern recurs if enough issues
    (labels) show it. Vectors are the table's, each drawn towards that of its group, so that there are clusters."""
    e = read_table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("own"), "label")
    base = e.select(F.col("vec_id").alias("head"), F.col("own").alias("base"))
    drawn = F.zip_with("base", "own", lambda b, x: b + x / (2 + F.col("vec_id") % 2))
    rows = e.withColumn("head", F.col("vec_id") - F.col("vec_id") % 6).join(base, "head").select("vec_id", "label", drawn.alias("embedding"))
    files = Rounds(spark)
    found = files.keep(Y.exact_clusters(rows, (0.85, 0.68)).select(F.col("id").alias("vec_id"), F.col("clusters")[0].alias("same"), F.col("clusters")[1].alias("pattern")))
    placed = found.join(rows.select("vec_id", "label"), "vec_id")
    n = rows.agg(F.count_distinct("label").alias("n"))  # one row
    frequency = placed.groupBy("pattern").agg(F.count_distinct("label").alias("frequency"))
    f, few = F.col("frequency"), F.col("n") < 5
    recurs = F.when(few, (f >= 2) & (f >= 0.4 * F.col("n"))).otherwise((f >= 3) & (f >= 0.3 * F.col("n")))
    known = frequency.join(F.broadcast(n)).select("pattern", "frequency", recurs.alias("recurs"))
    return files.result(found.join(known, "pattern").select("vec_id", "same", "pattern", "frequency", "recurs"))


_TOP = f"SELECT l_orderkey AS q, l_returnflag AS kind, l_suppkey AS trajectory, {_SPOT} AS spot FROM lineitem"


@query(f"WITH t AS ({_TOP}), h AS (SELECT q, trajectory, min(spot) AS spot FROM t WHERE kind = 'N' GROUP BY ALL), hn AS (SELECT q, spot, row_number() OVER (PARTITION BY q ORDER BY spot) AS k FROM h), dn AS (SELECT q, spot, row_number() OVER (PARTITION BY q ORDER BY spot) AS k FROM t WHERE kind = 'R') SELECT q, 'P0' AS id, 1 AS priority, CAST(0 AS BIGINT) AS spot FROM (SELECT DISTINCT q FROM t) UNION ALL SELECT q, 'H' || k, 2, spot FROM hn WHERE k <= 5 UNION ALL SELECT q, 'D' || k, 3, spot FROM dn WHERE k <= 3")
def problem_list(spark, d):
    """The failure's own problem, up to five hidden ones of distinct trajectories, and up to three of patterns, with priorities."""
    t = spark.sql(_TOP.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    own = t.select("q").distinct().select("q", F.lit("P0").alias("id"), F.lit(1).alias("priority"), F.lit(0).cast("long").alias("spot"))
    hidden = t.where("kind = 'N'").groupBy("q", "trajectory").agg(F.min("spot").alias("spot"))

    def capped(df: DataFrame, letter: str, priority: int, most: int) -> DataFrame:
        top = R.top_k(df, ["q"], most, F.col("spot"))
        return top.select("q", F.concat(F.lit(letter), F.col("rank").cast("string")).alias("id"), F.lit(priority).alias("priority"), "spot")

    return own.unionByName(capped(hidden, "H", 2, 5)).unionByName(capped(t.where("kind = 'R'"), "D", 3, 3))


def asked_memory(spark: SparkSession, d: str) -> S.Asked:
    """Every fiftieth document asks. Memories are documents (L1), answers (L2) and benchmark items (L3); a document's source is its
    repository, its language the workflow and the kind of failure, its first word the signal; each third one enables the next."""
    docs = read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("repo"), "lang")
    signal = F.regexp_extract(F.lower("text"), r"^[^a-z]*([a-z]+)", 1)
    k = F.col("doc_id")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<bigint>")
    one = docs.select(F.lit("L1").alias("level"), (k * 4).alias("memory"), "repo", F.col("lang").alias("workflow"), F.col("lang").alias("kind"), signal.alias("signal"), F.concat_ws("/", "repo", "lang").alias("issue"), "text", F.when(k % 3 == 0, F.array((k + 1) * 4)).otherwise(empty).alias("enables"), empty.alias("enabled_by"))
    answers = read_table(spark, d, "conversations").where("role = 'assistant'")
    two = answers.select(F.lit("L2"), F.col("conv_id") * 4000 + F.col("turn") * 4 + 1, F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")), none, none, F.lit(""), F.concat(F.lit("c"), F.col("conv_id").cast("string")), "text", empty, empty)
    three = read_table(spark, d, "benchmark").select(F.lit("L3"), F.col("item_id") * 4 + 2, none, none, none, F.lit(""), F.concat(F.lit("b"), F.col("item_id").cast("string")), "text", empty, empty)
    asked = docs.where(k % 50 == 0).select(k.alias("query"), "repo", F.col("lang").alias("workflow"), F.col("lang").alias("kind"), "text")
    return S.Asked(asked, one.union(two).union(three), stop_words=_STOP)


_ASKED = f"""
d AS (SELECT doc_id, coalesce(text, '') AS text, source AS repo, lang, regexp_extract(lower(coalesce(text, '')), '^[^a-z]*([a-z]+)', 1) AS signal FROM documents),
mem AS MATERIALIZED (
  SELECT 'L1' AS level, doc_id * 4 AS memory, repo, lang AS flow, lang AS kind, signal, concat_ws('/', repo, lang) AS issue, text FROM d
  UNION ALL SELECT 'L2', conv_id * 4000 + turn * 4 + 1, 'src' || (conv_id % 5), NULL, NULL, '', 'c' || conv_id, coalesce(text, '') FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'L3', item_id * 4 + 2, NULL, NULL, NULL, '', 'b' || item_id, text FROM benchmark),
q AS MATERIALIZED (SELECT doc_id AS query, repo, lang, text FROM d WHERE doc_id % 50 = 0),
mt AS (SELECT memory, term, count(*) AS tf FROM (SELECT memory, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM mem) WHERE term NOT IN ({_STOPPED}) GROUP BY ALL),
qt AS (SELECT query, term, count(*) AS tf FROM (SELECT query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM q) WHERE term NOT IN ({_STOPPED}) GROUP BY ALL),
voc AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM mem)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM mt GROUP BY 1 ORDER BY total DESC, term LIMIT 1000)),
mw AS (SELECT memory, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY memory)) AS w FROM mt JOIN voc USING (term)),
qw AS (SELECT query, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query)) AS w FROM qt JOIN voc USING (term)),
sc AS (SELECT query, memory, round(sum(mw.w * qw.w), 9) AS score FROM mw JOIN qw USING (term) GROUP BY ALL),
hit AS MATERIALIZED (
  SELECT query, level, memory, score FROM (SELECT *, row_number() OVER (PARTITION BY query, level ORDER BY score DESC, memory) AS r FROM sc JOIN mem USING (memory)) WHERE r <= 5),
frequent AS (
  SELECT signal FROM mem WHERE signal <> '' GROUP BY 1
  HAVING count(DISTINCT issue) >= 3 AND count(DISTINCT issue) * 100 >= 30 * (SELECT count(DISTINCT issue) FROM mem WHERE signal <> '')),
firsts AS (SELECT signal, repo, kind, min(memory) AS memory FROM mem JOIN frequent USING (signal) GROUP BY 1, 2, 3),
cfg AS (
  SELECT unnest(['full_recap', 'no_applicability_filter', 'no_dependency_expansion', 'no_hidden_problems', 'no_ordering', 'no_recurring_recall']) AS configuration),
kept AS (
  SELECT configuration, h.query, h.level, h.memory, h.score, row_number() OVER (PARTITION BY configuration, h.query ORDER BY h.level, h.score DESC, h.memory) AS place
  FROM cfg, hit h JOIN mem m USING (memory) JOIN q ON q.query = h.query
  WHERE configuration = 'no_applicability_filter' OR h.level = 'L3' OR (m.repo = q.repo AND (h.level = 'L2' OR m.flow IS NULL OR m.flow = '' OR m.flow = q.lang))),
walk AS (
  SELECT configuration, query, memory, score, 'direct' AS source, place, 0 AS step FROM kept
  UNION ALL
  SELECT k.configuration, k.query, n.memory, round(k.score * 0.9, 9), 'dependency_enabled', k.place, 1
  FROM kept k JOIN mem o ON o.memory = k.memory JOIN (SELECT DISTINCT configuration, query, issue FROM kept JOIN mem USING (memory)) i ON i.configuration = k.configuration AND i.query = k.query
  JOIN mem n ON n.memory = k.memory + 4 AND n.issue = i.issue
  WHERE k.level = 'L1' AND k.memory % 12 = 0 AND k.configuration NOT IN ('no_dependency_expansion', 'no_hidden_problems')),
found AS (SELECT configuration, query, memory, score, source FROM walk QUALIFY row_number() OVER (PARTITION BY configuration, query, memory ORDER BY place, step) = 1),
everything AS (
  SELECT * FROM found
  UNION ALL
  SELECT configuration, query, f.memory, 0.0, 'recurring' FROM cfg, q JOIN firsts f ON f.repo = q.repo AND f.kind = q.lang AND contains(lower(q.text), f.signal)
  WHERE configuration NOT IN ('no_recurring_recall', 'no_hidden_problems') AND (configuration, query, f.memory) NOT IN (SELECT (configuration, query, memory) FROM found)),
placed AS (
  SELECT *, CASE WHEN configuration <> 'no_ordering' THEN row_number() OVER (PARTITION BY configuration, query ORDER BY CASE source WHEN 'direct' THEN 1 WHEN 'dependency_enabled' THEN 3 ELSE 4 END, score DESC, memory) END AS place FROM everything)"""


@query(f"""
WITH {_ASKED}
SELECT configuration, configuration <> 'full_recap' AS run_new, count(*) AS problems, count(DISTINCT query) AS issues, count(*) FILTER (source = 'direct') AS direct,
  count(*) FILTER (source = 'dependency_enabled') AS linked, count(*) FILTER (source = 'recurring') AS recurring, count(place) AS ordered, CAST(sum(coalesce(place, 0) * (memory % 1009)) AS BIGINT) AS places
FROM placed GROUP BY 1
""")
def ablated_retrieval(spark, d):
    """Retrieval in stages (search, filter, expand, recall, order) by every named configuration: its levels, and the stages that its
    ablation leaves out; the one without memory finds nothing."""
    files = Rounds(spark)
    asked = asked_memory(spark, d)
    asked = S.Asked(files.keep(asked.queries), files.keep(asked.memory), stop_words=asked.stop_words)
    # the same for all that search all levels
    found, links, confirmed = files.keep(S.search(asked.queries, asked)), files.keep(S.linked(asked.memory)), files.keep(S.confirmed(asked))
    known = {"search": lambda _, a: found, "expand": lambda m, a: S.expand(m, a, links), "recall": lambda m, a: S.recall(m, a, confirmed)}
    once = S.Plan(tuple(S.Stage(s.name, known.get(s.name, s.run)) for s in S.STAGES))
    fresh, out = set(S.configurations(run_new=True)), None
    for name, (levels, ablation) in S.configurations().items():
        rows = once.without(ablation).run(S.Asked(asked.queries, asked.memory, levels, stop_words=asked.stop_words))
        rows = rows.select(F.lit(name).alias("configuration"), F.lit(name in fresh).alias("run_new"), "query", "memory", "source", "place")
        out = rows if out is None else out.unionByName(rows)
    count = lambda c: F.count_if(F.col("source") == c)
    return files.result(out.groupBy("configuration", "run_new").agg(
        F.count(F.lit(1)).alias("problems"), F.count_distinct("query").alias("issues"), count("direct").alias("direct"), count("dependency_enabled").alias("linked"), count("recurring").alias("recurring"),
        F.count("place").alias("ordered"), F.sum(F.coalesce("place", F.lit(0)) * (F.col("memory") % 1009)).cast("long").alias("places")))
