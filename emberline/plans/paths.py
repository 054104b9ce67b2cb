"""Queries over paths and dependencies. Paths are played by parts, an issue's changed files by the files of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import graph
from ..shared import Rounds
from ..sources.io import read_table
from .base import query

_HEADS = ("./", "/", "src\\", "libs/agno/", "framework/", "../", "", "Libs/", "python ")
_FOLDERS = ("core", "tests", "docs/source", "pkg/Tests", ".github/workflows", "lib/tests/unit")
_NAMES = ("exit_code_test.py", "test_exit_codes.py", "ReadMe.md", "setup.cfg", "pyproject.toml", "Makefile", "data.bin", "pytest", "requirements.txt", "a;b.py", "util.py")


def _pick(values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_A = f"{_pick(_HEADS, 'p_partkey % 9')} || {_pick([f + '/' for f in _FOLDERS] + [''], 'p_partkey % 7')} || {_pick(_NAMES, 'p_partkey % 11')}"
_B = f"{_pick(_HEADS, 'p_size % 9')} || {_pick([f + '/' for f in _FOLDERS] + [''], 'p_partkey % 7')} || {_pick(_NAMES, '(p_partkey + p_size % 2) % 11')}"
_PARTS = f"SELECT p_partkey AS id, {_A} AS a, {_B} AS b FROM part"
PATHS_SQL = f"p AS ({_PARTS})"


def named_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PARTS.replace("\\", "\\\\").replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))


_SLASH = "lower(regexp_replace(replace({0}, '\\', '/'), '^\\./', ''))"
_BARE = "regexp_replace(lower(ltrim(replace(trim({0}), '\\', '/'), './')), '^(libs/agno/|libs/|src/)', '')"
_STOPPED = "['source','docs','doc','test','tests','framework','common','code','py','rst','md']"
_WORDS = f"list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(lower(a), '[a-z][a-z0-9]+'), list_transform(list_filter(regexp_extract_all(lower(a), '[a-z][a-z0-9]+'), lambda w: suffix(w, 's') AND length(w) > 3), lambda w: w[1:length(w) - 1])), lambda w: length(w) >= 3 AND NOT list_contains({_STOPPED}, w))))"
_Q = "ltrim(trim(a), '/')"
_REFERENCE = f"({_Q} <> '' AND NOT regexp_matches(lower({_Q}), '^(\\./|(bash|sh|python|python3|pip|uv|poetry|npm|pnpm|yarn|make|tox|pytest|ruff|mypy|black|isort|flake8|docformatter|pre-commit) )') AND NOT regexp_matches({_Q}, '&&|[|;`\\s]|\\$\\(') AND NOT starts_with({_Q}, '-') AND lower({_Q}) NOT IN ('pytest','ruff','mypy','black','isort','make','tox') AND (contains({_Q}, '/') OR starts_with({_Q}, '.') OR regexp_matches(lower({_Q}), '\\.(cfg|ini|json|lock|py|rst|sh|toml|txt|yaml|yml)$') OR regexp_matches({_Q}, '(^|/)(Dockerfile|Makefile)$')))"
_CONFIG = "regexp_matches(a, 'pyproject\\.toml|setup\\.py|setup\\.cfg|requirements\\.txt|package\\.json|tsconfig\\.json|\\.pre-commit-config\\.yaml|Dockerfile|\\.github/workflows')"


@query(f"WITH {PATHS_SQL} SELECT id, {_SLASH.format('a')} AS slash, replace(ltrim(trim(a), '/'), '\\', '/') AS clean, {_BARE.format('a')} AS bare, CASE WHEN regexp_matches(a, '_test\\.py$|/tests/') THEN 'test' WHEN regexp_matches(a, '\\.(toml|yaml|yml|json|ini|cfg)$') THEN 'config' WHEN regexp_matches(a, '\\.(rst|md)$') THEN 'docs' WHEN regexp_matches(a, '\\.py$') THEN 'code' ELSE 'other' END AS kind, CASE WHEN suffix(a, '_test.py') THEN replace(a, '_test.py', '.py') WHEN contains(a, '/test_') THEN replace(replace(a, '/test_', '/'), '/tests/', '/') END AS tested, array_to_string({_WORDS}, ',') AS words, {_CONFIG} AS config, {_REFERENCE} AS reference FROM p")
def path_names(spark, d):
    """Normal forms, kind, tested file and words of a path, and whether it is a configuration file or a path at all."""
    a = F.col("a")
    return named_paths(spark, d).select("id", T.slash_path(a).alias("slash"), P.clean(a).alias("clean"), T.bare_path(a).alias("bare"), T.file_kind(a).alias("kind"), P.tested_file(a).alias("tested"), F.array_join(P.words(a), ",").alias("words"), P.is_config(a).alias("config"), P.is_file_reference(a).alias("reference"))


def _two(x: str) -> str:
    return f"array_to_string(string_split({x}, '/')[-2:], '/')"


_S, _R = (_SLASH.format("a"), _SLASH.format("b")), (_BARE.format("a"), _BARE.format("b"))
_N = tuple(f"ltrim(replace(trim({x}), '\\', '/'), './')" for x in "ab")
_LAST = "string_split({0}, '/')[-1]"
_MANY = "contains({0}, '/') AND contains({1}, '/')"


@query(f"WITH {PATHS_SQL} SELECT id, {_S[0]} = {_S[1]} OR ({_MANY.format(*_S)} AND {_two(_S[0])} = {_two(_S[1])}) AS strict, CASE WHEN {_MANY.format(*_R)} THEN {_two(_R[0])} = {_two(_R[1])} ELSE {_LAST.format(_R[0])} = {_LAST.format(_R[1])} END AS loose, {_N[0]} = {_N[1]} OR ({_LAST.format(_N[0])} = {_LAST.format(_N[1])} AND (NOT ({_MANY.format(*_N)}) OR {_two(_N[0])} = {_two(_N[1])})) AS named FROM p")
def path_matches(spark, d):
    """Whether two paths are one file, by three rules."""
    a, b = F.col("a"), F.col("b")
    return named_paths(spark, d).select("id", T.files_match_strict(a, b).alias("strict"), T.files_match_loose(a, b).alias("loose"), P.same_name(a, b).alias("named"))


_CODE = f"CASE p_size % 6 WHEN 0 THEN 'from pkg.core import x' || chr(10) || 'import os.path' WHEN 1 THEN 'open(\"data/in' || p_partkey || '.json\") and glob(\"*.rst\")' WHEN 2 THEN 'Path(\"out' || p_size || '\") and import p' || p_partkey || '.core' WHEN 3 THEN '[tool.ruff]' || chr(10) || 'sphinx = 1' WHEN 4 THEN 'import sys; import os.path' ELSE 'mdformat' END"
_TEXTS = f"SELECT p_partkey AS id, {_CODE} AS code, {_pick(('pyproject.toml', '.github/ci.yml', 'src/a.py'), 'p_partkey % 3')} AS path FROM part"
_LOW = "lower(code)"


@query(f"WITH c AS ({_TEXTS}) SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(code, 'from\\s+([\\w.]+)\\s+import', 1), regexp_extract_all(code, 'import\\s+([\\w.]+)', 1)))), ',') AS imports, array_to_string(list_sort(list_distinct(regexp_extract_all(code, '(?:open|glob|Path)\\(\\x22([^\\x22]+)\\x22\\)', 1))), ',') AS reads, CASE path WHEN 'pyproject.toml' THEN CASE WHEN contains({_LOW}, 'sphinx') THEN '*.md,*.rst,*.py' WHEN contains({_LOW}, 'mdformat') THEN '*.md,*.rst' ELSE '*.py' END WHEN 'src/a.py' THEN '' ELSE '*' END AS reach FROM c")
def source_references(spark, d):
    """Modules and files that source text names, and globs that a configuration file bears on."""
    c = spark.sql(_TEXTS.replace("FROM part", "FROM {part}"), part=read_table(spark, d, "part"))
    return c.select("id", F.array_join(P.imports(F.col("code")), ",").alias("imports"), F.array_join(P.file_reads(F.col("code")), ",").alias("reads"), F.array_join(P.config_reach(F.col("path"), F.col("code")), ",").alias("reach"))


_FILES = ("src/pkg/core.py", "docs/source/exit/000.rst", "tests/exit_test.py", "src/pkg/__init__.py", "data/exit.json", "pyproject.toml", "docs/readme.md", "unrelated.txt")
_TARGETS = ("pkg.core", "*.rst", "docs/", "exit", "./core.py", "data/exit.json", "pkg")
_NODE = f"SELECT l_orderkey AS key, {_pick(_FILES, 'l_partkey % 8')} AS file, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2"
_EDGE = f"SELECT DISTINCT l_orderkey AS key, {_pick(_FILES, 'l_partkey % 8')} AS origin, {_pick(_TARGETS, 'l_suppkey % 7')} AS via, CASE WHEN l_suppkey % 2 = 0 THEN 'imports' ELSE 'reads' END AS kind FROM lineitem"
_FOLDER = "regexp_extract(origin, '^(.*)/[^/]*$', 1)"
_VIA = "regexp_replace(via, '^(\\./)+', '')"
_VARIANTS = f"CASE WHEN {_FOLDER} = '' THEN [{_VIA}] ELSE [{_VIA}, {_FOLDER} || '/' || rtrim({_VIA}, '/')] END"
_MATCH = "(kind = 'imports' AND (suffix(file, replace(v, '.', '/') || '.py') OR suffix(file, replace(v, '.', '/') || '/__init__.py'))) OR (contains(v, '*') AND file LIKE replace(v, '*', '%')) OR (suffix(v, '/') AND (starts_with(file, v))) OR file = v OR contains('/' || file || '/', '/' || rtrim(v, '/') || '/')"
_RESOLVED = f"n AS ({_NODE}), e AS ({_EDGE}), x AS (SELECT key, origin, via, kind, unnest({_VARIANTS}) AS v FROM e), r AS (SELECT DISTINCT x.key, x.origin, n.file AS target, x.kind, x.via FROM x JOIN n ON n.key = x.key AND ({_MATCH}) WHERE x.origin <> n.file)"


def dependency_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = read_table(spark, d, "lineitem")
    nodes = spark.sql(_NODE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    return nodes, spark.sql(_EDGE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)


def resolved_edges(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """(key, origin, target, kind, via): raw edges of an issue to those of its changed files that they name; no loops, each once."""
    j = raw.join(nodes.select("key", F.col("file").alias("target")), "key")
    return j.where((F.col("origin") != F.col("target")) & P.refers_to(F.col("target"), F.col("via"), F.col("origin"), F.col("kind"))).select("key", "origin", "target", "kind", "via").distinct()


@query(f"WITH {_RESOLVED} SELECT * FROM r")
def dependency_edges(spark, d):
    """Dependency patterns joined to the changed files of the same issue that they name, distinct and without loops."""
    return resolved_edges(*dependency_tables(spark, d))


_CHANGED = """SELECT DISTINCT l_orderkey AS key, CASE l_partkey % 4 WHEN 0 THEN 'tests/word' || (l_partkey % 7) || '_word' || (l_suppkey % 5) || '_test.py' WHEN 1 THEN 'docs/source/word' || (l_suppkey % 7) || 's/word' || (l_partkey % 5) || '.rst'
  WHEN 2 THEN 'data/word' || (l_suppkey % 5) || '.txt' ELSE 'src/word' || (l_partkey % 7) || '.py' END AS file FROM lineitem"""


@query(f"""
WITH n AS ({_CHANGED}), w AS (SELECT *, regexp_extract_all(file, 'word[0-9]+') AS w FROM n),
j AS (SELECT a.key, a.file AS origin, b.file AS target, list_sort(list_distinct(list_intersect(a.w, b.w))) AS shared FROM w a JOIN w b ON a.key = b.key AND starts_with(a.file, 'tests/') AND (starts_with(b.file, 'docs/') OR starts_with(b.file, 'data/')))
SELECT key, origin, target, array_to_string(shared[1:5], ', ') AS shared FROM j WHERE len(shared) > 0
""")
def related_changes(spark, d):
    """Test files with those documents and other files of the same issue that share words with them, and these words; plurals count as their singulars."""
    nodes = spark.sql(_CHANGED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    words = nodes.select("key", "file", T.file_kind(F.col("file")).alias("kind"), F.explode(P.words(F.col("file"))).alias("word"))
    tests = words.where("kind = 'test'").select("key", F.col("file").alias("origin"), "word")
    others = words.where("kind IN ('docs', 'other')").select("key", F.col("file").alias("target"), "word")
    shared = tests.join(others, ["key", "word"]).where("origin <> target").groupBy("key", "origin", "target").agg(F.sort_array(F.collect_list("word")).alias("w"))
    return shared.select("key", "origin", "target", F.array_join(F.slice("w", 1, 5), ", ").alias("shared"))


@query(f"WITH RECURSIVE {_RESOLVED}, e2 AS (SELECT key, origin AS a, target AS b FROM r UNION SELECT key, target, origin FROM r), w AS (SELECT key, file AS a, file AS b FROM n UNION SELECT w.key, w.a, e2.b FROM w JOIN e2 ON e2.key = w.key AND e2.a = w.b), c AS (SELECT key, a AS file, min(b) AS cluster FROM w GROUP BY 1, 2), x2 AS (SELECT c.key, c.cluster, string_agg(r.origin || ' ' || upper(r.kind) || ' ' || r.target || ' via ' || r.via, chr(10) ORDER BY r.origin || ' ' || upper(r.kind) || ' ' || r.target || ' via ' || r.via) AS text FROM r JOIN c ON c.key = r.key AND c.file = r.origin GROUP BY 1, 2) SELECT c.key, c.cluster, string_agg(c.file, ',' ORDER BY c.file) AS files, coalesce(any_value(x2.text), 'No dependencies within cluster') AS text FROM c LEFT JOIN x2 ON x2.key = c.key AND x2.cluster = c.cluster GROUP BY 1, 2")
def dependency_clusters(spark, d):
    """Clusters of an issue's files along resolved edges, known by their first file, and each cluster's edges as text."""
    nodes, raw = dependency_tables(spark, d)
    kept = Rounds(spark)
    edges = kept.keep(resolved_edges(nodes, raw))  # read twice
    # an issue and a file make one node, so that components are found for all issues at once
    node = lambda file: F.concat(F.col("key").cast("string"), F.lit("/"), F.col(file))
    labels = graph.components(edges.select(node("origin").alias("a"), node("target").alias("b")))
    placed = nodes.select("key", "file", node("file").alias("node")).join(labels, "node", "left").select("key", "file", F.coalesce(F.regexp_replace("component", "\\A[^/]*/", ""), "file").alias("cluster"))
    told = F.concat(F.col("origin"), F.lit(" "), F.upper("kind"), F.lit(" "), F.col("target"), F.lit(" via "), F.col("via"))
    texts = edges.join(placed.withColumnRenamed("file", "origin"), ["key", "origin"]).groupBy("key", "cluster").agg(F.array_join(F.sort_array(F.collect_list(told)), "\n").alias("text"))
    files = placed.groupBy("key", "cluster").agg(F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files"))
    return kept.result(files.join(texts, ["key", "cluster"], "left").select("key", "cluster", "files", F.coalesce("text", F.lit("No dependencies within cluster")).alias("text")))


@query(f"WITH {_RESOLVED}, q AS (SELECT key, file FROM n WHERE n = 1), t AS (SELECT DISTINCT r.key, unnest([r.origin, r.target]) AS file FROM r JOIN q ON q.key = r.key AND (q.file = r.origin OR q.file = r.target)), a AS (SELECT * FROM t UNION SELECT * FROM q) SELECT DISTINCT r.key, r.origin, r.target, r.via FROM r JOIN a x ON x.key = r.key AND x.file = r.origin JOIN a y ON y.key = r.key AND y.file = r.target")
def relevant_edges(spark, d):
    """H5: edges whose both ends are an issue's problem files or touch one of them."""
    nodes, raw = dependency_tables(spark, d)
    rounds = Rounds(spark)
    edges = rounds.keep(resolved_edges(nodes, raw))  # read three times
    problem = nodes.where("n = 1").select("key", "file")
    both = edges.select("key", "origin", "target", F.explode(F.array("origin", "target")).alias("file"))
    touched = both.join(problem, ["key", "file"], "left_semi").select("key", F.explode(F.array("origin", "target")).alias("file"))
    near = touched.unionByName(problem).distinct()
    kept = edges
    for end in ("origin", "target"):
        kept = kept.join(near.withColumnRenamed("file", end), ["key", end], "left_semi")
    return rounds.result(kept.select("key", "origin", "target", "via").distinct())
