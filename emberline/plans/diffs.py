"""Queries over diffs. Diffs are played by orders: each line item is one file's section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff as D
from ..functions import text as T
from ..shared import Rounds
from ..sources.io import read_table
from ..sources.predictions import repair_in_place
from ..sources.versioned import VersionedTable
from .base import query

PATHS = ("src/app.py", "tests/test_app.py", "docs/readme.md", "setup.cfg", "lib/core.so", "package.lock", "web/node_modules/x.js", ".vscode/settings.json", "pkg/requirements.txt", "src/core/util.py", "data/model.bin", "htmlcov/index.html", "src/types.py")
#: What both engines read: one section's path, counts and text, in SQL that both know.
_CASES = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS))
_PATH = f"CASE l_suppkey % 3 WHEN 0 THEN 'framework/' ELSE '' END || CASE l_partkey % 13 {_CASES} END"
_KIND = "CASE WHEN l_partkey % 13 IN (4, 10) THEN CASE l_returnflag WHEN 'A' THEN 'differ' ELSE 'literal' END ELSE 'text' END"
_COUNTS = "l_orderkey AS key, l_linenumber AS n, l_linenumber % 3 AS d, CAST(floor(l_quantity) AS BIGINT) % 4 AS a, l_suppkey AS s"
_BODY = """CASE kind WHEN 'differ' THEN 'Binary files a/' || path || ' and b/' || path || ' differ' || chr(10)
  WHEN 'literal' THEN 'GIT binary patch' || chr(10) || 'literal ' || (s * 70000) || chr(10)
  ELSE '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,' || (1 + d) || ' +1,' || (1 + a) || ' @@' || chr(10) || ' context' || chr(10) || repeat('-import old' || chr(10), CAST(d AS INT)) || repeat('+def f() -> int: return ' || s || chr(10), CAST(a AS INT)) END"""
_SECTION = f"'diff --git a/' || path || ' b/' || path || chr(10) || 'index 11..22' || chr(10) || {_BODY}"
_HEAD = "CASE WHEN key % 11 = 0 THEN 'Error while fetching' || chr(10) WHEN key % 7 = 0 THEN 'From abc' || chr(10) ELSE '' END"
_ITEMS = f"SELECT *, {_SECTION} AS section FROM (SELECT {_COUNTS}, {_PATH} AS path, {_KIND} AS kind FROM lineitem)"
SECTIONS_SQL = f"s AS ({_ITEMS}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n, section) AS ord FROM s)"
DIFFS_SQL = SECTIONS_SQL + f", t AS (SELECT key, {_HEAD} || string_agg(section, '' ORDER BY ord) AS diff FROM o GROUP BY key)"


def diffs(spark: SparkSession, d: str) -> DataFrame:
    """(key, diff): all sections of an order, in order."""
    items = spark.sql(_ITEMS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, d, "lineitem"))
    whole = items.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "section"))).alias("x"))
    return whole.select("key", F.concat(F.expr(_HEAD), F.array_join(F.transform("x", lambda x: x["section"]), "")).alias("diff"))


_IGNORED = "regexp_matches(path, '(^\\.git/|(^|/)\\.DS_Store$|(^|/)\\.vscode/)')"
_BINARY = "regexp_matches(path, '(\\.dylib$|\\.a$|\\.so$|\\.dll$|\\.exe$|\\.bin$|\\.o$|bin/grype$)')"
_GENERATED = "regexp_matches(path, '(coverage.*\\.json$|\\.coverage$|htmlcov/|node_modules/|vendor/|\\.lock$)')"
_SKIPPED = f"({_IGNORED} OR {_BINARY} OR {_GENERATED})"


@query(f"WITH {SECTIONS_SQL} SELECT key, count(DISTINCT path) AS files, CAST(sum(CASE kind WHEN 'text' THEN a ELSE 0 END) AS BIGINT) AS additions, CAST(sum(CASE kind WHEN 'text' THEN d ELSE 0 END) AS BIGINT) AS deletions, CAST(CASE WHEN sum(CASE kind WHEN 'text' THEN a + d ELSE 0 END) = 0 THEN 10 * count(DISTINCT path) ELSE sum(CASE kind WHEN 'text' THEN a + d ELSE 0 END) END AS BIGINT) AS lines, CASE WHEN key % 11 = 0 THEN 0 ELSE count(*) END AS total, CASE WHEN key % 11 = 0 THEN 0 ELSE count(*) FILTER (NOT {_SKIPPED}) END AS included, CASE WHEN key % 11 = 0 THEN 0 ELSE count(*) FILTER ({_SKIPPED}) END AS ignored FROM o GROUP BY key")
def diff_counts(spark, d):
    """Files, added and deleted lines (ten lines a file where none is), sections in all, included and ignored."""
    t = diffs(spark, d)
    c, none = F.col("diff"), F.startswith("diff", F.lit("Error"))
    paths = F.transform(T.diff_sections(c), D.new_path)
    files, plus, minus = F.size(F.array_distinct(paths)), D.added(c), D.deleted(c)
    ignored = F.size(F.filter(F.transform(T.diff_sections(c), D.old_path), D.is_ignored))
    total = F.size(paths)
    counts = {"files": files, "additions": plus, "deletions": minus, "lines": F.when(plus + minus == 0, 10 * files).otherwise(plus + minus), "total": F.when(none, 0).otherwise(total), "included": F.when(none, 0).otherwise(total - ignored), "ignored": F.when(none, 0).otherwise(ignored)}
    return t.select("key", *(x.cast("long").alias(n) for n, x in counts.items()))


@query(f"WITH {SECTIONS_SQL}, f AS (SELECT key, path, min(ord) AS first FROM o GROUP BY ALL), u AS (SELECT key, string_agg(path, ',' ORDER BY first) AS files FROM f GROUP BY key) SELECT o.key, any_value(u.files) AS files, CASE WHEN o.key % 11 = 0 THEN '' ELSE coalesce(string_agg(path, ',' ORDER BY ord) FILTER (NOT {_SKIPPED}), '') END AS changed, string_agg(path, ',' ORDER BY ord) AS named FROM o JOIN u ON u.key = o.key GROUP BY o.key")
def diff_files(spark, d):
    """New paths each once in order, old paths that no family leaves out, and new paths with repeats."""
    c = F.col("diff")
    clean = lambda p: F.replace(F.ltrim(F.trim(p), F.lit("/")), F.lit("\\"), F.lit("/"))
    changed = F.when(F.startswith(c, F.lit("Error")), F.array().cast("array<string>")).otherwise(F.filter(F.transform(T.diff_sections(c), D.old_path), lambda p: ~D.is_ignored(p)))
    named = F.transform(F.regexp_extract_all(c, F.lit("(?m)^diff --git \\S+ (\\S+)"), F.lit(1)), lambda p: F.regexp_replace(p, "\\Ab/", ""))
    return diffs(spark, d).select("key", F.array_join(F.array_distinct(F.transform(T.diff_files(c), clean)), ",").alias("files"), F.array_join(changed, ",").alias("changed"), F.array_join(named, ",").alias("named"))


@query(f"WITH {SECTIONS_SQL} SELECT key, ord AS pos, path, {_SKIPPED} AS ignored, {_BINARY} AS binary_file, {_GENERATED} AS generated_file, kind <> 'text' AS binary_patch, path = 'app.py' OR suffix(path, 'app.py') OR suffix(path, 'framework/lib/core.so') OR path = 'lib/core.so' OR suffix(path, 'readme.md') AS target FROM o")
def diff_paths(spark, d):
    """What each section's path and text belong to."""
    s = diffs(spark, d).select("key", F.posexplode(T.diff_sections(F.col("diff"))).alias("pos", "section")).withColumn("path", D.old_path(F.col("section")))
    p = F.col("path")
    return s.select("key", (F.col("pos") + 1).cast("long").alias("pos"), "path", D.is_ignored(p).alias("ignored"), D.is_binary_file(p).alias("binary_file"), D.is_generated_file(p).alias("generated_file"), D.has_binary_patch(F.col("section")).alias("binary_patch"), D.is_target(p, ("app.py", "framework/lib/core.so", " /readme.md", "")).alias("target"))


_TARGETS = ("src/app.py", "framework/src/types.py", "lib/core.so", "/setup.cfg")


@query(f"WITH {DIFFS_SQL}, k AS (SELECT key, {_HEAD} || coalesce(string_agg(section, '' ORDER BY ord) FILTER (NOT {_SKIPPED} AND kind = 'text'), '') AS kept, coalesce(string_agg(section, '' ORDER BY ord) FILTER (NOT {_SKIPPED} AND kind = 'text' AND (suffix(path, 'src/app.py') OR suffix(path, 'src/types.py') OR suffix(path, 'setup.cfg'))), '') AS target FROM o GROUP BY key) SELECT key, md5(CASE WHEN key % 11 = 0 THEN diff ELSE kept END) AS kept, md5(CASE WHEN key % 11 = 0 THEN '' ELSE target END) AS target FROM k JOIN t USING (key)")
def diff_filtered(spark, d):
    """The diff without ignored, generated and binary sections, and with those of target files only."""
    return diffs(spark, d).select("key", F.md5(T.without_paths(F.col("diff"))).alias("kept"), F.md5(D.only_targets(F.col("diff"), _TARGETS)).alias("target"))


_NOTE = "printf('%.2f', length(diff) / 1024.0)"
_LINES = "string_split(diff, chr(10))"
_FIRST = f"({_LINES})[1:20]"
_HEADERS = "regexp_matches(x, '^(diff --git|index|new file|deleted file|---|\\+\\+\\+|@@)')"
_UPTO = f"CASE WHEN len(list_filter({_FIRST}, lambda x: x[1:2] = '@@')) > 0 THEN ({_FIRST})[1:list_position(list_transform({_FIRST}, lambda x: x[1:2] = '@@'), true)] ELSE {_FIRST} END"
_IS_BINARY = "(contains(diff, 'GIT binary patch') OR contains(diff, 'Binary files'))"
_SUMMARY = f"array_to_string(list_concat(list_filter({_UPTO}, lambda x: {_HEADERS}), [CASE WHEN {_IS_BINARY} THEN '[BINARY FILE REMOVED: ' ELSE '[LARGE DIFF REMOVED: ' END || {_NOTE} || 'KB]']), chr(10))"
_REASON = f"CASE WHEN {_IS_BINARY} THEN 'binary' WHEN regexp_matches(diff, 'coverage.*\\.json|\\.coverage|htmlcov/|node_modules/|package-lock\\.json|yarn\\.lock|poetry\\.lock') THEN 'generated' WHEN length(diff) / 1024.0 > 0.5 THEN 'large' END"
_MARKED = "regexp_matches(x, '^(diff --git|new file mode|index)') OR contains(x, 'Binary files')"
_STOP = f"list_position(list_transform({_LINES}, lambda x: x[1:7] = 'literal'), true)"
_MB = "'[BINARY FILE: ' || printf('%.2f', CAST(regexp_extract(x, 'literal (\\d+)', 1) AS DOUBLE) / 1048576) || 'MB]'"
_BRIEF = f"array_to_string(list_transform(list_filter(CASE WHEN {_STOP} > 0 THEN ({_LINES})[1:{_STOP}] ELSE {_LINES} END, lambda x: {_MARKED} OR x[1:7] = 'literal'), lambda x: CASE WHEN x[1:7] = 'literal' THEN {_MB} ELSE x END), chr(10))"


@query(f"WITH {DIFFS_SQL}, r AS (SELECT key, diff, {_REASON} AS removed FROM t) SELECT key, removed, md5(CASE WHEN removed IS NULL THEN diff ELSE {_SUMMARY} END) AS cleaned, md5(CASE WHEN {_IS_BINARY} THEN {_BRIEF} ELSE diff END) AS without_binary FROM r")
def diff_rewritten(spark, d):
    """Binary, generated or large diffs (here over half a KB) give way to a summary; binary ones to a shorter one."""
    c = F.col("diff")
    t = diffs(spark, d).withColumn("removed", D.removal_reason(c, 0.5))
    return t.select("key", "removed", F.md5(F.when(F.col("removed").isNull(), c).otherwise(D.header_summary(c))).alias("cleaned"), F.md5(F.when(D.has_binary_patch(c), D.binary_summary(c)).otherwise(c)).alias("without_binary"))


@query(f"WITH {DIFFS_SQL}, r AS (SELECT key, length(diff) / 1024.0 AS size_kb, row_number() OVER (ORDER BY length(diff) DESC, key) AS rank, sum(length(diff) / 1024.0) OVER () AS total_kb FROM t) SELECT key, CAST(rank AS INTEGER) AS rank, round(size_kb, 6) AS size_kb, round(sum(size_kb) OVER (), 4) AS top_kb, round(total_kb, 4) AS total_kb FROM r WHERE rank <= 20")
def patch_sizes(spark, d):
    """The 20 largest diffs with their sum and that of all."""
    from pyspark.sql import Window

    sized = diffs(spark, d).select("key", (F.length("diff") / 1024).alias("size_kb"))
    total = sized.agg(F.sum("size_kb").alias("total_kb"))  # one row
    top = sized.orderBy(F.col("size_kb").desc(), "key").limit(20)
    everything = Window.orderBy(F.col("size_kb").desc(), "key")  # over 20 rows
    return top.join(F.broadcast(total)).select("key", F.row_number().over(everything).alias("rank"), F.round("size_kb", 6).alias("size_kb"), F.round(F.sum("size_kb").over(Window.partitionBy()), 4).alias("top_kb"), F.round("total_kb", 4).alias("total_kb"))


_KINDS = "list_filter([CASE WHEN FALSE THEN 'assertions' END, CASE WHEN regexp_matches(path, '\\.(toml|ini|cfg|yaml|yml|json)$') THEN 'config' END, CASE WHEN f.kind = 'text' AND f.a > 0 THEN 'definitions' END, CASE WHEN regexp_matches(path, '\\.(txt|lock)$') OR contains(path, 'requirements') THEN 'dependencies' END, CASE WHEN regexp_matches(path, '\\.md$') OR contains(lower(path), 'readme') THEN 'docs' END, CASE WHEN f.kind = 'text' AND f.d > 0 THEN 'imports' END, CASE WHEN f.kind = 'text' AND f.a > 0 THEN 'returns' END, CASE WHEN contains(lower(path), 'test') THEN 'tests' END, CASE WHEN f.kind = 'text' AND f.a > 0 THEN 'type_hints' END], lambda x: x IS NOT NULL)"
_FOUND = "f AS (SELECT o.key, o.ord, o.path, (SELECT arg_min(struct_pack(kind := h.kind, a := h.a, d := h.d, section := h.section, last := h.ord = (SELECT max(z.ord) FROM o z WHERE z.key = h.key)), h.ord) FROM o h WHERE h.key = o.key AND contains(h.path, o.path)) AS f FROM o), g AS (SELECT key, ord, path, CASE f.kind WHEN 'text' THEN f.a ELSE 0 END AS a, CASE f.kind WHEN 'text' THEN f.d ELSE 0 END AS d, " + f"{_KINDS} AS kinds, CASE WHEN f.last THEN f.section ELSE regexp_replace(f.section, '\\n$', '') END AS section FROM f)"


@query(f"WITH {SECTIONS_SQL}, {_FOUND}, h AS (SELECT key, ord, count(*) OVER (PARTITION BY key) AS n, '  - ' || path || ' (+' || a || ', -' || d || '): ' || CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, ', ') ELSE 'code' END AS line, section FROM g) SELECT key, string_agg(line, chr(10) ORDER BY ord) FILTER (ord <= 3) || CASE WHEN any_value(n) > 3 THEN chr(10) || '  ... and ' || (any_value(n) - 3) || ' more files' ELSE '' END AS summary, md5(string_agg(section[1:300], '' ORDER BY ord)) AS samples FROM h GROUP BY key")
def diff_summaries(spark, d):
    """A line for each of the first three files (of the first section that names it), and how many more; beginnings of their sections."""
    found = F.transform("all", lambda s: F.struct(D.new_path(s).alias("path"), D.section_of(F.col("all"), D.new_path(s)).alias("s")))
    counted = F.transform(F.slice("found", 1, 3), lambda x: F.concat(F.lit("  - "), x["path"], F.lit(" (+"), D.added(x["s"]).cast("string"), F.lit(", -"), D.deleted(x["s"]).cast("string"), F.lit("): "), F.array_join(D.change_kinds(x["path"], x["s"]), ", ")))
    more = F.when(F.size("found") > 3, F.array(F.concat(F.lit("  ... and "), (F.size("found") - 3).cast("string"), F.lit(" more files")))).otherwise(F.array().cast("array<string>"))
    samples = F.transform("found", lambda x: F.substring(x["s"], 1, 300))
    return diffs(spark, d).select("key", T.diff_sections(F.col("diff")).alias("all")).select("key", found.alias("found")).select("key", F.array_join(F.concat(counted, more), "\n").alias("summary"), F.md5(F.array_join(samples, "")).alias("samples"))


@query(f"WITH {SECTIONS_SQL} SELECT key, path AS file, count(*) AS n, md5(string_agg(section, '' ORDER BY ord)) AS patches, md5(string_agg(CASE kind WHEN 'text' THEN section[strpos(section, '@@ -1,'):] ELSE '' END, '' ORDER BY ord)) AS hunks, md5(string_agg(CASE kind WHEN 'text' THEN section[1:strpos(section, '@@ -1,') - 1] ELSE section END, '' ORDER BY ord)) AS headers FROM o WHERE key % 11 <> 0 AND key % 7 <> 0 GROUP BY ALL")
def patches_by_file(spark, d):
    """File records of every diff without text before it, counted and gathered by file in order."""
    clean = diffs(spark, d).where(F.startswith("diff", F.lit("diff --git ")))
    r = clean.select("key", F.posexplode(D.records(F.col("diff"))).alias("pos", "r")).groupBy("key", F.col("r.file").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("x"))
    joined = lambda name: F.md5(F.array_join(F.transform("x", lambda x: x["r"][name]), ""))
    return r.select("key", "file", "n", joined("full_patch").alias("patches"), joined("hunks").alias("hunks"), joined("header").alias("headers"))


def _sha1(domain: str, value: str) -> str:
    return f"sha1(encode('file-line-v1') || '\\x00'::BLOB || encode('{domain}') || '\\x00'::BLOB || encode({value}))"


@query(f"WITH {SECTIONS_SQL}, l AS (SELECT key, sum(a) FILTER (kind = 'text') AS added, sum(d) FILTER (kind = 'text') AS deleted, string_agg(repeat({_sha1('path', 'path')} || {_sha1('line', chr(39) + 'def f() -> int: return ' + chr(39) + ' || s')}, CAST(a AS INT)), '' ORDER BY ord) FILTER (kind = 'text') AS prints FROM o GROUP BY key) SELECT key, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(deleted, 0) AS BIGINT) AS deleted, md5(coalesce(prints, '')) AS prints FROM l")
def accepted_diff_lines(spark, d):
    """Added and deleted lines, and the path's and line's fingerprint of each effective added line in order."""
    parts = F.transform(T.diff_sections(F.col("diff")), D.added_lines)

    def prints(p):
        kept = F.filter(F.transform(p["texts"], T.squeezed), T.is_effective)
        own = D.bound(T.fingerprint("path", p["path"]), lambda path: F.array_join(F.transform(kept, lambda x: F.concat(path, T.fingerprint("line", x))), ""))
        return F.when(p["path"].isNotNull(), own).otherwise("")

    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[name])
    return diffs(spark, d).select("key", parts.alias("p")).select("key", total("added").alias("added"), total("deleted").alias("deleted"), F.md5(F.array_join(F.transform("p", prints), "")).alias("prints"))


@query()
def diff_chunks(spark, d):
    """Chunks of at most 60 tokens that keep files whole where they fit and cut the others between hunks."""
    chunks = diffs(spark, d).select("key", F.posexplode(D.file_chunks(F.col("diff"), 60)).alias("pos", "c"))
    return chunks.select("key", "pos", "c.tokens", F.array_join("c.files", ",").alias("files"), F.md5("c.diff").alias("diff"))


_CUT = "m AS (SELECT key, l_linenumber % 3 AS gone, key % 4 AS wrong, '@@ -1,' || (2 + l_linenumber % 3 + CASE WHEN key % 4 = 3 THEN 1 ELSE 0 END) || ' +1,' || (2 + l_linenumber % 3) || ' @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+c' AS diff FROM (SELECT l_orderkey AS key, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1))"


@query(f"WITH {_CUT} SELECT key, CASE WHEN wrong <> 3 THEN CAST(gone AS INTEGER) END AS deficit, CASE WHEN wrong <> 3 THEN md5(diff || chr(10) || repeat(' ' || chr(10), CAST(gone AS INT))) END AS repaired, CASE WHEN wrong = 3 THEN 'the last hunk' END AS problem FROM m")
def diff_repairs(spark, d):
    """Blank context lines that the last hunk has lost are put back; hunks that differ otherwise are named."""
    m = spark.sql("SELECT key, diff FROM (" + _CUT.removeprefix("m AS (").removesuffix(")").replace("FROM lineitem", "FROM {lineitem}") + ")", lineitem=read_table(spark, d, "lineitem"))
    return m.select("key", D.repair(F.col("diff")).alias("r")).select("key", "r.deficit", F.md5("r.repaired").alias("repaired"), "r.problem")


@query(f"""
WITH {_CUT},
p AS (
  SELECT 'k' || key AS id, CASE WHEN wrong <> 3 AND gone > 0 THEN diff || chr(10) || repeat(' ' || chr(10), CAST(gone AS INT)) ELSE diff END AS after, wrong <> 3 AND gone > 0 AS fixed, gone > 0 OR wrong = 3 AS broken, gone, key FROM m),
r AS (SELECT count(*) FILTER (broken) AS selected, count(*) FILTER (fixed) AS repaired, count(*) FILTER (fixed AND gone = 1) AS one_lost FROM p)
SELECT id, md5(after) AS diff, CASE WHEN key % 2 = 0 THEN CAST(strlen(after) AS BIGINT) END AS patch_bytes, selected, repaired, one_lost FROM p, r
""")
def repaired_predictions(spark, d):
    """Predictions whose diffs are repaired where they lie, with the size of those that carry one, and the report of the repair."""
    files = Rounds(spark)
    m = spark.sql("SELECT key, diff FROM (" + _CUT.removeprefix("m AS (").removesuffix(")").replace("FROM lineitem", "FROM {lineitem}") + ")", lineitem=read_table(spark, d, "lineitem"))
    table = VersionedTable(spark, f"{files.base}/predictions", "id string, diff string, patch_bytes long", "id", 8)
    table.replace(m.select(F.concat(F.lit("k"), F.col("key").cast("string")).alias("id"), "diff", F.when(F.col("key") % 2 == 0, F.octet_length("diff").cast("long")).alias("patch_bytes")))
    report = repair_in_place(table).select("selected", "repaired", F.coalesce(F.try_element_at("deficits", F.lit(1)), F.lit(0)).cast("long").alias("one_lost"))
    return files.result(table.read().select("id", F.md5("diff").alias("diff"), "patch_bytes").join(F.broadcast(report)))
