"""Column functions over unified diffs. A section is one file's part, from its `diff --git` line on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Signs of generated files in a whole diff.
GENERATED_MARKS = (r"coverage.*\.json", r"\.coverage", r"htmlcov/", r"node_modules/", r"package-lock\.json", r"yarn\.lock", r"poetry\.lock")
# Changes that a section's text or path tells of.
CONFIG_ENDS, DEPENDENCY_ENDS = (".toml", ".ini", ".cfg", ".yaml", ".yml", ".json"), (".txt", ".lock")
#: Hunk header: old start, old count, new start, new count.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def line_list(c: Column) -> Column:
    """Lines as a reader gives them: no empty one after a last newline."""
    return F.split(F.regexp_replace(c, "\\n\\z", ""), "\n")


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(c, F.lit("|".join(patterns)))


def is_binary_file(path: Column) -> Column:
    return any_of(path, T.BINARY_PATHS)


def is_generated_file(path: Column) -> Column:
    return any_of(path, T.GENERATED_PATHS)


def is_ignored(path: Column) -> Column:
    """Of one of the ignored, binary or generated families."""
    return any_of(path, T.IGNORED_PATHS) | is_binary_file(path) | is_generated_file(path)


def has_binary_patch(c: Column) -> Column:
    return F.contains(c, F.lit("GIT binary patch")) | F.contains(c, F.lit("Binary files"))


def old_path(section: Column) -> Column:
    return F.regexp_extract(section, r"\Adiff --git a/(.*?) b/", 1)


def new_path(section: Column) -> Column:
    return F.regexp_extract(section, r"\Adiff --git a/[^\n]+ b/([^\n]+)", 1)


def is_target(path: Column, targets: tuple[str, ...]) -> Column:
    """Equal to a target, ending with it (at any place), or the end of it after a slash."""
    p = F.ltrim(F.trim(path), F.lit("/"))
    out = F.lit(False)
    for t in (t.strip().lstrip("/") for t in targets):
        if t:
            out = out | F.endswith(p, F.lit(t)) | F.endswith(F.lit(t), F.concat(F.lit("/"), p))
    return out


def failed(c: Column) -> Column:
    """No diff: missing, empty or an error text."""
    return c.isNull() | (c == "") | F.startswith(c, F.lit("Error"))


def only_targets(c: Column, targets: tuple[str, ...]) -> Column:
    """The sections of target files that are neither ignored nor binary; empty for no diff."""
    kept = F.filter(T.diff_sections(c), lambda s: is_target(old_path(s), targets) & ~is_ignored(old_path(s)) & ~has_binary_patch(F.regexp_replace(s, r"\A[^\n]*", "")))
    return F.when(failed(c), "").otherwise(F.array_join(kept, ""))


def added(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))))


def deleted(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))


def two_digits(c: Column) -> Column:
    """Two decimals; exact halves go to the even digit."""
    return F.format_string("%.2f", F.bround(c, 2))


def removal_reason(c: Column, threshold_kb: float) -> Column:
    """The first rule that a diff breaks: binary, generated, large (code points over 1024); null if none."""
    return F.when(has_binary_patch(c), "binary").when(any_of(c, GENERATED_MARKS), "generated").when(F.length(c) / 1024 > threshold_kb, "large")


def header_summary(c: Column) -> Column:
    """Header lines among the first 20, up to the first hunk line, and a note of the size."""
    first = F.slice(lines(c), 1, 20)
    hunk = F.array_position(F.transform(first, lambda x: F.startswith(x, F.lit("@@"))), True)
    upto = F.when(hunk > 0, F.slice(first, F.lit(1), hunk.cast("int"))).otherwise(first)
    kept = F.filter(upto, lambda x: F.rlike(x, F.lit("^(diff --git|index|new file|deleted file|---|\\+\\+\\+|@@)")))
    note = F.concat(F.when(has_binary_patch(c), "[BINARY FILE REMOVED: ").otherwise("[LARGE DIFF REMOVED: "), two_digits(F.length(c) / 1024), F.lit("KB]"))
    return F.array_join(F.concat(kept, F.array(note)), "\n")


def binary_summary(c: Column) -> Column:
    """Header and binary lines up to the first `literal` line, whose size is given in MB."""
    all_ = lines(c)
    stop = F.array_position(F.transform(all_, lambda x: F.startswith(x, F.lit("literal")) & ~F.rlike(x, F.lit("^(diff --git|new file mode|index)|Binary files"))), True)
    upto = F.when(stop > 0, F.slice(all_, F.lit(1), stop.cast("int"))).otherwise(all_)
    size = lambda x: F.regexp_extract(x, r"literal (\d+)", 1)
    found = F.transform(
        upto,
        lambda x: F.when(F.rlike(x, F.lit("^(diff --git|new file mode|index)|Binary files")), x).when(
            F.startswith(x, F.lit("literal")) & (size(x) != ""), F.concat(F.lit("[BINARY FILE: "), two_digits(size(x).try_cast("double") / (1024 * 1024)), F.lit("MB]"))
        ),
    )
    out = F.array_join(F.array_compact(found), "\n")
    return F.when(out == "", "[BINARY FILE CHANGE]").otherwise(out)


def change_kinds(path: Column, section: Column) -> Column:
    """Sorted names of the kinds of change that text and path tell of; `code` if none."""
    low, low_path = F.lower(section), F.lower(path)
    has = lambda c, *words: F.rlike(c, F.lit("|".join(words)))
    ends = lambda *ends_: has(path, *(e.replace(".", "\\.") + "\\z" for e in ends_))
    rules = {
        "assertions": has(low, "assert"), "config": ends(*CONFIG_ENDS), "definitions": has(section, "def ", "class "),
        "dependencies": ends(*DEPENDENCY_ENDS) | has(path, "requirements"), "docs": ends(".md") | has(low_path, "readme"),
        "imports": has(low, "import", "from "), "returns": has(low, "return"), "tests": has(low_path, "test"), "type_hints": has(section, "-> "),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("code")))


def section_of(all_: Column, path: Column) -> Column:
    """Of all sections the first whose first line contains the path, without the newline before the next one."""
    at = F.array_position(F.transform(all_, lambda s: F.contains(F.substring_index(s, "\n", 1), path)), True)
    own = F.try_element_at(all_, F.nullif(at, F.lit(0)).cast("int"))
    return F.when(at == F.size(all_), own).otherwise(F.regexp_replace(own, "\\n\\z", ""))


def records(c: Column) -> Column:
    """array<struct<file, header, hunks, full_patch>> of a whole diff; text before the first section raises, blank text has none."""
    kind = "array<struct<file:string,header:string,hunks:string,full_patch:string>>"
    of = lambda s: F.struct(
        new_path(s).alias("file"), F.regexp_extract(s, r"(?sm)\A(.*?)(?:^@@|\z)", 1).alias("header"), F.regexp_extract(s, r"(?sm)(^@@.*)\z", 1).alias("hunks"), s.alias("full_patch")
    )
    lead = F.rlike(F.regexp_extract(c, r"(?sm)\A(.*?)(?:^diff --git |\z)", 1), F.lit("\\S"))
    return F.when(lead, F.raise_error(F.lit("text before the diff")).cast(kind)).otherwise(F.transform(T.diff_sections(c), of))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once; inside lambdas an expression is computed wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def added_lines(section: Column) -> Column:
    """struct<added, deleted, path, texts>: counted inside hunks and, but for file headers, before them."""
    starts = lambda mark: lambda x: F.startswith(x, F.lit(mark))

    def halves(all_: Column) -> Column:
        def cut(at: Column) -> Column:
            head = F.when(at > 0, F.slice(all_, F.lit(1), at - 1)).otherwise(all_)
            body = F.when(at > 0, F.filter(F.slice(all_, at, F.size(all_)), lambda x: ~F.startswith(x, F.lit("@@ ")))).otherwise(F.array().cast("array<string>"))
            return F.struct(head.alias("head"), body.alias("body"))

        return bound(F.array_position(F.transform(all_, starts("@@ ")), True).cast("int"), cut)

    def counted(h: Column) -> Column:
        head, body = h["head"], h["body"]
        plus = F.concat(F.filter(head, lambda x: starts("+")(x) & ~starts("+++ ")(x)), F.filter(body, starts("+")))
        minus = F.size(F.filter(head, lambda x: starts("-")(x) & ~starts("--- ")(x))) + F.size(F.filter(body, starts("-")))
        given = F.trim(F.substring(F.try_element_at(F.filter(head, starts("+++ ")), F.lit(-1)), 5, 1 << 30))
        path = bound(given, lambda g: F.when(g != "/dev/null", F.regexp_replace(g, "\\A[ab]/", "")))
        return bound(plus, lambda p: F.struct(F.size(p).alias("added"), minus.alias("deleted"), path.alias("path"), F.transform(p, lambda x: F.substring(x, 2, 1 << 30)).alias("texts")))

    return bound(bound(line_list(section), halves), counted)


def hunk_gaps(c: Column) -> Column:
    """array<struct<old, new>>: for each hunk the lines that its header counts and its body lacks."""
    pieces = F.filter(F.split(c, "(?m)(?=^@@ |^diff --git )"), lambda s: F.rlike(s, F.lit("\\A" + HUNK[1:])))

    def gap(piece: Column) -> Column:
        body = F.slice(line_list(piece), 2, 1 << 30)
        stop = F.array_position(F.transform(body, lambda x: ~F.rlike(x, F.lit("^([ +-]|\\\\ No newline at end of file)"))), True).cast("int")
        body = F.when(stop > 0, F.slice(body, F.lit(1), stop - 1)).otherwise(body)
        n = lambda k: F.coalesce(F.regexp_extract(piece, "\\A" + HUNK[1:], k).try_cast("int"), F.lit(1))
        have = lambda marks: F.size(F.filter(body, lambda x: F.rlike(x, F.lit(f"^[{marks}]"))))
        return F.struct((n(2) - have(" -")).alias("old"), (n(4) - have(" +")).alias("new"))

    return F.transform(pieces, gap)


def repair(c: Column) -> Column:
    """struct<deficit, repaired, problem>: blank context lines that the last hunk has lost are put back.

    Problem names why a diff cannot be repaired; then the other two are null."""

    def judge(gaps: Column) -> Column:
        last = F.try_element_at(gaps, F.lit(-1))
        before = F.when(F.size(gaps) > 1, F.slice(gaps, F.lit(1), F.size(gaps) - 1)).otherwise(F.slice(gaps, 1, 0))
        problem = (
            F.when(c.isNull() | (c == ""), "empty").when(F.exists(before, lambda g: (g["old"] != 0) | (g["new"] != 0)), "an earlier hunk")
            .when((F.size(gaps) > 0) & ((last["old"] < 0) | (last["new"] < 0) | (last["old"] != last["new"])), "the last hunk")
        )
        deficit = F.when(F.size(gaps) > 0, last["old"]).otherwise(0)
        whole = F.concat(c, F.when(F.endswith(c, F.lit("\n")), "").otherwise("\n"), F.repeat(F.lit(" \n"), deficit))
        return F.struct(F.when(problem.isNull(), deficit).alias("deficit"), F.when(problem.isNull(), whole).alias("repaired"), problem.alias("problem"))

    # a list of one binds the gaps, which would else be counted anew wherever they stand
    return F.element_at(F.transform(F.array(hunk_gaps(c)), judge), 1)


def _fold(items: Column, limit: int, start: Column, joined) -> Column:
    """array<struct<tokens, parts>>: items (tokens, part) in order, a new chunk before one that would pass the limit."""
    kind = "array<struct<tokens:bigint,parts:array<string>>>"

    def step(acc: Column, x: Column) -> Column:
        cur = F.try_element_at(acc, F.lit(-1))
        new = F.struct((start + x["tokens"]).alias("tokens"), F.array(x["part"]).alias("parts"))
        grown = F.struct((cur["tokens"] + x["tokens"]).alias("tokens"), F.concat(cur["parts"], F.array(x["part"])).alias("parts"))
        fresh = (F.size(acc) == 0) | (cur["tokens"] + x["tokens"] > limit)
        return F.when(fresh, F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).cast(kind)

    return F.transform(F.aggregate(items, F.array().cast(kind), step), joined)


def hunk_chunks(section: Column, limit: int) -> Column:
    """array<struct<tokens, files, diff>>: one file's section cut between hunks; its header leads every chunk."""
    pieces = F.split(section, "\\n(?=@@)")
    path, head, hunks = new_path(section), F.element_at(pieces, 1), F.slice(pieces, 2, 1 << 30)
    items = F.transform(hunks, lambda h: F.struct(T.estimate_tokens(h).alias("tokens"), h.alias("part")))
    chunk = lambda c: F.struct(c["tokens"].alias("tokens"), F.array(path).alias("files"), F.concat(head, F.lit("\n"), F.array_join(c["parts"], "\n")).alias("diff"))
    alone = F.array(F.struct(T.estimate_tokens(section).alias("tokens"), F.array(path).alias("files"), section.alias("diff")))
    return F.when(F.size(hunks) > 0, _fold(items, limit, T.estimate_tokens(head), chunk)).otherwise(alone)


def file_chunks(c: Column, limit: int) -> Column:
    """array<struct<tokens, files, diff>>: sections in order, whole, while a chunk keeps within the limit; one that alone is over is cut between its hunks."""
    kind = "array<struct<tokens:bigint,files:array<string>,diff:string,open:boolean>>"
    n = F.size(T.diff_sections(c))
    # a section ends before the newline that leads to the next one
    sections = F.transform(T.diff_sections(c), lambda s, i: F.when(i < n - 1, F.regexp_replace(s, "\\n\\z", "")).otherwise(s))

    def step(acc: Column, s: Column) -> Column:
        tokens, cur = T.estimate_tokens(s), F.try_element_at(acc, F.lit(-1))
        cut = F.transform(hunk_chunks(s, limit), lambda x: F.struct(x["tokens"].alias("tokens"), x["files"].alias("files"), x["diff"].alias("diff"), F.lit(False).alias("open")))
        own = F.struct(tokens.alias("tokens"), F.array(new_path(s)).alias("files"), F.concat(s, F.lit("\n")).alias("diff"), F.lit(True).alias("open"))
        joined = F.struct((cur["tokens"] + tokens).alias("tokens"), F.concat(cur["files"], own["files"]).alias("files"), F.concat(cur["diff"], own["diff"]).alias("diff"), F.lit(True).alias("open"))
        fresh = (F.size(acc) == 0) | ~cur["open"] | (cur["tokens"] + tokens > limit)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
        return F.when(tokens > limit, F.concat(acc, cut)).when(fresh, F.concat(acc, F.array(own))).otherwise(grown).cast(kind)

    return F.transform(F.aggregate(sections, F.array().cast(kind), step), lambda x: F.struct(x["tokens"].alias("tokens"), x["files"].alias("files"), x["diff"].alias("diff")))
