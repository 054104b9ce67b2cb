"""Column functions that tell how well two things agree: types, file sets, texts and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Terms of a text as the pair similarity counts them: words with inner dots and dashes.
TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}_])?"


def canonical_type(c: Column) -> Column:
    """The first family whose words a type name holds; an unknown name stays as it is, null is Unknown."""
    t = F.lower(F.trim(c.cast("string")))
    has = lambda *words: F.rlike(t, F.lit("|".join(words)))
    return (
        F.when(c.isNull(), "Unknown").when(has("type") & has("check", "error"), "Type Checking").when(has("lint"), "Linting")
        .when(has("format") & has("doc", "rst"), "Documentation Formatting").when(has("format"), "Code Formatting")
        .when((has("test") & has("fail", "error")) | t.isin("test", "testing"), "Test Failure").when(has("assert"), "Assertion Error").when(has("config"), "Configuration Error")
        .when(has("depend", "package", "install"), "Dependency Issues").when(has("doc"), "Doc/Docstring").when(has("runtime"), "Runtime Error").when(has("import"), "Import Error")
        .when(has("build"), "Build Error").otherwise(c)
    )


#: Families that may stand for one another.
COMPATIBLE = (("Configuration Error", "Dependency Issues"), ("Code Formatting", "Documentation Formatting"), ("Test Failure", "Assertion Error"))


def types_agree(a: Column, b: Column) -> Column:
    """Both given, and of one family or of two that may stand for one another."""
    x, y = canonical_type(a), canonical_type(b)
    out = x == y
    for group in COMPATIBLE:
        out = out | (x.isin(*group) & y.isin(*group))
    return F.coalesce((a != "") & (b != "") & out, F.lit(False))


def file_list(c: Column) -> Column:
    """Distinct trimmed items of a comma list, without empty ones and `nan`."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "nan")))


def list_overlap(a: Column, b: Column) -> Column:
    """Largest of Jaccard and both containments of two comma lists; 0 if one is null or empty."""
    x, y = file_list(a), file_list(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), T.overlap(x, y)).otherwise(0.0)


def terms(c: Column) -> Column:
    """Words and pairs of neighbouring words, with repeats."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def support(explanation: Column, hunk: Column) -> Column:
    """struct<score, terms>: the share of an explanation's content words that a hunk has, and those, sorted."""
    own, other = T.content_tokens(F.coalesce(explanation, F.lit(""))), T.content_tokens(F.coalesce(hunk, F.lit("")))
    shared = F.array_sort(F.array_intersect(own, other))
    return F.struct(F.when(F.size(own) > 0, F.size(shared) / F.size(own)).otherwise(0.0).alias("score"), shared.alias("terms"))


def step_score(step: Column, job: Column, record: Column, cand_step: Column, cand_job: Column, cand_text: Column) -> Column:
    """100 for the same step, 70 if one step's name holds the other's, 20 for jobs alike, and up to 40 for shared words."""
    s, j, cs, cj = (T.alnum_fold(F.coalesce(x, F.lit(""))) for x in (step, job, cand_step, cand_job))
    both, jobs = (s != "") & (cs != ""), (j != "") & (cj != "")
    holds = lambda a, b: F.contains(a, b) | F.contains(b, a)
    return F.when(both & (s == cs), 100).when(both & holds(s, cs), 70).otherwise(0) + F.when(jobs & holds(j, cj), 20).otherwise(0) + T.capped_overlap(F.coalesce(record, F.lit("")), F.coalesce(cand_text, F.lit("")))


def fix_pattern(description: Column, kind: Column, changes: Column) -> Column:
    """The first category whose words a problem has and whose signs its changes have, else `specific` if they hold a quoted name, else null."""
    # Words of a category, and signs of a fix of it.
    rules = {
        "type_checking": (("type", "mypy", "optional", "union", "str", "int", "none"), ("Optional", "Union", "cast(", "-> ", ": str", ": int", "isinstance", "if not None", "if ... is not None")),
        "linting": (("lint", "ruff", "flake8", "f-string", "unused", "import"), ("# noqa", "import ", "from ", '"""', "'''", "removed f-string")),
        "testing": (("test", "pytest", "assert", "mock", "fixture"), ("assert", "mock", "@pytest", "def test_", "expected", "actual")),
        "import": (("import", "module", "cannot import", "no module"), ("import ", "from ", "__init__")),
        "syntax": (("syntax", "parsing", "indentation", "unexpected"), ("    ", "\t", ":", "(", ")", "[", "]")),
    }
    from .paths import contains_any

    low, low_kind = F.lower(description), F.lower(kind)
    out = None
    for name, (words, signs) in rules.items():
        hit = (contains_any(low, words) | contains_any(low_kind, words)) & contains_any(changes, signs)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.exists(F.regexp_extract_all(description, F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.contains(changes, x)), "specific")


def association(affected: Column, evidence: Column, pattern: Column, description: Column) -> Column:
    """struct<label, confidence>: a decision table over whether the file is affected, whether CI names the place, and whether a fix pattern fits."""
    wide = F.rlike(F.lower(description), F.lit("type|import"))
    fits = pattern.isNotNull()
    label = F.when(~affected, "unrelated").when(evidence & fits, "direct").when(evidence, "uncertain").when(fits & wide, "shared").when(fits, "uncertain").otherwise("unrelated")
    sure = F.when(~affected | (evidence & fits), "high").when(~evidence & fits & ~wide, "low").otherwise("medium")
    return F.struct(label.alias("label"), sure.alias("confidence"))
