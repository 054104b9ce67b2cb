"""Column functions over repository paths, globs and what source text refers to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Beginnings of commands, tool names and ends of files that tell commands from paths.
COMMAND_PREFIXES = ("./", "bash ", "sh ", "python ", "python3 ", "pip ", "uv ", "poetry ", "npm ", "pnpm ", "yarn ", "make ", "tox ", "pytest ", "ruff ", "mypy ", "black ", "isort ", "flake8 ", "docformatter ", "pre-commit ")
TOOLS = ("pytest", "ruff", "mypy", "black", "isort", "make", "tox")
FILE_SUFFIXES = (".cfg", ".ini", ".json", ".lock", ".py", ".rst", ".sh", ".toml", ".txt", ".yaml", ".yml")
# Name fragments of configuration files.
CONFIG_NAMES = ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "package.json", "tsconfig.json", ".pre-commit-config.yaml", "Dockerfile", ".github/workflows")
# Path words that relate nothing.
PATH_STOP = ("source", "docs", "doc", "test", "tests", "framework", "common", "code", "py", "rst", "md")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def starts_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(c, F.lit(w))
    return out


def ends_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.endswith(c, F.lit(w))
    return out


def clean(c: Column) -> Column:
    """Trimmed, without leading slashes, back slashes to slashes."""
    return F.replace(F.ltrim(F.trim(c), F.lit("/")), F.lit("\\"), F.lit("/"))


def plain(c: Column) -> Column:
    """Slashes, trimmed, every leading ./ dropped; null is empty."""
    return F.regexp_replace(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))), "^(\\./)+", "")


def is_config(c: Column) -> Column:
    return contains_any(c, CONFIG_NAMES)


def is_file_reference(c: Column) -> Column:
    """Whether a text looks like a path in a repository, not like a command or a tool's name."""
    p = F.ltrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("/"))
    low, name = F.lower(p), F.element_at(F.split(p, "/"), -1)
    shell = contains_any(p, ("&&", "|", ";", "\n", "$(", "`")) | F.rlike(p, F.lit("(?U)\\s"))
    looks = F.contains(p, F.lit("/")) | F.startswith(low, F.lit(".")) | ends_any(low, FILE_SUFFIXES) | name.isin("Dockerfile", "Makefile")
    return (p != "") & ~starts_any(low, COMMAND_PREFIXES) & ~shell & ~F.startswith(p, F.lit("-")) & ~low.isin(*TOOLS) & looks


def words(c: Column) -> Column:
    """Distinct words of a path with plurals folded beside them, three letters at least, without PATH_STOP."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9]+"), F.lit(0)))
    single = F.transform(F.filter(found, lambda w: F.endswith(w, F.lit("s")) & (F.length(w) > 3)), lambda w: F.substr(w, F.lit(1), F.length(w) - 1))
    return F.array_sort(F.filter(F.array_union(found, single), lambda w: (F.length(w) >= 3) & ~w.isin(*PATH_STOP)))


def tested_file(c: Column) -> Column:
    """The source file that a test file's name speaks of; null for others."""
    return F.when(F.endswith(c, F.lit("_test.py")), F.replace(c, F.lit("_test.py"), F.lit(".py"))).when(
        F.contains(c, F.lit("/test_")), F.replace(F.replace(c, F.lit("/test_"), F.lit("/")), F.lit("/tests/"), F.lit("/"))
    )


def same_name(a: Column, b: Column) -> Column:
    """Equal without leading dots and slashes, or equal base names whose last two segments agree where both have two."""
    a, b = (F.regexp_replace(F.replace(F.trim(x), F.lit("\\"), F.lit("/")), "^[./]+", "") for x in (a, b))
    both = (F.size(F.split(a, "/")) > 1) & (F.size(F.split(b, "/")) > 1)
    return (a == b) | (F.element_at(F.split(a, "/"), -1) == F.element_at(F.split(b, "/"), -1)) & (~both | (T.last_two(a) == T.last_two(b)))


def glob_pattern(c: Column) -> Column:
    """A regular expression for a file glob: * and ? cross slashes, [!x] negates."""
    out = F.regexp_replace(c, r"([.^$+(){}|\\])", r"\\$1")
    return F.concat(F.lit("(?s)\\A"), F.replace(F.replace(F.replace(out, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("\\z"))


def parent(c: Column) -> Column:
    return F.regexp_extract(c, r"\A(.*)/[^/]*\z", 1)


def variants(pattern: Column, from_file: Column) -> Column:
    """The pattern as it is, below the referring file's folder, and with a star if it names a folder; each once, none if empty."""
    p, folder = plain(pattern), parent(from_file)
    # a joined path has no slash at its end
    below = F.when(folder != "", F.regexp_replace(plain(F.concat(folder, F.lit("/"), p)), "(?<=.)/+\\z", ""))
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(p, below, F.when(F.endswith(p, F.lit("/")), F.concat(p, F.lit("*")))))))


def refers_to(changed: Column, pattern: Column, from_file: Column, kind: Column) -> Column:
    """Whether a dependency pattern names a changed file: as a module, glob, folder, path, or folder inside a path."""
    c = plain(changed)

    def by(v: Column) -> Column:
        module = F.replace(v, F.lit("."), F.lit("/"))
        imports = (kind == "imports") & (F.endswith(c, F.concat(module, F.lit(".py"))) | F.endswith(c, F.concat(module, F.lit("/__init__.py"))))
        bare = F.rtrim(v, F.lit("/"))
        inside = (bare != "") & F.contains(F.concat(F.lit("/"), c, F.lit("/")), F.concat(F.lit("/"), bare, F.lit("/")))
        return imports | F.contains(v, F.lit("*")) & F.rlike(c, glob_pattern(v)) | F.endswith(v, F.lit("/")) & F.startswith(c, v) | (c == v) | inside

    return F.exists(variants(pattern, from_file), by)


def imports(code: Column) -> Column:
    """Distinct modules of import statements, sorted."""
    return F.array_sort(F.array_union(F.regexp_extract_all(code, F.lit(r"from\s+([\w.]+)\s+import"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"import\s+([\w.]+)"), F.lit(1))))


def file_reads(code: Column) -> Column:
    """Distinct quoted paths that source text opens, globs or names, sorted."""
    quoted = lambda call: F.regexp_extract_all(code, F.lit(call + r"""\(["']([^"']+)["']\)"""), F.lit(1))
    literal = F.regexp_extract_all(code, F.lit(r"""["']([^"']*(?:/|\*|\.(?:rst|md|py|txt|json|toml|ya?ml))[^"']*)["']"""), F.lit(1))
    return F.array_sort(F.array_union(F.array_union(quoted("Path"), quoted("glob")), F.array_union(quoted("open"), literal)))


def config_reach(path: Column, content: Column) -> Column:
    """File globs that a changed configuration file bears on; none for other files."""
    low, none = F.lower(content), F.array().cast("array<string>")
    docs = F.when(contains_any(low, ("mdformat", "docformatter", "sphinx")), F.array(F.lit("*.md"), F.lit("*.rst"))).otherwise(none)
    code = F.when(contains_any(low, ("mypy", "ruff", "pytest", "black", "isort")), F.array(F.lit("*.py"))).otherwise(none)
    both = F.concat(docs, code)
    return F.when(F.contains(path, F.lit("pyproject.toml")), F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("*.py")))).when(ends_any(path, (".yaml", ".yml")), F.array(F.lit("*"))).otherwise(none)
