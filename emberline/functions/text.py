"""Column functions over text, paths and diffs. Null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# Stop words of the content-token set.
STOP_WORDS = ("added", "changed", "fixed", "removed", "updated", "using", "with", "from", "that", "this", "which", "file", "code", "error", "function", "method")
# Special tokens that normalising drops, in this order.
SPECIAL_TOKENS = ("<|endoftext|>", "<|startoftext|>", "<|end|>", "<|start|>", "<|im_start|>", "<|im_end|>")
# Words read as true or false in outcome columns.
TRUE_WORDS, FALSE_WORDS = ("1", "true", "success", "successes", "passed", "pass", "yes", "y", "✓"), ("0", "false", "failure", "fail", "failed", "no", "n", "✗")
# Path families that diffs may leave out.
IGNORED_PATHS = (r"^\.git/", r"(^|/)\.DS_Store$", r"(^|/)\.vscode/")
GENERATED_PATHS = (r"coverage.*\.json$", r"\.coverage$", r"htmlcov/", r"node_modules/", r"vendor/", r"\.lock$")
BINARY_PATHS = (r"\.dylib$", r"\.a$", r"\.so$", r"\.dll$", r"\.exe$", r"\.bin$", r"\.o$", r"bin/grype$")
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode composition; the engine has no built-in for it."""
    for s in texts:
        yield s.str.normalize("NFC")


def normalize_text(c: Column, collapse: bool = True, compose: bool = True) -> Column:
    """Drops special tokens one after another, BOMs at the start, NUL and control characters (not tab, newline, return), composes, and collapses blank lines, runs of blanks past a line's first character and newlines at the end."""
    out = c
    for token in SPECIAL_TOKENS:
        out = F.replace(out, F.lit(token))
    out = F.regexp_replace(out, r"\A\uFEFF?(?:\u00EF\u00BB\u00BF)?[\uFEFF\uFFFE\uFFFF]*", "")
    out = F.regexp_replace(out, "\\x00", "")
    out = nfc(out) if compose else out
    out = F.regexp_replace(out, "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "")
    if collapse:
        out = F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "(?<=[^\\n])[ \\t]{2,}", " ")
        out = F.regexp_replace(out, "\\n+\\z", "\n")
    return out


def safe_json_string(c: Column) -> Column:
    return normalize_text(F.coalesce(c, F.lit("")), collapse=False)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the code points, rounded down; null counts as empty."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4).cast("long")


def approx_tokens_bytes(c: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(c) + 3) / 4).cast("long")


def item_tokens(items: Column) -> Column:
    """Sum of each string's own floor, so small items round down one by one."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + estimate_tokens(x))


def chunk_band(tokens: Column, small: int = 10_000, medium: int = 40_000) -> Column:
    return F.when(tokens < small, "full").when(tokens < medium, "chunked").otherwise("summarized")


def output_limit(context: Column, used: Column, safe: Column, share: float = 0.1, least: int = 16_000) -> Column:
    """Tokens left for output after a safety margin."""
    return F.least(safe, F.greatest(F.lit(0), context - used - F.greatest(F.lit(least), F.floor(context * F.lit(share))))).cast("long")


def input_limit(context: Column, output: Column, share: float = 0.02, most: int = 10_000) -> Column:
    return F.greatest(F.lit(0), context - output - F.least(F.lit(most), F.floor(context * F.lit(share)))).cast("long")


def fallback_chunk(tokens: Column) -> Column:
    return F.greatest(F.floor(tokens / 2), F.lit(1000)).cast("long")


def content_tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_.-]{2,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*stop)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct items that b holds; 0 for an empty a."""
    a = F.array_distinct(a)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Largest of Jaccard similarity and both containments."""
    union = F.size(F.array_union(a, b))
    return F.greatest(F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0), containment(a, b), containment(b, a))


def capped_overlap(a: Column, b: Column, cap: int = 40) -> Column:
    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(alnum_fold(c), " "), lambda t: F.length(t) > 2))

    return F.least(4 * F.size(F.array_intersect(words(a), words(b))), F.lit(cap))


def alnum_fold(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def search_fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(c)), "/"), -1)


def slash_path(c: Column) -> Column:
    """Back slashes to slashes, one leading ./ dropped, lower case."""
    return F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^\\./", ""))


def bare_path(c: Column, prefixes: str = "libs/agno/|libs/|src/") -> Column:
    """Trimmed, slashes, leading dots and slashes dropped as a set, lower case, the first known prefix dropped once."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "^[./]+", "")), f"^({prefixes})", "")


def last_two(c: Column) -> Column:
    return F.slice(F.split(c, "/"), F.greatest(F.size(F.split(c, "/")) - 1, F.lit(1)), 2)


def files_match_strict(a: Column, b: Column) -> Column:
    """Neither empty, and equal, or the last two segments are equal and both have two."""
    a, b = slash_path(a), slash_path(b)
    return (a != "") & (b != "") & (a == b) | ((F.size(F.split(a, "/")) > 1) & (F.size(F.split(b, "/")) > 1) & (last_two(a) == last_two(b)))


def files_match_loose(a: Column, b: Column) -> Column:
    """As the strict one after prefixes are dropped; a path of one segment is compared by base name."""
    given = (a != "") & (b != "")
    a, b = bare_path(a), bare_path(b)
    one = (F.size(F.split(a, "/")) == 1) | (F.size(F.split(b, "/")) == 1)
    return given & F.when(one, F.element_at(F.split(a, "/"), -1) == F.element_at(F.split(b, "/"), -1)).otherwise((a == b) | (last_two(a) == last_two(b)))


def diff_files(diff: Column) -> Column:
    """New paths of a unified diff's sections, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(diff, F.lit("(?m)^diff --git a/.+ b/(.+)$"), F.lit(1)))


def diff_lines(diff: Column, sign: str) -> Column:
    """Added (+) or removed (-) lines without the file headers."""
    head = sign * 3
    return F.size(F.filter(F.split(diff, "\n"), lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(head))))


def diff_sections(diff: Column) -> Column:
    return F.filter(F.split(diff, "(?m)(?=^diff --git )"), lambda s: F.startswith(s, F.lit("diff --git ")))


def without_paths(diff: Column, patterns=IGNORED_PATHS + GENERATED_PATHS + BINARY_PATHS) -> Column:
    """The diff without sections of ignored, generated or binary files, by their old path; text before the first section stays, and so does a text that begins with Error."""
    any_ = "|".join(patterns)

    def kept(s: Column) -> Column:
        body = F.regexp_replace(s, r"\A[^\n]*", "")
        dropped = F.rlike(F.regexp_extract(s, "^diff --git a/(.*?) b/", 1), F.lit(any_)) | F.contains(body, F.lit("GIT binary patch")) | F.contains(body, F.lit("Binary files"))
        return ~F.startswith(s, F.lit("diff --git ")) | ~dropped

    return F.when(F.startswith(diff, F.lit("Error")), diff).otherwise(F.array_join(F.filter(F.split(diff, "(?m)(?=^diff --git )"), kept), ""))


def parse_success(c: Column) -> Column:
    """True, false, null for blank; anything else raises."""
    w = F.lower(F.trim(c))
    return F.when(c.isNull() | (w == ""), F.lit(None).cast("boolean")).when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not an outcome: "), c)).cast("boolean"))


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def metric_tag(c: Column) -> Column:
    """Other characters than [A-Za-z0-9._/-] to _, trimmed of _, 256 at most; without letters or digits `unspecified`."""
    out = F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._/-]", "_"), "^_+|_+$", ""), 1, 256)
    return F.when(F.rlike(out, F.lit("[A-Za-z0-9]")), out).otherwise("unspecified")


def fingerprint(domain: str, c: Column) -> Column:
    """Domain-separated SHA-1."""
    nul = F.lit(b"\x00")
    return F.sha1(F.concat(F.lit(b"file-line-v1"), nul, F.lit(domain.encode()), nul, c.cast("binary")))


def squeezed(c: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def is_effective(line: Column) -> Column:
    """Whether a line without needless white space has more than three bytes and a letter, digit or underscore."""
    return (F.octet_length(line) > 3) & F.rlike(line, F.lit("[\\p{L}\\p{N}_]"))


def effective_line(c: Column) -> Column:
    """White space collapsed; null for lines of three bytes or less or without a letter, digit or underscore."""
    out = squeezed(c)
    return F.when(is_effective(out), out)


def timestamp_any(c: Column) -> Column:
    """Seconds since 1970 from an integer or an ISO text; null if neither."""
    return F.coalesce(c.try_cast("bigint"), F.unix_timestamp(F.try_to_timestamp(c)))


def epoch_millis(c: Column) -> Column:
    """Seconds to milliseconds; values that already are milliseconds stay."""
    return F.when(c < F.lit(1577836800000), c * 1000).otherwise(c)


def snippet(c: Column, needle: Column, before: int = 49, after: int = 96) -> Column:
    """Text around the first match, ignoring case, on collapsed white space; null without a match."""
    t = F.trim(F.regexp_replace(c, "(?U)\\s+", " "))
    at = F.position(F.lower(needle), F.lower(t))
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + F.length(needle) + after, F.length(t) + 1)
    body = F.concat(F.when(start > 1, "... ").otherwise(""), F.trim(F.substr(t, start, stop - start)), F.when(stop <= F.length(t), " ...").otherwise(""))
    return F.when(at > 0, body)


@F.pandas_udf(ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))
def literal_ranges(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Byte ranges of a needle's non-overlapping matches, ignoring case; letters whose lower case is longer keep their own place."""

    def find(text: str, needle: str) -> list[dict]:
        needle = needle.lower()
        if text is None or not needle:
            return []
        low, owner = [], []  # lower-cased letters, and the place of the letter that each comes from
        for i, letter in enumerate(text):
            low += letter.lower()
            owner += [i] * len(letter.lower())
        whole, out, at = "".join(low), [], 0
        starts = [0]
        for letter in text:
            starts.append(starts[-1] + len(letter.encode()))
        while (at := whole.find(needle, at)) >= 0:
            out.append({"start": starts[owner[at]], "end": starts[owner[at + len(needle) - 1] + 1]})
            at += len(needle)
        return out

    return pd.Series([find(t, n) for t, n in zip(texts, needles, strict=True)])


@F.pandas_udf(StructType([StructField("places", ArrayType(IntegerType())), StructField("score", IntegerType())]))
def fuzzy_match(texts: pd.Series, needles: pd.Series) -> pd.DataFrame:
    """Places of the letters that a needle's letters take in order, and a score: the gap between them, 100 less from the start on; null if a letter is missing."""

    def match(text: str, needle: str) -> dict:
        if text is None or needle is None:
            return {"places": None, "score": None}
        if not needle:
            return {"places": [], "score": 2**31 - 1}
        low = [(x, i) for i, letter in enumerate(text) for x in letter.lower()]
        wanted, hits, at = needle.lower(), [], 0
        for letter in wanted:
            while at < len(low) and low[at][0] != letter:
                at += 1
            if at == len(low):
                return {"places": None, "score": None}
            hits.append(at)
            at += 1
        first = next(k for k, (_, i) in enumerate(low) if i == low[hits[0]][1])
        return {"places": sorted({low[k][1] for k in hits}), "score": max(0, hits[-1] - first + 1 - len(wanted)) - (100 if first == 0 else 0)}

    return pd.DataFrame([match(t, n) for t, n in zip(texts, needles, strict=True)], columns=["places", "score"])


def head_bytes(c: Column, most: Column) -> Column:
    """The longest beginning of at most so many UTF-8 bytes that ends at a letter's end."""
    cut = F.substr(F.encode(c, "UTF-8"), F.lit(1), most.cast("int"))
    size = F.octet_length(cut)
    byte = lambda back: F.conv(F.hex(F.substr(cut, size - back, F.lit(1))), 16, 10).cast("int")
    # a letter's first byte tells its length: it may be up to three places before the end
    gone = F.lit(0)
    for back in (3, 2, 1, 0):
        need = F.when(byte(back) >= 240, 4).when(byte(back) >= 224, 3).when(byte(back) >= 192, 2).otherwise(1)
        gone = F.when((size > back) & (need > back + 1), back + 1).otherwise(gone)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substr(cut, F.lit(1), size - gone), "UTF-8"))


def tail_bytes(c: Column, most: Column) -> Column:
    """The longest end of at most so many UTF-8 bytes that starts at a letter's start: letters take the same bytes in any order."""
    return F.reverse(head_bytes(F.reverse(c), most))


def cut_middle(c: Column, tokens: int) -> Column:
    """Beginning and end within four bytes a token, and between them how many tokens are left out."""
    budget = 4 * tokens
    left, right = budget // 2, budget - budget // 2
    gone = F.floor((F.octet_length(c) - budget + 3) / 4).cast("string")
    marker = F.concat(F.lit("…"), gone, F.lit(" tokens truncated…"))
    return F.when((F.octet_length(c) <= budget) | (c == ""), c).otherwise(F.concat(head_bytes(c, F.lit(left)), marker, tail_bytes(c, F.lit(right))))


def fnv_percent(c: Column) -> Column:
    """The text's 64-bit FNV-1a hash modulo 100, in two halves of 32 bits that never overflow."""
    bytes_ = F.hex(F.encode(c, "UTF-8"))
    half = 1 << 32
    # Offset basis and prime (2^40 + 435) of the hash.
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))

    def step(acc: Column, i: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(F.substr(bytes_, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
        product = low * 435
        return F.struct(((acc["high"] * 435 + F.floor(product / half).cast("long") + low * 256) % half).alias("high"), (product % half).alias("low"))

    places = F.when(F.octet_length(c) > 0, F.sequence(F.lit(0), F.octet_length(c) - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, start, step)
    return ((h["high"] * (half % 100) + h["low"]) % 100).cast("int")


def unfenced(c: Column) -> Column:
    """A text without the code fence around it: its first line, and the last if that closes the fence."""
    t = F.trim(F.regexp_replace(c, r"\A\s+|\s+\z", ""))
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n?", ""), r"\n?[ \t]*```[^\n]*\z", "")
    return F.when(F.startswith(t, F.lit("```")), F.regexp_replace(inner, r"\A\s+|\s+\z", "")).otherwise(t)


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else: the parser stops at a value's end, so the text must fit both into a list and an object."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    alone = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}"))).isNotNull(), F.lit(False))


def _json(c: Column, kind: str) -> Column:
    """The text if it is JSON of that kind ({ or [), else null."""
    t = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return F.when(F.startswith(t, F.lit(kind)) & is_json(t), t)


def lenient_object(c: Column) -> Column:
    """The JSON object that a reply holds: the whole, else from the first brace to the last; null if neither parses."""
    t = unfenced(c)
    return F.coalesce(_json(t, "{"), _json(F.regexp_extract(t, r"(?s)\{.*\}", 0), "{"))


def lenient_json(c: Column) -> Column:
    """The JSON that a reply holds: the whole, else its widest array, or object if there is no array; null if that does not parse."""
    t = unfenced(c)
    array, object_ = F.regexp_extract(t, r"(?s)\[.*\]", 0), F.regexp_extract(t, r"(?s)\{.*\}", 0)
    part = F.when(array != "", array).otherwise(object_)
    return F.coalesce(F.when(is_json(t), t), F.when(is_json(part), part))


def fenced_json(c: Column) -> Column:
    """The text inside the first code fence, else from the first brace or bracket on; null for blank text."""
    t = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    inside = F.regexp_extract(t, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    found = F.rlike(t, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"))
    rest = F.regexp_extract(t, r"(?s)[{\[].*", 0)
    out = F.when(found, F.regexp_replace(inside, r"\A\s+|\s+\z", "")).when(rest != "", rest).otherwise(t)
    return F.when((t != "") & is_json(out), out)


def ascii_json(c: Column) -> Column:
    """A JSON text with every letter beyond ASCII as \\uXXXX, in surrogate pairs beyond the first plane."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    n = F.floor(F.length(units) / 4).cast("int")
    hexes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(units, i * 4 + 1, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    letters = F.transform(hexes, lambda h: F.when(h < "0080", F.char(F.conv(h, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(h))))
    return F.array_join(letters, "")


# Signs of several solutions, and of solutions in code and in configuration.
SEVERAL = ("multiple related issues", "alternative fix", "2.", "option 2", "or")
CODE_FIXES, CONFIG_FIXES = ("change code", "modify file", "edit", "replace type", "fix annotation"), ("change config", "modify pyproject", "add plugin", "update toml")


def has_conflict(statement: Column, fix: Column) -> Column:
    """Several solutions, of which one changes code and another configuration."""
    holds = lambda c, words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(c), w))
    both = F.concat(statement, F.lit(" "), fix)
    return holds(statement, SEVERAL) & holds(both, CODE_FIXES) & holds(both, CONFIG_FIXES)


def percent(n: Column, d: Column) -> Column:
    return F.when(d == 0, "0.00%").otherwise(F.format_string("%.2f%%", F.bround(n / d * 100, 2)))


def folder_name(c: Column) -> Column:
    """The last segment of a name with runs of other letters than [A-Za-z0-9_.-] as one dash; `model` if nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(c, "\\Aopenrouter/", ""), "/"), -1)
    out = F.regexp_replace(F.regexp_replace(last, "[^A-Za-z0-9_.-]+", "-"), "\\A-+|-+\\z", "")
    return F.when(out == "", "model").otherwise(out)


def file_kind(c: Column) -> Column:
    """By the end of a path, tests first: test, config, docs, code or other; letters' case counts."""
    return (
        F.when(F.rlike(c, F.lit("_test\\.py\\z|/tests/")), "test").when(F.rlike(c, F.lit("\\.(toml|yaml|yml|json|ini|cfg)\\z")), "config")
        .when(F.rlike(c, F.lit("\\.(rst|md)\\z")), "docs").when(F.rlike(c, F.lit("\\.py\\z")), "code").otherwise("other")
    )


def compact_shell(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " && ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NaN if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(float("nan")))


def named_repo(name: Column, full: Column) -> Column:
    """A record's repository in lower case: its name, else the end of its full name; without either it raises."""
    own = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    end = F.nullif(F.element_at(F.split(F.trim(F.coalesce(full, F.lit(""))), "/"), -1), F.lit(""))
    return F.lower(F.coalesce(own, end, F.raise_error(F.lit("no repository")).cast("string")))


def usage_cost(given: Column, cached: Column, out: Column, reasoning: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    return (given - cached) * F.lit(price_in) + cached * F.lit(price_cached) + (out + reasoning) * F.lit(price_out)


def patch_error(message: Column) -> Column:
    """The first kind of error that a patch tool's message fits."""
    m = F.lower(message)
    return (
        F.when(F.contains(m, F.lit("does not exist in index")), "missing_file").when(F.rlike(m, F.lit("patch does not apply|patch failed:")), "context_mismatch")
        .when(F.rlike(m, F.lit("corrupt patch|patch fragment without header")), "corrupt_patch").when(F.contains(m, F.lit("lacks the necessary blob")), "missing_blob")
        .when(F.contains(m, F.lit("does not match index")), "index_mismatch").otherwise("unknown")
    )


def patch_error_files(kind: Column, message: Column, patch_files: Column) -> Column:
    """The files that a message of that kind names; of a corrupt patch the patch's own."""
    named = lambda pattern: F.regexp_extract_all(message, F.lit(pattern), F.lit(1))
    return (
        F.when(kind == "missing_file", named(r"error: ([^\s:]+): does not exist in index")).when(kind == "context_mismatch", named(r"error: patch failed: ([^\s:]+):\d+"))
        .when(kind == "corrupt_patch", patch_files).when(kind == "index_mismatch", named(r"error: ([^\s:]+): does not match index")).otherwise(F.array().cast("array<string>"))
    )


def item_text(kind: Column, role: Column, message: Column, parts: Column) -> Column:
    """What a search reads of a log item: user and agent messages without white space at their ends, and text parts of users and assistants; null for others."""
    strip = lambda c: F.nullif(F.regexp_replace(c, r"\A\s+|\s+\z", ""), F.lit(""))
    texts = F.transform(F.filter(parts, lambda p: p["type"].isin("input_text", "output_text")), lambda p: p["text"])
    joined = F.array_join(texts, " ")
    return F.when(kind.isin("user_message", "agent_message"), strip(message)).when((kind == "message") & role.isin("user", "assistant") & strip(joined).isNotNull(), joined)
