"""Markdown as plain text for search, as columns: a fold over lines finds blocks, a pass over tokens settles what is
literal, and patterns drop the inline marks that are left. Block ends and breaks become spaces.

Literal characters that could be marks stand as private-use characters until the end, so no later step takes
them for marks. Nested lists and quotes lose their marks level by level; of nested emphasis three levels are seen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may be marks, and what stands for them while they are literal.
MARKS = "\\`*_[]()<>!#&~|+-.:=\"'{}$%,/;?@^"
HELD = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
#: Named entities that are decoded; numbered ones are too.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "middot": "\u00b7", "times": "\u00d7", "euro": "\u20ac"}

#: Fixed values of the format: elements that begin a block of raw HTML, which lasts until an empty line.
BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param pre script search section style summary table "
    "tbody td textarea tfoot th thead title tr track ul"
).split()

_HTML = r"^ {0,3}</?(?i:" + "|".join(BLOCKS) + r")(?:[\s>]|/>|$)"
_CONTAINER = r"^( {0,3}>[ \t]?| {0,3}(?:[-+*]|[0-9]{1,9}[.)])(?=[ \t]|$)[ \t]{0,4})+"
_RULE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
_FENCE = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})"
_TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>"
_LINK = r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_TOKEN = rf"((?<!`)(`+)(?!`)(?:(?!\n\n)[\s\S])*?[^`]\2(?!`)|`+|\\\n|\\[!-/:-@\[-`{{-~]|{_LINK}|{_TAG}|{_ENTITY}|[^\\`<&]+|[\s\S])"
_DEFINITION = r"^ {0,3}\[([^\[\]]+)\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$"
_TARGET = r"\((?:<[^<>\n]*>|(?:[^\s()<]|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"
_INSIDE = r"((?:[^\[\]]|\[[^\[\]]*\])*)"


def held(c: Column) -> Column:
    return F.translate(c, MARKS, HELD)


def _kept(c: Column, mark: str) -> Column:
    """A literal's text between marks of its kind."""
    return held(F.regexp_replace(c, mark, ""))


def _lines(markdown: Column) -> Column:
    """(out, refs): the blocks' texts with an empty line between blocks, code held; and the names of reference definitions."""
    start = F.struct(F.lit("").alias("fence"), F.lit(False).alias("para"), F.lit("").alias("out"), F.array().cast("array<string>").alias("refs"))

    def step(s: Column, line: Column) -> Column:
        bare = F.when(F.rlike(line, F.lit(_RULE)), line).otherwise(F.regexp_replace(line, _CONTAINER, ""))
        inside, fence = s["fence"] != "", F.regexp_extract(bare, _FENCE, 1)
        trimmed = F.trim(bare)
        raw, html = s["fence"] == "<", F.rlike(bare, F.lit(_HTML))
        closes = inside & F.when(raw, trimmed == "").otherwise((F.length(F.regexp_replace(trimmed, "[`~]", "")) == 0) & F.startswith(trimmed, s["fence"]))
        code = ~s["para"] & F.rlike(bare, F.lit(r"^(?: {4}|\t)"))
        rule, under = F.rlike(bare, F.lit(_RULE)), s["para"] & F.rlike(bare, F.lit(r"^ {0,3}(?:=+|-+)[ \t]*$"))
        heading = F.rlike(bare, F.lit(r"^ {0,3}#{1,6}(?:[ \t]|$)"))
        title = F.regexp_replace(F.regexp_replace(bare, r"^ {0,3}#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t]*$", "")
        name = F.when(~s["para"], F.regexp_extract(bare, _DEFINITION, 1)).otherwise("")
        block = (bare != line) | rule  # a mark of its own begins a block
        end = F.lit("\n\n")
        text = (
            F.when(closes, end).when(inside, F.concat(F.lit("\n"), held(line))).when(fence != "", end).when(html, F.concat(end, held(bare))).when(code, F.concat(F.lit("\n"), held(bare)))
            .when(under | rule | (trimmed == "") | (name != ""), end).when(heading, F.concat(end, title, end)).when(block, F.concat(end, trimmed)).otherwise(F.concat(F.lit("\n"), trimmed))
        )
        plain = ~inside & (fence == "") & ~html & ~code & ~under & ~rule & (trimmed != "") & ~heading & (name == "")
        return F.struct(
            F.when(closes, "").when(inside, s["fence"]).when(html, "<").otherwise(fence).alias("fence"), plain.alias("para"), F.concat(s["out"], text).alias("out"),
            F.when(~inside & (name != ""), F.array_append(s["refs"], F.lower(name))).otherwise(s["refs"]).alias("refs"))

    return F.aggregate(F.split(F.regexp_replace(markdown, r"\r\n?", "\n"), "\n"), start, step)


def _token(t: Column) -> Column:
    """A token of running text: code, escapes, tags and entities become literal, the rest stays."""
    entity = F.regexp_extract(t, r"^&([^;]+);$", 1)
    number = F.when(F.startswith(F.lower(entity), F.lit("#x")), F.conv(F.substring(entity, 3, 9), 16, 10)).otherwise(F.substring(entity, 2, 9)).try_cast("int")
    named = F.element_at(F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair)), entity)
    code = F.regexp_replace(F.regexp_replace(t, r"^`+|`+$", ""), r"\n", " ")
    return (
        F.when(t == "\\\n", " ").when(F.rlike(t, F.lit(r"^`+[\s\S]*[^`]`+$")), held(code))
        .when(F.rlike(t, F.lit(r"^\\[!-/:-@\[-`{-~]$")), held(F.substring(t, 2, 1)))
        .when(F.rlike(t, F.lit(rf"^(?:{_LINK})$")), held(F.regexp_replace(t, "^<|>$", "")))
        .when(F.rlike(t, F.lit(rf"^(?:{_TAG})$")), held(t))
        .when(F.startswith(entity, F.lit("#")) & number.between(1, 65535) & ~number.between(0xD800, 0xDFFF), held(F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")))
        .when(named.isNotNull(), held(named)).otherwise(t)
    )


def search_text(markdown: Column) -> Column:
    """The text of a Markdown column with its marks dropped and white space collapsed; null stays null."""
    blocks = _lines(F.regexp_replace(markdown, r"(?U)^\s+|\s+$", ""))
    tokens = F.transform(F.regexp_extract_all(blocks["out"], F.lit(_TOKEN), F.lit(1)), _token)
    text = F.array_join(tokens, "")
    for _ in range(2):  # an image may lie in a link
        text = F.regexp_replace(text, rf"!?\[{_INSIDE}\]{_TARGET}", "$1")
    spans = rf"!?\[{_INSIDE}\](?:\[([^\[\]]*)\])?"
    # text and label of each possible reference, dropped only where the label is defined
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({spans})"), F.lit(1)))

    def refer(out: Column, span: Column) -> Column:
        inner, label = F.regexp_extract(span, f"^{spans}$", 1), F.regexp_extract(span, f"^{spans}$", 2)
        known = F.array_contains(blocks["refs"], F.lower(F.when(label == "", inner).otherwise(label)))
        return F.when(known, F.replace(out, span, inner)).otherwise(out)

    text = F.when(F.size(blocks["refs"]) > 0, F.aggregate(found, text, refer)).otherwise(text)
    for _ in range(3):
        text = F.regexp_replace(text, r"(\*{1,3})(?=[^\s*])((?:(?!\n\n)[^*])*?)(?<=[^\s*])\1", "$2")
        text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])(_{1,3})(?=[^\s_])((?:(?!\n\n)[\s\S])*?)(?<=[^\s_])\1(?![\p{L}\p{N}_])", "$2")
    return F.trim(F.regexp_replace(F.translate(text, HELD, MARKS), r"(?U)\s+", " "))
