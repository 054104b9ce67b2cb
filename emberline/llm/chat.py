"""Chat formatting with DataFrame functions only.

A declarative template names, for each role, the marks that open and close a turn and whether
its text carries loss. A finite-state machine over the roles says whether the order of turns
is valid. Control strings inside texts are escaped reversibly: every backslash is doubled and
every control string gets a backslash after its first character, so the marks of the output
are exactly the template's own, and one pattern reads the turns back.

A conversation is one output value, so one task must hold it whole; nothing larger than one
conversation is ever gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Marks by role; `other` takes any further role, whose escaped name stands between `open` and `named`."""

    roles: dict[str, Turn]
    other: Turn
    named: str
    #: (state, role) -> state; what is missing leads to "invalid". Roles without an entry count as "other".
    moves: dict[tuple[str, str], str]
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    control: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = {self.named, self.other.open, self.other.close}
        for turn in self.roles.values():
            marks |= {turn.open, turn.close}
        object.__setattr__(self, "control", tuple(sorted(marks, key=lambda m: (-len(m), m))))
        for mark in self.control:
            if len(mark) < 2 or "\\" in mark:
                raise ValueError(f"a mark needs two characters and no backslash: {mark!r}")


DEFAULT = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>", False),
        "user": Turn("[INST]", "[/INST]", False),
        "assistant": Turn("<s>", "</s>", True),
    },
    other=Turn("[ROLE]", "[/TURN]", False),
    named="[/ROLE]",
    moves={
        ("start", "system"): "instructed", ("start", "user"): "asked", ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    },
)


def _any(strings) -> str:
    return "|".join(re.escape(s) for s in strings)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    inside = "|".join(f"(?<={re.escape(m[0])})(?={re.escape(m[1:])})" for m in template.control)
    return F.regexp_replace(doubled, inside, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles."""
    known = F.create_map(*(F.lit(x) for (a, r), b in template.moves.items() for x in (f"{a}\n{r}", b)))

    def move(state: Column, role: Column) -> Column:
        named = F.when(role.isin(*template.roles), role).otherwise("other")
        return F.coalesce(F.try_element_at(known, F.concat(state, F.lit("\n"), named)), F.lit("invalid"))

    return F.aggregate(roles, F.lit(template.start), move)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conv_id: roles' order checked, segments with loss flags, and the formatted text.

    Takes conv_id, turn, role, text; further columns are ignored. Null texts and roles are
    empty; a null conv_id is a conversation of its own; equal turn numbers go by role, then
    text; repeated rows are turns each; an empty table gives no rows. Conversations in an
    invalid order are formatted all the same, with valid = false.
    """
    r, t = F.col("x.role"), F.col("x.text")
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))

    def by_role(value) -> Column:
        out = None
        for role, turn in template.roles.items():
            out = F.when(r == role, value(turn)) if out is None else out.when(r == role, value(turn))
        return out.otherwise(value(template.other))

    name = F.when(r.isin(*template.roles), F.lit("")).otherwise(F.concat(escape(r, template), F.lit(template.named)))
    segment = F.struct(
        F.concat(by_role(lambda p: F.lit(p.open)), name).alias("open"),
        escape(t, template).alias("body"),
        by_role(lambda p: F.lit(p.close)).alias("close"),
        by_role(lambda p: F.lit(p.loss)).alias("loss"),
    )
    # escaping is done before the shuffle, row by row, inside generated code
    whole = rows.select("conv_id", F.struct("x.turn", "x.role", "x.text", segment.alias("s")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select(
        "conv_id",
        F.size("x").cast("long").alias("n_turns"),
        _state(F.transform("x", lambda e: e["role"]), template).isin(*template.accepting).alias("valid"),
        F.flatten(
            F.transform(
                "x",
                lambda e: F.array(
                    F.struct(e["s"]["open"].alias("text"), F.lit(False).alias("loss")),
                    F.struct(e["s"]["body"].alias("text"), e["s"]["loss"].alias("loss")),
                    F.struct(e["s"]["close"].alias("text"), F.lit(False).alias("loss")),
                ),
            )
        ).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Turns (role, text, loss) from the formatted text alone, in the column `turns`."""
    opens = [t.open for t in template.roles.values()] + [template.other.open]
    closes = [t.close for t in template.roles.values()] + [template.other.close]
    turn = f"(?s)(?:{_any(opens)}).*?(?:{_any(closes)})"

    def parsed(s: Column) -> Column:
        role, body, loss = None, None, None
        for name, t in template.roles.items():
            inner = F.substr(s, F.lit(len(t.open) + 1), F.char_length(s) - len(t.open) - len(t.close))
            here = F.startswith(s, F.lit(t.open))
            role = F.when(here, F.lit(name)) if role is None else role.when(here, F.lit(name))
            body = F.when(here, inner) if body is None else body.when(here, inner)
            loss = F.when(here, F.lit(t.loss)) if loss is None else loss.when(here, F.lit(t.loss))
        o = template.other
        inner = F.substr(s, F.lit(len(o.open) + 1), F.char_length(s) - len(o.open) - len(o.close))
        cut = F.position(F.lit(template.named), inner)
        role = role.otherwise(F.substr(inner, F.lit(1), cut - 1))
        body = body.otherwise(F.substr(inner, cut + len(template.named), F.char_length(inner)))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"), loss.otherwise(F.lit(o.loss)).alias("loss"))

    return formatted.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(turn), F.lit(0)), parsed))


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = rows_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(probe)
    read = read_back(format_conversations(turns))
    # what the segments' own flags put under the mask
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql(template: Template = DEFAULT) -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for m in template.control:
            out = f"replace({out}, {lit(m)}, {lit(m[0] + chr(92) + m[1:])})"
        return out

    marks = " ".join(f"WHEN role = {lit(r)} THEN {len(t.open) + len(t.close)}" for r, t in template.roles.items())
    other = len(template.other.open) + len(template.other.close) + len(template.named)
    loss = ", ".join(lit(r) for r, t in template.roles.items() if t.loss)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE {marks} ELSE {other} + length({escaped("role")}) END + length({escaped("text")}) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  -- the machine's moves as a pattern over the first letters of the roles
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'o' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM f GROUP BY conv_id
"""


OP2_SQL = _sql()
