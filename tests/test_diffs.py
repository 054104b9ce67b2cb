"""Diff functions against plain versions, line by line."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import diff as D


def section(rng, k):
    path = f"src/{rng.choice('abc')}{k}.py"
    hunks = [f"@@ -{h},2 +{h},3 @@\n " + "x" * rng.randint(0, 60) + f"\n+y{h}\n" for h in range(1, rng.randint(1, 5))]
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n" + "".join(hunks)


def plain_chunks(diff, limit):
    """(tokens, files, text) of the chunks: every section is a list of lines, as a reader of the whole text by lines sees it."""
    parts, size = [], lambda t: len(t) // 4
    for line in diff.split("\n"):
        if line.startswith("diff --git"):
            parts.append([line])
        elif parts:
            parts[-1].append(line)
    out, room = [], None  # room: the chunk that may still grow
    for part in parts:
        path, text = part[0].split(" b/")[1], "\n".join(part)
        if size(text) <= limit:
            if room is None or room[0] + size(text) > limit:
                out.append(room := [0, [], ""])
            room[0] += size(text)
            room[1].append(path)
            room[2] += text + "\n"
            continue
        room = None
        marks = [i for i, x in enumerate(part) if x.startswith("@@")]
        if not marks:
            out.append([size(text), [path], text])
            continue
        head = "\n".join(part[: marks[0]])
        hunks = ["\n".join(part[a:b]) for a, b in zip(marks, [*marks[1:], len(part)])]
        own = []
        for hunk in hunks:
            if not own or own[-1][0] + size(hunk) > limit:
                own.append([size(head), [path], head])
            own[-1][0] += size(hunk)
            own[-1][2] += "\n" + hunk
        out += own
    return [tuple(x) for x in out]


def test_chunks_against_plain(spark):
    rng = random.Random(2)
    texts = ["", "no diff\n", section(rng, 0)] + [rng.choice(["", "head\n"]) + "".join(section(rng, k) for k in range(rng.randint(1, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", D.file_chunks(F.col("t"), 40).alias("c")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(c["tokens"], c["files"], c["diff"]) for c in r["c"]] == plain_chunks(r["t"], 40)


def test_repairs(spark):
    cases = {
        "@@ -1,2 +1,3 @@\n a\n+b": ("ok", 1), "@@ -1 +1 @@\n-a\n+b\n": ("ok", 0), "": ("empty", None), "no hunk": ("ok", 0),
        "@@ -1,2 +1,2 @@\n a\n@@ -9,1 +9,1 @@\n a\n": ("an earlier hunk", None), "@@ -1,3 +1,2 @@\n a\n": ("the last hunk", None), "@@ -1,1 +1,1 @@\n a\n b\n": ("the last hunk", None),
        "@@ -1,1 +1,1 @@\n a\n\\ No newline at end of file\n": ("ok", 0), "@@ -0,0 +1,1 @@\n+a\ndiff --git a/x b/x\n@@ -1,2 +1,2 @@\n a": ("ok", 1),
    }
    for text, (problem, deficit) in cases.items():
        r = spark.createDataFrame([(text,)], "t string").select(D.repair(F.col("t")).alias("r")).first()["r"]
        assert (r["problem"] or "ok", r["deficit"]) == (problem, deficit), text
        if deficit is not None:
            assert r["repaired"] == text + ("" if text.endswith("\n") else "\n") + " \n" * deficit


def test_records_and_sizes(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first()["x"]
    assert one(D.records(F.col("t")), " \n") == []
    with pytest.raises(Exception, match="text before the diff"):
        one(D.records(F.col("t")), "junk\ndiff --git a/x b/x\n")
    x, y = one(D.records(F.col("t")), "\ndiff --git a/x b/x\nold mode\ndiff --git a/y b/y\n@@ -1 +1 @@\n+a\n@@ -5 +5 @@\n")
    assert (x["header"], x["hunks"]) == ("diff --git a/x b/x\nold mode\n", "") and y["hunks"] == "@@ -1 +1 @@\n+a\n@@ -5 +5 @@\n"
    assert [one(D.two_digits(F.lit(v)), "") for v in (0.125, 0.375, 2.0, 0.0049)] == ["0.12", "0.38", "2.00", "0.00"]
    assert one(D.binary_summary(F.col("t")), "a\nliteral 1048576\nindex 1") == "[BINARY FILE: 1.00MB]" and one(D.binary_summary(F.col("t")), "a") == "[BINARY FILE CHANGE]"
    assert one(D.header_summary(F.col("t")), "\n".join(["x"] * 20 + ["@@ late"])) == "[LARGE DIFF REMOVED: 0.05KB]"


def test_added_lines_cut_a_section_once(spark):
    """The lines of a section stand once in the expression, and parts are those of a plain reading."""
    assert D.added_lines(F.col("t"))._jc.toString().count("split(") == 1
    texts = ["", "+a\n-b\n", "--- a/x\n+++ b/x y \n+early\n@@ -1 +1 @@\n c\n+++ z\n-- q\n@@ x\n+n\n\\ No\n", "+++ /dev/null\n@@ -1 +0,0 @@\n-gone", "no sign\n+++ a/b\n+++ plain\n@@ @@"]

    def plain(t):
        lines = t.removesuffix("\n").split("\n")
        at = next((i for i, x in enumerate(lines) if x.startswith("@@ ")), len(lines))
        head, body = lines[:at], [x for x in lines[at:] if not x.startswith("@@ ")]
        plus = [x for x in head if x[:1] == "+" and not x.startswith("+++ ")] + [x for x in body if x[:1] == "+"]
        minus = [x for x in head if x[:1] == "-" and not x.startswith("--- ")] + [x for x in body if x[:1] == "-"]
        given = [x[4:].strip(" ") for x in head if x.startswith("+++ ")]
        path = given[-1] if given and given[-1] != "/dev/null" else None
        return len(plus), len(minus), path[2:] if path and path[:2] in ("a/", "b/") else path, [x[1:] for x in plus]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.added_lines(F.col("t")).alias("r")).collect()
    assert {r["t"]: tuple(r["r"]) for r in rows} == {t: plain(t) for t in texts}
