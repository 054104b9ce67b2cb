"""Logs by byte ranges, projections, versions of tables, similar vectors, staged retrieval, Markdown and workflows against plain versions."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from emberline.functions import markdown, workflows
from emberline.operators import history as H
from emberline.operators import relational as R
from emberline.operators import similarity as Y
from emberline.operators import staged as S
from emberline.operators.textindex import TextIndex
from emberline.plans import files as Q
from emberline.sources import io, listing, ranges
from emberline.sources.predictions import repair_in_place
from emberline.sources.versioned import Conflict, VersionedTable
from emberline.streaming import projection


def test_records_backward_in_any_cut():
    rng = random.Random(1)
    for _ in range(500):
        data = bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(60)))
        limit = rng.randrange(len(data) + 1)
        want, at = [], 0
        for x in data[:limit].split(b"\n"):
            want.append((at, at + len(x), x))
            at += len(x) + 1
        size, chunk = rng.choice([1, 3, 7, 20, 100]), rng.choice([1, 2, 5, 100])
        got = []
        for start in range(0, limit, size):
            got += list(ranges.records_backward(lambda n, i: data[i : i + n], start, min(start + size, limit), limit, chunk))[::-1]  # noqa: B023
        assert got == [w for w in want if w[0] < limit]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    lines = [json.dumps({"k": i, "t": "ü" * (i % 50)}, ensure_ascii=False) if i % 5 else ("", "{", " \t")[i % 3] for i in range(4000)]
    data = "\n".join(lines).encode() + b"\n\xff\xfe\nlast"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_bytes(data)
    (tmp_path / "log" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "log" / ".hidden").write_bytes(b"{}\n")
    frozen = len(data) - 2  # cuts the last line
    df = ranges.read_backward(spark, str(tmp_path / "log"), "k int, t string", {str(tmp_path / "log" / "a.jsonl"): frozen}, range_bytes=16 << 10)
    rows = sorted(df.collect(), key=lambda r: r["back"])
    want, at = [], 0
    for x in data[:frozen].split(b"\n"):
        if x.strip(ranges.BLANK):
            try:
                k = json.loads(x)["k"]
            except ValueError:
                k = None
            want.append((at, at + len(x), k))
        at += len(x) + 1
    assert [(r["first"], r["last"], r["row"] and r["row"]["k"]) for r in rows] == want[::-1]
    assert [r["rejected"] for r in rows] == [k is None for _, _, k in want[::-1]] and [r["back"] for r in rows] == list(range(1, len(want) + 1))
    tasks = ranges._load(spark, str(tmp_path / "log"), rangeBytes=16 << 10).select(F.spark_partition_id()).distinct().count()
    assert tasks > 3
    counts = {r["file"].split("/")[-1]: r["newlines"] for r in ranges.newline_counts(spark, str(tmp_path / "log"), 1 << 10).collect()}
    assert counts == {"a.jsonl": data.count(b"\n")}
    assert ranges.newline_counts(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="past the file"):
        ranges.read_backward(spark, str(tmp_path / "log"), "k int", {str(tmp_path / "log" / "a.jsonl"): len(data) + 1}).collect()


CHUNK = "thread string, start_offset long, next_offset long, lines array<struct<ordinal:long,text:string>>"


def polled(spark, tmp_path, chunks):
    if chunks:
        spark.createDataFrame(chunks, CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = projection.tail(spark, str(tmp_path / "log"), CHUNK)
    projection.project(log, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return sorted((r["thread"], r["ordinal"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


@pytest.mark.parametrize("bad", [("a", 30, 40, [(5, "gap")]), ("a", 31, 40, [(3, "start")]), ("b", 0, 5, [(0, "again")])])
def test_projection_compares_batches(spark, tmp_path, bad):
    """A gap between two batches, a start that is not the stored offset and a chunk that comes again all raise; what was written stays."""
    first = [("a", 10, 30, [(1, "y"), (2, "z")]), ("a", 0, 10, [(0, "x")]), ("b", 0, 5, [(0, "u")]), ("c", 0, 7, [])]
    want = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "u")]
    assert polled(spark, tmp_path, first) == want
    assert polled(spark, tmp_path, []) == want  # nothing new changes nothing
    with pytest.raises(StreamingQueryException):
        polled(spark, tmp_path, [bad])
    assert sorted((r["thread"], r["ordinal"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_projection_goes_on(spark, tmp_path):
    polled(spark, tmp_path, [("a", 0, 10, [(0, "x")]), ("c", 0, 7, [])])
    assert polled(spark, tmp_path, [("a", 10, 20, [(1, "y")]), ("c", 7, 9, [(0, "v")])]) == [("a", 0, "x"), ("a", 1, "y"), ("c", 0, "v")]


@pytest.mark.parametrize("claim", ["_link", "_rename"])
def test_versions_of_a_table(spark, tmp_path, monkeypatch, claim):
    monkeypatch.setattr(VersionedTable, "_link", getattr(VersionedTable, claim) if claim == "_rename" else VersionedTable.__dict__["_link"])
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v int", "k", 4)
    own = lambda rows: spark.createDataFrame(rows, "k string, v int")
    read = lambda version=None: sorted(map(tuple, table.read(version).collect()))
    assert read() == [] and table.version() == 0
    assert table.upsert(own([("a", 1), ("b", 1), ("b", 1)])) == 1
    seen = []

    def meanwhile(attempt):
        seen.append((attempt, read()))
        if attempt == 0:
            VersionedTable(spark, table.path, table.schema, "k", 4).upsert(own([("c", 3), ("a", 9)]))

    assert table.upsert(own([("a", 2), ("d", 4)]), meanwhile) == 3
    # readers between the steps see whole versions; the second attempt started from the other writer's rows
    assert seen == [(0, [("a", 1), ("b", 1)]), (1, [("a", 9), ("b", 1), ("c", 3)])]
    assert read() == [("a", 2), ("b", 1), ("c", 3), ("d", 4)] and read(1) == [("a", 1), ("b", 1)]
    used = sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    assert len(used) == 3  # the attempt that lost left nothing
    table.replace(own([("z", 0)]))
    table.vacuum(keep=1)
    assert read() == [("z", 0)] and table.versions() == [4] and len(list((tmp_path / "t" / "data").iterdir())) == 1
    with pytest.raises(Conflict):
        table.upsert(own([("y", 1)]), lambda attempt: VersionedTable(spark, table.path, table.schema, "k", 4).replace(own([("z", attempt)])))


def brute(v):
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    return np.round(u @ u.T, 9)


@pytest.mark.parametrize(("threshold", "block"), [(0.7, 4096), (0.9, 40), (0.3, 64)])
def test_threshold_join_equals_all_pairs(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(Y, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24)) * np.linspace(2, 0.1, 24)
    v = centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 24)) * rng.choice([0.02, 0.3], 600)[:, None]
    v[500:520] = v[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(v)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (None, [1.0] * 24), (903, [1.0, 2.0]), (904, [2.0, 4.1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs, members, counts = Y.threshold_join(df, threshold, "id", "v")
    reps = {r["id"]: r["rep"] for r in members.collect()}
    assert reps[519] == 0 and set(reps) == {*range(600), 903, 904}
    s = brute(v)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= threshold and reps[i] == i and reps[j] == j}
    got = {(r["a"], r["b"]): r["score"] for r in pairs.collect()}
    assert set(got) == want | {(903, 904)} and all(abs(got[p] - s[p]) < 1e-8 for p in want)
    c = {r["dim"]: r for r in counts.collect()}[24]
    assert len(want) <= c["scored"] < c["pairs"] and c["met"] <= c["pairs"]
    if threshold == 0.9:
        assert c["met"] < c["pairs"] * 3 / 4 and c["scored"] < c["pairs"] / 10
    links = {r["id"]: r["links"] for r in Y.linked_counts(df, threshold, "id", "v").collect()}
    assert all(links[i] == int((s[i] >= threshold).sum()) - 1 for i in range(600))


def test_counts_and_clusters_over_many_blocks(spark, monkeypatch):
    """Small blocks, dealt a few rows at a time: counts for two thresholds and all clusters are those of all pairs."""
    for name, n in (("BLOCK", 40), ("DEALT", 30), ("STEP", 16), ("EXACT", 25)):
        monkeypatch.setattr(Y, name, n)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.02, 0.3], 400)[:, None]
    v[300:320], v[320:330] = v[0], -v[1]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)] + [(900, None), (903, [1.0, 2.0]), (904, [2.0, 4.1])], "id long, v array<double>")
    s = brute(v)
    np.fill_diagonal(s, -2)
    got = {r["id"]: r for r in Y.link_counts(df, (0.9, 0.5), "id", "v").collect()}
    assert set(got) == {*range(400), 903, 904} and got[903]["links"] == [1, 1]
    for i in range(400):
        assert got[i]["links"] == [int((s[i] >= 0.9).sum()), int((s[i] >= 0.5).sum())]
        assert (got[i]["best"] is None) == (s[i].max() < 0.5) and (got[i]["best"] is None or abs(got[i]["best"] - s[i].max()) < 2e-9)
    clusters = {r["id"]: r["clusters"] for r in Y.exact_clusters(df, (0.97, 0.7), "id", "v").collect()}
    for k, t in enumerate((0.97, 0.7)):
        label = np.arange(400)
        while (new := np.minimum(label, np.where(s >= t, label[None, :], 400).min(axis=1))).tolist() != label.tolist():
            label = new
        assert [clusters[i][k] for i in range(400)] == label.tolist() and clusters[904][k] == 903


@pytest.mark.parametrize("block", [4096, 50])
def test_similar_clusters_recall(spark, monkeypatch, block):
    """Share of all pairs over the threshold that end in one cluster, and no cluster that all pairs would not make."""
    monkeypatch.setattr(Y, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 32))
    v = np.concatenate([base, base[:300] + 0.55 * rng.normal(size=(300, 32)), np.repeat(base[5:6], 150, axis=0)])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in Y.similar_clusters(df, 0.85, "id", "v").collect()}
    s = brute(v)
    a, b = np.nonzero(np.triu(s >= 0.85, 1))
    root = list(range(len(v)))
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = i, j
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    top = lambda i: i if root[i] == i else top(root[i])
    found = sum(got[i] == got[j] for i, j in zip(a.tolist(), b.tolist()))
    distinct = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < 1200 and j < 1200]
    assert found / len(a) >= 0.9 and sum(got[i] == got[j] for i, j in distinct) / len(distinct) >= 0.9
    assert all(top(i) == top(got[i]) for i in got)
    assert Y.bands_for(0.85, 12, 0.9) == math.ceil(math.log(0.1) / math.log(1 - (1 - math.acos(0.85) / math.pi) ** 12))


def test_stages_are_left_out_and_checked(spark):
    m = "level string, memory bigint, repo string, workflow string, kind string, signal string, issue string, text string, enables array<bigint>, enabled_by array<bigint>"
    memory = spark.createDataFrame(
        [
            ("L1", 1, "o/r", "ci", "lint", "", "i1", "unused import in module", [2], []), ("L1", 2, "o/r", "ci", "lint", "", "i1", "other words here", [], []),
            ("L1", 3, "o/x", "ci", "lint", "unused", "i2", "unused import again", [], []), ("L1", 4, "r", "nightly", "lint", "unused", "i3", "unused import", [], []),
            ("L3", 5, None, None, None, "", "i4", "import of patterns", [], []), ("L2", 6, "o/r", None, "lint", "unused", "i5", "nothing alike", [], [])], m)
    queries = spark.createDataFrame([(7, "o/r", "ci", "lint", "an unused import was found"), (8, "z/z", "ci", "x", None)], "query bigint, repo string, workflow string, kind string, text string")
    asked = S.Asked(queries, memory)
    run = lambda ablation, levels=("L1", "L2", "L3"): {(r["query"], r["memory"]): (r["source"], r["place"]) for r in S.Plan().without(ablation).run(S.Asked(queries, memory, levels)).collect()}
    full = run(None)
    assert full == {(7, 1): ("direct", 1), (7, 5): ("direct", 2), (7, 2): ("dependency_enabled", 3), (7, 6): ("recurring", 4)}
    assert set(run("no_applicability_filter")) == {(7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (7, 6)}
    assert set(run("no_dependency_expansion")) == {(7, 1), (7, 5), (7, 6)} and set(run("no_recurring_recall")) == {(7, 1), (7, 2), (7, 5)}
    assert set(run("no_hidden_problems")) == {(7, 1), (7, 5)} and {p for _, p in run("no_ordering").values()} == {None}
    assert run(None, ()) == {} and (7, 5) not in run(None, ("L1",))
    with pytest.raises(TypeError, match="stage search"):
        S.Plan((S.Stage("search", lambda df, a: df.drop("place")),)).run(asked)


MARKDOWN = [
    ("# Title #\n\npara *em* **strong** ***both*** `code *x*`", "Title para em strong both code *x*"), ("a_b_c and _em_ and __strong__ 2*3*4 a * b", "a_b_c and em and strong 234 a * b"),
    ("- one\n- two\n  more\n\n1. three\n2) four", "one two more three four"), ("> quote\n> > deep\nlazy", "quote deep lazy"), ("```py\nx = *1*\n# no\n```\nafter", "x = *1* # no after"),
    ("~~~\n```\n~~~\ndone", "``` done"), ("    code *x*\n\ntext", "code x text"), ("Head\n====\nSub\n---\ntext\n\n***\nend", "Head Sub text end"),
    ('[link](http://x/y "t") ![alt](i.png) [![in](a)](b) <http://a.b/c_d_e>', "link alt in http://a.b/c_d_e"), ("[ref][a] [a] [Other][] [none]\n\n[a]: http://x\n[other]: <u> 'T'", "ref a Other [none]"),
    ("a &amp; b &lt;c&gt; &#65; &#x42; &nosuch;", "a & b <c> A B &nosuch;"), ("<b>bold</b> text <!-- c -->", "<b>bold</b> text <!-- c -->"),
    ("\\*no\\* \\`tick\\` back\\\\slash \\q", "*no* `tick` back\\slash \\q"), ("line one  \nline two\\\nthree", "line one line two three"), ("`` a ` b `` and ` open", "a ` b and ` open"), ("", ""),
    ("**a *b* c** *d **e** f*", "a b c d e f"), ("x\n\n    code *x*\n\n<div>\n*raw* &amp;\n</div>\n\n*em*", "x code *x* <div> *raw* &amp; </div> em"), ("word\u00a0x\u2003y", "word x y"),
    ("* * *\n- - -\nx", "x"), ("####### seven", "####### seven"), ("**unclosed and *x", "**unclosed and *x"), (None, None), ("```\nnever closed *x*", "never closed *x*"), ("a\r\n\r\nb", "a b"),
]


def test_markdown_literals(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MARKDOWN)], "i int, m string")
    got = {r["i"]: r["p"] for r in df.select("i", markdown.search_text(F.col("m")).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(MARKDOWN)}


WORKFLOW = """# c
name: CI
on: [push]
env:
  A: "x # y"
jobs:
  build:   # note
    name: "Build: all"
    strategy:
      matrix:
        py: [3.10, 3.11]
    steps:
    - uses: actions/checkout@v4
      with:
        fetch-depth: 0
    - name: Install
      run: |
        pip install -r requirements.txt

          indented
        pytest
    - run: echo "a: b"  # said
      env:
        - X
    -
      name: 'it''s'
      run: >-
        folded
        text
    - run: false
  lint:
    steps:
      - run: ruff check .
        name: Lint
      - run:
          make
          all
  empty:
    steps:
  odd: text
"""


def test_workflow_files(spark):
    bad = ["a:\n\tb: 1", "jobs:\n  a:\n b: 1", "x", "jobs: &a\n  b: 1", "- a\n- b", "jobs:\n  a:\n    steps:\n    - run: 'x\n"]
    rows = [("w", WORKFLOW), ("none", None), ("nothing", ""), ("list", "jobs: []"), *((f"bad{i}", b) for i, b in enumerate(bad))]
    got = workflows.command_candidates(spark.createDataFrame(rows, "path string, text string"), "path", "text").orderBy("path", "place").collect()
    steps = [(r["place"], r["command"], r["job"], r["step"], r["text"], r["source"]) for r in got if r["path"] == "w"]
    assert steps == [
        (0, "pip install -r requirements.txt && indented && pytest", "Build: all", "Install", "build Build: all Install", "workflow:w"), (1, 'echo "a: b"', "Build: all", 'echo "a: b"', 'build Build: all echo "a: b"', "workflow:w"),
        (2, "folded text", "Build: all", "it's", "build Build: all it's", "workflow:w"), (3, "ruff check .", "lint", "Lint", "lint lint Lint", "workflow:w"), (4, "make all", "lint", "make all", "lint lint make all", "workflow:w")]
    assert {r["path"]: (r["bad"], r["place"]) for r in got if r["path"] != "w"} == {**{f"bad{i}": (True, None) for i in range(len(bad))}, "none": (False, None), "nothing": (False, None), "list": (False, None)}


def test_predictions_are_repaired_where_they_lie(spark, tmp_path):
    head = "diff --git a/x b/x\n--- a/x\n+++ b/x\n"
    fine = head + "@@ -1,2 +1,2 @@\n a\n-b\n+c"
    cut = head + "@@ -1,4 +1,4 @@\n a\n-b\n+c"
    odd = head + "@@ -1,5 +1,4 @@\n a\n-b\n+c"
    rows = [("1", fine, 5), ("2", cut, 5), ("3", odd, None), ("4", "", 0), ("5", None, None), ("6", cut, None)]
    table = VersionedTable(spark, str(tmp_path / "t"), "id string, diff string, patch_bytes long", "id", 2)
    table.replace(spark.createDataFrame(rows, table.schema))
    dry = repair_in_place(table, dry_run=True).first().asDict()
    assert dry == {"selected": 3, "repaired": 2, "already_valid": 0, "unrepairable": 1, "deficits": {2: 2}, "selection": "scan", "dry_run": True, "written": False} and table.version() == 1
    with pytest.raises(ValueError, match="'9'"):
        repair_in_place(table, spark.createDataFrame([("9",), ("2",)], "id string"))
    report = repair_in_place(table, spark.createDataFrame([("1",), ("2",), ("2",)], "id string")).first().asDict()
    assert (report["selected"], report["repaired"], report["already_valid"], report["selection"], report["written"]) == (2, 1, 1, "report", True)
    whole = cut + "\n \n \n"
    want = {r[0]: r for r in rows} | {"2": ("2", whole, len(whole))}
    assert {r["id"]: tuple(r) for r in table.read().collect()} == want
    repair_in_place(table)
    assert {r["id"]: tuple(r) for r in table.read().collect()} == want | {"6": ("6", whole, None)}
    again = repair_in_place(table).first().asDict()
    assert (again["selected"], again["repaired"], again["written"]) == (1, 0, False)


def test_small_files_are_listed_and_dealt(spark, tmp_path):
    for k in range(40):
        folder = tmp_path / "tree" / f"run={k}" / "deep"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(f'{{"k": {k}}}\n\n{{"k": -1}}\n')
        (folder / "_skipped").write_text("x")
    (tmp_path / "tree" / "top.json").write_bytes(b"\xff")
    files = listing.list_files(spark, str(tmp_path / "tree"))
    assert files.count() == 41 and files.agg(F.sum("size")).first()[0] == sum(p.stat().st_size for p in (tmp_path / "tree").rglob("*.json"))
    lines = listing.read_files(files.where("path LIKE '%run=%'")).select(F.regexp_extract("path", "run=([^/]*)", 1).alias("run"), F.get_json_object("value", "$.k").alias("k")).collect()
    assert sorted((int(r["run"]), int(r["k"])) for r in lines) == sorted((k, x) for k in range(40) for x in (k, -1))
    whole = {r["path"].split("/")[-1]: r["value"] for r in listing.read_files(files, whole=True).collect()}
    assert whole["a.json"].endswith('{"k": -1}') and whole["top.json"] == "�"
    assert listing.list_files(spark, str(tmp_path / "none")).count() == 0 and listing.read_files(files.limit(0)).count() == 0
    assert listing.list_files(spark, str(tmp_path / "tree" / "top.json")).count() == 1


def test_files_are_written_by_tasks(spark, tmp_path, sf_dir, monkeypatch):
    """A file a row, whole, in folders that the driver need not list; nothing beside them is left, and the result's texts come back."""
    rows = [(f"bucket={k % 3}/folder={k}/a.txt", [f"text {k}\n\n", "ü", "", None][k % 4]) for k in range(60)]
    listing.write_files(spark.createDataFrame(rows, "name string, value string"), f"file:{tmp_path}/tree")
    listing.write_files(spark.createDataFrame(rows[:9], "name string, value string"), f"file:{tmp_path}/tree")  # as a task that runs again
    assert {str(p.relative_to(tmp_path / "tree")): p.read_bytes() for p in (tmp_path / "tree").rglob("*") if p.is_file()} == {n: (v or "").encode() for n, v in rows}
    files = listing.list_files(spark, f"file:{tmp_path}/tree")
    assert {r["path"].split("/tree/")[1]: r["value"] for r in listing.read_files(files, whole=True).collect()} == {n: (v or "").removesuffix("\n") for n, v in rows}
    asked = []
    monkeypatch.setattr(listing, "bucket", lambda key, n=256, f=listing.bucket: asked.append(n) or f(key, n))
    got = Q.consolidated_patches(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 4 <> 2").select("user_id").distinct().count()
    assert got.count() == users and asked == [256, 256]


def test_startup_claims(spark):
    jobs = [("a", "s", None, 950, "idle", None, None, 1), ("b", "s", None, 940, "idle", None, None, 1), ("c", "s", 960, 930, "idle", None, None, 1), ("d", "s", None, 920, "idle", None, None, 1), ("old", "s", None, 10, "idle", None, None, 1), ("busy", "s", None, 999, "idle", None, None, 1), ("far", "x", None, 945, "idle", None, None, 1), ("none", None, None, 945, "idle", None, None, 1), ("late", "s", None, 800, "idle", None, None, 1)]
    df = spark.createDataFrame(jobs, "id string, source string, output_at long, source_at long, status string, leased_at long, retry_at long, retries int")
    run = lambda scan, most: {r["id"]: r["outcome"] for r in H.startup_claims(df, 1000, 100, scan, most, 500, 50, ("s",)).collect()}
    assert run(4, 2) == {"a": "claimed", "b": "claimed", "c": "up_to_date", "d": "left"}
    assert run(10, 10) == {"a": "claimed", "b": "claimed", "c": "up_to_date", "d": "claimed", "late": "claimed"} and run(0, 5) == {}


def test_last_row_of_a_key_counts(spark):
    df = spark.createDataFrame([(1, "x", "y", 1), (2, "y", None, 2), (3, "", "x", 0)], "v int, a string, b string, n int")
    assert {r["key"]: r["v"] for r in R.key_bridge(df, "v", "a", "b", order="n").collect()} == {"x": 1, "y": 2}


def test_list_elements_in_any_cut():
    rng = random.Random(3)

    def some(depth=0):
        k = rng.randrange(6 if depth < 3 else 4)
        if k < 4:
            return (rng.randrange(100), rng.choice(["a,b", "[x", '}"\\', 'é"', ""]), None, 1.5)[k]
        return [some(depth + 1) for _ in range(rng.randrange(4))] if k == 4 else {rng.choice(["a", "b]", '"']): some(depth + 1) for _ in range(rng.randrange(3))}

    def cut(data, chunk):
        return list(ranges.list_elements(lambda n, i: data[i : i + n], len(data), chunk))

    for _ in range(400):
        x = [some() for _ in range(rng.randrange(6))]
        data = (rng.choice(["", " \n"]) + json.dumps(x, indent=rng.choice([None, 1]), ensure_ascii=False) + rng.choice(["", " \n"])).encode()
        got = cut(data, rng.choice([1, 2, 3, 7, 1000]))
        assert [json.loads(b) for *_, b in got] == x and all(data[a:b] == v for a, b, v in got)
        with pytest.raises(ValueError):  # noqa: PT011
            cut(data.rstrip()[: rng.randrange(len(data.rstrip()))], 3)
    for bad in (b"[1,]", b"[,1]", b"[1] x", b"{}", b"", b"x[1]", b"[1}"):
        with pytest.raises(ValueError):  # noqa: PT011
            cut(bad, 3)


def test_lists_and_lines_by_ranges(spark, tmp_path):
    lines = [json.dumps({"id": str(i % 700), "conclusion": "success" if i % 3 else "x"}) for i in range(5000)]
    (tmp_path / "a.json").write_text("\n\n".join(lines))
    (tmp_path / "b.json").write_text("\n [" + ",\n".join(lines[:900]) + "]")
    (tmp_path / "c.json").write_text("[" + ",".join(lines[:5]))
    rows = ranges.json_rows(spark, str(tmp_path / "*.json"), range_bytes=16 << 10)
    counts = {r["file"].split("/")[-1]: r["count"] for r in rows.groupBy("file").count().collect()}
    assert counts == {"a.json": 5000, "b.json": 900, "c.json": 5} and rows.select(F.spark_partition_id()).distinct().count() > 3
    assert io.read_json_any(spark, str(tmp_path / "*.json"), "id string").count() == 5900 and io.read_list(spark, str(tmp_path / "*.json"), "id string").count() == 900
    won = {r["id"]: r["won"] for r in io.read_outcomes(spark, str(tmp_path / "a.json")).collect()}
    assert won == {str(i % 700): int(bool(i % 3)) for i in range(5000)}


def test_index_ranks_as_a_full_scan(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.choice(["a", "b"]), i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 30)))) for i in range(800)]
    rows += [("c", 900, "w1 w1"), ("c", 901, None), ("c", 902, "stop"), ("a", 903, rows[0][2])]
    df = spark.createDataFrame(rows, "level string, id long, text string")
    index = TextIndex.build(df, str(tmp_path / "i"), features=50, stop_words=("stop",))
    tf = [dict(Counter(w for w in (t or "").split() if w != "stop")) for _, _, t in rows]
    df_, total = Counter(w for c in tf for w in c), Counter()
    for c in tf:
        total.update(c)
    idf = {w: math.log((1 + len(rows)) / (1 + df_[w])) + 1 for w in sorted(total, key=lambda w: (-total[w], w))[:50]}

    def unit(c):
        x = {w: n * idf[w] for w, n in c.items() if w in idf}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / length for w, v in x.items()}

    for text in ("w40 w0 w45", "w59 w58 w0 w0 w1", "w1", "stop none", "w30 w31 w32 w33 w0"):
        q = unit(Counter(w for w in text.split() if w in idf))
        want = []
        for level in ("a", "b", "c"):
            scored = sorted((-round(sum(q.get(w, 0) * v for w, v in unit(c).items()), 9), i) for (lv, i, _), c in zip(rows, tf) if lv == level)
            want += [(level, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
        got = [(r["level"], r["rank"], r["id"], r["score"]) for r in index.search(text, 5).orderBy("level", "rank").collect()]
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, want))
        assert index.read <= index.total
    index.search("w40 w0 w45", 5)
    assert index.read < index.total * 0.8
