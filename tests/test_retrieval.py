"""Retrieval operators against plain versions and the cases that define them."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from emberline import shared
from emberline.operators import retrieval as V
from emberline.operators import staged as S
from emberline.plans import retrieval as Q


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("quartz", "quartz", True), ("quartz-lab/quartz", "quartz-lab/quartz", True), ("quartz-lab/quartz", "quartz", True), ("repo", "owner/repo", True), ("quartz-lab/quartz", "other/repo", False), ("quartz", "meadow", False), ("owner/repo1", "owner/repo2", False), ("x/repo", "y/repo", False), ("", "quartz", False), ("quartz", "", False), ("", "", False)],
)
def test_same_repo(spark, a, b, same):
    assert spark.range(1).select(V.same_repo(F.lit(a), F.lit(b)).alias("x")).first()["x"] is same


def test_applicable_memories(spark):
    memory = spark.createDataFrame([("sha1", "owner/demo", "ci.yml"), ("sha2", "owner/demo", "test.yml"), ("sha3", "owner/other", "ci.yml"), ("sha4", "demo", None), ("sha5", "else/demo", "ci.yml")], "memory string, repo string, workflow string")
    query = spark.createDataFrame([("q", "owner/demo", "ci.yml")], "query string, repo string, workflow string")
    assert sorted(r["memory"] for r in V.applicable(query, memory).collect()) == ["sha1", "sha4"]


def test_applicable_in_blocks(spark, monkeypatch):
    """One repository has most rows: no task makes more than a share of the pairs, null ids stay, and all pairs are there once."""
    for name, n in (("QUERY_BLOCK", 40), ("MEMORY_BLOCK", 100), ("PAIRS", 500)):
        monkeypatch.setattr(V, name, n, raising=False)
    rng = random.Random(5)
    repo = lambda: rng.choice(["o/hot"] * 6 + ["hot", "p/hot", "", None, "x/y"])
    queries = [(i, repo(), rng.choice(["ci", "cd", None])) for i in range(300)] + [(None, "o/hot", "ci")]
    memory = [(i, repo(), rng.choice(["ci", "", None])) for i in range(1000)] + [(None, "hot", "")]
    same = lambda a, b: bool(a and b) and (a == b or (("/" not in a or "/" not in b) and a.split("/")[-1] == b.split("/")[-1]))
    want = sorted((str(q), str(m)) for q, a, f in queries for m, b, g in memory if same(a, b) and (not g or g == f))
    found = V.applicable(spark.createDataFrame(queries, "query long, repo string, workflow string"), spark.createDataFrame(memory, "memory long, repo string, workflow string"))
    assert sorted((str(r["query"]), str(r["memory"])) for r in found.collect()) == want
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares) / 4


def test_evidence_gate(spark):
    rows = [
        ("ci_failure", ["x.py"], None, None, []), ("dependency", ["libs/orbit/orbit/tools/mcp.py"], "type_checking", "mypy", ["ClientSession has no attribute"]),
        ("common", ["libs/orbit/orbit/utils/whatsapp.py"], "type checking", None, ["return value has type bytes, expected dict"]), ("common", ["orbit/utils/whatsapp.py"], "lint", "mypy", ["type bytes"]), ("common", [], "type checking", "mypy", ["type bytes"]),
    ]
    df = spark.createDataFrame(rows, "kind string, files array<string>, failure string, tool string, signals array<string>")
    one = lambda x: F.array(F.lit(x))
    status = V.evidence_status(*(F.col(c) for c in df.columns), one("orbit/utils/whatsapp.py"), one("type checking"), one("mypy"), F.lit("mypy: return value has type bytes, expected dict"))
    assert [r["s"] for r in df.select(status.alias("s")).collect()] == ["observed", None, "confirmed_in_target_failure", "confirmed_in_target_failure", None]


def test_expansion_against_recursion(spark, sf_dir):
    rng = random.Random(6)
    memory, hits = [], []
    for g in range(40):
        for p in range(1, rng.randint(2, 9)):
            memory.append((g, p, [rng.randint(0, 9) for _ in range(rng.randint(0, 3))], [rng.randint(0, 9) for _ in range(rng.randint(0, 2))]))
        hits += [(g, rng.randint(1, 5), rng.random(), k) for k in range(2)]
    want = {}
    known = {(g, p): (e, b) for g, p, e, b in memory}
    for g in range(40):
        out = []
        done = set()

        def visit(p, score, g=g, out=out, done=done):
            if p in done or (g, p) not in known:
                return
            done.add(p)
            out.append((p, round(score, 9)))
            for x in known[g, p][0] + known[g, p][1]:
                visit(x, score * 0.9)

        for _, p, s, _ in [h for h in hits if h[0] == g]:
            visit(p, s)
        want[g] = out
    m = spark.createDataFrame(memory, "grp long, problem long, enables array<long>, enabled_by array<long>")
    got = defaultdict(list)
    for r in V.expand_depth_first(m, spark.createDataFrame(hits, "grp long, problem long, score double, place int"), "grp").orderBy("grp", "place").collect():
        got[r["grp"]].append((r["problem"], round(r["score"], 9)))
    assert {g: v for g, v in want.items() if v} == dict(got)
    assert Q.expanded_problems(spark, sf_dir).where("place = 1 AND source <> 'direct'").count() == 0


def test_merging_against_plain(spark, sf_dir):
    rows = defaultdict(list)
    for r in Q.fix_groups(spark, sf_dir).where("grp < 200").collect():
        rows[r["grp"]].append(r)
    want = {}
    for g, items in rows.items():
        items.sort(key=lambda r: r["place"])
        left = list(items)
        while left:
            first, rest = left[0], left[1:]
            like = [r for r in rest if SequenceMatcher(None, first["fix"].lower(), r["fix"].lower()).ratio() > 0.8 or len(set(first["files"]) & set(r["files"])) / len(set(first["files"]) | set(r["files"])) > 0.5]
            want[g, first["problem"]] = [first["problem"], *(r["problem"] for r in like)]
            left = [r for r in rest if r not in like]
    got = {(r["grp"], r["problem"]): [int(x) for x in r["merged_from"].split(",")] for r in Q.merged_problems(spark, sf_dir).where("grp < 200").collect()}
    assert got == want


def test_stages_and_levels(spark):
    assert V.levels(" l1_L2 ") == ("L1", "L2") and V.levels("baseline") == () and V.levels("L3") == ("L3",)
    with pytest.raises(ValueError):
        V.levels("L2+L3")
    with pytest.raises(ValueError):
        V.without("nothing")
    assert [s.name for s in S.Plan().without("no_hidden_problems").stages] == ["search", "filter", "order"]
    assert set(S.configurations(run_new=False)) == {"baseline", "full_recap"} and set(S.configurations(run_new=True)) == set(V.ABLATIONS)


def test_alike_against_all_pairs(spark, sf_dir):
    rng = random.Random(9)
    texts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(300)} | {"aaaa", "aaaaa", "x", "x y"})
    grams = {t: {t[i : i + 3] for i in range(max(len(t) - 2, 1))} for t in texts}
    want = {(a, b) for a in texts for b in texts if a < b and len(grams[a] & grams[b]) >= 0.68 * len(grams[a] | grams[b])}
    got = V.alike(spark.createDataFrame([(t,) for t in [*texts, *texts[:5], None]], "t string"), "t").collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_recurring_problems_keep_no_copies(spark, sf_dir, monkeypatch):
    """No table that is written on the way has more rows than two forests over the vectors, whatever the number of bands that buckets would need."""
    kept, write = [], shared.Rounds._write
    monkeypatch.setattr(shared.Rounds, "_write", lambda self, df, path: kept.append(write(self, df, path).count()) or write(self, df, f"{path}-again"))
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert Q.recurring_problems(spark, sf_dir).count() == n and max(kept) <= 2 * n
