"""Matching operators against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberline.functions import match as M
from emberline.operators import matching as O
from emberline.plans import matching as Q


def plain_same(a, b):
    def norm(p):
        p = p.strip().replace("\\", "/").lstrip("./").lower()
        first = next((x for x in ("libs/agno/", "libs/", "src/") if p.startswith(x)), "")
        return p[len(first) :].split("/")

    x, y = norm(a), norm(b)
    return bool(a and b) and (x == y or (x[-2:] == y[-2:] if len(x) > 1 and len(y) > 1 else x[-1] == y[-1]))


def test_greedy_matching_against_plain(spark, sf_dir):
    gold, predicted = Q.associations(spark, sf_dir)
    rows = defaultdict(lambda: ([], []))
    for k, df in enumerate((gold, predicted)):
        for r in df.collect():
            rows[r["key"]][k].append((r["spot"], r["file"]))
    want = {}
    for key, (g, p) in rows.items():
        free, tp = [f for _, f in sorted(g)], 0
        for _, f in sorted(p):
            hit = next((i for i, x in enumerate(free) if plain_same(x, f)), None)
            if hit is not None:
                free.pop(hit)
                tp += 1
        want[key] = (tp, len(p) - tp, len(g) - tp)
    got = {r["instance"]: (r["tp"], r["fp"], r["fn"]) for r in Q.greedy_associations(spark, sf_dir).collect()}
    assert got == want
    total = Q.attribution_totals(spark, sf_dir).first()
    some = [v for v in want.values() if v[0] + v[2]]
    assert (total["instances"], total["tp"], total["fp"], total["fn"]) == (len(some), *(sum(v[i] for v in some) for i in range(3)))
    assert total["precision"] == pytest.approx(total["tp"] / (total["tp"] + total["fp"])) and total["perfect"] == sum(v[0] > 0 and not v[1] and not v[2] for v in some)


def test_greedy_matching_keeps_order(spark):
    rows = lambda files: spark.createDataFrame([(1, f, i) for i, f in enumerate(files)], "key int, file string, spot int")
    got = O.greedy_pairs(rows(["a/x.py", "x.py", ""]), rows(["x.py", "a/x.py", "b/x.py", ""]), "key", "file", "spot").first()
    assert (got["n_gold"], got["n_predicted"], got["tp"]) == (3, 4, 2)  # the bare name takes a/x.py, a/x.py takes the bare one


def test_pair_cosines_against_plain(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta-x gamma. Delta e.e ε _z 1".split()) for _ in range(rng.randint(0, 7))) for _ in range(40)]

    def grams(t):
        w = re.findall(M.TERM.replace(r"\p{L}\p{N}", r"\w"), t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    left, right = (spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts[k::2])], f"g int, {n} int, t string") for k, n in ((0, "a"), (1, "b")))
    got = {(r["a"], r["b"]): r["cosine"] for r in O.pair_cosines(left, right, "g", "a", "b", "t").collect()}
    for a, x in enumerate(map(grams, texts[0::2])):
        for b, y in enumerate(map(grams, texts[1::2])):
            if a % 2 == b % 2:
                idf = lambda t: 1.0 if t in x and t in y else math.log(1.5) + 1  # noqa: E731, B023
                dot = sum(x[t] * y[t] for t in x if t in y)
                norm = math.sqrt(sum((c * idf(t)) ** 2 for t, c in x.items()) * sum((c * idf(t)) ** 2 for t, c in y.items()))
                assert got.get((a, b), 0.0) == pytest.approx(dot / norm if norm else 0.0)


def test_bootstrap_of_few(spark):
    rows = spark.createDataFrame([(5, 1, 1, 3, "a"), (2, 2, 0, 1, "b"), (0, 0, 4, 4, "c")], "tp long, fp long, fn long, tn long, source string")
    got = {r["measure"]: (r["low"], r["high"]) for r in O.cluster_bootstrap(rows, "source").collect()}
    assert set(got) == {"precision", "recall", "f1", "accuracy"} and all(0 <= a <= b <= 1 for a, b in got.values())
    assert got["recall"][0] == 0.0 and got["recall"][1] == 1.0
    assert O.cluster_bootstrap(rows.limit(0), "source").count() == 0


def test_types_and_steps(spark):
    r = spark.range(1).select(M.canonical_type(F.lit(None).cast("string")).alias("a"), M.types_agree(F.lit("lint"), F.lit("")).alias("b"), M.types_agree(F.lit("pip install"), F.lit("ci_config")).alias("c"), M.step_score(F.lit("Run A"), F.lit("x"), F.lit(None), F.lit("run-a"), F.lit("job x"), F.lit(None)).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("Unknown", False, True, 120)


def test_greedy_matching_of_one_large_group(spark):
    """One instance and base name, with and without bare names, against the rule taken literally."""
    rng = random.Random(2)
    for names in (["a/x.py", "b/x.py", "c/d/x.py"], ["a/x.py", "b/x.py", "x.py"]):
        sides = [[rng.choice(names) for _ in range(n)] for n in (900, 700)]
        gold, guess = (spark.createDataFrame([("i", f, k) for k, f in enumerate(side)], "key string, file string, spot long") for side in sides)
        free, tp = ["/".join(f.split("/")[-2:]) for f in sides[0]], 0
        for f in sides[1]:
            two = "/".join(f.split("/")[-2:])
            if (hit := next((k for k, g in enumerate(free) if g == two or "/" not in g or "/" not in two), None)) is not None:
                del free[hit]
                tp += 1
        assert tuple(O.greedy_pairs(gold, guess, "key", "file", "spot").first()) == ("i", 900, 700, tp)
    many = spark.range(400_000).select(F.lit("i").alias("key"), F.concat((F.col("id") % 1000).cast("string"), F.lit("/x.py")).alias("file"), F.col("id").alias("spot"))
    assert O.greedy_pairs(many, many.where("spot % 3 > 0"), "key", "file", "spot").first()["tp"] == 266_666


def test_best_candidates_of_whole_groups_against_plain(spark):
    def fold(x):
        return re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()

    def long(x):
        return {w for w in fold(x).split(" ") if len(w) > 2}

    def points(step, job, text, cstep, cjob, ctext):
        s, cs, j, cj = map(fold, (step, cstep, job, cjob))
        names = 100 if s and s == cs else 70 if s and cs and (s in cs or cs in s) else 0
        return names + (20 if j and cj and (j in cj or cj in j) else 0) + min(40, 4 * len(long(text) & long(ctext)))

    def pick(texts, k):
        return texts[k] if k < len(texts) else None

    d = "/root/testdata/sf0.01"
    places = [r[0] for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").collect()]
    want = {}
    for id, size in spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size").collect():
        # a group is all suppliers that leave the same rest by 25 as the part's size
        scored = [(points(pick(Q._STEPS, id % 7), pick(Q._JOBS, size % 4), pick(Q._STEPS, size % 6) + " on main branch", pick(Q._STEPS, p % 6), pick(Q._JOBS, p // 5 % 4), "main branch of " + pick(Q._STEPS, p // 3 % 6)), -p) for p in places if p % 25 == size % 25]
        top, place = max(scored, default=(0, 0))
        want[id] = ("make all", None) if id % 9 == 0 else (f"pytest -k {-place} && echo done", min(top, 100)) if top >= 12 else ("", 0)
    assert {r[0]: (r[1], r[2]) for r in Q.resolved_commands(spark, d).collect()} == want
