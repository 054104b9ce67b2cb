"""Search by terms in cells against all pairs, and expansion that reads only what a walk visits."""

import math
import random
import re
from collections import Counter

from emberline.operators import retrieval as V
from emberline.operators import staged as S
from emberline.operators import termsearch as K


def test_cells_against_all_pairs(spark, monkeypatch):
    for name, n in (("GROUP", 60), ("QUERY_BLOCK", 7), ("TILE", 16), ("EXACT", 5), ("WORDS", 40)):
        monkeypatch.setattr(K, name, n)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["the", "ünï"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    memory = [(rng.choice(["L1", "L1", "L2", None]), i, text()) for i in range(200)] + [("L1", 300 + i, "w1 w2 w2") for i in range(40)] + [("L3", 900, None), ("L2", 901, "w1 w2 w2")]
    queries = [(i, text()) for i in range(20)] + [(50, "w2 w1"), (51, None), (52, "unknown")]
    cut = lambda t: Counter(w for w in re.findall(r"\w{2,}", (t or "").lower()) if w != "the")
    total, df = Counter(), Counter()
    for _, _, t in memory:
        total.update(cut(t))
        df.update(set(cut(t)))
    known = sorted(total, key=lambda w: (-total[w], w))[:25]

    def unit(t):
        w = {x: n * (math.log((1 + len(memory)) / (1 + df[x])) + 1) for x, n in cut(t).items() if x in known}
        return {x: v / math.sqrt(sum(y * y for y in w.values())) for x, v in w.items()}

    want = {}
    for q, t in queries:
        mine = unit(t)
        for level in ("L1", "L2", "L3", None):
            scored = [(-round(sum(mine[x] * v for x, v in u.items() if x in mine), 9), m) for own, m, t2 in memory if own == level and mine.keys() & (u := unit(t2)).keys()]
            want |= {(q, level, m): -s for s, m in sorted(scored)[:5]}
    m, q = spark.createDataFrame(memory, "level string, memory bigint, text string"), spark.createDataFrame(queries, "query bigint, text string")
    got = {(r["query"], r["level"], r["memory"]): r["score"] for r in S.tfidf_top(m, q, 5, 25, ("the",)).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in want)
    assert S.tfidf_top(m.limit(0), q, 5).count() == 0 and S.tfidf_top(m, q.limit(0), 5).count() == 0


def test_expansion_reads_what_it_reaches(spark, monkeypatch):
    """A chain of three in an issue of a thousand; a link into another issue is not followed."""
    none = []
    memory = [("L1", i, "r", "w", "k", "", "i", "x", {1: [2], 2: [3, 2000], 3: [1]}.get(i, none), [5] if i == 3 else none) for i in range(1, 1001)] + [("L1", 2000, "r", "w", "k", "", "j", "x", none, none)]
    m = spark.createDataFrame(memory, "level string, memory bigint, repo string, workflow string, kind string, signal string, issue string, text string, enables array<bigint>, enabled_by array<bigint>")
    read, walk = [], V.expand_depth_first
    monkeypatch.setattr(V, "expand_depth_first", lambda near, hits, group: read.append(near.count()) or walk(near, hits, group))
    matches = spark.createDataFrame([(7, "L1", 1, 1.0, "direct", None)], S.MATCHES)
    got = {(r["memory"], r["score"], r["source"]) for r in S.expand(matches, S.Asked(matches, m)).collect()}
    assert got == {(1, 1.0, "direct"), (2, 0.9, "dependency_enabled"), (3, 0.81, "dependency_enabled"), (5, 0.729, "dependency_enabler")} and read == [4]
