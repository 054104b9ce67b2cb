"""History and selection operators against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import history as H
from emberline.operators import relational as R
from emberline.plans import history as Q
from emberline.plans import selection as S


def plain_order(nodes, edges):
    """One ready node after the other, that of the lowest rank first; the rest by rank."""
    left, out = dict(nodes), []
    edges = {(a, b) for a, b in edges if a != b and a in left and b in left}
    while left:
        ready = [n for n in left if not any(b == n and a in left for a, b in edges)]
        if not ready:
            return out + sorted(left, key=left.get)
        out.append(min(ready, key=left.get))
        del left[out[-1]]
    return out


def test_topological_order(spark, sf_dir):
    rng = random.Random(8)
    nodes, edges, want = [], [], {}
    for g in range(60):
        own = {n: r for r, n in enumerate(rng.sample(range(20), rng.randint(1, 9)))}
        links = [(rng.randint(0, 19), rng.randint(0, 19)) for _ in range(rng.randint(0, 12))]
        nodes += [(g, n, r) for n, r in own.items()]
        edges += [(g, a, b) for a, b in links]
        want[g] = plain_order(own, links)
    got = defaultdict(list)
    for r in H.topological_order(spark.createDataFrame(nodes, "g long, node long, rank int"), spark.createDataFrame(edges, "g long, origin long, target long"), "g").orderBy("g", "place").collect():
        got[r["g"]].append(r["node"])
    assert dict(got) == want
    whole = Q.dependency_order(spark, sf_dir)
    assert whole.count() == whole.select("key", "node").distinct().count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", S._SPOT).distinct().count()


def test_first_uses_forget(spark, sf_dir):
    def plain(rows, limit):
        seen, out = set(), []
        for i, *key in rows:
            if None in key:
                out.append(i)
                continue
            if len(seen) >= limit:
                seen = set()
            if tuple(key) not in seen:
                out.append(i)
            seen.add(tuple(key))
        return out

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").selectExpr("event_id", "user_id", "event_id div 500", "CASE WHEN value >= 5 THEN event_type END").collect()]
    by = defaultdict(list)
    for i, user, turn, tool in rows:
        by[user].append((i, turn, tool))
    assert sorted(r["event_id"] for r in Q.first_tool_uses(spark, sf_dir).collect()) == sorted(i for r in by.values() for i in plain(r, 40))
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate([1, 2, 1, 3, 1, None, 2, 1])], "c int, i int, k int")
    assert sorted(r["i"] for r in H.first_uses(df, "c", ["k"], 2, "i").collect()) == plain([(i, k) for i, k in enumerate([1, 2, 1, 3, 1, None, 2, 1])], 2)


def test_lineage(spark):
    metas = spark.createDataFrame([("a", None, None), ("b", "a", 5), ("c", "b", 9), ("x", "y", 1), ("y", "x", 2), ("m", "gone", 3), ("s", "s", 1)], "thread string, base string, cutoff long")
    good, bad = H.lineage(metas, spark.createDataFrame([(t,) for t in "acxms"], "thread string"))
    assert sorted(tuple(r) for r in good.where("requested = 'c'").select("place", "thread", "ends").collect()) == [(0, "a", 5), (1, "b", 9), (2, "c", None)]
    assert {r["requested"]: r["why"] for r in bad.collect()} == {"x": "cycle", "m": "missing", "s": "cycle"} and {r["requested"] for r in good.collect()} == {"a", "c"}
    assert H.lineage(metas, metas.limit(0).select("thread"))[0].count() == 0


def test_turns_wait_and_break(spark):
    kinds = ["item", "start", "item", "complete", "item", "complete", "item", "start", "start", "item", "aborted", "item", "start", "item"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "g int, i int, kind string")
    turns, errors = H.turn_spans(df, "g", "kind", "start", ("complete", "aborted"), "i")
    got = defaultdict(list)
    for r in turns.orderBy("i").collect():
        got[r["turn"], r["outcome"]].append(r["i"])
    assert got == {(1, "complete"): [0, 1, 2, 3], (3, "aborted"): [8, 9, 10]} and sorted(r["i"] for r in errors.collect()) == [5, 8]


def plain_chunks(sizes, limit):
    chunks, room = [], None
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] > limit:
            chunks.append([i])
            room = None
        elif room is None or room + sizes[i] > limit:
            chunks.append([i])
            room = sizes[i]
        else:
            chunks[-1].append(i)
            room += sizes[i]
    half = len(sizes) // 2
    return [list(range(half)), list(range(half, len(sizes)))] if len(chunks) == 1 and len(sizes) > 1 else chunks


def test_item_chunks(spark, sf_dir):
    rng = random.Random(2)
    for sizes in [[], [5], [50], [1, 2, 3], [9, 9, 1], *([rng.randint(0, 14) for _ in range(rng.randint(1, 9))] for _ in range(25))]:
        items = F.array(*(F.struct(F.lit(s).cast("long").alias("tokens"), F.lit(i).alias("pos")) for i, s in enumerate(sizes))) if sizes else F.array().cast("array<struct<tokens:bigint,pos:int>>")
        assert spark.range(1).select(R.next_fit(items, 10).alias("x")).first()["x"] == plain_chunks(sizes, 10)
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r["conv_id"]].append(r)
    want = {c: [",".join(str(rs[i]["turn"]) for i in part) for part in plain_chunks([len(r["text"] or "") // 4 for r in rs], 40)] for c, rs in rows.items()}
    got = defaultdict(list)
    for r in S.item_chunks(spark, sf_dir).orderBy("conv_id", "chunk").collect():
        got[r["conv_id"]].append(r["turns"])
    assert dict(got) == want


def test_global_rank_over_ranges(spark):
    df = spark.range(5000).selectExpr("pmod(id * 7919, 311) AS a", "id").repartition(9)
    got = sorted((r["k"], r["a"], r["id"]) for r in R.global_rank(df, "k", "a", "id").collect())
    assert [(a, i) for _, a, i in got] == sorted((r["a"], r["id"]) for r in df.collect()) and [k for k, *_ in got] == list(range(1, 5001))
    assert R.global_rank(df.limit(0), "k", "a", "id").count() == 0


def test_search_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    ranges = lambda t, n: [tuple(r) for r in one(T.literal_ranges(F.lit(t), F.lit(n)))]
    assert ranges("aİb AİB", "i̇") == [(1, 3), (6, 8)] and ranges("ßSS", "ss") == [(2, 4)] and ranges("aaaa", "AA") == [(0, 2), (2, 4)] and ranges("", "x") == []
    fuzzy = lambda t, n: (lambda r: (r["places"], r["score"]))(one(T.fuzzy_match(F.lit(t), F.lit(n))))
    assert fuzzy("hello", "hl") == ([0, 2], -99) and fuzzy("hello", "heo") == ([0, 1, 4], -98) and fuzzy("xhello", "hl") == ([1, 3], 1) and fuzzy("abc", "z") == (None, None) and fuzzy("abc", "") == ([], 2**31 - 1)
    text = "x" * 60 + " needle " + "y" * 120
    assert one(T.snippet(F.lit(text), F.lit("NEEDLE"))) == "... " + "x" * 48 + " needle " + "y" * 95 + " ..."
    assert [one(T.is_json(F.lit(t))) for t in ('{"a":1}', "1, 2", "1], [2", '1}, {"y":2', '{"a":1} x', "", " [1] ", "null")] == [True, False, False, False, False, False, True, True]
    assert [one(T.fnv_percent(F.lit(t))) for t in ("", "a", "foobar")] == [0xCBF29CE484222325 % 100, 0xAF63DC4C8601EC8C % 100, 0x85944171F73967E8 % 100]
    assert one(T.head_bytes(F.lit("aé日😀"), F.lit(6))) == "aé日" and one(T.head_bytes(F.lit("aé日😀"), F.lit(5))) == "aé" and one(T.head_bytes(F.lit("😀"), F.lit(3))) == "" and one(T.tail_bytes(F.lit("aé日😀"), F.lit(7))) == "日😀"


@pytest.mark.parametrize("kind", ["message", "reasoning", "turn_started", "user_message", "item_completed", "other"])
def test_policy(spark, kind):
    r = spark.range(1).select(H.is_persisted(F.lit(kind), F.lit("paginated"), F.lit(False)).alias("p"), H.is_for_memories(F.lit(kind), F.lit("developer")).alias("m")).first()
    assert (r["p"], r["m"]) == (kind not in ("user_message", "other"), False)
