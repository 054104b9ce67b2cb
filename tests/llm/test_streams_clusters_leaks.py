"""Turn reassembly, centroid clustering and decontamination against plain versions, and their edge cases."""

import hashlib
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import clustering, decontamination, entry, langid, reassembly
from emberline.streaming.state import STORE

# 11


def plain_events(arrivals, batches, idle):
    """All events by their definition: every batch in turn, everything looked at again."""
    first, talks, out = {}, {}, []
    for conv, turn, *_ in arrivals:
        first[conv] = min(turn, first.get(conv, turn))
    for n in range(batches + 1):
        here = {}
        for conv, turn, role, text, b in arrivals:
            if b == n:
                here[conv, turn] = min(here.get((conv, turn), (b"\xff",)), (f"{role}|{text}".encode(), role, text))
        for (conv, turn), (_, role, text) in sorted(here.items()):
            talk = talks.setdefault(conv, {"kept": {}, "gone": set(), "last": n, "closed": False})
            if talk["closed"]:
                out.append(("reject", conv, turn, n, role, text, None, None, None))
            else:
                talk["last"] = n
                talk["kept"].setdefault(turn, (role, text))
        for conv, talk in talks.items():
            if talk["closed"]:
                continue
            kept, turn = talk["kept"], first[conv]
            while turn in kept:
                if turn not in talk["gone"]:
                    talk["gone"].add(turn)
                    out.append(("release", conv, turn, n, *kept[turn], None, None, None))
                turn += 1
            if n == batches or n - talk["last"] >= idle:
                talk["closed"] = True
                missing = max(kept) - first[conv] + 1 - len(kept)
                breaks = sum(t - 1 in kept and kept[t][0] == kept[t - 1][0] for t in kept)
                out.append(("close", conv, -1, n, None, None, tuple(sorted(set(kept) - talk["gone"])), missing, breaks))
    return sorted(out, key=repr)


def streamed(spark, rows, batches, idle):
    df = spark.createDataFrame(rows, "conv string, turn long, role string, text string, n int")
    got = reassembly.reassemble(df, batches, idle).collect()
    turns = lambda r: None if r["unreleased"] is None else tuple(t for a, b in r["unreleased"] for t in range(a, b + 1))
    return sorted(((r["event"], r["conv"], r["turn"], r["batch"], r["role"], r["text"], turns(r), r["n_missing"], r["n_breaks"]) for r in got), key=repr)


def test_reassembly_of_random_arrivals(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(25):
        low, n = rng.choice([0, -3, 10**12]), rng.randrange(1, 9)
        for turn in rng.sample(range(low, low + n + rng.randrange(4)), n):
            for _ in range(rng.choice([1, 1, 2, 3])):  # repeats with other texts and roles, in the same batch or another
                rows.append((str(conv), turn, rng.choice(["user", "assistant", "", "user|x"]), rng.choice(["", "hi", "x|y", "ß", "a" * 20_000]), rng.choice([rng.randrange(6), 0])))
    rows += rows[:5]
    want = plain_events(rows, 6, 2)
    assert {e[0] for e in want} == {"release", "reject", "close"} and any(e[6] for e in want)
    assert streamed(spark, rows, 6, 2) == want


def test_reassembly_restores_settings_and_takes_an_empty_table(spark):
    before = {k: spark.conf.get(k, None) for k in STORE}
    assert streamed(spark, [], 1, 2) == []
    assert {k: spark.conf.get(k, None) for k in STORE} == before


def test_cut_of_batches_with_nulls(spark):
    rows = [(1, 0, None, None, 7), (1, None, "user", "x", 7), (None, 2, "user", "y", 7), *((c, t, "assistant", "t", 7) for c in range(20) for t in range(5))]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    for r in reassembly.cut(df).collect():
        got[r["conv"], r["turn"]].append((r["n"], r["role"], r["text"]))
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if turn is not None:
            conv = "" if conv is None else str(conv)
            h = int(hashlib.sha256(f"{conv}:{turn}".encode()).hexdigest()[:8], 16)
            want[conv, turn] += [(h % 12, role or "", text or "")] + [((h + 3) % 12, "user", text or "")] * (h % 7 < 2)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def oracle(name, sf_dir):
    con = duckdb.connect()
    for table in ("conversations", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.abspath(sf_dir)}/{table}.parquet'")
    return con.sql(entry.ORACLES[name])


@pytest.mark.parametrize("name", ["op11_reassembly", "op12_centroids", "op13_decontamination"])
def test_query_equals_its_sql(spark, sf_dir, name):
    got = entry.QUERIES[name](spark, sf_dir)
    want = oracle(name, sf_dir)
    rows = got.select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


# 12


def plain_clusters(v, k, rounds):
    ids = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]
    c = v[ids].astype(object)
    x = v.astype(object)
    for r in range(rounds + 1):
        d = np.array([[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x], dtype=object)
        own = np.array([row.argmin() for row in d])
        if r < rounds:
            for j in set(own.tolist()):
                c[j] = [sum(col) // int((own == j).sum()) for col in x[own == j].T]
    return own, np.array([d[i, j] for i, j in enumerate(own)]), c


@pytest.mark.parametrize("largest", [3, 40, 1 << 27])
def test_exponion_equals_full_scans(spark, largest):
    """Few values make many ties and coinciding centroids; large ones need 64-bit integers."""
    rng = np.random.default_rng(largest)
    centres = rng.integers(-largest // 2, largest // 2 + 1, (6, 3))
    v = np.clip(centres[rng.integers(0, 6, 400)] + rng.integers(-max(1, largest // 20), max(1, largest // 20) + 1, (400, 3)), -largest, largest)
    df = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in enumerate(v)], "id long, v array<bigint>")
    rows, c = clustering.cluster(df, k=20, rounds=4)
    own, d, want = plain_clusters(v, 20, 4)
    got = {r["id"]: (r["cluster"], r["distance"]) for r in rows.collect()}
    assert got == {i: (int(own[i]), int(d[i])) for i in range(len(v))}
    assert (c == want.astype(np.int64)).all()


def test_exponion_scans_few_where_clusters_are_apart():
    rng = np.random.default_rng(0)
    centres = rng.integers(-100_000, 100_000, (64, 16))
    v = centres[rng.integers(0, 64, 5000)] + rng.integers(-20, 21, (5000, 16))
    now = clustering.Centroids(centres)
    own, upper, lower, _ = now.assign(v, None, None, None)
    nxt = centres + rng.integers(-3, 4, centres.shape)
    after = clustering.Centroids(nxt, centres)
    again, _, _, stats = after.assign(v, own, upper.copy(), lower.copy())
    assert stats["kept"] == len(v) and (again == own).all()
    # without a lower bound the ball is what prunes
    near, _, _, stats = clustering.Centroids(nxt, centres).assign(v, own, np.full(len(v), 1e6), np.zeros(len(v)))
    full = clustering.Centroids(nxt).assign(v, None, None, None)[0]
    assert (near == full).all() and stats["scanned"] + stats["tightened"] < stats["all"] / 8


def test_clusters_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, -1.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, []), (8, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("cluster", F.lit(9))
    kept = clustering.kept_vectors(df, "vec_id", "embedding", dim=2)
    big = clustering.LARGEST
    assert sorted(map(repr, ((r["id"], r["v"]) for r in kept.collect()))) == sorted(map(repr, [(1, [128, 256]), (1, [128, 256]), (None, [128, -256]), (8, [big, -big])]))
    out = clustering.summary(*clustering.cluster(kept, k=4, rounds=2)).collect()
    assert len(out) == 4 and {r["vec_id"] for r in out} == {1, None, 8} and all(r["distance"] == 0 == r["inertia"] for r in out)
    none = clustering.summary(*clustering.cluster(kept.where("id > 99")))
    assert none.count() == 0 and "centroid_sha256" in none.columns


# 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_hits(docs, items, size=10):
    cut = set()
    for i, t in items:
        w = WORD.findall(lower(t))
        cut |= {(tuple(w[k : k + size]), i) for k in range(max(1, len(w) - size + 1)) if w}
    out = []
    for i, t in docs:
        found = list(WORD.finditer(lower(t)))
        w, hit, own = [m[0] for m in found], set(), set()
        for win, item in cut:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own.add(item)
        out.append((i, len(w), tuple((found[k].start(), found[k].end()) for k in sorted(hit)), tuple(sorted(str(x) for x in own if x is not None))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    vocabulary = ["ab", "ba", "ß", "é1", "日本", "Zz", "x9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14, 30, 12])]
    items += [(3, items[7][1]), (None, "q w e"), (11, None), (12, "... !"), (13, items[8][1].upper())]
    gaps = [" ", ", ", "\n\n", "--", "\x00", " \x1c "]
    docs = []
    for k in range(40):
        ws = rng.choices([*vocabulary, "other", "Ünknown"], k=rng.randrange(60))
        item = items[rng.randrange(len(items))][1] or ""
        at = rng.randrange(len(ws) + 1)
        ws[at:at] = item.split() if k % 2 else []
        docs.append((k, "".join(w + rng.choice(gaps) for w in ws)))
    docs += [(50, None), (51, ""), (52, "?!"), (None, "Q, w; E"), (5, items[9][1]), (5, items[9][1]), (60, "x9 " * 3000 + items[8][1] + " ba" * 3000)]
    return docs, items


@pytest.mark.parametrize("part", [None, 200])
def test_decontamination_equals_plain_search(spark, leaks, monkeypatch, part):
    """With one automaton, and with so small ones that there are many."""
    docs, items = leaks
    if part:
        docs = docs[::5] + docs[-4:]
        monkeypatch.setattr(decontamination, "PART_BYTES", part)
    df = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, items string, item_id int")
    got = decontamination.scan(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = []
    for r in got.collect():
        found = list(WORD.finditer(lower(r["text"])))
        hit = [k for s in r["spans"] for k in range(s["first_word"], s["last_word"] + 1)]
        assert len(hit) == len(set(hit))
        for s in r["spans"]:
            assert (found[s["first_word"]].start(), found[s["last_word"]].end()) == (s["start"], s["end"])
        rows.append((r["doc_id"], r["n_words"], tuple((found[k].start(), found[k].end()) for k in hit), tuple(r["items"])))
    assert sorted(rows, key=repr) == plain_hits(docs, items)


def test_passages_are_dropped_or_cut(spark, leaks):
    docs, items = leaks
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted(repr((d[0], d[1])) for d, p in ((d, plain_hits([d], items)[0]) for d in docs) if not p[2])
    assert sorted(repr(tuple(r)) for r in decontamination.keep_clean(df, bench).collect()) == clean
    cut = spark.createDataFrame([(1, "Before. Q, W;\n e! after é"), (2, "none"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decontamination.cut_passages(cut, bench.where("item_id IS NULL"), "[cut]").collect()} == {1: "Before. [cut]! after é", 2: "none", 3: None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.keep_clean(cut, none).count() == 3
    assert decontamination.scan(cut.limit(0), bench).count() == 0


def test_language_id_learns_all_ngrams_of_a_long_text(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=rng.randrange(3, 9))) for _ in range(60_000))
    seen = []
    monkeypatch.setattr(langid, "fit", lambda counts, labels, seed=7: seen.extend(counts) or langid.Model([]))
    langid.train(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string"), modulus=7, held_out=9)
    want = defaultdict(int)
    for word in text.split():
        for at in langid.subwords(word):
            want[at] += 1
    (at, times), = seen
    assert len(want) > 20_000 and dict(zip(at.tolist(), times.tolist())) == want
