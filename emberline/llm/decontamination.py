"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Test items are normalised (letters A-Z in lower case, words apart by one space) and cut into windows of ten words;
the automaton holds all windows, each between two spaces, and goes through a document's normalised text
once. A hit is mapped back to the document's words, and from them to places in the original text.

Windows are cut and counted by Spark. What a task is sent is at most PART_BYTES of windows; a
benchmark beyond that makes several automata, and documents go through one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, text_slices

#: Words in a window, and bytes of windows in one automaton (a node for each at most, of some 50 bytes).
WINDOW, PART_BYTES = 10, 2 << 20
#: Bytes that are no part of a word; all bytes of letters beyond ASCII are.
GAPS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
UPPER = bytes(range(0x41, 0x5B))
#: Lower-cases A-Z and makes everything between words a space.
NORMAL = bytes(b + 32 if b in UPPER else 0x20 if b in GAPS else b for b in range(256))
SPANS = "array<struct<start:long,end:long,first_word:long,last_word:long>>"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item_id), distinct: every run of `size` words of an item; an item of fewer words, but not none, is one window."""
    own = items.select(F.col(id_column).alias("item_id"), words(F.col(text_column)).alias("w")).where(F.size("w") > 0)
    at = own.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("i"))
    return at.select(F.array_join(F.slice("w", F.col("i"), size), " ").alias("window"), "item_id").distinct()


def parts(benchmark: DataFrame, id_column: str, text_column: str, size: int) -> Iterator[dict[str, tuple[int, list]]]:
    """{window: (words, item ids)} dealt by hash so that each holds about PART_BYTES; one at a time comes to the driver."""
    each = windows(benchmark, id_column, text_column, size)
    total = each.agg(F.sum(F.octet_length("window") + 32)).collect()[0][0] or 0
    n = max(1, -(-total // PART_BYTES))
    each = checkpointed(each) if n > 1 else each
    for p in range(n):
        own: dict[str, tuple[int, list]] = {}
        for window, item in each.where(F.pmod(F.xxhash64("window"), F.lit(n)) == p).toLocalIterator():
            own.setdefault(window, (window.count(" ") + 1, []))[1].append(item)
        yield own


@lru_cache(maxsize=1)
def _automaton(sent):
    """The automaton of a broadcast part, built once a worker; its letters are bytes."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for window, value in sent.value.items():
        out.add_word(" " + window.encode().decode("latin-1") + " ", value)
    out.make_automaton()
    return out


def normalised(raw: bytes) -> tuple[str, int]:
    """A text's words, each between two spaces, a byte a letter; and how many they are."""
    found = raw.translate(NORMAL).split()
    return (" " + b" ".join(found).decode("latin-1") + " " if found else "", len(found))


def hits(automaton, text: str) -> tuple[list[tuple[int, int]], set]:
    """([first word, word after the last] of each run of hit words, item ids), from a normalised text."""
    places: list[tuple[int, int]] = []
    items: set = set()
    words_before, at = -1, 0  # spaces in text[:at]
    for end, (n, ids) in automaton.iter(text):
        words_before, at = words_before + text.count(" ", at, end), end
        first, after = words_before + 1 - n, words_before + 1  # the space at `end` follows the window's last word
        while places and places[-1][1] >= first:  # ends rise, but a longer window may start before several others
            first = min(first, places.pop()[0])
        places.append((first, after))
        items.update(ids)
    return places, items


def spans_of(raw: bytes, places: list[tuple[int, int]]) -> list[dict]:
    """Places of words as spans of characters of the original text, `end` being the first one after."""
    if not places:
        return []
    flat = np.frombuffer(raw, dtype=np.uint8)
    inside = np.frombuffer(raw.translate(NORMAL), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])  # characters before each byte
    return [{"start": int(letters[starts[a]]), "end": int(letters[ends[b - 1]]), "first_word": a, "last_word": b - 1} for a, b in places]


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents' own columns with n_words, spans (of characters and of words, joined where they touch) and
    items (distinct ids of the items with occurring windows, sorted as strings), in place of columns of these names.

    A null text has no words. Repeated documents and items, and null ids of documents, are rows like others; an item
    without an id marks words but is not listed; no documents give no rows, no items no spans."""
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    rows = docs.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k, own in enumerate(parts(benchmark, id_column, text_column, size)):
        rows = checkpointed(rows) if k else rows
        rows = _scan(rows, own)
    return rows


def _scan(rows: DataFrame, own: dict) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(own)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)
        for part in batches:
            at = {name: part.schema.get_field_index(name) for name in ("n_words", "spans", "items")}
            counts, spans, items = [], [], []
            before = part.column(at["spans"]), part.column(at["items"])
            done = 0
            for rows_ in text_slices([part]):
                for raw in rows_.column("text").cast(pa.large_binary()).to_pylist():
                    text, n = normalised(raw)
                    places, found = hits(automaton, text) if text and own_any else ([], set())
                    here, ids = spans_of(raw, places), {str(i) for i in found if i is not None}
                    if (old := before[0][done].as_py()) is not None:
                        here, ids = spans_of(raw, _merged([*places, *((s["first_word"], s["last_word"] + 1) for s in old)])), ids | set(before[1][done].as_py())
                    counts.append(n)
                    spans.append(here)
                    items.append(sorted(ids))
                    done += 1
            out = part
            for name, values, kind in (("n_words", counts, pa.int64()), ("spans", spans, part.schema.field(at["spans"]).type), ("items", items, pa.list_(pa.string()))):
                out = out.set_column(at[name], name, pa.array(values, kind))
            yield out

    own_any = bool(own)
    return bounded_batches(rows).mapInArrow(run, schema)


def _merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage, in their own columns."""
    return scan(docs, benchmark).where(F.size("spans") == 0).select(*docs.columns)


def cut_passages(docs: DataFrame, benchmark: DataFrame, mark: str = "") -> DataFrame:
    """The documents with `mark` in place of each benchmark passage of their original texts; texts without one, null ones too, stay."""
    found = scan(docs, benchmark)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
    between = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.array_join(between, mark)).otherwise(F.col("text"))).select(*docs.columns)


def op13(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    found = scan(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"), rows_of(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    listed = F.array_join("items", ",")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
