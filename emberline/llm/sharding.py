"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Equal texts share a key on the ring. Light texts fall into a fixed number of cells, whose sizes
are summed in one aggregation; texts that weigh as much as several cells are named one by one,
a few thousand by arithmetic. The walk over the ring needs only these sums. An item whose first
shard clockwise is full continues clockwise to the next with room, so no shard exceeds the
bound of (1 + SLACK) of the mean. An item of up to SLACK of the mean always finds room. A cell
above that is dealt into smaller cells of whole texts. A heavy text is placed whole if it finds
room (heavy ones go first) and is split by document only if not. Only documents that are larger
than what is left can lift the bound, for all shards alike, to the least that holds them.

Rows are then joined to the placed items and numbered inside them, in lines of a bounded number
of rows. DataFrame functions only; the walk is plain arithmetic on the driver over at most a
few hundred thousand items, whatever the input's size.

A further shard takes its share from all others, and as the bound is tight some items also move
between old shards: on /root/testdata/sf0.1 about a tenth of all bytes moves, where a ring
without bounds would move a seventeenth.
"""

from __future__ import annotations

import bisect
import json
import math
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARDS, VIRTUAL_NODES, CELLS, SLACK = 16, 128, 1 << 16, 0.002
#: Most rows that are numbered together, absolutely and as a share of all rows.
LINE_ROWS, LINE_SHARE = 1 << 20, 1 / 1024


class Ring:
    """Shards on a ring, what each holds, and the bound for all."""

    def __init__(self, shards: int, total: int, slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES):
        self.nodes = sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(virtual_nodes))
        self.places = [p for p, _ in self.nodes]
        self.load, self.bound = [0] * shards, total / shards * (1 + slack)

    def place(self, name: str, size: int, lift: bool = True) -> int:
        """The shard of an item: clockwise from its place to the first one with room. Without room -1, or if `lift` the bound rises."""
        if min(self.load) + size > self.bound:
            if not lift:
                return -1
            self.bound = min(self.load) + size
        at = bisect.bisect_left(self.places, zlib.crc32(name.encode()))
        while self.load[s := self.nodes[at % len(self.nodes)][1]] + size > self.bound:
            at += 1
        self.load[s] += size
        return s


def _rows(spark: SparkSession, values: list[list[int]], names: str) -> DataFrame:
    """A small table from plain numbers, parsed in the JVM."""
    fields = ", ".join(f"{n}: bigint" for n in names.split())
    data = json.dumps([dict(zip(names.split(), v, strict=True)) for v in values])
    return spark.range(1).select(F.explode(F.from_json(F.lit(data), f"array<struct<{fields}>>")).alias("x")).select("x.*")


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus one; null texts are empty. Equal texts share a shard
    unless together they find no room in one. Slots count from 0 without a gap in each shard;
    ties go by doc_id, repeated rows are rows each, null ids are placed like any other; an empty
    table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = checkpointed(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 40)).alias("spread"))
        .withColumn("cell", F.pmod("key", F.lit(cells)))
    )
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")]
    cell_sums = {c: (b, n) for c, b, n in rows.groupBy("cell").agg(*sums).collect()}
    total, count = sum(b for b, _ in cell_sums.values()), sum(n for _, n in cell_sums.values())
    fits = SLACK * total / shards  # with so much, the least loaded shard is always under the bound
    line_rows = min(LINE_ROWS, max(64, int(count * LINE_SHARE)))

    # texts over half of `fits`: 2 * shards / SLACK at most, all in cells that are at least as heavy
    known = ["key", "text_crc32", "size"]
    hot = [[c] for c, (b, _) in cell_sums.items() if 2 * b > fits]
    heavy = rows.join(F.broadcast(_rows(spark, hot, "cell")), "cell", "left_semi").groupBy("cell", *known).agg(*sums).where(2 * F.col("bytes") > F.lit(fits)).collect() if hot else []
    heavy.sort(key=lambda r: (-r["bytes"], r["key"], r["text_crc32"], r["size"]))
    ring, placed = Ring(shards, total), {}
    dealt, light = [], dict(cell_sums)  # dealt: item, what it is known by, parts, lines
    for i, r in enumerate(heavy, cells):
        parts = 1
        if (s := ring.place(f"text {r['key']} {r['text_crc32']} {r['size']}", r["bytes"], lift=False)) >= 0:
            placed[i, 0] = s
        else:
            parts = math.ceil(2 * r["bytes"] / fits)
        dealt.append([i, r["key"], r["text_crc32"], r["size"], parts, max(1, -(-r["n"] // (line_rows * parts)))])
        b, n = light[r["cell"]]
        light[r["cell"]] = (b - r["bytes"], n - r["n"])
    split = []
    for c, (b, n) in light.items():
        parts = 1 if b <= fits else 16 * math.ceil(b / fits)
        if parts > 1 or n > line_rows:
            split.append([c, parts, max(1, -(-n // (line_rows * parts)))])

    rows = rows.join(F.broadcast(_rows(spark, dealt, "item key text_crc32 size parts lines")), known, "left") if dealt else rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("item", "parts", "lines")))
    # both tables are bounded: each of their rows stands for a share of all bytes or rows
    rows = rows.join(F.broadcast(_rows(spark, split, "cell cell_parts cell_lines")), "cell", "left") if split else rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("cell_parts", "cell_lines")))
    alone, one = F.col("item").isNotNull(), F.lit(1).cast("long")
    part = F.when(alone, F.pmod("spread", F.coalesce("parts", one))).otherwise(F.pmod(F.xxhash64("key", F.lit(cells)), F.coalesce("cell_parts", one)))
    line = F.pmod(F.xxhash64("spread"), F.when(alone, F.coalesce("lines", one)).otherwise(F.coalesce("cell_lines", one)))
    rows = rows.select("doc_id", "size", "text_crc32", "spread", F.coalesce("item", "cell").alias("item"), part.alias("part"), line.alias("line"))
    lines = sorted(tuple(r) for r in rows.groupBy("item", "part", "line").agg(*sums).collect())
    sizes: dict[tuple[int, int], int] = {}
    for i, p, _, b, _ in lines:
        sizes[i, p] = sizes.get((i, p), 0) + b
    for i, p in sorted(sizes, key=lambda k: (-sizes[k], k)):
        if (i, p) not in placed:
            placed[i, p] = ring.place(f"item {i} part {p}", sizes[i, p])
    filled, plan = [0] * shards, []
    for i, p, k, _, n in lines:
        s = placed[i, p]
        plan.append([i, p, k, s, filled[s]])
        filled[s] += n
    order = Window.partitionBy("item", "part", "line").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "spread")
    numbered = rows.withColumn("k", F.row_number().over(order) - 1)
    # the plan has one row for each line: bounded
    return numbered.join(F.broadcast(_rows(spark, plan or [[-1, 0, 0, 0, 0]], "item part line shard first")), ["item", "part", "line"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("first") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    return shard(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
