"""Conversation turns put together again from batches, in a streaming query that keeps state.

Kept turns that wait for an earlier one lie in fragments: runs without a gap. Two MapStates index
a conversation's fragments by their first and by their last turn, so an arrival finds its
neighbours, and joins them, in constant time; a fragment carries the roles at its ends and how
often a role repeats inside it, so these counts are added and nothing is read again. The fragment
that starts at the next turn to come is released.

Batches are event time: batch b is hour b + 1 of the clock, and a row in each batch sets the clock to the
next one's hour. So the watermark stands at a batch's own hour while it is read, and once its
arrivals are in, the timers of conversations go off whose last arrivals are `idle` batches back. The
state of a closed conversation is one small row, by which later arrivals are rejected.

Rows of one conversation stream through its state, in RocksDB: memory holds one of them at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..shared import delete_folder, shared_folder
from ..streaming.state import settings

#: Batches of the contract's cut, and batches without arrivals that close a conversation.
BATCHES, IDLE = 12, 3
#: Rows in one file of a batch, about.
FILE_ROWS = 500_000
#: Milliseconds that one batch stands for.
HOUR = 3_600_000
FEED = "conv string, turn long, role string, text string, first long, n int, at timestamp, tick boolean"
EVENTS = "event string, conv string, turn long, batch int, role string, text string, unreleased array<struct<first:long,last:long>>, n_missing long, n_breaks long"


@dataclass
class Talk:
    """What a conversation's state row holds."""

    first: int
    next: int
    tail: str | None  # role of the last released turn
    breaks: int  # among released turns
    pending: int  # kept turns that are not released
    last: int  # batch of the last arrival
    closed: bool


class Reassembly(StatefulProcessor):
    """Events of one conversation at a time."""

    def __init__(self, idle: int, batches: int):
        self.idle, self.batches = idle, batches

    def init(self, handle) -> None:
        self.handle = handle
        self.talk = handle.getValueState("talk", "first long, next long, tail string, breaks long, pending long, last int, closed boolean")
        self.starts = handle.getMapState("starts", "first long", "last long, first_role string, last_role string, breaks long")
        self.ends = handle.getMapState("ends", "last long", "first long")
        self.kept = handle.getMapState("kept", "turn long", "role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tick, conv = key
        if tick:
            for _ in rows:
                pass
            return
        state = self.talk.get()
        talk = Talk(*state) if state else None
        for r in rows:
            if talk is None:
                talk = Talk(r.first, r.first, None, 0, 0, r.n, False)
            if talk.closed:
                yield self._turn("reject", conv, r.turn, r.n, r.role, r.text)
                continue
            talk.last = r.n
            if r.turn == talk.next:  # the end of the released run moves on by itself
                talk.breaks += talk.tail == r.role
                talk.tail, talk.next = r.role, talk.next + 1
                yield self._turn("release", conv, r.turn, r.n, r.role, r.text)
            elif r.turn > talk.next and not (talk.pending and self.kept.containsKey((r.turn,))):
                self._join(r.turn, r.role, talk.pending > 0)
                self.kept.updateValue((r.turn,), (r.role, r.text))
                talk.pending += 1
            # fragments never touch the released run for long: at most one starts at the next turn
            if talk.pending and (ready := self.starts.getValue((talk.next,))):
                last, first_role, last_role, breaks = ready
                self.starts.removeKey((talk.next,))
                self.ends.removeKey((last,))
                for turn in range(talk.next, last + 1):
                    role, text = self.kept.getValue((turn,))
                    self.kept.removeKey((turn,))
                    yield self._turn("release", conv, turn, r.n, role, text)
                talk.breaks += breaks + (talk.tail == first_role)
                talk.pending -= last + 1 - talk.next
                talk.tail, talk.next = last_role, last + 1
        if not talk.closed:
            self.talk.update(tuple(vars(talk).values()))
            if state is None:
                self.handle.registerTimer(self._due(talk.last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        talk = Talk(*self.talk.get())
        if (due := self._due(talk.last)) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)  # there were arrivals since
            return
        runs = sorted((first, value[0]) for (first,), value in self.starts.iterator()) if talk.pending else []
        inner = sum(value[3] for _, value in self.starts.iterator()) if talk.pending else 0
        missing = runs[-1][1] + 1 - talk.next - talk.pending if runs else 0
        for state in (self.starts, self.ends, self.kept):
            if talk.pending:
                state.clear()
        talk.closed, talk.pending = True, 0
        self.talk.update(tuple(vars(talk).values()))
        yield Row(event="close", conv=key[1], turn=-1, batch=min(talk.last + self.idle, self.batches), role=None, text=None, unreleased=[Row(first=a, last=b) for a, b in runs], n_missing=missing, n_breaks=talk.breaks + inner)

    def _due(self, last: int) -> int:
        """Just before the hour of the batch in which a conversation closes."""
        return (last + self.idle + 1) * HOUR - 1

    def _join(self, turn: int, role: str, others: bool) -> None:
        """Puts a turn into the fragments, together with its neighbours."""
        first = last = turn
        first_role = last_role = role
        breaks = 0
        if others and (left := self.ends.getValue((turn - 1,))):
            _, first_role, left_role, inside = self.starts.getValue((first := left[0],))
            breaks += inside + (left_role == role)
            self.ends.removeKey((turn - 1,))
        if others and (right := self.starts.getValue((turn + 1,))):
            last, right_role, last_role, inside = right
            breaks += inside + (right_role == role)
            self.starts.removeKey((turn + 1,))
        self.starts.updateValue((first,), (last, first_role, last_role, breaks))
        self.ends.updateValue((last,), (first,))

    @staticmethod
    def _turn(event: str, conv: str, turn: int, batch: int, role: str, text: str) -> Row:
        return Row(event=event, conv=conv, turn=turn, batch=batch, role=role, text=text, unreleased=None, n_missing=None, n_breaks=None)


def cut(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(conv, turn, role, text, n): the arrivals of each batch n, by the first 8 hex digits of sha256(`conv_id:turn`).

    Null turns are dropped, null roles and texts are empty, a null conv_id is conversation ''. A row with h % 7 < 2
    arrives again, as `user`, three batches on, around the end."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(conv, F.lit(":"), turn.cast("string")), 256), 1, 8), 16, 10).cast("long")
    own = F.struct(F.coalesce("role", F.lit("")).alias("role"), (h % batches).cast("int").alias("n"))
    again = F.struct(F.lit("user").alias("role"), ((h + 3) % batches).cast("int").alias("n"))
    times = F.filter(F.array(own, F.when(h % 7 < 2, again)), lambda x: x.isNotNull())
    each = conversations.where(F.col("turn").isNotNull()).select(conv.alias("conv"), turn.alias("turn"), F.coalesce("text", F.lit("")).alias("text"), F.explode(times).alias("time"))
    return each.select("conv", "turn", "time.role", "text", "time.n")


def write_batches(arrivals: DataFrame, folder: str, batches: int, idle: int) -> None:
    """Writes each batch to a folder of its own: of a turn's arrivals in a batch the one with the smallest `role|text`, with
    its conversation's smallest turn, and a row that sets the clock. The last folder has no arrivals, and ends all."""
    spark = arrivals.sparkSession
    payload = F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role", "text")
    least = arrivals.groupBy("n", "conv", "turn").agg(F.min(payload).alias("p")).select("n", "conv", "turn", "p.role", "p.text")
    first = arrivals.groupBy("conv").agg(F.min("turn").alias("first"))
    rows = least.join(first, "conv").withColumns({"at": F.timestamp_millis((F.col("n") + 1).cast("long") * HOUR), "tick": F.lit(False)})
    clock = F.when(F.col("id") >= batches - 1, F.lit(2 * batches + idle)).otherwise(F.col("id") + 1)
    ticks = spark.range(batches + 1).select(
        F.lit("").alias("conv"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("first"),
        F.col("id").cast("int").alias("n"), F.timestamp_millis((clock + 1) * HOUR).alias("at"), F.lit(True).alias("tick"))
    names = [x.split()[0] for x in FEED.split(", ")]
    files = max(1, -(-arrivals.count() // (batches * FILE_ROWS)))
    all_ = rows.select(*names).unionByName(ticks).withColumn("batch", F.col("n"))
    all_.repartition((batches + 1) * files, "batch", F.pmod(F.xxhash64("conv", "turn"), F.lit(files))).write.partitionBy("batch").parquet(folder)


def reassemble(arrivals: DataFrame, batches: int = BATCHES, idle: int = IDLE) -> DataFrame:
    """Events of all conversations: (event, conv, turn, batch, role, text, unreleased, n_missing, n_breaks).

    `arrivals` are (conv, turn, role, text, n) with no nulls, n the batch from 0 to batches - 1. Of a turn's
    arrivals in one batch only the smallest `role|text` counts, of all its arrivals the earliest is kept. Each batch
    releases the gapless run of kept turns from the conversation's smallest turn on. A conversation closes in the last of
    `idle` successive batches without its arrivals, or at the end as batch `batches`, with its kept
    turns that were never released as runs (first, last), the turns that no one sent and how often a kept turn has
    the role of the kept one before it; what arrives after that is rejected. Repeated rows count once in a
    batch and keep their conversation open; no rows give no events.

    Each batch is moved into the folder that the query reads, and the query started anew on one checkpoint, so it may stop
    between any two; its sink's log keeps a batch that runs again from counting twice."""
    spark = arrivals.sparkSession
    base = f"{shared_folder(spark)}/reassembly-{uuid.uuid4().hex}"
    write_batches(arrivals, f"{base}/cut", batches, idle)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(f"{base}/feed"))
    with settings(spark):
        for n in range(batches + 1):
            if not fs.rename(fs_path(f"{base}/cut/batch={n}"), fs_path(f"{base}/feed/batch={n}")):
                raise OSError(f"batch {n} could not be moved")
            feed = spark.readStream.schema(FEED).parquet(f"{base}/feed")
            events = feed.withWatermark("at", "0 seconds").groupBy("tick", "conv").transformWithState(Reassembly(idle, batches), EVENTS, "Append", "EventTime")
            query = events.writeStream.format("parquet").option("path", f"{base}/events").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("append").start()
            query.awaitTermination()
    for part in ("cut", "feed", "checkpoint"):
        delete_folder(spark, f"{base}/{part}")
    return spark.read.schema(EVENTS).parquet(f"{base}/events")


def digests(events: DataFrame) -> DataFrame:
    """Events with a digest for the payload, or for the unreleased turns of a conversation that closes."""
    turns = F.array_join(F.transform(F.flatten(F.transform("unreleased", lambda r: F.sequence(r["first"], r["last"]))), lambda t: t.cast("string")), ",")
    said = F.when(F.col("event") == "close", turns).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", F.nullif(F.col("conv"), F.lit("")).cast("long").alias("conv_id"), "turn", F.col("batch").cast("long").alias("batch"), F.sha2(said, 256).alias("sha256"), "n_missing", "n_breaks")


def op11(spark, sf_dir: str) -> DataFrame:
    from .common import rows_of, table

    return digests(reassemble(cut(rows_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"))))


OP11_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST('0x' || substr(sha256(conv_id || ':' || turn), 1, 8) AS BIGINT) AS h
  FROM conversations WHERE turn IS NOT NULL),
every AS (
  SELECT conv_id, turn, role, text, h % 12 AS batch FROM base
  UNION ALL SELECT conv_id, turn, 'user', text, (h + 3) % 12 FROM base WHERE h % 7 < 2),
arrivals AS (
  SELECT conv_id, turn, batch, min(role || '|' || text) AS payload, arg_min(role, role || '|' || text) AS role FROM every GROUP BY ALL),
gaps AS (
  SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS after FROM (SELECT DISTINCT conv_id, batch FROM arrivals)),
closes AS (
  SELECT conv_id, min(CASE WHEN after IS NULL OR after > batch + 3 THEN least(batch + 3, 12) END) AS closed FROM gaps GROUP BY conv_id),
firsts AS (SELECT conv_id, min(turn) AS first FROM base GROUP BY conv_id),
kept AS (
  SELECT conv_id, turn, min(batch) AS batch, arg_min(payload, batch) AS payload, arg_min(role, batch) AS role
  FROM arrivals JOIN closes USING (conv_id) WHERE batch <= closed GROUP BY conv_id, turn),
placed AS (
  SELECT *, turn - first = row_number() OVER w - 1 AS gapless, max(batch) OVER w AS released,
    coalesce(lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role, false) AS breaks
  FROM kept JOIN firsts USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ends AS (
  SELECT conv_id, any_value(closed) AS closed, max(turn) - any_value(first) + 1 - count(*) AS n_missing, CAST(count(*) FILTER (breaks) AS BIGINT) AS n_breaks,
    coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (NOT gapless), '') AS turns
  FROM placed JOIN closes USING (conv_id) GROUP BY conv_id)
SELECT 'release' AS event, conv_id, turn, CAST(released AS BIGINT) AS batch, sha256(payload) AS sha256, CAST(NULL AS BIGINT) AS n_missing, CAST(NULL AS BIGINT) AS n_breaks FROM placed WHERE gapless
UNION ALL SELECT 'reject', conv_id, turn, CAST(batch AS BIGINT), sha256(payload), NULL, NULL FROM arrivals JOIN closes USING (conv_id) WHERE batch > closed
UNION ALL SELECT 'close', conv_id, -1, CAST(closed AS BIGINT), sha256(turns), CAST(n_missing AS BIGINT), n_breaks FROM ends
"""
