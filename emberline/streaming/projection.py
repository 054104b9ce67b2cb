"""Streams: a tail over files, watermarked windows, bounded dedupe and an exactly-once projection."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructField, StructType

from .state import settings


def tail(spark: SparkSession, path: str, schema, files_per_trigger: int = 200) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def first_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of a key within the watermark: state is bounded by time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Projection(StatefulProcessor):
    """Next byte offset and next ordinal of each thread. A chunk that does not start at the stored offset, or a line that has
    not the next ordinal, raises: the batch is not committed, and state and rows stay behind the log."""

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "offset long, ordinal long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        offset, ordinal = self.next.get() or (0, 0)
        # chunks of one thread in one batch, which the trigger bounds
        for chunk in sorted(rows, key=lambda r: (r.start_offset, r.next_offset)):
            if chunk.start_offset != offset:
                raise ValueError(f"{key[0]}: projection stands at byte {offset}, the chunk starts at {chunk.start_offset}")
            for line in chunk.lines:
                if line["ordinal"] != ordinal:  # structs in a list come as dictionaries
                    raise ValueError(f"{key[0]}: expected ordinal {ordinal}, got {line['ordinal']}")
                ordinal += 1
                yield Row(thread=key[0], line=Row(**line))
            offset = chunk.next_offset
        self.next.update((offset, ordinal))


def project(chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the lines of (thread, start_offset, next_offset, lines) chunks to a table, each exactly once, and stops at the log's present end.

    A thread's chunks come in any order within a batch and in order between batches; its state is keyed, so threads run in
    parallel. `lines` are structs with an `ordinal`. State, offsets and the sink's log are committed by
    batch: one that runs again replaces its own rows."""
    thread, lines = (chunks.schema[c].dataType for c in ("thread", "lines"))
    schema = StructType([StructField("thread", thread), StructField("line", lines.elementType)])
    with settings(chunks.sparkSession):
        rows = chunks.select("thread", "start_offset", "next_offset", "lines").groupBy("thread").transformWithState(Projection(), schema, "Append", "None")
        return rows.select("thread", "line.*").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
