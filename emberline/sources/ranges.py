"""Lines of files by byte ranges, from the end of a file on: a data source whose partitions are ranges.

A file is cut into ranges, many tasks read one file and one task several small ones. A record belongs to the
range in which it begins; a task finds newlines backwards in chunks of 8 KiB and reads on past its range only to
finish a record. A file's end is frozen when the read is planned, or given, so what is appended later is not seen.

Stores are opened through pyarrow (local files, HDFS, S3, GCS and whatever else its URIs name)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_json

#: Bytes read at once, most and least bytes in a range, and rows handed over at a time.
CHUNK, RANGE, LEAST_RANGE, ROWS = 8192, 32 << 20, 16 << 10, 4096
#: Bytes that make a line blank if it has no others.
BLANK = b" \t\n\x0c\r"


def open_store(path: str):
    """(file system, path in it) of a URI or path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(URI or path, bytes) of a file, or of all files below a folder but hidden ones; none if nothing is there."""
    from pyarrow import fs

    store, at = open_store(path)
    root = store.get_file_info(at)
    if root.type == fs.FileType.NotFound:
        return []
    found = [root] if root.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in p.removeprefix(at).split("/") if x)
    base = path.removesuffix("/")
    return sorted((base + x.path.removeprefix(at), x.size) for x in found if x.type == fs.FileType.File and not hidden(x.path))


def records_backward(read_at: Callable[[int, int], bytes], start: int, stop: int, limit: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, end, bytes) of the records that begin in [start, stop), the last first; `read_at(n, at)` gives bytes, the file ends at `limit`."""
    carry: list[bytes] = []  # pieces of the record at hand, the last first
    end = limit if stop == limit else None  # its end; None while it goes on past the range

    def record(first: int, body: bytes) -> tuple[int, int, bytes]:
        body += b"".join(reversed(carry))
        last = end
        if last is None:
            last = stop
            while last < limit:
                piece = read_at(min(chunk, limit - last), last)
                cut = piece.find(b"\n")
                body, last = body + (piece if cut < 0 else piece[:cut]), last + (len(piece) if cut < 0 else cut)
                if cut >= 0:
                    break
        return first, last, body

    pos, low = stop, max(start - 1, 0)
    while pos > low:
        n = min(chunk, pos - low)
        piece, right = read_at(n, pos - n), n
        while (q := piece.rfind(b"\n", 0, right)) >= 0:
            if (first := pos - n + q + 1) < stop:
                yield record(first, piece[q + 1 : right])
            carry, end, right = [], first - 1, q
        carry.append(piece[:right])
        pos -= n
    if start == 0 and stop > 0:
        yield record(0, b"")


_MARK, _QUOTE = re.compile(rb'["\[\]{},]'), re.compile(rb'["\\]')


def first_byte(read_at: Callable[[int, int], bytes], limit: int) -> bytes:
    """The first byte of a file that is not blank; empty if there is none."""
    for at in range(0, limit, CHUNK):
        if piece := read_at(min(CHUNK, limit - at), at).lstrip(BLANK):
            return piece[:1]
    return b""


def list_elements(read_at: Callable[[int, int], bytes], limit: int, chunk: int = 1 << 16, opening: bytes = b"[") -> Iterator[tuple[int, int, bytes]]:
    """(first byte, end, bytes) of the elements of a JSON list, or with a brace of the entries of a JSON object, that is the whole file,
    read in chunks: memory holds one element. Anything else raises where it is found; elements are only cut, not parsed."""
    closing = {b"[": b"]", b"{": b"}"}[opening]
    buffer, base, at, depth, quoted, opened, closed, commas = b"", 0, 0, 0, False, False, False, 0
    start = 0  # of the element at hand, in the buffer

    def element(stop: int) -> tuple[int, int, bytes]:
        body = buffer[start:stop]
        left = len(body) - len(body.lstrip(BLANK))
        return base + start + left, base + start + len(body.rstrip(BLANK)), body.strip(BLANK)

    for offset in range(0, limit, chunk):
        buffer += read_at(min(chunk, limit - offset), offset)
        while True:
            m = (_QUOTE if quoted else _MARK).search(buffer, at)
            if closed or not m:
                at = len(buffer)
                break
            mark, place = m[0], m.start()
            if quoted:
                if mark == b"\\" and place + 2 > len(buffer):
                    at = place  # what it escapes is in the next chunk
                    break
                at, quoted = (place + 2, True) if mark == b"\\" else (place + 1, False)
                continue
            at = place + 1
            if not opened:
                if mark != opening or buffer[:place].strip(BLANK):
                    raise ValueError("no list")
                opened, start = True, at
            elif mark == b'"':
                quoted = True
            elif mark in b"[{":
                depth += 1
            elif depth and mark in b"]}":
                depth -= 1
            elif not depth:
                if mark not in (b",", closing):
                    raise ValueError("an unopened bracket")
                found = element(place)
                if found[2]:
                    yield found
                elif mark == b"," or commas:
                    raise ValueError("an element is missing")
                commas, closed, start = commas + (mark == b","), mark == closing, at
        if closed and buffer[start:].strip(BLANK):
            raise ValueError("more after the list")
        if opened:
            buffer, base, at, start = buffer[start:], base + start, at - start, 0
    if not closed:
        raise ValueError("the list does not end")


@dataclass
class Ranges(InputPartition):
    #: (file, first byte, byte after the last, frozen end)
    ranges: list[tuple[str, int, int, int]]


def deal(files: list[tuple[str, int]], size: int) -> list[Ranges]:
    """Ranges of at most `size` bytes, several small ones in a partition."""
    out, own, used = [], [], 0
    for file, end in files:
        for start in range(0, end, size):
            stop = min(start + size, end)
            if own and used + stop - start > size:
                out.append(Ranges(own))
                own, used = [], 0
            own.append((file, start, stop, end))
            used += stop - start
    return out + ([Ranges(own)] if own else [])


class LineRanges(DataSource):
    """Options: path (several apart by newlines); ends, a JSON object of frozen ends by file, or of a share of each file's bytes at "*"; rangeBytes and
    slots (a range is cut smaller where there are more slots than ranges); rows: records (default), newlines, or json: the elements of files that
    begin with a bracket and the lines of others, in any order, and a row without a value for a list that is broken; or lists: of such files alone; or entries: those
    and the entries of files that are one object."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        if self.options.get("rows") == "newlines":
            return "file string, start long, newlines long"
        return "file string, start long, first long, last long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], options.get("rows", "records")
        self.ends = json.loads(options.get("ends", "{}"))
        self.size, self.slots = int(options.get("rangebytes", options.get("rangeBytes", RANGE))), int(options.get("slots", 1))

    def partitions(self) -> list[InputPartition]:
        files = []
        for file, size in (f for path in self.path.split("\n") if path for f in files_of(path)):
            end = self.ends.get(file, int(size * self.ends["*"]) if "*" in self.ends else size)
            if end > size:
                raise ValueError(f"the end of {file} is past the file")
            files.append((file, end))
        share = -(-sum(end for _, end in files) // max(1, 4 * self.slots))
        return deal(files, max(1, min(self.size, max(LEAST_RANGE, share)))) or [Ranges([])]

    def read(self, partition: Ranges):
        import pyarrow as pa

        for file, start, stop, limit in partition.ranges:
            store, at = open_store(file)
            with store.open_input_file(at) as f:
                if self.rows == "newlines":
                    n = sum(f.read_at(min(CHUNK, stop - i), i).count(b"\n") for i in range(start, stop, CHUNK))
                    yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "newlines": [n]})
                    continue
                batch: dict[str, list] = {"first": [], "last": [], "value": []}
                for first, last, body in self._records(f.read_at, start, stop, limit):
                    if not body.strip(BLANK):
                        continue
                    for name, value in (("first", first), ("last", last), ("value", body)):
                        batch[name].append(value)
                    if len(batch["first"]) == ROWS:
                        yield self._batch(pa, file, start, batch)
                        batch = {name: [] for name in batch}
                if batch["first"]:
                    yield self._batch(pa, file, start, batch)

    def _records(self, read_at, start: int, stop: int, limit: int) -> Iterator[tuple[int, int, bytes]]:
        opening = b"" if self.rows == "records" else first_byte(read_at, limit)
        if opening != b"[" and (self.rows != "entries" or opening != b"{"):
            if self.rows not in ("lists", "entries"):
                yield from records_backward(read_at, start, stop, limit)
        elif start == 0:  # one task streams through a list, wherever its ranges end
            try:
                yield from list_elements(read_at, limit, opening=opening)
            except ValueError:
                yield -1, -1, b"\xff"

    @staticmethod
    def _batch(pa, file: str, start: int, batch: dict[str, list]):
        texts = []
        for body in batch["value"]:
            try:
                texts.append(body.decode())
            except UnicodeDecodeError:
                texts.append(None)  # is rejected
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([start] * n, pa.int64()), pa.array(batch["first"], pa.int64()), pa.array(batch["last"], pa.int64()), pa.array(texts, pa.string())], ["file", "start", "first", "last", "value"])


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(LineRanges)
    if any(c in path for c in "*?[{"):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        path = "\n".join(f.getPath().toString() for f in found or [])
    return spark.read.format("line_ranges").options(path=path, slots=spark.sparkContext.defaultParallelism, **options).load()


def read_backward(spark: SparkSession, path: str, schema: str, ends: dict[str, int | float] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(file, first, last, back, rejected, row) of a path, or of all that a pattern names: JSON lines with their bytes and their place from the file's end, blank ones skipped, bad ones rejected in place.

    `ends` freezes files at a byte, or all at a share of their bytes under "*"; a record that the end
    cuts is read as far as it goes. An end past its file raises, a missing path gives no rows."""
    rows = _load(spark, path, ends=json.dumps(ends or {}), rangeBytes=range_bytes)
    # records of each range first, so that no window spans more than a range
    counts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("file").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = counts.select("file", "start", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after"))
    own = F.row_number().over(Window.partitionBy("file", "start").orderBy(F.col("first").desc()))
    fine = F.coalesce(is_json(F.col("value")), F.lit(False))
    placed = rows.withColumn("own", own).join(after, ["file", "start"])
    return placed.select("file", "first", "last", (F.col("after") + F.col("own")).alias("back"), (~fine).alias("rejected"), F.when(fine, F.from_json("value", schema)).alias("row"))


def newline_counts(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, newlines): newline bytes of each file; files without bytes, and what is not there, have no row."""
    return _load(spark, path, rows="newlines", rangeBytes=range_bytes).groupBy("file").agg(F.sum("newlines").alias("newlines"))


def json_rows(spark: SparkSession, path: str, range_bytes: int = RANGE, rows: str = "json") -> DataFrame:
    """(file, first, value): elements of JSON lists and lines of JSON lines, with the byte that they begin at, told apart by each file's
    first byte. Lines are read by ranges, a list by one task, an element at a time; a broken list gives what was
    read before the fault, and a row with a null value at -1. Blank lines are left out, nothing is parsed. With rows `lists` only files with a list have
    rows, with `entries` also those with one object: its entries, key and value."""
    return _load(spark, path, rows=rows, rangeBytes=range_bytes).select("file", "first", "value")
