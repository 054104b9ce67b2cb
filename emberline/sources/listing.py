"""Trees of many small files: listed by tasks, and read by tasks that are dealt files by their bytes.

Stores are opened through pyarrow, as byte ranges are. A listing is a table, so it can be filtered, joined or kept before
anything is read."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import files_of, open_store

#: Bytes for one task, what opening a file counts for, most tasks, and folders that a task lists.
TASK_BYTES, OPEN_BYTES, MOST_TASKS, FOLDERS = 32 << 20, 128 << 10, 20_000, 256


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all files below a folder but hidden ones. The driver sees the first level only; tasks list what lies below."""
    from pyarrow import fs

    store, at = open_store(path)
    root = store.get_file_info(at)
    if root.type != fs.FileType.Directory:
        return spark.createDataFrame(files_of(path), "path string, size long")
    base = path.removesuffix("/")
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.base_name[:1] not in "_."]
    tasks = max(1, -(-len(names) // FOLDERS), min(len(names) // 16, 4 * spark.sparkContext.defaultParallelism))
    tops = spark.createDataFrame([(f"{base}/{n}",) for n in names], "top string").repartition(tasks)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([f for top in batch["top"] for f in files_of(top)], columns=["path", "size"])

    return tops.mapInPandas(below, "path string, size long")


def _opened(path: str):
    """A file's bytes to read; a plain local path needs no store."""
    from pyarrow import fs

    store, at = open_store(path)
    return open(at, "rb") if isinstance(store, fs.LocalFileSystem) else store.open_input_stream(at)


def bucket(key: Column, n: int = 256) -> Column:
    """The name of one of n folders that take the folders of keys, so that no folder has them all and the driver lists only these."""
    return F.concat(F.lit("bucket="), F.pmod(F.xxhash64(key), F.lit(n)).cast("string"))


def write_files(files: DataFrame, path: str) -> None:
    """Writes a file for each (name, value) row below a folder, its folders with it; names are unique.

    Tasks open the store themselves: Spark's writers sort rows by folder, and the driver then moves each file into place by
    itself. A task that runs again writes the same names again, whole."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, at = open_store(path.removesuffix("/"))
        local, made = isinstance(store, fs.LocalFileSystem), set()
        for batch in batches:
            for name, value in zip(batch["name"], batch["value"], strict=True):
                folder, _, _ = f"{at}/{name}".rpartition("/")
                if folder not in made:
                    os.makedirs(folder, exist_ok=True) if local else store.create_dir(folder)
                    made.add(folder)
                # a local file that is opened through the store costs several times as much
                with open(f"{at}/{name}", "wb") if local else store.open_output_stream(f"{at}/{name}") as f:
                    f.write((value or "").encode())
            made.clear()
            yield pd.DataFrame({"n": [len(batch)]})

    open_store(path)[0].create_dir(open_store(path)[1])
    dealt = files.select("name", "value").repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    dealt.mapInPandas(write, "n long").agg(F.sum("n")).collect()  # one row


def read_files(files: DataFrame, whole: bool = False) -> DataFrame:
    """(path, value) of listed (path, size) files: a row a line, without blank ones, or a row a file without a last newline. Bytes that are no UTF-8 are replaced."""
    total = files.agg(F.sum(F.col("size") + OPEN_BYTES)).collect()[0][0] or 0
    tasks = max(1, min(MOST_TASKS, -(-total // TASK_BYTES)))
    tasks = max(tasks, min(files.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * OPEN_BYTES))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths, values, held = [], [], 0
            for path, size in zip(batch["path"], batch["size"], strict=True):
                with _opened(path) as f:
                    text = f.read().decode("utf-8", "replace")
                rows = [text.removesuffix("\n")] if whole else [x for x in text.split("\n") if x.strip()]
                paths += [path] * len(rows)
                values += rows
                held += size
                if held > TASK_BYTES:
                    yield pd.DataFrame({"path": paths, "value": values})
                    paths, values, held = [], [], 0
            yield pd.DataFrame({"path": paths, "value": values})

    return files.repartition(tasks).mapInPandas(read, "path string, value string")
