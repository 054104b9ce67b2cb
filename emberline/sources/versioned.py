"""A keyed table in versions: readers see one version whole, and of two writers one commits and the other tries again.

Rows lie in buckets by a hash of their key. A version is a small manifest that names the folder of each bucket, and it is
created only if its number is free, by an operation that fails where a file is there: a link on a local store, a rename
without overwriting elsewhere (atomic on HDFS; an object store needs one that is). An upsert reads and writes
only the buckets that its rows fall into."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, and attempts of a writer.
BUCKETS, ATTEMPTS = 64, 20


class Conflict(RuntimeError):
    """Others committed first, in every attempt."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the versions that are kept."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n.removesuffix(".json")) for s in self._fs.listStatus(folder) if (n := s.getPath().getName())[0].isdigit())

    def version(self) -> int:
        """The number of the last version; 0 where there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder by bucket of a version, by default of the last."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:010d}.json", wholetext=True).collect()[0][0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, whatever is written meanwhile."""
        return self._rows(self.manifest(version))

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, between: Callable[[int], None] | None = None) -> int:
        """Puts rows in place of those with their keys (of repeated ones any); the number of the new version.

        `between` is called with each attempt's number before it commits."""
        new = rows.dropDuplicates([self.key]).withColumn("bucket", self._bucket())
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # `buckets` at most

        def write(before: dict[str, str], folder: str) -> dict[str, str]:
            old = self._rows({b: f for b, f in before.items() if int(b) in touched})
            kept = old.join(new.select(self.key), self.key, "left_anti").withColumn("bucket", self._bucket())
            self._save(kept.unionByName(new), folder)
            return before | {str(b): folder for b in touched}

        return self._commit(write, between)

    def replace(self, rows: DataFrame, between: Callable[[int], None] | None = None) -> int:
        """Puts rows in place of all there are; the number of the new version."""

        def write(before: dict[str, str], folder: str) -> dict[str, str]:
            self._save(rows.withColumn("bucket", self._bucket()), folder)
            return dict.fromkeys(self._buckets_of(folder), folder)

        return self._commit(write, between)

    def _save(self, rows: DataFrame, folder: str) -> None:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")

    def _buckets_of(self, folder: str) -> list[str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data/{folder}")))
        return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]

    def _commit(self, write: Callable[[dict[str, str], str], dict[str, str]], between: Callable[[int], None] | None) -> int:
        for attempt in range(ATTEMPTS):
            last, folder = self.version(), uuid.uuid4().hex
            after = write(self.manifest(last), folder)
            if between:
                between(attempt)
            if self._create(last + 1, json.dumps(after)):
                return last + 1
            self._fs.delete(self._hadoop.Path(f"{self.path}/data/{folder}"), True)  # nobody names it
        raise Conflict(f"{self.path}: others committed first {ATTEMPTS} times")

    def _create(self, version: int, text: str) -> bool:
        """Whether the manifest of this number is ours. It is written in full under another name first."""
        folder = f"{self.path}/versions"
        target, draft = self._hadoop.Path(f"{folder}/{version:010d}.json"), self._hadoop.Path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            (self._link if self._fs.getUri().getScheme() == "file" else self._rename)(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    @staticmethod
    def _link(draft, target) -> None:
        os.link(draft.toUri().getPath(), target.toUri().getPath())

    def _rename(self, draft, target) -> None:
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(str(target)) from e
            raise

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the folders that only versions before the last `keep` name, and those versions. Their readers end first."""
        every = self.versions()
        gone, kept = every[:-keep], every[-keep:]
        used = {f for v in kept for f in self.manifest(v).values()}
        for v in gone:
            for folder in set(self.manifest(v).values()) - used:
                self._fs.delete(self._hadoop.Path(f"{self.path}/data/{folder}"), True)
            self._fs.delete(self._hadoop.Path(f"{self.path}/versions/{v:010d}.json"), False)
