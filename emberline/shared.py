"""The folder that driver and executors share, and tables that are written there and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows in one batch between the JVM and a worker; both hold a few of them at a time, the JVM outside its heap.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="emberline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches keep to BATCH_BYTES, unless its settings say otherwise."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Tables of one iteration, written to a folder of their own and read again: short lineage,
    sizes from the files, and everything but the result goes when the iteration ends.

    Rounds over checkpoints grew slower and slower, most likely (not measured by itself) as a
    checkpoint keeps the size estimate of the plan it cuts, which a self-join squares in
    every round until its digits alone take seconds to multiply."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        return self._write(df, f"{self.base}/{uuid.uuid4().hex}")

    def result(self, df: DataFrame) -> DataFrame:
        """Written beside the rounds, which are then deleted."""
        out = self._write(df, f"{shared_folder(self.spark)}/result-{uuid.uuid4().hex}")
        delete_folder(self.spark, self.base)
        return out

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
