"""Settings under which streaming queries keep keyed state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Keyed maps and timers need this store. Its change logs keep a commit small (without a file of checksums beside each, which a
#: shared store keeps itself), its memory is bounded for a whole executor, and a task's store goes with its task.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str] = STORE):
    """These settings inside the block, and those from before after it."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
