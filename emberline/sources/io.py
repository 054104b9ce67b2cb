"""Readers that keep a row's place and tolerate bad lines, and sinks. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import is_json
from . import ranges


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): lines in order; pos rises within a file and across partitions."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Parsed rows with file and pos; blank lines are skipped, malformed ones keep their place with `bad` true."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = read_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema))
    return parsed.select("file", "pos", (~is_json(F.col("value"))).alias("bad"), "row.*")


def _whole(rows: DataFrame, faulty: F.Column) -> DataFrame:
    """The rows of files without a faulty one."""
    return rows.join(rows.where(faulty).select("file").distinct(), "file", "left_anti")


def read_json_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character of each file; an array that is broken has no rows.

    Lines of one file are read by many tasks; an array streams through one, an element at a time."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = _whole(ranges.json_rows(spark, path), F.col("value").isNull() & (F.col("first") < 0))
    return rows.select("file", F.from_json("value", schema).alias("row")).select("file", "row.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line; blank lines and # comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where((F.col("id") != "") & ~F.startswith("id", F.lit("#"))).distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a file without a header raises."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if not df.columns:
        raise ValueError(f"no header in {path}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_by(df: DataFrame, path: str, *columns: str, fmt: str = "parquet") -> None:
    """One folder per value; rows of a value may come from many tasks."""
    df.write.mode("overwrite").partitionBy(*columns).format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, required: tuple[str, ...] = ()) -> list[str]:
    """Writes JSON lines; returns required columns that are missing, which only warns."""
    df.write.mode("overwrite").json(path)
    return [c for c in required if c not in df.columns]


def files_exist(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path or matches a pattern, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_or_none(spark: SparkSession, path: str, schema: StructType | str, read=None) -> DataFrame:
    """A file's rows, or none of that schema if it is not there."""
    return (read or read_json_any)(spark, path, schema) if files_exist(spark, path) else spark.createDataFrame([], schema)


def read_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON files that hold a list; a missing, corrupt or other file counts as an empty list."""
    if not files_exist(spark, path):
        return spark.createDataFrame([], schema)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lists = ranges.json_rows(spark, path, rows="lists")
    return _whole(lists, F.col("value").isNull() | ~is_json(F.col("value"))).select(F.from_json("value", schema).alias("row")).select("row.*")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(id, won): 1 where the last row of an id concludes in success or else passed verification, from a JSON list or lines."""
    schema = "id string, conclusion string, verification_passed boolean"
    each = ranges.json_rows(spark, path).select("file", F.col("first").alias("pos"), F.from_json("value", schema).alias("r")).select("file", "pos", "r.*").where("id IS NOT NULL")
    won = F.when((F.col("conclusion") == "success") | F.coalesce("verification_passed", F.lit(False)), 1).otherwise(0)
    return each.groupBy("id").agg(F.max_by(won, F.struct("file", "pos")).alias("won"))


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, row) of JSON objects by key, and of lists whose rows are known by id, instance_id or sha_fail; rows without any, values that
    are no objects and files that are broken are left out. A file streams through a task, a row at a time."""
    rows = _whole(ranges.json_rows(spark, path, rows="entries"), F.col("value").isNull() & (F.col("first") < 0))
    entry = F.startswith("value", F.lit('"'))
    keyed = rows.where(entry).select(F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), f"map<string,{schema}>")).alias("key", "row"))
    named = rows.where(~entry).select(F.from_json("value", schema).alias("row"))
    named = named.select(F.coalesce(*(F.nullif(F.col(f"row.{n}"), F.lit("")) for n in ("id", "instance_id", "sha_fail"))).alias("key"), "row")
    return keyed.unionByName(named).where("key IS NOT NULL AND row IS NOT NULL")


def folder_of(depth: int = 0) -> F.Column:
    """The name of the folder that a row's file lies in, or of one further up."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2 - depth)


def write_id_lists(df: DataFrame, path: str, by: str, key: str) -> None:
    """One sorted text list of ids for each value of a column."""
    df.select(F.col(by), F.col(key).cast("string").alias("value")).repartition(F.col(by)).sortWithinPartitions(by, "value").write.partitionBy(by).text(path)
