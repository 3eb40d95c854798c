"""Tables on shared storage: node-partitioned Parquet, JSON rows and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from lodgeframe.functions.text import json_rows
from lodgeframe.operators.replication import latest_changes
from lodgeframe.schemas import BRANCH_TABLES, schema


def node_schema(table: str) -> StructType:
    return StructType([*schema(table).fields, StructField("node", StringType())])


def write_by_node(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per node. The rebalance splits a big node over many tasks and joins small ones."""
    df.hint("rebalance", "node").write.mode(mode).partitionBy("node").parquet(path)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table under ``root`` with its declared schema; branch tables carry their ``node``."""
    declared = node_schema(table) if table in BRANCH_TABLES else schema(table)
    return spark.read.schema(declared).parquet(f"{root}/{table}")


def write_json(df: DataFrame, path: str, time_columns: tuple[str, ...] = ()) -> None:
    json_rows(df, time_columns).write.mode("overwrite").text(path)


class ChangeLog:
    """A table kept as a snapshot and the changes since, both plain Parquet folders.

    A batch of changes is written to a folder named after it, so writing it again after a failure
    replaces it. Readers take the latest change per key, which also makes overlapping batches safe.
    """

    def __init__(self, spark: SparkSession, root: str, feed: StructType):
        self.spark = spark
        self.root = root
        self.feed = feed

    def append(self, changes: DataFrame, batch: int) -> None:
        """Keeps only the batch's last change per key; earlier ones can never win."""
        kept = latest_changes(changes).select(*self.feed.fieldNames())
        kept.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.feed).parquet(f"{self.root}/changes")

    def latest(self) -> DataFrame:
        """The last change of every key, deletes included."""
        return latest_changes(self.changes())

    def current(self) -> DataFrame:
        return self.latest().where("op <> 'D'")

    def compact(self, into: str) -> ChangeLog:
        """A new log under ``into`` holding one batch: the last change of every key."""
        fresh = ChangeLog(self.spark, into, self.feed)
        fresh.append(self.changes(), -1)
        return fresh


def files_under(spark: SparkSession, path: str) -> list[str]:
    """The data files below a folder, by names relative to it; none if it is missing. Folder names are listed, no data is read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    base, found = system.getFileStatus(folder).getPath().toString(), []
    every = system.listFiles(folder, True)
    while every.hasNext():
        name = every.next().getPath().toString().removeprefix(base).lstrip("/")
        if name.endswith(".parquet") and "/_temporary/" not in f"/{name}":
            found.append(name)
    return sorted(found)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder and what lies below it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
