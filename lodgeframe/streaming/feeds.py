"""Change feeds and rollups as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodgeframe.operators.replication import local_changes
from lodgeframe.sources.store import ChangeLog

# Fixed value: how often payments are consolidated.
ROLLUP_WIDTH = "3 hours"


def read_feed(spark: SparkSession, path: str, declared: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files under ``path`` as a stream."""
    return spark.readStream.schema(declared).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow(feed: DataFrame, log: ChangeLog, checkpoint: str) -> StreamingQuery:
    """Keeps ``log`` current from a feed. Repeated batches overwrite their own folder."""
    return (
        feed.writeStream.foreachBatch(lambda batch, number: log.append(batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_mesh(feeds: list[DataFrame], log: ChangeLog, checkpoint: str) -> StreamingQuery:
    """The same for feeds of several writers of one table; changes passed on by others are dropped."""
    received = feeds[0]
    for feed in feeds[1:]:
        received = received.unionByName(feed)
    return follow(local_changes(received), log, checkpoint)


def rollup_stream(payments: DataFrame, late_by: str = "1 hour", width: str = ROLLUP_WIDTH) -> DataFrame:
    """Payments per node and window from a stream of ``payment_id, node, ts, amount``.

    A payment delivered twice within the allowed lateness counts once. A window is emitted when the
    watermark passes it.
    """
    timed = payments.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late_by)
    return (
        timed.dropDuplicatesWithinWatermark(["payment_id"])
        .groupBy("node", F.window("ts", width).alias("slot"))
        .agg(F.count("*").alias("payments"), F.sum("amount").cast("decimal(18,2)").alias("total"))
        .select("node", F.col("slot.start").alias("window_start"), "payments", "total")
    )


def write_rollup(rolled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        rolled.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
