"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the caller of every column expression takes longer than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here expects; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# What one task reads. A shuffled row takes a task some 450 bytes of memory and 14 bytes of a file.
ROWS_PER_TASK = 250_000
TASK_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def task_sized_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with the same settings but smaller tasks; ``spark`` itself stays as it is.

    By default a task reads 128 MB of a file, and joined shuffle partitions grow to 64 MB, so the memory of a task
    grows with the tables until then.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in TASK_CONF.items():
        own.conf.set(key, value)
    return own


def raise_partitions(spark: SparkSession, rows: int) -> None:
    """Lets shuffles of some ``rows`` rows keep to ``ROWS_PER_TASK``; never lowers the number of partitions."""
    needed = -(-rows // ROWS_PER_TASK)
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(needed))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a session without executors may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if spark.sparkContext.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[spark.sparkContext.applicationId] = tempfile.TemporaryDirectory(prefix="lodgeframe-")
    return _OWN_FOLDERS[spark.sparkContext.applicationId].name


# Folders of local sessions; they go when the process ends.
_OWN_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not replay every earlier round."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
