"""Copies of tables that follow a change feed: a branch's copy of a reference table, and the centre's consolidated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lodgeframe.operators.replication import latest_changes, replay
from lodgeframe.session import cut_lineage
from lodgeframe.sources.store import drop_folder, files_under

BUCKETS = 64


def _stored(spark: SparkSession, path: str, declared: StructType) -> DataFrame:
    if files_under(spark, path):
        return spark.read.schema(declared).parquet(path)
    return spark.createDataFrame([], declared)


def _replace_buckets(rows: DataFrame, path: str) -> None:
    """Writes whole buckets in place of their old files. The rows are saved first, as they may come from those."""
    cut_lineage(rows).hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)


class SubscribedCopy:
    """A copy of a keyed table, taken at a position of its feed, and the changes that lie after it.

    The table has one writer, which numbers its changes with ``seq``. A copy is taken of the table as
    it is at a position, while the writer goes on; the feed is delivered later, from any place at or
    before that position on. What the copy holds already is skipped, so changes made during the copy
    arrive once however often they are sent. A delivery is a folder named after its last position, so
    one that fails is written again in its place.
    """

    def __init__(self, spark: SparkSession, root: str, table: StructType, columns: list[str], key_type: str = "bigint"):
        self.spark, self.root, self.table, self.columns = spark, root, table, columns
        types = {f.name: f.dataType.simpleString() for f in table.fields}
        values = ", ".join(f"{c} {types[c]}" for c in columns)
        self.feed = StructType.fromDDL(f"seq bigint, op string, key {key_type}, {values}, upto bigint")

    @staticmethod
    def _cast(fields) -> list:
        return [F.col(f.name).cast(f.dataType) for f in fields]

    def take(self, rows: DataFrame, position: int) -> None:
        """Saves the rows as the table at that position."""
        rows.select(*self._cast(self.table.fields)).write.mode("overwrite").parquet(f"{self.root}/copy/position={position}")

    def _taken(self) -> DataFrame:
        return _stored(self.spark, f"{self.root}/copy", StructType([*self.table.fields, *StructType.fromDDL("position bigint")]))

    def _delivered(self) -> DataFrame:
        return _stored(self.spark, f"{self.root}/changes", self.feed)

    def position(self) -> int:
        """How far the copy has come. Positions are folder names, so an empty copy counts as well."""
        found = [
            int(name.split("=")[1])
            for part in ("copy", "changes")
            for name in {p for f in files_under(self.spark, f"{self.root}/{part}") for p in f.split("/") if "=" in p}
        ]
        return max(found, default=-1)

    def deliver(self, changes: DataFrame) -> None:
        """Adds what lies after the copy's position."""
        fresh = cut_lineage(changes.where(F.col("seq") > self.position()).select(*self._cast(self.feed.fields[:-1])))
        last = fresh.agg(F.max("seq")).first()[0]
        if last is not None:
            fresh.write.mode("overwrite").parquet(f"{self.root}/changes/upto={last}")

    def current(self) -> DataFrame:
        return replay(self._taken().drop("position"), self._delivered().drop("upto"), self.columns)


class CentreTable:
    """One table at the centre, consolidated from the branches' changes, whole rows in buckets of keys.

    Of each key the winning change is kept, deletes included, so late changes meet the version they
    lost to. Changes of an origin arrive in ``seq`` order; the highest one applied is its mark, and
    what lies at or before it is skipped. A batch rewrites the buckets of its fresh keys only, and one
    that brings nothing new writes no file. Marks are saved after the rows: a batch that fails in
    between is applied again, which changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, columns: StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        feed = StructType.fromDDL("seq bigint, ts timestamp_ntz, origin string, op string, key bigint")
        self.feed = StructType([*feed.fields, *columns.fields])
        self.columns = columns.fieldNames()

    def marks(self) -> DataFrame:
        """``origin, mark``: how far each origin's changes have been applied."""
        kept = _stored(self.spark, f"{self.root}/marks", StructType.fromDDL("origin string, mark bigint"))
        return kept.groupBy("origin").agg(F.max("mark").alias("mark"))

    def _rows(self) -> DataFrame:
        return _stored(self.spark, f"{self.root}/rows", StructType([*self.feed.fields, *StructType.fromDDL("bucket int")]))

    def apply(self, changes: DataFrame) -> int:
        """Applies a batch and returns the number of buckets it rewrote."""
        sent = changes.select(*self.feed.fieldNames()).join(self.marks(), "origin", "left")
        fresh = cut_lineage(
            sent.where("mark IS NULL OR seq > mark")
            .drop("mark")
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        )
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            kept = self._rows().where(F.col("bucket").isin(touched))
            order = [*self.feed.fieldNames(), "bucket"]
            merged = latest_changes(kept.select(*order).union(fresh.select(*order)))
            _replace_buckets(merged.select(*order), f"{self.root}/rows")
            reached = fresh.groupBy("origin").agg(F.max("seq").alias("mark")).coalesce(1)
            reached.write.mode("append").parquet(f"{self.root}/marks")
        return len(touched)

    def current(self) -> DataFrame:
        """``node, key`` and the columns of the rows that are there."""
        return self._rows().where("op <> 'D'").select(F.col("origin").alias("node"), "key", *self.columns)


class RowVersions:
    """The winning version of every row of a feed, in buckets of keys.

    Micro-batches come in order of their numbers. Each writes the buckets of its own keys anew, to a folder of its
    own, from the newest ones of lower numbers. A batch that fails half way and comes again therefore
    meets the same versions and writes the same rows. Buckets that were replaced before the last batch go.
    """

    def __init__(self, spark: SparkSession, root: str, version: StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.kept = StructType(
            [*StructType.fromDDL("table_name string, key string").fields]
            + [StructField(name, version) for name in ("version", "previous")]
            + [StructField("changed", BooleanType()), StructField("bucket", IntegerType())]
        )

    def _newest(self, before: int) -> dict[int, int]:
        """The last batch lower than that which wrote each bucket. Folder names are listed, no data is read."""
        written = {tuple(int(part.split("=")[1]) for part in name.split("/")[:2]) for name in files_under(self.spark, self.root)}
        newest: dict[int, int] = {}
        for number, bucket in written:
            if number < before:
                newest[bucket] = max(number, newest.get(bucket, -1))
        for number, bucket in written:
            if number < newest.get(bucket, -1):
                drop_folder(self.spark, f"{self.root}/step={number}/bucket={bucket}")
        return newest

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.kept)
        return self.spark.read.schema(self.kept).option("basePath", self.root).parquet(*folders).drop("step")

    def add(self, came: DataFrame, batch: int) -> DataFrame:
        """Adds ``table_name, key, version`` rows and returns ``version`` and ``previous`` (if any) of the keys changed.

        Versions are ordered by their first three fields. Of the rows of a key in ``came`` the last one counts.
        """
        came = came.withColumn("bucket", F.pmod(F.xxhash64("table_name", "key"), F.lit(self.buckets)).cast("int"))
        touched = [r[0] for r in came.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return self._read([])
        newest = self._newest(batch)
        held = self._read([f"{self.root}/step={newest[b]}/bucket={b}" for b in touched if b in newest])
        names, none = ["bucket", "table_name", "key"], F.lit(None).cast(self.kept["version"].dataType)
        both = held.select(*names, F.col("version").alias("held"), none.alias("came")).union(
            came.select(*names, none.alias("held"), F.col("version").alias("came"))
        )
        last = both.repartition(self.buckets, "bucket").groupBy(*names).agg(
            F.max("held").alias("held"), F.max("came").alias("came")
        )
        order = self.kept["version"].dataType.fieldNames()[:3]
        place = lambda row: F.struct(*[F.col(row)[name] for name in order])
        wins = F.col("held").isNull() | (F.col("came").isNotNull() & (place("held") < place("came")))
        last.select(
            "table_name", "key",
            F.when(wins, F.col("came")).otherwise(F.col("held")).alias("version"),
            F.when(wins, F.col("held")).alias("previous"),
            wins.alias("changed"), "bucket",
        ).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/step={batch}")
        return self._read([f"{self.root}/step={batch}/bucket={b}" for b in touched]).where("changed")


class SignedCounts:
    """Counts by key, kept in buckets of keys from numbered batches of signed numbers.

    A batch rewrites the buckets of its own keys only. Each key remembers the last batch that counted
    for it, so a batch that is sent again, whole or in part, adds nothing; batches come in order.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets
        self.kept = StructType.fromDDL(", ".join(f"`{k}` string" for k in keys) + ", n bigint, batch bigint, bucket int")

    def _rows(self) -> DataFrame:
        return _stored(self.spark, f"{self.root}/counts", self.kept)

    def add(self, signed: DataFrame, batch: int) -> int:
        """Adds ``n`` to each key's count and returns the number of buckets rewritten."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        texts = signed.select(*[F.col(k).cast("string").alias(k) for k in self.keys], "n")
        change = cut_lineage(texts.groupBy(*self.keys).agg(F.sum("n").alias("change")).select("*", bucket))
        touched = [r[0] for r in change.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            names = [*self.keys, "bucket"]
            kept = self._rows().where(F.col("bucket").isin(touched)).select(*names, "n", "batch", F.lit(None).cast("bigint").alias("change"))
            new = change.select(*names, F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("batch"), "change")
            merged = kept.union(new).groupBy(*names).agg(
                F.sum("n").alias("n"), F.max("batch").alias("batch"), F.sum("change").alias("change")
            )
            counts = F.col("change").isNotNull() & (F.col("batch") < batch)
            after = merged.select(
                *self.keys,
                (F.col("n") + F.when(counts, F.col("change")).otherwise(0)).alias("n"),
                F.when(counts, F.lit(batch)).otherwise(F.col("batch")).cast("bigint").alias("batch"),
                "bucket",
            )
            # Zeros of earlier batches can go: only the last batch may come again.
            _replace_buckets(after.where(F.expr(f"n <> 0 OR batch >= {batch}")), f"{self.root}/counts")
        return len(touched)

    def current(self) -> DataFrame:
        """The keys and ``n`` of all counts that are not zero."""
        return self._rows().where("n <> 0").select(*self.keys, "n")


def whole_rows(df: DataFrame, ts: str) -> DataFrame:
    """Rows with ``id`` and ``node`` as the inserts their branch sent, each at the time ``ts``."""
    values = [c for c in df.columns if c not in ("id", "node")]
    return df.select(
        F.col("id").alias("seq"), F.expr(ts).cast("timestamp_ntz").alias("ts"), F.col("node").alias("origin"),
        F.lit("I").alias("op"), F.col("id").alias("key"), *values,
    )
