"""Counts kept current from change feeds: every change takes back what the version before it counted.

A stream of row versions becomes signed rows: the version a change replaces with -1, the new one
with +1. Whatever is a count of rows by some key, such as active reservations per hotel, uses of a key value
or children of a parent, is then a sum of signs. The versions are a table in buckets of keys; a micro-batch is joined
to it by grouping and rewrites the buckets of its own keys only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodgeframe.schemas import FOREIGN_KEYS
from lodgeframe.sources.copies import RowVersions, SignedCounts

@dataclass
class SignedRows:
    """A stream of row versions whose micro-batches, held against the versions before, become signed rows."""

    feed: DataFrame
    columns: list[str]

    def of_batch(self, batch: DataFrame, number: int, versions: RowVersions) -> DataFrame:
        """``table_name, key, sign`` and the columns, as text, of what the micro-batch changes."""
        changed = versions.add(batch, number)
        signs = F.array(
            *[F.struct(F.lit(sign).alias("sign"), F.col(name).alias("row")) for name, sign in (("previous", -1), ("version", 1))]
        )
        there = changed.select("table_name", "key", F.explode(signs).alias("s")).where("s.row.op <> 'D'")
        return there.select("table_name", "key", "s.sign", *[F.col("s.row")[c].alias(c) for c in self.columns])


def signed_rows(feed: DataFrame, columns: list[str]) -> SignedRows:
    """Signed rows from a stream of ``table_name, key, seq, ts, origin, op`` and the columns.

    The winning version of a row is the latest by time, then origin, then number; older ones that come late change
    nothing. A key's versions of a micro-batch count as their winner. Versions may come in any order.
    """
    version = F.struct(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"),
        "origin",
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("op", F.lit("")).alias("op"),
        *[F.col(c).cast("string").alias(c) for c in columns],
    )
    return SignedRows(feed.select("table_name", F.col("key").cast("string").alias("key"), version.alias("version")), columns)


def keep_counts(
    signed: SignedRows, counted: Callable[[DataFrame], DataFrame], counts: SignedCounts, checkpoint: str
) -> StreamingQuery:
    """Adds each micro-batch to ``counts``; ``counted`` turns signed rows into the counts' keys and ``n``.

    The versions lie beside the counts. A micro-batch that is repeated after a failure is recognised by its
    number: it meets the same versions as before and adds nothing.
    """
    versions = RowVersions(counts.spark, f"{counts.root}/versions", signed.feed.schema["version"].dataType, counts.buckets)
    return (
        signed.feed.writeStream.foreachBatch(
            lambda batch, number: counts.add(counted(signed.of_batch(batch, number, versions)), number)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def by_columns(*names: str) -> Callable[[DataFrame], DataFrame]:
    """Counts rows by the named columns."""
    return lambda signed: signed.select(*names, F.col("sign").alias("n"))


def key_uses(
    unique: list[tuple[str, list[str]]], foreign: list[tuple[str, str, str]] = FOREIGN_KEYS
) -> Callable[[DataFrame], DataFrame]:
    """Counts ``rule, value``: uses of unique keys, values of foreign keys, and ids of the tables these name.

    Keys with an absent part don't count. ``rule`` is ``unique:table:columns``, ``child:table:column`` or ``id:table``.
    """

    def uses(signed: DataFrame) -> DataFrame:
        def use(table: str, rule: str, columns: list[str]) -> Column:
            whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns], F.col("table_name") == table)
            return F.when(whole, F.struct(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("value")))

        every = [use(table, f"unique:{table}:{','.join(columns)}", columns) for table, columns in unique]
        every += [use(child, f"child:{child}:{column}", [column]) for child, column, _ in foreign]
        every += [use(parent, f"id:{parent}", ["key"]) for parent in dict.fromkeys(rule[2] for rule in foreign)]
        return signed.select("sign", F.explode(F.array_compact(F.array(*every))).alias("u")).select(
            "u.rule", "u.value", F.col("sign").alias("n")
        )

    return uses


def duplicates(counts: DataFrame) -> DataFrame:
    """``table_name, key_columns, key_value, rows_found`` of unique keys in use more than once."""
    named = F.split("rule", ":")
    return counts.where("rule LIKE 'unique:%' AND n > 1").select(
        named[1].alias("table_name"), named[2].alias("key_columns"), F.col("value").alias("key_value"), F.col("n").alias("rows_found")
    )


def orphans(counts: DataFrame, foreign: list[tuple[str, str, str]] = FOREIGN_KEYS) -> DataFrame:
    """``table_name, column_name, value, rows_found`` of foreign keys in use whose parent is not there."""
    parents = F.create_map(*[F.lit(x) for child, column, parent in foreign for x in (f"child:{child}:{column}", f"id:{parent}")])
    used = counts.where("rule LIKE 'child:%' AND n > 0").withColumn("parent", parents[F.col("rule")])
    there = counts.where("rule LIKE 'id:%' AND n > 0").select(F.col("rule").alias("parent"), "value")
    named = F.split("rule", ":")
    return used.join(there, ["parent", "value"], "left_anti").select(
        named[1].alias("table_name"), named[2].alias("column_name"), "value", F.col("n").alias("rows_found")
    )
