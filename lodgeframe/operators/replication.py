"""Copies, consolidation and change feeds between the centre and its branches, as batches.

A change feed has ``seq, ts, origin, op, key`` and the changed columns; ``op`` is I, U or D. Where
two nodes write the same key the latest ``ts`` wins, then the greater origin, then the greater
``seq``; that rule is ours, the replicated tables carry none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.schemas import BRANCHES
from lodgeframe.session import cut_lineage

FEED = ["seq", "ts", "origin", "op", "key"]
RECENCY = ["ts", "origin", "seq"]


def distribute_reference(tables: dict[str, DataFrame], branches: list[str] = BRANCHES) -> dict[str, DataFrame]:
    """Each reference table as the branches receive it: all its rows once per ``node``."""
    receivers = F.explode(F.array(*[F.lit(b) for b in branches])).alias("node")
    return {name: df.select("*", receivers) for name, df in tables.items()}


def stacked(table: str, df: DataFrame) -> DataFrame:
    """``table_name, node, id, column_name, value``: a row per cell, so that unlike tables go together.

    Absent values stay NULL.
    """
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in df.columns
        if c not in ("id", "node")
    ]
    return df.select(F.lit(table).alias("table_name"), "node", "id", F.explode(F.array(*cells)).alias("c")).select(
        "table_name", "node", "id", "c.*"
    )


def consolidate(fragments: dict[str, DataFrame]) -> DataFrame:
    """One table from the branches' fragments, each row tagged with its ``node``."""
    tagged = [df.withColumn("node", F.lit(node)) for node, df in fragments.items()]
    return reduce(DataFrame.unionByName, tagged)


def split_by_node(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds the owning node through ``hotel_id``."""
    return df.join(routes.select("hotel_id", "node"), "hotel_id")


def node_scan(df: DataFrame, node: str) -> DataFrame:
    """Rows of one node; on a table written with ``partitionBy('node')`` only its files are read."""
    return df.where(F.col("node") == node)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The winning change per key. Aggregates before the shuffle, so hot keys stay cheap."""
    values = [c for c in changes.columns if c != "key"]
    newest = F.max_by(F.struct(*values), F.struct(*RECENCY)).alias("last")
    return changes.groupBy("key").agg(newest).select("key", "last.*")


def local_changes(received: DataFrame) -> DataFrame:
    """Keeps what a source wrote itself; ``source`` is the sending node. Nothing is passed on twice."""
    return received.where(F.col("origin") == F.col("source")).drop("source")


def sync_tables(feeds: list[DataFrame]) -> DataFrame:
    """The state every node converges to from all nodes' feeds; deleted keys are gone."""
    received = reduce(DataFrame.unionByName, feeds)
    return latest_changes(local_changes(received)).where("op <> 'D'")


def apply_changes(target: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``target`` (keyed by ``id``) after the feed: changed columns replaced, new keys added, deletes gone.

    Of a key that the target lacks only an insert makes a row; an update of it changes nothing.
    Applying the same feed again changes nothing.
    """
    latest = latest_changes(changes.select(*FEED, *columns)).select(
        "key", "op", *[F.col(c).alias(f"new_{c}") for c in columns]
    )
    changed = F.col("op").isNotNull()
    out = []
    for name in target.columns:
        if name == "id":
            out.append(F.coalesce("id", "key").alias("id"))
        elif name in columns:
            out.append(F.when(changed, F.col(f"new_{name}")).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    merged = target.join(latest, target.id == latest.key, "full")
    return merged.where("op IS NULL OR op = 'I' OR (op = 'U' AND id IS NOT NULL)").select(*out)


def replay(target: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``target`` (keyed by ``id``) after its only writer's changes, in ``seq`` order.

    A key is there if its last insert comes after its last delete, or if neither came and it was there
    before; its values are those of its last insert or update. An update of a missing key changes
    nothing. Aggregates before the shuffle, so hot keys stay cheap.
    """
    last = changes.groupBy("key").agg(
        F.max(F.when(F.col("op") == "D", F.col("seq"))).alias("gone"),
        F.max(F.when(F.col("op") == "I", F.col("seq"))).alias("made"),
        F.expr(f"max_by(struct({', '.join(f'`{c}`' for c in columns)}), seq) FILTER (WHERE op <> 'D')").alias("new"),
    )
    there = (
        F.when(F.col("made").isNull() & F.col("gone").isNull(), F.col("id").isNotNull())
        .otherwise(F.coalesce(F.col("made") > F.col("gone"), F.col("made").isNotNull()))
    )
    fresh = F.col("made").isNotNull() & F.col("gone").isNotNull()

    def value(name: str) -> Column:
        if name == "id":
            return F.coalesce("id", "key").alias("id")
        if name in columns:
            return F.when(F.col("new").isNotNull(), F.col("new")[name]).otherwise(F.col(name)).alias(name)
        # A row made anew after its removal keeps nothing of the old one.
        return F.when(~fresh, F.col(name)).alias(name)

    merged = target.join(last, target.id == last.key, "full")
    return merged.where(there).select(*[value(c) for c in target.columns])


def payments_rollup(payments: DataFrame, width: str = "3 hours") -> DataFrame:
    """Count and sum of payments per node and time window; needs ``node, ts, amount``."""
    return (
        payments.groupBy("node", F.window("ts", width).alias("slot"))
        .agg(F.count("*").alias("payments"), F.sum("amount").cast("decimal(18,2)").alias("total"))
        .select("node", F.col("slot.start").alias("window_start"), "payments", "total")
    )


def fragment_parity(branch: DataFrame, centre: DataFrame, table: str) -> DataFrame:
    """Per node: rows on both sides, only at the branch, only at the centre.

    Both tables have ``node, key``. Rows are matched by key; only counts leave the join.
    """
    here = branch.select("node", "key", F.lit(1).alias("at_branch"))
    there = centre.select("node", "key", F.lit(1).alias("at_centre"))
    both = here.join(there, ["node", "key"], "full")
    return both.groupBy("node").agg(
        F.count_if(F.col("at_branch").isNotNull() & F.col("at_centre").isNotNull()).alias("matched"),
        F.count_if(F.col("at_centre").isNull()).alias("missing_at_centre"),
        F.count_if(F.col("at_branch").isNull()).alias("only_at_centre"),
    ).select(F.lit(table).alias("table_name"), "node", "matched", "missing_at_centre", "only_at_centre")


def range_digests(rows: DataFrame, size: int) -> DataFrame:
    """``node, span, rows, digest`` of ``node, key, digest`` rows, per run of ``size`` keys."""
    return rows.groupBy("node", F.floor(F.col("key") / size).alias("span")).agg(
        F.count("*").alias("rows"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest")
    )


def differing_keys(branch: DataFrame, centre: DataFrame, table: str, fan: int = 1024, levels: int = 3) -> DataFrame:
    """Keys whose rows differ between the two sides: ``table_name, node, key, difference``.

    Both sides have ``node, key`` and ``digest``, a hash of the whole row; keys may repeat. Sides are
    compared by digests of key ranges, wide ones first, and only rows of ranges that differ go on to
    the next level, so on equal sides no more than a few sums leave a task.
    """
    for level in range(levels - 1, -1, -1):
        size = fan**level
        here, there = range_digests(branch, size).alias("here"), range_digests(centre, size).alias("there")

        def equal(name: str) -> Column:
            return F.col(f"here.{name}").eqNullSafe(F.col(f"there.{name}"))

        unequal = (
            here.join(there, equal("node") & equal("span"), "full")
            .where(~(equal("rows") & equal("digest")))
            .select(
                F.coalesce("here.node", "there.node").alias("node"),
                F.coalesce("here.span", "there.span").alias("span"),
                F.when(F.col("there.rows").isNull(), "missing at centre")
                .when(F.col("here.rows").isNull(), "only at centre")
                .otherwise("different")
                .alias("difference"),
            )
        )
        if level:
            unequal = cut_lineage(unequal.drop("difference"))

            def narrowed(rows: DataFrame) -> DataFrame:
                placed = rows.withColumn("span", F.floor(F.col("key") / size))
                return placed.join(unequal, ["node", "span"], "left_semi").drop("span")

            branch, centre = narrowed(branch), narrowed(centre)
    return unequal.select(F.lit(table).alias("table_name"), "node", F.col("span").alias("key"), "difference")
