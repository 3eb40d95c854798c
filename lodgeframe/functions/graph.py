"""Groups of rows that depend on each other: overlapping dates in a room, and what links such groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.session import cut_lineage


def islands(rows: DataFrame, key: str, first: str, last: str, member: str) -> DataFrame:
    """``rows`` with ``island``, the lowest member of the row's island.

    An island is a maximal set of stretches of one key that overlap in a chain; stretches that only
    touch are apart. Stretches are reduced to one per key and first day before they are ordered, so
    the ordered rows of a key are bounded by the calendar.
    """
    low, high = F.least(first, last), F.greatest(first, last)
    days = rows.groupBy(key, low.alias("low")).agg(F.max(high).alias("high"), F.min(member).alias("least_member"))
    by_day = Window.partitionBy(key).orderBy("low")
    reached = F.max("high").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("low") >= reached, F.lit(True)).cast("int")
    numbered = days.withColumn("begins", begins).withColumn("number", F.sum("begins").over(by_day))
    named = numbered.select(
        key, "low", F.min("least_member").over(Window.partitionBy(key, "number")).alias("island")
    )
    return rows.withColumn("low", low).join(named, [key, "low"]).drop("low")


def linked_groups(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, linked_group`` for every node of a link to another one: one label per connected component.

    Contraction: each round moves every node to the neighbour of lowest hash, if that is lower than
    its own, and joins the links of nodes that moved together. Hashes make the order random, so the
    nodes left fall by a constant factor a round, whatever the ids; a chain needs logarithmically
    many rounds. Minima are aggregated before the shuffle, so a node with very many links is no one
    task's work. Rounds are checkpointed; labels are looked up backwards through them.
    """
    edges = cut_lineage(
        links.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y").distinct()
    )
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        nearest = both.groupBy("x").agg(F.min(F.struct(F.xxhash64("y").alias("h"), F.col("y").alias("node"))).alias("n"))
        own = F.struct(F.xxhash64("x").alias("h"), F.col("x").alias("node"))
        moved = cut_lineage(nearest.select("x", F.least(F.col("n"), own)["node"].alias("to")))
        moves.append(moved)
        edges = cut_lineage(
            edges.join(moved.withColumnRenamed("to", "new_x"), "x")
            .join(moved.select(F.col("x").alias("y"), F.col("to").alias("new_y")), "y")
            .select(F.col("new_x").alias("x"), F.col("new_y").alias("y"))
            .where("x <> y")
            .distinct()
        )
    if not moves:
        return links.select(F.col(left).alias("node"), F.col(left).alias("linked_group")).limit(0)
    found = moves[-1].select(F.col("x").alias("node"), F.col("to").alias("linked_group"))
    for moved in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("linked_group").alias("further"))
        found = moved.join(later, "to", "left").select(
            F.col("x").alias("node"), F.coalesce("further", "to").alias("linked_group")
        )
    return found
