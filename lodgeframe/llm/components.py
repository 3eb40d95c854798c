"""Connected components of a link table, on Spark from start to end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each linked node and the smallest node it can reach.

    Alternating large and small stars: every round hangs neighbours under the smallest one, so the
    number of rounds grows with the logarithm of a chain's length. A round's edges are written to
    the checkpoint folder. Minima are pre-aggregated before they shuffle, and a node with very many
    links only makes a skewed equi join, which adaptive execution splits. Null ends and loops link
    nothing; no links give an empty table.
    """
    a, b = F.col(src), F.col(dst)
    edges = cut_lineage(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = _signature(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = cut_lineage(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def join_sets(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unites the sets of left[i] and right[i]; parent maps each item to its set's smallest item."""
    while len(left):
        a, b = parent[left], parent[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    return parent
