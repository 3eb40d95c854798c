"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference vectors drawn from the data, about the square root of its size. A vector is
described by its nearest pivots in order; each of these has an inverted list. Two vectors are
candidates if they share MIN_SHARED of their pivots, and are verified in double precision in the
list of the lowest pivot they share, so once. Links come out counted per vector and as spanning
forests, never as all pairs. Copies are compared once and counted as often as they occur.

Measured recall is in the README. Bad and odd input: vectors that are null, zero or empty, or hold a
null or non-finite component, and rows without a label or id, link with nothing; they are their own
component (null without an id) and are kept. Vectors of different dimensions never link. Repeated
rows are vectors of their own. Empty tables give empty ones; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.components import connected_components, join_sets
from lodgeframe.session import cut_lineage

THRESHOLD = 0.93
#: Nearest pivots that describe a vector, and how many of them candidates share.
NEAREST = 6
MIN_SHARED = 2
#: Pivots at most; at 64 dimensions 8 MB are sent to each executor.
MOST_PIVOTS = 16384
#: Rows of a list that are compared in one piece; longer lists are cut into slices that meet pairwise.
SLICE_ROWS = 1024
_FORM = "node long, label {kind}, dim int, copies long, v binary, pivots array<int>"


def _matrix(column: pa.Array, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(rows, dim)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Indices of the nearest pivots by cosine, nearest first; fewer if there are fewer pivots."""
    take = min(nearest, len(pivots))
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    some = np.argpartition(-sims, take - 1, axis=1)[:, :take] if take < len(pivots) else np.tile(np.arange(take), (len(x), 1))
    order = np.lexsort((some, -np.take_along_axis(sims, some, 1)), axis=1)
    return np.take_along_axis(some, order, 1)


def candidates(left: np.ndarray, right: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which pairs of pivot lists share enough pivots and meet first in this pivot's list."""
    names = np.unique(np.concatenate([left.ravel(), right.ravel()]))
    marks = []
    for lists in (left, right):
        mark = np.zeros((len(lists), len(names)), dtype=np.float32)
        mark[np.arange(len(lists))[:, None], np.searchsorted(names, lists)] = 1
        marks.append(mark)
    low = int(np.searchsorted(names, pivot))
    enough = marks[0] @ marks[1].T >= min(shared, left.shape[1])
    return enough & (marks[0][:, :low] @ marks[1][:, :low].T == 0)


def _describe(index: dict[int, np.ndarray], kind: str):
    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            vectors = batch.column(4).to_pylist()
            blobs: list = [b""] * len(vectors)
            lists: list = [[-1]] * len(vectors)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.array([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), int(dim))
                found = nearest_pivots(x, index[int(dim)], NEAREST).tolist() if int(dim) in index else [[-1]] * len(rows)
                for i, row, own in zip(rows, x, found):
                    blobs[i], lists[i] = row.astype("<f8").tobytes(), own
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(4)] + [pa.array(blobs, pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
                names=["node", "label", "dim", "copies", "v", "pivots"],
            )

    return run


def _compare(threshold: float, shared: int):
    """Rows come sorted by group: (group, node, copies, dim, v, pivots, pivot, own, other)."""

    def links(table: pa.Table):
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        dim, pivot = table.column("dim")[0].as_py(), table.column("pivot")[0].as_py()
        x = _matrix(table.column("v"), len(node), dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = np.array(table.column("pivots").to_pylist(), dtype=np.int64)
        own = table.column("own").to_numpy()
        one = own.min() == own.max() and bool((own == table.column("other").to_numpy()).all())
        left, right = (np.arange(len(node)),) * 2 if one else (np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min()))
        near = np.zeros((len(left), len(right)), dtype=bool)
        if len(left) and len(right):
            near = (x[left] @ x[right].T >= threshold) & candidates(lists[left], lists[right], pivot, shared)
        if one:
            np.fill_diagonal(near, False)
        count = np.zeros(len(node), dtype=np.int64)
        count[left] += near @ copies[right]
        if not one:
            count[right] += near.T @ copies[left]
        a, b = np.nonzero(np.triu(near) if one else near)
        parent = join_sets(np.arange(len(node)), left[a], right[b])
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[some]), pa.array(count[some]), pa.array(node[parent[some]])], names=["node", "links", "root"]
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and held[0].column(0)[0].as_py() != int(groups[start]):
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links of cosine >= threshold within a label.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, and
    kept says whether that is the row's own.
    """
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    fine = F.coalesce(usable & ~bad & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).select(
        "id", "label", "v", F.when(fine, F.xxhash64("label", "v")).alias("node")
    )
    kind = rows.schema["label"].dataType.simpleString()
    distinct = cut_lineage(
        rows.where("node is not null")
        .groupBy("node", "label", "v")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
        .select("node", "label", F.size("v").alias("dim"), "copies", "v", "least_id")
    )
    index: dict[int, list] = {}
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    if sizes:
        wanted = {dim: min(MOST_PIVOTS, int(np.ceil(np.sqrt(n)))) for dim, n in sizes.items()}
        share = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, wanted[dim] / n)])
        drawn = distinct.where(F.pmod("node", F.lit(1 << 30)) < share[F.col("dim")] * (1 << 30))
        for r in drawn.orderBy("node").select("dim", "v").collect():
            index.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: np.array(v, dtype=np.float64).reshape(len(v), dim) for dim, v in index.items()}
    pivots = {dim: v / np.linalg.norm(v, axis=1, keepdims=True) for dim, v in pivots.items()}
    listed = (
        distinct.select("node", "label", "dim", "copies", "v")
        .mapInArrow(_describe(pivots, kind), _FORM.format(kind=kind))
        .withColumn("pivot", F.explode("pivots"))
    )
    keys = ["label", "dim", "pivot"]
    long = listed.groupBy(*keys).count().where(F.col("count") > SLICE_ROWS).select(
        *keys, F.ceil(F.col("count") / SLICE_ROWS).cast("int").alias("slices")
    )
    grouped = (
        listed.join(long, keys, "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(
            F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")).alias("group"),
            "node", "copies", "dim", "v", "pivots", "pivot", "own", "other",
        )
    )
    met = cut_lineage(
        grouped.repartition("group").sortWithinPartitions("group", "node")
        .mapInArrow(_compare(threshold, MIN_SHARED), "node long, links long, root long")
    )
    found = connected_components(met, "node", "root")
    counted = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        distinct.select("node", "copies", "least_id")
        .join(counted, "node", "left")
        .join(found, "node", "left")
        .select("node", "least_id", F.coalesce("component", "node").alias("component"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("node", "n_links", "component_id")
    joined = rows.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
