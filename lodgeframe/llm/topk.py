"""Exact top-k by inner product, pruned by segment means and deviations from coarse to fine.

A vector's segments have means and deviations; of two vectors, each segment's part of the inner
product is at most length * (mean * mean + deviation * deviation) (so the distance is at least that
of means and deviations). Pairs whose bound is below the query's k-th best score so far are dropped
at each level; only survivors are computed exactly.

Bad and odd input: vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id. Vectors are compared with those of their own dimension. Rows of one id count as
one item with its best score; a query's own id is no candidate. Ties go to the smaller id. Empty
tables give empty ones; extra columns don't matter. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments at each level.
LEVELS = (1, 4, 16)
QUERIES_AT_ONCE = 4096
CANDIDATES_AT_ONCE = 8192
_STEP = 1024


def _segments(x: np.ndarray, count: int) -> np.ndarray:
    """Features whose inner product bounds that of the vectors: scaled means and deviations by segment."""
    starts = np.linspace(0, x.shape[1], min(count, x.shape[1]) + 1).astype(int)[:-1]
    sizes = np.diff(np.append(starts, x.shape[1]))
    means = np.add.reduceat(x, starts, axis=1) / sizes
    squares = np.add.reduceat(x * x, starts, axis=1) / sizes
    spread = np.sqrt(np.maximum(squares - means**2, 0))
    return np.hstack([means, spread]) * np.sqrt(np.append(sizes, sizes))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id; ids are one row or one row for each."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:
        # Columns stand in the order of ids, so the first of equal maxima is the one wanted.
        scores, rows = scores.copy(), np.arange(len(scores))
        top, names = np.full((len(scores), k), -np.inf), np.zeros((len(scores), k), dtype=np.int64)
        for r in range(k):
            at = scores.argmax(axis=1)
            top[:, r], names[:, r] = scores[rows, at], ids[rows, at]
            scores[rows, at] = -np.inf
        return top, names
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's k best vectors (-inf where there are fewer), and pairs computed.

    The vectors are integers; ids may repeat next to each other once sorted.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    exact_type = np.float64
    if vectors.shape[1] and len(vectors) and len(queries):
        largest = np.abs(vectors).max() * float(np.abs(queries).max()) * vectors.shape[1]
        exact_type = np.float64 if largest < 2**52 else np.int64
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    scores = np.full((len(q), k), -np.inf)
    names = np.zeros((len(q), k), dtype=np.int64)
    computed = 0
    features = [(_segments(q, m), _segments(x, m)) for m in LEVELS] if x.shape[1] else []
    slack = 1e-9 * (1 + np.sqrt((q * q).sum(axis=1))) * (1 + np.sqrt((x * x).sum(axis=1).max(initial=0)))
    at = 0
    while at < len(ids):
        # Rows of one id stay together.
        end = min(at + _STEP, len(ids))
        end = int(np.searchsorted(ids, ids[end - 1], side="right"))
        rows, cols = np.arange(len(q)), np.arange(at, end)
        for fq, fx in features:
            near = fq[rows] @ fx[cols].T >= (scores[rows, -1] - slack[rows])[:, None]
            rows, cols = rows[near.any(axis=1)], cols[near.any(axis=0)]
            if not len(rows):
                break
        if len(rows):
            found = queries[rows].astype(exact_type) @ vectors[cols].astype(exact_type).T
            computed += found.size
            found, own = found.astype(np.float64) if exact_type is np.float64 else found, ids[cols]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            if len(starts) < len(own):
                found, own = np.maximum.reduceat(found, starts, axis=1), own[starts]
            found = np.where(own[None, :] == query_ids[rows][:, None], -np.inf, found)
            top, top_ids = _best(found, own[None, :], k)
            scores[rows], names[rows] = _best(np.hstack([scores[rows], top]), np.hstack([names[rows], top_ids]), k)
        at = end
    return scores, names, computed


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k best other ids.

    The rows are cut into slices and the queries into groups; each slice meets each group once, and
    no task holds more than about CANDIDATES_AT_ONCE rows and QUERIES_AT_ONCE queries.
    """
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
        .select(
            "id",
            F.coalesce("is_query", F.lit(False)).alias("is_query"),
            F.size("v").alias("dim"),
            F.transform("v", lambda e: F.floor(e.cast("double") * scale)).alias("v"),
        )
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    slices = max(1, -(-sizes["n"] // CANDIDATES_AT_ONCE))
    groups = max(1, -(-sizes["q"] // QUERIES_AT_ONCE))
    part = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("dim", part(slices).alias("slice"), each(groups).alias("team"), "id", "v")
    right = rows.where("is_query").select("dim", each(slices).alias("slice"), part(groups).alias("team"), "id", "v")

    def meet(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        out = {"query_id": [], "id": [], "score": []}
        if len(candidates) and len(queries):
            stack = lambda frame: np.array(frame["v"].tolist(), dtype=np.int64).reshape(len(frame), dim)
            asked = queries["id"].to_numpy()
            scores, names, _ = search(stack(queries), asked, stack(candidates), candidates["id"].to_numpy(), k)
            row, rank = np.nonzero(scores > -np.inf)
            out = {"query_id": asked[row], "id": names[row, rank], "score": scores[row, rank].astype(np.int64)}
        return pd.DataFrame(out).astype("int64")

    keys = ["dim", "slice", "team"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, id long, score long")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )
