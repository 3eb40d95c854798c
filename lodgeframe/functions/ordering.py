"""Ranks, first rows per key and ordered folds that stay parallel when one key is huge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import lodgeframe
from lodgeframe.session import cut_lineage

# Fold steps travel with the task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(lodgeframe)

ID_BLOCK = 1 << 16
SALTS = 256
BLOCK_ROWS = 200_000


def rank_by_id(df: DataFrame, keys: list[str], id_column: str, into: str, block: int = ID_BLOCK) -> DataFrame:
    """1-based rank of a unique non-negative integer id within ``keys``.

    Ids are cut into blocks. Rows are ordered inside a block only, and a block's offset comes from
    the row counts of the blocks before it, so no task orders more than ``block`` rows of a key.
    """
    blocked = df.withColumn("_block", F.expr(f"`{id_column}` DIV {block}L"))
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(id_column)
    return (
        blocked.withColumn("_position", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(into, F.col("_offset") + F.col("_position"))
        .drop("_block", "_offset", "_position")
    )


def strided_ids(
    df: DataFrame, writer: str, id_column: str, stride: int, into: str, used: Column | None = None
) -> DataFrame:
    """Ids ``w, w + stride, w + 2 stride ...`` for writer number ``w`` (1 .. stride), in id order.

    ``used`` is the number of ids the writer has given out already.
    """
    taken = used if used is not None else F.lit(0)
    ranked = rank_by_id(df, [writer], id_column, "_rank")
    number = F.col(writer) + F.lit(stride) * (taken + F.col("_rank") - 1)
    return ranked.withColumn(into, number.cast("bigint")).drop("_rank")


def writer_of(strided_id: Column, stride: int) -> Column:
    return (strided_id - 1) % stride + 1


def first_rows(df: DataFrame, keys: list[str], order: list[str], limit: int, salts: int = SALTS) -> DataFrame:
    """The first ``limit`` rows of every key. Each salt is trimmed first, then the survivors."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    per_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    per_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_position", F.row_number().over(per_salt))
        .where(F.col("_position") <= limit)
        .withColumn("_position", F.row_number().over(per_key))
        .where(F.col("_position") <= limit)
        .drop("_salt", "_position")
    )


def rows_after(df: DataFrame, head: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``df`` that come after the last ``head`` row of their key."""
    last = head.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return df.join(last, keys).where(F.struct(*order) > F.col("_last")).drop("_last")


def fold_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    result_ddl: str,
    start: Callable,
    step: Callable,
) -> DataFrame:
    """Reads each key's rows in order and emits a result per row, or none where ``step`` gives None.

    ``start(row)`` makes a key's state and ``step(state, row)`` returns the result values; both see
    the keys and ``columns``. Rows stream through in Arrow batches, so a worker holds one batch and
    one key's state, never a whole group. The partition count is fixed because the bytes, which
    adaptive coalescing goes by, say little about the time Python takes.
    """
    names = [part.split()[0] for part in result_ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            results = []
            for row in batch.itertuples(index=False):
                key = row[: len(keys)]
                if key != current:
                    current, state = key, start(row)
                result = step(state, row)
                if result is not None:
                    results.append(result)
            yield pd.DataFrame(results, columns=names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, *columns).mapInPandas(run, result_ddl)


def ordered_fold(
    events: DataFrame,
    state: DataFrame,
    keys: list[str],
    order: list[str],
    prepare: Callable[[DataFrame, DataFrame], DataFrame],
    decide: Callable[[DataFrame, DataFrame], DataFrame],
    advance: Callable[[DataFrame, DataFrame], DataFrame],
    settle: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    block_rows: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Order-dependent decisions per key, in rounds only when a key has very many rows.

    ``prepare(pending, state)`` looks the state up for all pending rows in parallel and
    ``decide(rows, state)`` decides them in order. With no key above ``block_rows`` that is all.
    Otherwise each round first lets ``settle(rows)`` split off the results the state alone fixes,
    decides the first ``block_rows`` of every key, and brings the state forward with
    ``advance(state, decided)``; the rest waits for the next round. On a crowded key ``settle``
    usually clears most of it at once. ``sized`` is a cheaper superset of the events to measure.
    """
    if not has_large_key(sized if sized is not None else events, keys, block_rows):
        return decide(prepare(events, state), state)
    columns = events.columns
    pending, done = cut_lineage(events), []
    while True:
        open_rows = cut_lineage(prepare(pending, state))
        if settle is not None:
            settled, open_rows = settle(open_rows)
            done.append(settled)
        if not has_large_key(open_rows, keys, block_rows):
            done.append(decide(open_rows, state))
            break
        head = cut_lineage(first_rows(open_rows, keys, order, block_rows))
        decided = cut_lineage(decide(head, state))
        done.append(decided)
        state = cut_lineage(advance(state, decided))
        pending = cut_lineage(rows_after(open_rows.select(*columns), head, keys, order))
    return reduce(DataFrame.unionByName, done)


def has_large_key(df: DataFrame, keys: list[str], limit: int) -> bool:
    return not df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty()
