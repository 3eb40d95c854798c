"""Training rows: a bounded part of labelled rows, and the folds of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def is_fold(id_col: str | Column, folds: int, number: int) -> Column:
    """Whether the id belongs to that fold; a null id belongs to none."""
    return F.coalesce(fold(id_col, folds) == number, F.lit(False))


#: Rows drawn of each class before the first ones are taken, as a multiple of those wanted.
SPARE = 4


def first_per_class(rows: DataFrame, class_col: str, order: Column, most: int) -> DataFrame:
    """Of each class the first ``most`` rows, or all if it has fewer. A task passes on no more than that of a class."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(class_col).orderBy(order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def drawn_per_class(rows: DataFrame, class_col: str, most: int) -> DataFrame:
    """Of each class ``most`` rows drawn at random, or all if it has fewer: never more, and equal rows count as any others.

    The classes are counted on Spark; each row draws a number from a fixed seed, about SPARE times the
    rows wanted pass by their class's share, and of those the lowest numbers stay.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[x for c, n in sorted(counts.items()) for x in (F.lit(c), F.lit(min(1.0, SPARE * most / n)))])
    drawn = rows.where(F.col(class_col).isNotNull()).withColumn("_draw", F.rand(17))
    return first_per_class(drawn.where(F.col("_draw") < share[F.col(class_col)]), class_col, F.col("_draw"), most).drop("_draw")
