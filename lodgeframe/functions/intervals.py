"""Date-interval predicates and overlap counting without joining intervals to intervals.

A stay blocks a window under the half-open rule when ``stay.start < window.end`` and
``stay.end > window.start``. The closed rule (``<=`` and ``>=``) is the half-open rule on stays
widened by a day on both sides, so everything below works on half-open stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_OPEN = "half_open"
CLOSED = "closed"

FAR_PAST = "0001-01-01"
FAR_FUTURE = "9999-12-31"


def as_half_open(stays: DataFrame, bounds: str) -> DataFrame:
    if bounds == HALF_OPEN:
        return stays
    return stays.withColumns(
        {"start_date": F.date_sub("start_date", 1), "end_date": F.date_add("end_date", 1)}
    )


def boundary_marks(stays: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows per stay, ``day, starts, ends, empties``: one for its start and one for its end.

    ``empties`` marks the start of a stay without a night.
    """
    empty = (F.col("start_date") == F.col("end_date")).cast("int")

    def mark(day: str, starts: int, ends: int, empties: Column) -> Column:
        return F.struct(
            F.col(day).alias("day"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"), empties.alias("empties")
        )

    marks = F.array(mark("start_date", 1, 0, empty), mark("end_date", 0, 1, F.lit(0)))
    return stays.select(*keys, F.explode(marks).alias("mark")).select(*keys, "mark.*")


def per_day(marks: DataFrame, keys: list[str]) -> DataFrame:
    return marks.groupBy(*keys, "day").agg(*[F.sum(name).alias(name) for name in ("starts", "ends", "empties")])


def running_boundaries(windows: DataFrame, stays: DataFrame, keys: list[str]) -> DataFrame:
    """``so_far = [started before, ended by, empty on]`` for every day a window starts or ends on.

    Stays are counted per key and day before anything is ordered, so the window function sees at
    most one row per key and calendar day however many stays a key has. The counts share an
    array so that both lookups below need the very same columns and Spark computes them once.
    """
    none = [F.lit(0).alias(name) for name in ("starts", "ends", "empties")]
    probes = windows.select(*keys, F.explode(F.array("start_date", "end_date")).alias("day")).select(*keys, "day", *none)
    days = per_day(boundary_marks(stays, keys).union(probes), keys)
    so_far = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.sum("starts").over(so_far) - F.col("starts")
    return days.select(
        *keys, "day", F.array(started, F.sum("ends").over(so_far), F.col("empties")).alias("so_far")
    )


def count_overlaps(
    windows: DataFrame, stays: DataFrame, keys: list[str], bounds: str = HALF_OPEN, into: str = "overlap_count"
) -> DataFrame:
    """Adds to each window the number of stays of the same key that overlap it.

    Stays have ``start_date <= end_date``. A stay that does not overlap either ended by the window's
    start or starts at or after its end, so the count is (started before the end) - (ended by the
    start). Only a stay without a night on the day of a window without a night is both; such stays
    are counted apart. A window that ends before it starts gets NULL.
    """
    days = running_boundaries(windows, as_half_open(stays, bounds), keys)

    def on(side: str, day: str) -> Column:
        pairs = [F.col(f"{side}.{key}") == F.col(f"w.{key}") for key in keys]
        return reduce(Column.__and__, pairs, F.col(f"{side}.day") == F.col(f"w.{day}"))

    joined = (
        windows.alias("w")
        .join(days.alias("opening"), on("opening", "start_date"), "left")
        .join(days.alias("closing"), on("closing", "end_date"), "left")
    )
    twice = F.when(F.col("w.start_date") == F.col("w.end_date"), F.col("opening.so_far")[2]).otherwise(0)
    counted = F.coalesce(F.col("closing.so_far")[0] - F.col("opening.so_far")[1] + twice, F.lit(0))
    forward = F.col("w.start_date") <= F.col("w.end_date")
    return joined.select("w.*", F.when(forward, counted.cast("bigint")).alias(into))


def free_gaps(rooms: DataFrame, stays: DataFrame, bounds: str = HALF_OPEN, single_days: bool = False) -> DataFrame:
    """Longest free stretches of each room: ``room_id, gap_start, gap_end``.

    A window fits a room exactly when one of its gaps holds the whole window. For windows without a
    night ask for ``single_days``: then stays without a night, which stop no such window, make no
    gap's end, and a gap may be a single day between two stays. Under the closed rule these are the
    gaps of all windows. Stays that begin on the same day shrink to the longest one first, which
    bounds the ordered rows per room by the calendar.
    """
    held = as_half_open(stays.where("room_id IS NOT NULL"), bounds)
    if single_days:
        held = held.where("start_date < end_date")
    longest = held.groupBy("room_id", "start_date").agg(F.max("end_date").alias("end_date"))
    never = F.lit(FAR_FUTURE).cast("date")
    closing = rooms.select(F.col("id").alias("room_id"), never.alias("start_date"), never.alias("end_date"))
    before = Window.partitionBy("room_id").orderBy("start_date").rowsBetween(Window.unboundedPreceding, -1)
    return (
        longest.unionByName(closing)
        .select(
            "room_id",
            F.coalesce(F.max("end_date").over(before), F.lit(FAR_PAST).cast("date")).alias("gap_start"),
            F.col("start_date").alias("gap_end"),
        )
        .where("gap_start <= gap_end" if single_days else "gap_start < gap_end")
    )
