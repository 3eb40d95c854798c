"""Which rooms and categories are free for tables of date windows.

A request table has ``request_id, hotel_id, room_category_id, start_date, end_date`` unless a
function says otherwise. "Active" stays belong to confirmed or pending reservations.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.functions.daybits import RoomCalendar, lowest
from lodgeframe.functions.graph import islands
from lodgeframe.functions.intervals import CLOSED, HALF_OPEN, count_overlaps, free_gaps
from lodgeframe.functions.ordering import fold_sorted
from lodgeframe.schemas import ACTIVE

CATEGORY_KEY = ["hotel_id", "room_category_id"]
DATES = ["start_date", "end_date"]
ROOM_LIST_LIMIT = 5
BAD_DATES = "End date must be after start date"


def active_stays(reservations: DataFrame, details: DataFrame) -> DataFrame:
    """One row per detail line of an active reservation."""
    active = reservations.where(F.col("status").isin(ACTIVE)).select(
        F.col("id").alias("reservation_id"), "hotel_id", "start_date", "end_date"
    )
    lines = details.select(
        F.col("id").alias("detail_id"),
        "reservation_id",
        F.col("requested_room_category").alias("room_category_id"),
        "room_id",
    )
    return active.join(lines, "reservation_id")


def room_totals(rooms: DataFrame) -> DataFrame:
    return rooms.groupBy("hotel_id", F.col("categories_room_id").alias("room_category_id")).agg(
        F.count("*").alias("total_rooms")
    )


def first_rooms(rooms: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` lowest room numbers of every hotel and category."""
    order = Window.partitionBy("hotel_id", "room_category_id").orderBy("room_number", "id")
    named = rooms.withColumnRenamed("categories_room_id", "room_category_id")
    return named.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def booking_capacity(requests: DataFrame, rooms: DataFrame, stays: DataFrame) -> DataFrame:
    """Per request: rooms of the category, overlapping detail lines and what is left, at least 0.

    A window that ends before it starts has no counts.
    """
    counted = count_overlaps(requests, stays, CATEGORY_KEY, into="reserved_rooms")
    total = F.coalesce("total_rooms", F.lit(0)).cast("bigint")
    left = F.when(F.col("reserved_rooms").isNotNull(), F.greatest(total - F.col("reserved_rooms"), F.lit(0)))
    return counted.join(room_totals(rooms), CATEGORY_KEY, "left").select(
        *requests.columns,
        (left > 0).alias("available"),
        left.cast("bigint").alias("available_count"),
        total.alias("total_rooms"),
        "reserved_rooms",
    )


def with_bad_windows(good: DataFrame, requests: DataFrame) -> DataFrame:
    """``good`` plus a row of status 400 for each request whose dates hold no night."""
    filled = {"status": F.lit(400), "error": F.lit(BAD_DATES)}
    bad = requests.where("NOT coalesce(start_date < end_date, false)").select(
        "request_id",
        *[
            filled.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in good.schema.fields
            if field.name != "request_id"
        ],
    )
    return good.unionByName(bad)


def with_quote(requests: DataFrame, hotels: DataFrame, categories_room: DataFrame) -> DataFrame:
    """Adds ``total_price``, ``price_per_night`` and the category's name and capacity.

    The quote has no guard: a hotel without a coefficient has no price, an unknown hotel counts
    as coefficient 1 and an unknown category as price 0.
    """
    known = hotels.select(F.col("id").alias("hotel_id"), "location_coeff_room", F.lit(True).alias("known"))
    kinds = categories_room.select(
        F.col("id").alias("room_category_id"), "category_name", "guests_capacity", F.col("price_per_night").alias("_price")
    )
    coeff = F.when(F.col("known"), F.col("location_coeff_room")).otherwise(F.lit(1).cast("decimal(5,2)"))
    price = F.coalesce("_price", F.lit(0).cast("decimal(10,2)"))
    length = pricing.nights(F.col("start_date"), F.col("end_date"))
    return (
        requests.join(known, "hotel_id", "left")
        .join(kinds, "room_category_id", "left")
        .withColumn("total_price", pricing.stay_price(price, coeff, length))
        .withColumn("price_per_night", pricing.stay_price(price, coeff, F.lit(1)))
        .drop("known", "location_coeff_room", "_price")
    )


def check_availability(
    requests: DataFrame, hotels: DataFrame, categories_room: DataFrame, rooms: DataFrame, stays: DataFrame
) -> DataFrame:
    """Capacity, quote and the first rooms by number; windows of no length get status 400."""
    listed = (
        first_rooms(rooms, ROOM_LIST_LIMIT)
        .groupBy("hotel_id", "room_category_id")
        .agg(F.array_sort(F.collect_list(F.struct("room_number", "id"))).alias("listed"))
        .withColumn("room_list", F.array_join(F.transform("listed", lambda r: r["room_number"]), ","))
        .drop("listed")
    )
    asked = booking_capacity(requests.where("start_date < end_date"), rooms, stays)
    quoted = with_quote(asked, hotels, categories_room).join(listed, CATEGORY_KEY, "left")
    good = quoted.select(
        "request_id",
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("error"),
        "available",
        F.col("available_count").alias("available_rooms_count"),
        "total_rooms",
        "reserved_rooms",
        pricing.nights(F.col("start_date"), F.col("end_date")).alias("nights"),
        "total_price",
        "price_per_night",
        "category_name",
        "guests_capacity",
        F.when(F.col("available"), F.coalesce("room_list", F.lit(""))).otherwise("").alias("available_rooms"),
    )
    return with_bad_windows(good, requests)


def available_categories(
    requests: DataFrame, hotels: DataFrame, categories_room: DataFrame, rooms: DataFrame, stays: DataFrame
) -> DataFrame:
    """Per request every category of the hotel with rooms left, priced; sort by request and price to show it.

    Requests need only ``request_id, hotel_id, start_date, end_date``. Dates without a night give
    one row of status 400.
    """
    asked = requests.where("start_date < end_date").select("request_id", "hotel_id", *DATES)
    choices = asked.join(room_totals(rooms), "hotel_id")
    counted = count_overlaps(choices, stays, CATEGORY_KEY, into="reserved_rooms")
    left = counted.withColumn("available_rooms_count", F.col("total_rooms") - F.col("reserved_rooms")).where(
        "available_rooms_count > 0"
    )
    priced = left.join(
        hotels.select(F.col("id").alias("hotel_id"), "location_coeff_room"), "hotel_id"
    ).join(categories_room.withColumnRenamed("id", "room_category_id"), "room_category_id")
    coeff = pricing.coeff_or_one(F.col("location_coeff_room"))
    length = pricing.nights(F.col("start_date"), F.col("end_date"))
    price = F.col("price_per_night")
    good = priced.select(
        "request_id",
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("error"),
        "hotel_id",
        F.col("room_category_id").alias("id"),
        "category_name",
        "guests_capacity",
        "price_per_night",
        "description",
        "location_coeff_room",
        "total_rooms",
        "reserved_rooms",
        "available_rooms_count",
        pricing.stay_price(price, coeff, length).alias("price_for_period"),
        pricing.stay_price(price, coeff, F.lit(1)).alias("price_per_night_with_coeff"),
    )
    return with_bad_windows(good, requests)


def search_windows(requests: DataFrame) -> DataFrame:
    """Each asked (hotel, category, dates) once, however many requests repeat it.

    A window may lack a night (start = end). What ends before it starts is no window.
    """
    return requests.where("start_date <= end_date").select(*CATEGORY_KEY, *DATES).distinct()


def _room_gaps(rooms: DataFrame, stays: DataFrame, bounds: str) -> DataFrame:
    """Free gaps with their room's hotel, category and number; ``single_day`` says for which windows."""
    placed = rooms.select(
        F.col("id").alias("room_id"), "hotel_id", F.col("categories_room_id").alias("room_category_id"), "room_number"
    )
    for_days = free_gaps(rooms, stays, bounds, single_days=True)
    if bounds == CLOSED:
        gaps = for_days.withColumn("single_day", F.explode(F.array(F.lit(False), F.lit(True))))
    else:
        gaps = (
            free_gaps(rooms, stays, bounds)
            .withColumn("single_day", F.lit(False))
            .unionByName(for_days.withColumn("single_day", F.lit(True)))
        )
    return gaps.join(placed, "room_id")


def _on_asked_days(gaps: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row of gaps once per ``start_date`` of a window of its kind that begins inside."""
    kinds = [*CATEGORY_KEY, "single_day"]
    starts = (
        windows.withColumn("single_day", F.col("start_date") == F.col("end_date"))
        .groupBy(*kinds)
        .agg(F.collect_set("start_date").alias("asked_starts"))
    )
    inside = F.filter(
        "asked_starts",
        lambda day: (day >= F.col("gap_start"))
        & ((day < F.col("gap_end")) | (F.col("single_day") & (day == F.col("gap_end")))),
    )
    return gaps.join(starts, kinds).withColumn("start_date", F.explode(inside)).drop("asked_starts")


def room_reach(windows: DataFrame, rooms: DataFrame, stays: DataFrame, bounds: str = HALF_OPEN) -> DataFrame:
    """``free_count`` and the lowest ``free_room_id`` for (hotel, category, start, end).

    Holds every asked window, repeated or not in the input, and some others. A room serves a window
    when one gap covers it. Equal gaps of a hotel and category are counted together before they
    meet the asked days, so rows are bounded by pairs of calendar days, not by the rooms.
    """
    equal = (
        _room_gaps(rooms, stays, bounds)
        .groupBy(*CATEGORY_KEY, "single_day", "gap_start", "gap_end")
        .agg(F.count("*").alias("found"), F.min("room_id").alias("room_id"))
    )
    gaps = _on_asked_days(equal, windows).select(
        *CATEGORY_KEY, "single_day", "start_date", F.col("gap_end").alias("day"), "found", "room_id"
    )
    probes = windows.select(
        *CATEGORY_KEY,
        (F.col("start_date") == F.col("end_date")).alias("single_day"),
        "start_date",
        F.col("end_date").alias("day"),
        F.lit(0).cast("bigint").alias("found"),
        F.lit(None).cast("bigint").alias("room_id"),
    )
    of_start = [*CATEGORY_KEY, "single_day", "start_date"]
    steps = (
        gaps.union(probes)
        .groupBy(*of_start, "day")
        .agg(F.sum("found").alias("found"), F.min("room_id").alias("room_id"))
    )
    lasting = Window.partitionBy(*of_start).orderBy(F.desc("day")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        steps.select(
            *of_start,
            F.col("day").alias("end_date"),
            F.sum("found").over(lasting).alias("free_count"),
            F.min("room_id").over(lasting).alias("free_room_id"),
        )
        .where(F.col("single_day") == (F.col("start_date") == F.col("end_date")))
        .drop("single_day")
    )


def free_rooms(windows: DataFrame, rooms: DataFrame, stays: DataFrame, bounds: str = HALF_OPEN) -> DataFrame:
    """Adds ``free_count`` and the lowest ``free_room_id`` to each window."""
    return windows.join(room_reach(windows, rooms, stays, bounds), [*CATEGORY_KEY, *DATES])


def candidate_rooms(
    requests: DataFrame,
    rooms: DataFrame,
    categories_room: DataFrame,
    limit: int = ROOM_LIST_LIMIT,
    exclude_occupied: bool = False,
    stays: DataFrame | None = None,
) -> DataFrame:
    """The first rooms by number for each request; occupied ones are kept unless asked otherwise.

    Dates without a night give one row of status 400.
    """
    asked = requests.where("start_date < end_date").select("request_id", *CATEGORY_KEY, *DATES)
    if exclude_occupied:
        windows = search_windows(asked)
        ends = [*CATEGORY_KEY, "gap_end"]
        # The best rooms of a window are among the best of each gap and of each gap end: trimming is exact.
        per_gap = Window.partitionBy(*ends, "gap_start").orderBy("room_number", "room_id")
        per_end = Window.partitionBy(*ends, "start_date").orderBy("room_number", "room_id")
        per_window = Window.partitionBy(*CATEGORY_KEY, *DATES).orderBy("room_number", "room_id")

        def trimmed(rows: DataFrame, window) -> DataFrame:
            return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= limit)

        gaps = trimmed(_room_gaps(rooms, stays, HALF_OPEN).where("NOT single_day"), per_gap)
        best = trimmed(_on_asked_days(gaps, windows), per_end).drop("position")
        picked = trimmed(
            windows.join(best, [*CATEGORY_KEY, "start_date"]).where("gap_end >= end_date"), per_window
        ).select(*CATEGORY_KEY, *DATES, F.col("room_id").alias("id"), "position")
        lines = asked.join(picked, [*CATEGORY_KEY, *DATES]).join(
            rooms.select("id", "room_number", "floor", "view"), "id"
        )
    else:
        lines = asked.join(first_rooms(rooms, limit), CATEGORY_KEY)
    good = lines.join(
        categories_room.select(
            F.col("id").alias("room_category_id"), "category_name", "guests_capacity", "price_per_night"
        ),
        "room_category_id",
    ).select(
        "request_id",
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("error"),
        "position",
        "id",
        "hotel_id",
        F.col("room_category_id").alias("categories_room_id"),
        "room_number",
        "floor",
        "view",
        "category_name",
        "guests_capacity",
        "price_per_night",
    )
    return with_bad_windows(good, requests)


def room_flags(requests: DataFrame, rooms: DataFrame, stays: DataFrame) -> DataFrame:
    """Every room of each distinct window's hotel and category, free or not (closed rule)."""
    gaps = (
        free_gaps(rooms, stays, CLOSED, single_days=True)
        .groupBy("room_id")
        .agg(F.collect_list(F.struct("gap_start", "gap_end")).alias("gaps"))
    )
    listed = rooms.join(gaps, rooms.id == gaps.room_id, "left").select(
        "hotel_id", F.col("categories_room_id").alias("room_category_id"), F.col("id").alias("room_id"),
        "room_number", "floor", "view", "gaps",
    )

    def covers(gap: Column) -> Column:
        return (gap["gap_start"] <= F.col("start_date")) & (gap["gap_end"] >= F.col("end_date"))

    return (
        search_windows(requests)
        .join(listed, CATEGORY_KEY)
        .select(
            *CATEGORY_KEY,
            *DATES,
            "room_id",
            "room_number",
            "floor",
            "view",
            F.coalesce(F.exists("gaps", covers), F.lit(False)).alias("is_available"),
        )
    )


def room_summary(requests: DataFrame, rooms: DataFrame, stays: DataFrame) -> DataFrame:
    """Total, free and occupied rooms by assigned room; no rooms means 0 total and NULL sums."""
    windows = search_windows(requests)
    found = windows.join(room_totals(rooms), CATEGORY_KEY, "left").join(
        room_reach(windows, rooms, stays).drop("free_room_id"), [*CATEGORY_KEY, *DATES], "left"
    )
    free = F.when(F.col("total_rooms").isNotNull(), F.coalesce("free_count", F.lit(0)))
    return found.select(
        *CATEGORY_KEY,
        *DATES,
        F.coalesce("total_rooms", F.lit(0)).alias("total_rooms"),
        free.alias("available_rooms_count"),
        (F.col("total_rooms") - free).alias("occupied_rooms_count"),
    )


def first_free_room(requests: DataFrame, rooms: DataFrame, stays: DataFrame, bounds: str) -> DataFrame:
    """The lowest free room per distinct window; windows without one are left out."""
    return (
        free_rooms(search_windows(requests), rooms, stays, bounds)
        .where("free_room_id IS NOT NULL")
        .select(*CATEGORY_KEY, *DATES, F.col("free_room_id").alias("room_id"))
    )


def lone_stays(stays: DataFrame) -> DataFrame:
    """``room_id, reservation_id`` where no other reservation touches the stay (closed rule).

    Equal dates in a room shrink to one row first, which bounds the ordered rows by the calendar.
    """
    spans = (
        stays.where("room_id IS NOT NULL")
        .groupBy("room_id", *DATES)
        .agg(F.min("reservation_id").alias("reservation_id"), F.max("reservation_id").alias("last_reservation"))
    )
    in_room = Window.partitionBy("room_id").orderBy(*DATES)
    earlier = F.max("end_date").over(in_room.rowsBetween(Window.unboundedPreceding, -1))
    later = F.lead("start_date").over(in_room)
    return (
        spans.withColumns({"earlier": earlier, "later": later})
        .where("coalesce(earlier < start_date, true) AND coalesce(later > end_date, true)")
        .where("reservation_id = last_reservation")
        .select("room_id", "reservation_id")
    )


def free_room_for_reservation(
    reservations: DataFrame, details: DataFrame, rooms: DataFrame, stays: DataFrame
) -> DataFrame:
    """Per reservation and category it asked for: the lowest room no other active stay touches."""
    asked = (
        details.select("reservation_id", F.col("requested_room_category").alias("room_category_id"))
        .distinct()
        .join(
            reservations.select(F.col("id").alias("reservation_id"), "hotel_id", *DATES), "reservation_id"
        )
        .select("reservation_id", *CATEGORY_KEY, *DATES)
    )
    free = room_reach(asked.select(*CATEGORY_KEY, *DATES), rooms, stays, CLOSED)
    # A reservation's own rooms look taken above; they are free when only its own lines touch them.
    placed = rooms.select(
        F.col("id").alias("room_id"), "hotel_id", F.col("categories_room_id").alias("room_category_id")
    )
    kept = (
        lone_stays(stays)
        .join(placed, "room_id")
        .groupBy("reservation_id", *CATEGORY_KEY)
        .agg(F.min("room_id").alias("own_room_id"))
    )
    return (
        asked.join(free, [*CATEGORY_KEY, *DATES], "left")
        .join(kept, ["reservation_id", *CATEGORY_KEY], "left")
        .select("reservation_id", *CATEGORY_KEY, F.least("free_room_id", "own_room_id").alias("room_id"))
    )


_NAMED = "room_id bigint, reservation_id bigint, low bigint, high bigint"


class Clashes:
    """The stays of one island of a room; they come in order of their reservations, so a member's bit tells its rank."""

    def __init__(self, _row):
        self.reservations: list[int] = []
        self.calendar = RoomCalendar()


def _name_clashes(clashes: Clashes, row):
    """Rows that hold the room sort first; then each stay asks for the lowest and highest of the others."""
    if not row.is_request:
        clashes.calendar.hold(len(clashes.reservations), row.first_day, row.last_day)
        clashes.reservations.append(row.reservation_id)
        return None
    own = bisect_left(clashes.reservations, row.reservation_id)
    others = clashes.calendar.clashes(row.first_day, row.last_day) & ~(1 << own)
    if not others:
        return None
    low, high = lowest(others), others.bit_length() - 1
    return row.room_id, row.reservation_id, clashes.reservations[low], clashes.reservations[high]


def room_conflicts(stays: DataFrame) -> DataFrame:
    """Per active reservation and room: how many stays of others overlap, and one of them.

    Lists no pairs and no nights. The count comes from running day counts. The named reservation is
    the lowest overlapping id where that is below its own, else the highest. Only stays with a clash
    go on to be named: they are cut into islands of overlapping dates, and a worker loads an island
    into a dyadic tree over days and asks it once per stay, so rows are bounded by stays, not by their
    length. A stay without a night (``start = end``) clashes only with stays that hold both the night
    before and the night after it: those past their first night.
    """
    on_rooms = stays.where("room_id IS NOT NULL")
    held = on_rooms.groupBy("reservation_id", "room_id", *DATES).agg(F.count("*").alias("lines"))
    counted = count_overlaps(held, on_rooms, ["room_id"], into="overlapping")
    # A stay without a night does not overlap itself.
    solid = F.col("start_date") < F.col("end_date")
    others = F.when(solid, F.col("overlapping") - F.col("lines")).otherwise(F.col("overlapping"))
    clashing = counted.withColumn("conflicts", others).where("conflicts > 0")
    days = clashing.select(
        "room_id",
        "reservation_id",
        F.datediff("start_date", F.lit("1970-01-01")).cast("bigint").alias("first_day"),
        F.datediff("end_date", F.lit("1970-01-01")).cast("bigint").alias("last_day"),
    )
    rows = islands(days, "room_id", "first_day", "last_day", "reservation_id")
    named = fold_sorted(
        rows.withColumn("is_request", F.explode(F.array(F.lit(False), F.lit(True)))),
        ["room_id", "island"],
        ["is_request", "reservation_id"],
        ["is_request", "reservation_id", "first_day", "last_day"],
        _NAMED,
        Clashes,
        _name_clashes,
    )
    chosen = F.when(F.col("low") < F.col("reservation_id"), F.col("low")).otherwise(F.col("high"))
    return clashing.join(named, ["reservation_id", "room_id"]).select(
        "reservation_id", "room_id", *DATES, "conflicts", chosen.alias("conflicting_reservation_id")
    )
