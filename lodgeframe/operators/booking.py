"""Booking, registration and room assignment for whole tables of requests.

Decisions that depend on earlier ones (who gets the last room) follow (requested_at, request id)
inside each hotel and category or each room. Everything that does not depend on order is joined
or counted in parallel before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.functions.daybits import DayBits, RoomCalendar, each, lowest
from lodgeframe.functions.graph import islands, linked_groups
from lodgeframe.functions.intervals import count_overlaps
from lodgeframe.functions.ordering import (
    BLOCK_ROWS,
    fold_sorted,
    has_large_key,
    ordered_fold,
    strided_ids,
    writer_of,
)
from lodgeframe.operators.availability import BAD_DATES, CATEGORY_KEY, DATES, room_totals
from lodgeframe.schemas import ACTIVE, BRANCHES
from lodgeframe.session import cut_lineage

ARRIVAL = ["requested_at", "request_id"]
NODE_NUMBERS = {node: number for number, node in enumerate([*BRANCHES, "central"], start=1)}
NO_ROOM = "No available rooms of this category for the selected dates. Available: 0, Required: 1"
REQUIRED = ["hotel_id", "guest_id", "room_category_id", "start_date", "end_date"]
# Unassigned reservations see this many rooms of a hotel and category at a time.
ROOM_CHUNK = 65_536
# Requests of one hotel that are answered in one go before they are cut into independent groups.
HOTEL_ROWS = 20_000


def missing_fields(required: list[str], types: dict[str, str]) -> Column:
    """Comma-separated names of the absent fields; a zero id counts as absent."""

    def absent(name: str) -> Column:
        gone = F.col(name).isNull()
        return gone | (F.col(name) == 0) if types[name] in ("bigint", "int", "smallint") else gone

    names = F.array(*[F.when(absent(name), F.lit(name)) for name in required])
    return F.array_join(F.array_compact(names), ", ")


def check_bookings(
    requests: DataFrame, hotels: DataFrame, cities: DataFrame, categories_room: DataFrame, routes: DataFrame
) -> DataFrame:
    """Adds ``status`` and ``error`` from the checks that need no availability, plus the price inputs."""
    known_hotels = hotels.join(cities.select(F.col("id").alias("city_id")), "city_id", "left_semi").select(
        F.col("id").alias("hotel_id"), "location_coeff_room", F.lit(True).alias("hotel_known")
    )
    kinds = categories_room.select(F.col("id").alias("room_category_id"), "guests_capacity", "price_per_night")
    missing = missing_fields(REQUIRED, dict(requests.dtypes))
    joined = (
        requests.join(known_hotels, "hotel_id", "left")
        .join(routes.select("hotel_id", "node"), "hotel_id", "left")
        .join(kinds, "room_category_id", "left")
        .withColumn("missing", missing)
    )
    lacking = F.col("missing") != ""
    unknown_hotel = F.col("hotel_known").isNull()
    unknown_kind = F.col("price_per_night").isNull()
    bad_dates = F.col("start_date") >= F.col("end_date")
    return joined.withColumns(
        {
            "status": F.when(lacking, 400).when(unknown_hotel | unknown_kind, 404).when(bad_dates, 400).otherwise(0),
            "error": F.when(lacking, F.concat(F.lit("Missing required fields: "), "missing"))
            .when(unknown_hotel, "Hotel not found")
            .when(unknown_kind, "Room category not found")
            .when(bad_dates, BAD_DATES),
        }
    ).drop("missing", "hotel_known")


_ACCEPTED = "request_id bigint, accepted boolean"


def _start_calendar(row) -> tuple[list, list]:
    return [], []


def _take_if_room_left(calendar, row):
    """Accept while stays on record plus stays taken in this run leave a room for the dates."""
    starts, ends = calendar
    taken = row.on_record + bisect_left(starts, row.last_day) - bisect_right(ends, row.first_day)
    if taken >= row.places:
        return row.request_id, False
    insort(starts, row.first_day)
    insort(ends, row.last_day)
    return row.request_id, True


def day_number(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("bigint")


def accept_in_order(
    requests: DataFrame,
    stays: DataFrame,
    keys: list[str],
    block_rows: int = BLOCK_ROWS,
    sized: DataFrame | None = None,
) -> DataFrame:
    """``request_id, accepted`` for requests with ``places`` per key, first come first served.

    ``stays`` are the dates already held per key.
    """

    asked = requests.select(*ARRIVAL, *keys, *DATES, "places")

    def prepare(pending, state):
        return count_overlaps(pending, state, keys, into="on_record")

    def settle(counted):
        full = counted.where("on_record >= places").select("request_id", F.lit(False).alias("accepted"))
        return full, counted.where("on_record < places")

    def decide(counted, state):
        days = counted.withColumns({"first_day": day_number("start_date"), "last_day": day_number("end_date")})
        columns = ["request_id", "first_day", "last_day", "on_record", "places"]
        return fold_sorted(days, keys, ARRIVAL, columns, _ACCEPTED, _start_calendar, _take_if_room_left)

    def advance(state, decided):
        won = asked.join(decided.where("accepted").select("request_id"), "request_id", "left_semi")
        return state.unionByName(won.select(*keys, *DATES))

    return ordered_fold(
        asked,
        stays.select(*keys, *DATES),
        keys,
        ARRIVAL,
        prepare,
        decide,
        advance,
        settle,
        block_rows,
        sized,
    )


def create_bookings(
    requests: DataFrame,
    hotels: DataFrame,
    cities: DataFrame,
    categories_room: DataFrame,
    routes: DataFrame,
    rooms: DataFrame,
    stays: DataFrame,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Status, error and price per request, in arrival order per hotel and category."""
    checked = check_bookings(requests, hotels, cities, categories_room, routes)
    open_requests = with_places(checked.where("status = 0"), rooms)
    decided = accept_in_order(open_requests, stays, CATEGORY_KEY, block_rows, requests)
    return answers(checked.join(decided, "request_id", "left"), requests.columns)


def with_places(checked: DataFrame, rooms: DataFrame) -> DataFrame:
    """Adds ``places``, the number of rooms of the asked hotel and category."""
    return checked.join(room_totals(rooms), CATEGORY_KEY, "left").withColumn(
        "places", F.coalesce("total_rooms", F.lit(0))
    )


def answers(decided: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of checked requests, node, status, error and price; ``accepted`` is NULL where a check failed."""
    length = pricing.nights(F.col("start_date"), F.col("end_date"))
    guests = F.coalesce("total_guests", F.lit(1))
    price = pricing.booking_price(
        F.col("price_per_night"), F.col("location_coeff_room"), F.col("guests_capacity"), guests, length
    )
    status = F.when(F.col("status") != 0, F.col("status")).when(F.col("accepted"), 201).otherwise(409)
    error = F.coalesce("error", F.when(~F.col("accepted"), NO_ROOM))
    return decided.select(
        *columns,
        F.coalesce("node", F.lit("central")).alias("node"),
        status.alias("status"),
        error.alias("error"),
        F.when(F.col("accepted"), price).alias("total_price"),
    )


def node_number(node: Column) -> Column:
    pairs = [F.lit(part) for pair in NODE_NUMBERS.items() for part in pair]
    return F.create_map(*pairs)[node]


def used_numbers(*tables: DataFrame) -> DataFrame:
    """``writer, used``: how many ids of each writer's series the tables' ids have gone past."""
    stride = len(NODE_NUMBERS)
    ids = reduce(DataFrame.unionByName, [table.select("id") for table in tables])
    return ids.groupBy(writer_of(F.col("id"), stride).cast("int").alias("writer")).agg(
        F.expr(f"max((id - 1) DIV {stride} + 1)").alias("used")
    )


def next_ids(df: DataFrame, id_column: str, into: str, used: DataFrame) -> DataFrame:
    """Numbers the rows of each ``writer`` past the ids in use, in ``id_column`` order."""
    known = df.join(used, "writer", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return strided_ids(known, "writer", id_column, len(NODE_NUMBERS), into, F.col("used")).drop("used")


def booking_tables(decisions: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New reservations, detail lines and guest rows of the accepted requests.

    Every node gives out its own ids: the centre writes too, so ids step by four. One number serves
    the reservation and its only detail line; ``used`` comes from :func:`used_numbers` over both
    tables. The decisions are saved first: numbering reads them twice and three tables come from
    them, and they should be made once.
    """
    accepted = cut_lineage(decisions.where("status = 201").withColumn("writer", node_number(F.col("node"))))
    numbered = next_ids(accepted, "request_id", "new_id", used)
    reservations = numbered.select(
        F.col("new_id").alias("id"),
        "hotel_id",
        F.lit(None).cast("bigint").alias("employee_id"),
        F.col("requested_at").alias("create_date"),
        F.lit("pending").alias("status"),
        "total_price",
        F.lit("unpaid").alias("payments_status"),
        F.col("guest_id").alias("payer_id"),
        "start_date",
        "end_date",
        "node",
    )
    details = numbered.select(
        F.col("new_id").alias("id"),
        F.col("new_id").alias("reservation_id"),
        F.lit(None).cast("bigint").alias("room_id"),
        "guest_id",
        F.col("room_category_id").alias("requested_room_category"),
        F.coalesce("total_guests", F.lit(1)).alias("total_guest_number"),
        "node",
    )
    party = F.array("guest_id")
    if "additional_guests" in decisions.columns:
        party = F.concat(party, F.coalesce("additional_guests", F.array().cast("array<bigint>")))
    occupancy = numbered.select(
        F.col("new_id").alias("room_reservation_id"), F.explode(party).alias("guest_id"), "node"
    ).distinct()
    return reservations, details, occupancy


_REGISTERED = "request_id bigint, conflict bigint"


class RoomBook:
    """Who holds which room when, as day numbers, for rooms whose reservations may move between them."""

    def __init__(self, _row):
        self.calendars: dict[int, RoomCalendar] = {}
        self.members: dict[int, int] = {}
        self.reservations: list[int] = []
        self.rooms: dict[int, dict[int, tuple[int, int]]] = {}

    def _member(self, reservation: int) -> int:
        if reservation not in self.members:
            self.members[reservation] = len(self.reservations)
            self.reservations.append(reservation)
        return self.members[reservation]

    def hold(self, room: int, reservation: int, first: int, last: int) -> None:
        self.calendars.setdefault(room, RoomCalendar()).hold(self._member(reservation), first, last)
        self.rooms.setdefault(reservation, {})[room] = first, last

    def conflict(self, room: int, reservation: int, first: int, last: int) -> int | None:
        """The lowest other reservation that overlaps the dates in the room."""
        if room not in self.calendars:
            return None
        others = self.calendars[room].clashes(first, last) & ~(1 << self._member(reservation))
        return min((self.reservations[member] for member in each(others)), default=None)

    def move(self, room: int, reservation: int, first: int, last: int) -> None:
        for old, dates in self.rooms.pop(reservation, {}).items():
            self.calendars[old].release(self._member(reservation), *dates)
        self.hold(room, reservation, first, last)


def _register(book: RoomBook, row):
    """Rows of stays sort first and fill the book; requests are answered from it."""
    ask = row.room_id, row.reservation_id, row.first_day, row.last_day
    if not row.is_request:
        book.hold(*ask)
        return None
    conflict = book.conflict(*ask)
    if conflict is None and row.has_lines:
        book.move(*ask)
    return row.number, conflict


def dependent_groups(rows: DataFrame) -> DataFrame:
    """Adds ``decided_with``: rows of different groups cannot change each other's answers.

    Two reservations meet only where their dates overlap in a room, so a room falls into islands of
    overlapping dates; a reservation ties the islands together that it holds or asks for. The groups
    are the connected components of these ties, named by one of their reservations.
    """
    placed = islands(rows, "room_id", "first_day", "last_day", "reservation_id")
    groups = linked_groups(placed, "reservation_id", "island")
    alone = F.col("reservation_id")
    return rows.join(groups.withColumnRenamed("node", "reservation_id"), "reservation_id", "left").withColumn(
        "decided_with", F.coalesce("linked_group", alone)
    ).drop("linked_group")


def register_guests(
    requests: DataFrame,
    reservations: DataFrame,
    details: DataFrame,
    rooms: DataFrame,
    hotel_rows: int = HOTEL_ROWS,
) -> DataFrame:
    """Status per request to put a reservation into a room, in arrival order per hotel.

    An accepted request moves the whole reservation: its other rooms are free for what follows, and
    a later request of the reservation may move it again. So rooms of a hotel depend on each other,
    and a hotel's requests stream through one worker that holds the calendar of its asked rooms.
    With more than ``hotel_rows`` requests of one hotel, requests are cut into the groups of
    :func:`dependent_groups` instead, which give the same answers and spread over the workers.
    """
    asked_rooms = requests.select("room_id").distinct()
    asked_for = requests.select("reservation_id").distinct()
    has_lines = details.join(asked_for, "reservation_id", "left_semi").select("reservation_id").distinct()
    wanted = reservations.select(F.col("id").alias("reservation_id"), "hotel_id", "payer_id", *DATES)
    placed = rooms.select(F.col("id").alias("room_id"), F.col("hotel_id").alias("room_hotel_id"))
    unknown = F.col("hotel_id").isNull()
    foreign_room = F.col("room_hotel_id").isNull() | (F.col("room_hotel_id") != F.col("hotel_id"))
    # Saved once: the fold and the answers both read it.
    checked = cut_lineage(
        requests.join(wanted, "reservation_id", "left")
        .join(placed, "room_id", "left")
        .join(has_lines.withColumn("has_lines", F.lit(True)), "reservation_id", "left")
        .withColumns(
            {
                "has_lines": F.coalesce("has_lines", F.lit(False)),
                "status": F.when(unknown, 404).when(foreign_room, 400).otherwise(0),
                "error": F.when(unknown, "Reservation not found").when(foreign_room, "Room not found in this hotel"),
            }
        )
    )

    def days(df: DataFrame, is_request: bool, number: Column, arrived: Column, lines: Column) -> DataFrame:
        return df.select(
            "hotel_id",
            F.lit(is_request).alias("is_request"),
            arrived.alias("requested_at"),
            number.alias("number"),
            "reservation_id",
            "room_id",
            day_number("start_date").alias("first_day"),
            day_number("end_date").alias("last_day"),
            lines.alias("has_lines"),
        )

    held = (
        details.join(asked_rooms, "room_id", "left_semi")
        .select("reservation_id", "room_id")
        .distinct()
        .join(
            reservations.where(F.col("status").isin(ACTIVE)).select(F.col("id").alias("reservation_id"), *DATES),
            "reservation_id",
        )
        .join(placed.withColumnRenamed("room_hotel_id", "hotel_id"), "room_id")
    )
    never = F.lit(None).cast(requests.schema["requested_at"].dataType)
    rows = days(held, False, F.col("reservation_id"), never, F.lit(True)).unionByName(
        days(checked.where("status = 0"), True, F.col("request_id"), F.col("requested_at"), F.col("has_lines"))
    )
    key = "hotel_id"
    if has_large_key(checked.where("status = 0"), ["hotel_id"], hotel_rows):
        rows, key = dependent_groups(cut_lineage(rows)), "decided_with"
    columns = ["is_request", "number", "reservation_id", "room_id", "first_day", "last_day", "has_lines"]
    order = ["is_request", "requested_at", "number"]
    decided = fold_sorted(rows, [key], order, columns, _REGISTERED, RoomBook, _register)
    answered, taken = F.col("status") == 0, F.col("conflict").isNotNull()
    occupied = F.concat(
        F.lit("Room is already occupied by another reservation (ID: "), F.col("conflict"), F.lit(") for these dates")
    )
    return checked.join(decided, "request_id", "left").select(
        "request_id",
        "requested_at",
        "reservation_id",
        "room_id",
        "payer_id",
        "guest_ids",
        F.when(~answered, F.col("status")).when(taken, 409).when(~F.col("has_lines"), 400).otherwise(200).alias("status"),
        F.when(~answered, F.col("error"))
        .when(taken, occupied)
        .when(~F.col("has_lines"), "Booking details not found")
        .alias("error"),
    )


def registered_details(details: DataFrame, decisions: DataFrame) -> DataFrame:
    """Detail lines with the room of their last accepted registration."""
    won = (
        decisions.where("status = 200")
        .groupBy("reservation_id")
        .agg(F.max_by("room_id", F.struct(*ARRIVAL)).alias("new_room"))
    )
    return details.join(won, "reservation_id", "left").select(
        *[F.coalesce("new_room", "room_id").alias("room_id") if c == "room_id" else c for c in details.columns]
    )


def registered_reservations(reservations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reservations with status ``confirmed`` where a registration was accepted."""
    won = decisions.where("status = 200").select(F.col("reservation_id").alias("id"), F.lit("confirmed").alias("new"))
    return reservations.join(won.distinct(), "id", "left").select(
        *[F.coalesce("new", "status").alias("status") if c == "status" else c for c in reservations.columns]
    )


def registered_guests(decisions: DataFrame, details: DataFrame, guests: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Guest rows the accepted registrations add: the payer, and listed guests that exist.

    They go to the reservation's lowest detail line; rows already there are skipped.
    """
    won = cut_lineage(decisions.where("status = 200"))
    lines = details.groupBy("reservation_id").agg(F.min("id").alias("room_reservation_id"))
    payers = won.select("reservation_id", F.col("payer_id").alias("guest_id"))
    listed = won.select("reservation_id", F.explode("guest_ids").alias("guest_id")).join(
        guests.select(F.col("id").alias("guest_id")), "guest_id", "left_semi"
    )
    return (
        payers.unionByName(listed)
        .distinct()
        .join(lines, "reservation_id")
        .select("room_reservation_id", "guest_id")
        .join(occupancy, ["room_reservation_id", "guest_id"], "left_anti")
    )


def unassigned(reservations: DataFrame, details: DataFrame) -> DataFrame:
    """Active reservations once per category of their lines without a room."""
    active = reservations.where(F.col("status").isin(ACTIVE)).select(
        F.col("id").alias("reservation_id"), F.col("create_date").alias("requested_at"), "hotel_id", *DATES
    )
    kinds = (
        details.where("room_id IS NULL")
        .select("reservation_id", F.col("requested_room_category").alias("room_category_id"))
        .distinct()
    )
    return active.join(kinds, "reservation_id").select(
        "reservation_id", "requested_at", "hotel_id", *DATES, "room_category_id"
    )


_ASSIGNED = "reservation_id bigint, hotel_id bigint, room_category_id bigint, room_id bigint"


class OpenRooms:
    """Rooms of a hotel and category in id order, and the days each is occupied, both ends included."""

    def __init__(self, _row):
        self.rooms: list[int] = []
        self.places: dict[int, int] = {}
        self.occupied = DayBits()

    def add_room(self, room: int) -> None:
        self.places[room] = len(self.rooms)
        self.rooms.append(room)

    def occupy(self, room: int, first: int, last: int) -> None:
        self.occupied.add(self.places[room], first, last + 1)

    def take(self, first: int, last: int) -> int | None:
        """The lowest room without a stay on the days; it is occupied then."""
        free = ((1 << len(self.rooms)) - 1) & ~self.occupied.busy(first, last + 1)
        if not free or last < first:
            return None
        room = self.rooms[lowest(free)]
        self.occupy(room, first, last)
        return room


def _assign(rooms: OpenRooms, row):
    """Rooms sort first, in id order, then their stays; reservations are answered from both."""
    if row.kind == 2:
        return row.number, row.hotel_id, row.room_category_id, rooms.take(row.first_day, row.last_day)
    if row.kind == 1:
        rooms.occupy(row.number, row.first_day, row.last_day)
    else:
        rooms.add_room(row.number)
    return None


def assign_free_rooms(
    asked: DataFrame,
    rooms: DataFrame,
    stays: DataFrame,
    block_rows: int = BLOCK_ROWS,
    room_chunk: int = ROOM_CHUNK,
) -> DataFrame:
    """The lowest room free on the closed dates for each unassigned reservation, in arrival order.

    ``asked`` comes from :func:`unassigned`; ``room_id`` is NULL where nothing was free. Choosing
    the first fitting room can be done a chunk of rooms at a time: what fits into the first chunk
    does not depend on the later ones, and what is left over moves on. So no task sees more than
    about ``room_chunk`` rooms and ``block_rows`` reservations of a hotel and category. A worker asks
    a dyadic tree over days for the set of occupied rooms, so an answer takes a number of set
    operations that grows with the logarithm of the stay, not with the rooms' stays. Absent
    dates, and dates that end before they start, get no room.
    """
    order = ["requested_at", "reservation_id"]
    occupied = stays.where("room_id IS NOT NULL").select("room_id", *DATES)
    in_chunks = has_large_key(rooms, ["hotel_id", "categories_room_id"], room_chunk)

    def place(pending: DataFrame, chunk: DataFrame) -> DataFrame:
        placed_rooms = chunk.select(
            F.col("id").alias("room_id"), "hotel_id", F.col("categories_room_id").alias("room_category_id")
        )

        def prepare(waiting, state):
            return waiting

        def decide(waiting, state):
            wanted = waiting.select(*CATEGORY_KEY).distinct()
            open_rooms = placed_rooms.join(wanted, CATEGORY_KEY, "left_semi")

            def rows(df: DataFrame, kind: int, arrived: Column, number: str, first: Column, last: Column) -> DataFrame:
                return df.select(
                    *CATEGORY_KEY,
                    F.lit(kind).alias("kind"),
                    arrived.cast("timestamp_ntz").alias("requested_at"),
                    F.col(number).alias("number"),
                    first.alias("first_day"),
                    last.alias("last_day"),
                )

            never, no_day = F.lit(None), F.lit(0).cast("bigint")
            dated = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
            first = F.when(dated, day_number("start_date")).otherwise(1)
            last = F.when(dated, day_number("end_date")).otherwise(0)
            # Of stays that begin on one day only the longest counts, which bounds a room's rows by the calendar.
            longest = state.where(dated).groupBy("room_id", "start_date").agg(F.max("end_date").alias("end_date"))
            every = (
                rows(open_rooms, 0, never, "room_id", no_day, no_day)
                .union(rows(longest.join(open_rooms, "room_id"), 1, never, "room_id", first, last))
                .union(rows(waiting, 2, F.col("requested_at"), "reservation_id", first, last))
            )
            return fold_sorted(
                every,
                CATEGORY_KEY,
                ["kind", "requested_at", "number"],
                ["kind", "number", "first_day", "last_day"],
                _ASSIGNED,
                OpenRooms,
                _assign,
            )

        def advance(state, decided):
            won = decided.where("room_id IS NOT NULL").join(
                pending.select("reservation_id", *CATEGORY_KEY, *DATES), ["reservation_id", *CATEGORY_KEY]
            )
            return state.unionByName(won.select("room_id", *DATES))

        return ordered_fold(
            pending, occupied, CATEGORY_KEY, order, prepare, decide, advance, block_rows=block_rows
        )

    if not in_chunks:
        return place(asked, rooms)
    numbered = cut_lineage(_chunked(rooms, room_chunk))
    last_chunk = numbered.agg(F.max("chunk")).first()[0]
    pending, done = cut_lineage(asked), []
    for number in range(last_chunk + 1):
        decided = cut_lineage(place(pending, numbered.where(F.col("chunk") == number)))
        done.append(decided.where("room_id IS NOT NULL"))
        left = decided.where("room_id IS NULL")
        pending = pending.join(left.drop("room_id"), ["reservation_id", *CATEGORY_KEY], "left_semi")
    done.append(left)
    return reduce(DataFrame.unionByName, done)


def _chunked(rooms: DataFrame, room_chunk: int) -> DataFrame:
    """Numbers runs of about ``room_chunk`` rooms, in id order, inside each hotel and category."""
    kind = ["hotel_id", "categories_room_id"]
    blocked = rooms.withColumn("block", F.expr(f"id DIV {room_chunk}L"))
    counts = blocked.groupBy(*kind, "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*kind).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.expr(f"before DIV {room_chunk}L").cast("int").alias("chunk")
    chunks = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(*kind, "block", chunk)
    return blocked.join(chunks, [*kind, "block"]).drop("block")


def assigned_details(details: DataFrame, assignments: DataFrame) -> DataFrame:
    """Detail lines without a room get the one found for their reservation and category."""
    found = assignments.where("room_id IS NOT NULL").select(
        "reservation_id",
        F.col("room_category_id").alias("requested_room_category"),
        F.col("room_id").alias("new_room"),
    )
    return details.join(found, ["reservation_id", "requested_room_category"], "left").select(
        *[F.coalesce("room_id", "new_room").alias("room_id") if c == "room_id" else c for c in details.columns]
    )


def attach_to_recent(
    reservations: DataFrame, details: DataFrame, occupancy: DataFrame, as_of: str, within: str = "1 minute"
) -> DataFrame:
    """Guest rows for each guest's newest detail line among reservations made just before ``as_of``."""
    now = F.expr(f"TIMESTAMP_NTZ'{as_of}'")
    recent = reservations.where(
        (F.col("create_date") >= now - F.expr(f"INTERVAL {within}")) & (F.col("create_date") <= now)
    ).select(F.col("id").alias("reservation_id"))
    return (
        details.join(recent, "reservation_id", "left_semi")
        .groupBy("guest_id")
        .agg(F.max("id").alias("room_reservation_id"))
        .select("room_reservation_id", "guest_id")
        .join(occupancy, ["room_reservation_id", "guest_id"], "left_anti")
    )
