"""Read models about reservations, stays and payers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.functions.text import full_name
from lodgeframe.schemas import ACTIVE

# Greatest count of each load tier.
LOW_LOAD = 5
MEDIUM_LOAD = 15
HISTORY_LIMIT = 10


def _active() -> Column:
    return F.col("status").isin(ACTIVE)


def _payers(guests: DataFrame, *columns: str) -> DataFrame:
    return guests.select(F.col("id").alias("payer_id"), *columns)


def _hotel_names(hotels: DataFrame, *more: str) -> DataFrame:
    return hotels.select(F.col("id").alias("hotel_id"), F.col("name").alias("hotel_name"), *more)


def _category_names(categories_room: DataFrame) -> DataFrame:
    return categories_room.select(F.col("id").alias("requested_room_category"), "category_name")


def _guests_per_detail(occupancy: DataFrame) -> DataFrame:
    return occupancy.groupBy("room_reservation_id").agg(F.count("guest_id").alias("registered"))


def cities_reservation_counts(cities: DataFrame, hotels: DataFrame, reservations: DataFrame) -> DataFrame:
    """Active reservations per city, zero kept. Reservations are counted per hotel before any join."""
    per_hotel = reservations.where(_active()).groupBy("hotel_id").agg(F.count("id").alias("n"))
    return counts_per_city(cities, hotels, per_hotel)


def counts_per_city(cities: DataFrame, hotels: DataFrame, per_hotel: DataFrame) -> DataFrame:
    """The same from ``hotel_id, n``, such as counts that are kept current."""
    per_city = (
        hotels.select(F.col("id").alias("hotel_id"), "city_id")
        .join(per_hotel, "hotel_id")
        .groupBy("city_id")
        .agg(F.sum("n").alias("n"))
    )
    return (
        cities.select(F.col("id").alias("city_id"), "city_name")
        .join(per_city, "city_id", "left")
        .select("city_name", F.coalesce("n", F.lit(0)).alias("reservations_count"))
        .distinct()
        .orderBy("city_name")
    )


def city_load_tier(city_counts: DataFrame) -> DataFrame:
    count = F.col("reservations_count")
    tier = (
        F.when(count == 0, "none").when(count <= LOW_LOAD, "low").when(count <= MEDIUM_LOAD, "medium").otherwise("high")
    )
    return city_counts.select("city_name", "reservations_count", tier.alias("load_tier"))


def city_reservations(
    reservations: DataFrame,
    guests: DataFrame,
    hotels: DataFrame,
    details: DataFrame,
    categories_room: DataFrame,
    occupancy: DataFrame,
    routes: DataFrame,
    newest_first: bool = True,
) -> DataFrame:
    """Active reservations with payer, hotel, requested room and registered guests, newest first if asked.

    Lines of one reservation that ask for the same category, size and room form one row. They are
    folded together on their narrow key, before the wide columns are joined.
    """
    lines = (
        details.join(_guests_per_detail(occupancy), details.id == F.col("room_reservation_id"), "left")
        .groupBy("reservation_id", "requested_room_category", "total_guest_number", "room_id")
        .agg(F.coalesce(F.sum("registered"), F.lit(0)).alias("registered"))
    )
    kept = reservations.where(_active()).select(
        "id",
        "hotel_id",
        "create_date",
        "start_date",
        "end_date",
        "status",
        "total_price",
        "payments_status",
        "payer_id",
    )
    listed = (
        kept.join(lines, kept.id == lines.reservation_id, "left")
        .join(_payers(guests, "first_name", "last_name", "phone_number", "email"), "payer_id")
        .join(_hotel_names(hotels), "hotel_id")
        .join(routes.select("hotel_id", "node"), "hotel_id")
        .join(_category_names(categories_room), "requested_room_category", "left")
        .select(
            *kept.columns,
            "first_name",
            "last_name",
            "phone_number",
            "email",
            "hotel_name",
            "requested_room_category",
            "total_guest_number",
            "room_id",
            "category_name",
            F.coalesce("registered", F.lit(0)).alias("registered_guests_count"),
            "node",
        )
    )
    return listed.orderBy(F.desc("create_date")) if newest_first else listed


def status_counts(listed: DataFrame) -> DataFrame:
    """Rows, waiting, confirmed and paid among the listed reservations of each node."""
    return listed.groupBy("node").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("payments_status") == "paid").alias("paid"),
    )


def registration_needed(listed: DataFrame) -> DataFrame:
    """Pending, or confirmed without a room. Room id 0 counts as none."""
    no_room = F.col("room_id").isNull() | (F.col("room_id") == 0)
    needed = (F.col("status") == "pending") | ((F.col("status") == "confirmed") & no_room)
    return listed.select("id", "status", "room_id", needed.alias("registration_needed"))


def hotel_reservations(
    reservations: DataFrame,
    guests: DataFrame,
    hotels: DataFrame,
    details: DataFrame,
    occupancy: DataFrame,
    status: str = "pending",
) -> DataFrame:
    """Reservations of one status with payer, hotel name and guest rows, newest first."""
    guest_rows = (
        details.select("id", "reservation_id")
        .join(_guests_per_detail(occupancy), F.col("id") == F.col("room_reservation_id"))
        .groupBy("reservation_id")
        .agg(F.sum("registered").alias("registered"))
    )
    kept = reservations.where(F.col("status") == status)
    return (
        kept.join(guest_rows, kept.id == guest_rows.reservation_id, "left")
        .join(_payers(guests, "first_name", "last_name", "phone_number"), "payer_id")
        .join(_hotel_names(hotels), "hotel_id")
        .select(
            *kept.columns,
            "first_name",
            "last_name",
            "phone_number",
            "hotel_name",
            F.coalesce("registered", F.lit(0)).alias("total_guests"),
        )
        .orderBy(F.desc("create_date"))
    )


def upcoming_reservations(
    reservations: DataFrame,
    guests: DataFrame,
    details: DataFrame,
    occupancy: DataFrame,
    categories_room: DataFrame,
    as_of: str,
) -> DataFrame:
    """Stays from ``as_of`` on with distinct guests and the requested categories as text.

    A category repeats once per guest row of its line. The repeats are counted per category first,
    so the text is put together from at most one piece per category.
    """
    ahead = reservations.where(F.col("start_date") >= F.lit(as_of).cast("date"))
    lines = details.join(ahead.select(F.col("id").alias("reservation_id")), "reservation_id", "left_semi").select(
        "id", "reservation_id", "requested_room_category"
    )
    distinct_guests = (
        lines.join(occupancy, F.col("id") == F.col("room_reservation_id"))
        .select("reservation_id", "guest_id")
        .distinct()
        .groupBy("reservation_id")
        .agg(F.count("*").alias("guest_total"))
    )
    pieces = (
        lines.join(_guests_per_detail(occupancy), F.col("id") == F.col("room_reservation_id"), "left")
        .groupBy("reservation_id", "requested_room_category")
        .agg(F.sum(F.greatest(F.coalesce("registered", F.lit(1)), F.lit(1))).cast("int").alias("times"))
        .join(_category_names(categories_room), "requested_room_category")
        .withColumn("piece", F.array_join(F.array_repeat("category_name", F.col("times")), ", "))
        .groupBy("reservation_id")
        .agg(F.array_sort(F.collect_list(F.struct("category_name", "piece"))).alias("pieces"))
        .select("reservation_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), ", ").alias("categories"))
    )
    return (
        ahead.join(_payers(guests, "first_name", "last_name"), "payer_id")
        .join(distinct_guests, ahead.id == distinct_guests.reservation_id, "left")
        .drop("reservation_id")
        .join(pieces, ahead.id == pieces.reservation_id, "left")
        .select(
            ahead.id.alias("reservation_id"),
            "hotel_id",
            "create_date",
            "start_date",
            "end_date",
            "status",
            "payments_status",
            "total_price",
            full_name(F.col("first_name"), F.col("last_name")).alias("guest_name"),
            F.coalesce("guest_total", F.lit(0)).alias("total_guests"),
            F.col("categories").alias("room_categories"),
        )
        .orderBy("start_date")
    )


def registration_details(
    reservations: DataFrame,
    details: DataFrame,
    guests: DataFrame,
    categories_room: DataFrame,
    rooms: DataFrame,
    occupancy: DataFrame,
) -> DataFrame:
    """One row per detail line with guest, category, room and whether anyone is registered."""
    registered = occupancy.select(F.col("room_reservation_id").alias("detail_id")).distinct()
    lines = details.withColumnRenamed("id", "detail_id")
    return (
        lines.join(reservations.select(F.col("id").alias("reservation_id")), "reservation_id", "left_semi")
        .join(registered.withColumn("seen", F.lit(True)), "detail_id", "left")
        .join(
            guests.select(F.col("id").alias("guest_id"), "first_name", "last_name", "phone_number", "document"),
            "guest_id",
        )
        .join(_category_names(categories_room), "requested_room_category")
        .join(rooms.select(F.col("id").alias("room_id"), "room_number"), "room_id", "left")
        .select(
            "reservation_id",
            full_name(F.col("first_name"), F.col("last_name")).alias("guest_name"),
            "phone_number",
            "document",
            F.col("category_name").alias("requested_category"),
            "total_guest_number",
            "room_number",
            F.coalesce("seen", F.lit(False)).alias("is_registered"),
        )
    )


def reservation_details(
    reservations: DataFrame,
    guests: DataFrame,
    hotels: DataFrame,
    cities: DataFrame,
    details: DataFrame,
    categories_room: DataFrame,
    rooms: DataFrame,
) -> DataFrame:
    """The wide reservation row, one per detail line, with the number of nights."""
    lines = details.select("reservation_id", "requested_room_category", "total_guest_number", "room_id")
    payer = _payers(
        guests, "first_name", "last_name", "phone_number", "email", "document", "loyalty_card_id", "bonus_points"
    )
    return (
        reservations.join(lines, reservations.id == lines.reservation_id, "left")
        .join(rooms.select(F.col("id").alias("room_id"), "room_number", "floor", "view"), "room_id", "left")
        .join(payer, "payer_id")
        .join(_hotel_names(hotels, "city_id"), "hotel_id")
        .join(cities.select(F.col("id").alias("city_id"), "city_name"), "city_id")
        .join(_category_names(categories_room), "requested_room_category", "left")
        .select(
            *reservations.columns,
            *payer.columns[1:],
            "hotel_name",
            "city_id",
            "city_name",
            "requested_room_category",
            "total_guest_number",
            "room_id",
            "category_name",
            "room_number",
            "floor",
            "view",
            F.datediff("end_date", "start_date").alias("nights"),
        )
    )


def payment_info(reservations: DataFrame, hotels: DataFrame, guests: DataFrame) -> DataFrame:
    return (
        reservations.join(_hotel_names(hotels), "hotel_id")
        .join(_payers(guests, "first_name", "last_name"), "payer_id")
        .select(*reservations.columns, "hotel_name", "first_name", "last_name")
    )


def active_bookings(
    reservations: DataFrame,
    hotels: DataFrame,
    details: DataFrame,
    rooms: DataFrame,
    categories_room: DataFrame,
    guests: DataFrame,
) -> DataFrame:
    """Active stays with an assigned room, by start, hotel and room number."""
    lines = details.where("room_id IS NOT NULL").select("reservation_id", "room_id", "total_guest_number")
    placed = rooms.select(F.col("id").alias("room_id"), "room_number", "floor", "categories_room_id")
    kinds = categories_room.select(F.col("id").alias("categories_room_id"), F.col("category_name").alias("room_category"))
    kept = reservations.where(_active())
    return (
        kept.join(lines, kept.id == lines.reservation_id)
        .join(placed, "room_id")
        .join(kinds, "categories_room_id")
        .join(_hotel_names(hotels), "hotel_id")
        .join(_payers(guests, "first_name", "last_name"), "payer_id")
        .select(
            "status",
            "payments_status",
            "hotel_name",
            "room_number",
            "floor",
            "room_category",
            full_name(F.col("first_name"), F.col("last_name")).alias("guest_name"),
            F.col("total_guest_number").alias("gn"),
            "start_date",
            "end_date",
            "total_price",
        )
        .orderBy("start_date", "hotel_name", "room_number")
    )


def payment_history(
    payments: DataFrame, reservations: DataFrame, hotels: DataFrame, limit: int = HISTORY_LIMIT
) -> DataFrame:
    """The newest payments of every payer."""
    stays = reservations.select(
        F.col("id").alias("reservation_id"), "payer_id", "hotel_id", "start_date", "end_date"
    )
    newest = Window.partitionBy("payer_id").orderBy(F.desc("payments_date"), F.desc("id"))
    kept = (
        payments.join(stays, "reservation_id")
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= limit)
    )
    return kept.join(_hotel_names(hotels), "hotel_id").select(
        "payer_id", "position", *payments.columns, "start_date", "end_date", "hotel_name"
    )


def guest_details(wanted: DataFrame, guests: DataFrame) -> DataFrame:
    return guests.join(wanted.select(F.col("guest_id").alias("id")), "id", "left_semi")


def _booked_rooms(
    latest: DataFrame, details: DataFrame, rooms: DataFrame, categories_room: DataFrame
) -> DataFrame:
    placed = rooms.select(F.col("id").alias("room_id"), "room_number", "categories_room_id")
    kinds = categories_room.select(F.col("id").alias("categories_room_id"), "category_name")
    return (
        latest.join(details.select("reservation_id", "room_id"), latest.id == F.col("reservation_id"))
        .join(placed, "room_id")
        .join(kinds, "categories_room_id")
        .select(
            "hotel_id",
            "reservation_id",
            "total_price",
            "room_number",
            "category_name",
            "start_date",
            "end_date",
            "status",
        )
    )


def latest_booking(
    reservations: DataFrame, details: DataFrame, rooms: DataFrame, categories_room: DataFrame
) -> DataFrame:
    """The booking with the greatest id; empty when it holds no room yet."""
    newest = reservations.agg(F.max("id")).scalar()
    return _booked_rooms(reservations.where(F.col("id") == newest), details, rooms, categories_room)


def latest_booking_per_hotel(
    reservations: DataFrame, details: DataFrame, rooms: DataFrame, categories_room: DataFrame
) -> DataFrame:
    newest = reservations.groupBy("hotel_id").agg(F.max("id").alias("id")).select("id")
    return _booked_rooms(reservations.join(newest, "id", "left_semi"), details, rooms, categories_room)


def latest_placed_booking(
    reservations: DataFrame, details: DataFrame, rooms: DataFrame, categories_room: DataFrame
) -> DataFrame:
    """The booking with the greatest id among those that hold a room."""
    newest = details.where("room_id IS NOT NULL").agg(F.max("reservation_id")).scalar()
    return _booked_rooms(reservations.where(F.col("id") == newest), details, rooms, categories_room)
