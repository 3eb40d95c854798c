"""Read models about hotels, their rooms, categories and amenities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.functions.text import teaser
from lodgeframe.schemas import CENTRAL


def _cities(cities: DataFrame, *more: str) -> DataFrame:
    return cities.select(F.col("id").alias("city_id"), "city_name", *more)


def _stars(categories_hotel: DataFrame, *more: str) -> DataFrame:
    return categories_hotel.select(F.col("id").alias("star_rating_id"), "star_rating", *more)


def list_hotels(hotels: DataFrame, cities: DataFrame, categories_hotel: DataFrame) -> DataFrame:
    return (
        hotels.join(_cities(cities), "city_id")
        .join(_stars(categories_hotel), "star_rating_id")
        .select(
            "id",
            "name",
            "city_name",
            "address",
            "phone_number",
            "email",
            "star_rating",
            "check_in_time",
            "check_out_time",
            "location_coeff_room",
            "description",
        )
        .orderBy("city_name", "name")
    )


def hotels_by_city(
    wanted: DataFrame, hotels: DataFrame, cities: DataFrame, categories_hotel: DataFrame
) -> DataFrame:
    """Hotels of the wanted ``city_name`` values, by name."""
    return (
        list_hotels(hotels, cities.join(wanted.select("city_name"), "city_name", "left_semi"), categories_hotel)
        .orderBy("name")
    )


def hotel_details(wanted: DataFrame, hotels: DataFrame, cities: DataFrame, categories_hotel: DataFrame) -> DataFrame:
    """All hotel columns with city and stars for the wanted ``hotel_id`` values."""
    return (
        hotels.join(wanted.select(F.col("hotel_id").alias("id")), "id", "left_semi")
        .join(_cities(cities), "city_id")
        .join(_stars(categories_hotel, "rating_coeff"), "star_rating_id")
        .select(*hotels.columns, "city_name", "star_rating", "rating_coeff")
    )


def hotel_directory(hotels: DataFrame, cities: DataFrame, categories_hotel: DataFrame) -> DataFrame:
    return (
        hotels.join(_cities(cities, "country_name_code"), "city_id")
        .join(_stars(categories_hotel), "star_rating_id")
        .select(
            F.col("id").alias("hotel_id"),
            F.col("name").alias("hotel_name"),
            "city_name",
            "country_name_code",
            "address",
            "star_rating",
            "phone_number",
            "email",
            "check_in_time",
            "check_out_time",
        )
        .orderBy(F.asc("city_name"), F.desc("star_rating"))
    )


def _category_choices(rooms: DataFrame) -> DataFrame:
    """Rooms per hotel and category: small next to the rooms, and enough for every price list."""
    return rooms.groupBy("hotel_id", "categories_room_id").agg(F.count("id").alias("room_count"))


def _categories(categories_room: DataFrame) -> DataFrame:
    return categories_room.withColumnRenamed("id", "categories_room_id").withColumnRenamed(
        "description", "category_description"
    )


def hotel_min_price(
    hotels: DataFrame, cities: DataFrame, categories_hotel: DataFrame, rooms: DataFrame, categories_room: DataFrame
) -> DataFrame:
    """Cheapest category price times coefficient; hotels without rooms stay, with NULL."""
    cheapest = (
        _category_choices(rooms)
        .join(categories_room.select(F.col("id").alias("categories_room_id"), "price_per_night"), "categories_room_id")
        .groupBy("hotel_id")
        .agg(F.min("price_per_night").alias("lowest"), F.max("price_per_night").alias("highest"))
    )
    coeff = F.col("location_coeff_room")
    price = F.when(coeff < 0, F.col("highest")).otherwise(F.col("lowest")) * coeff
    return (
        hotels.join(_cities(cities), "city_id")
        .join(_stars(categories_hotel), "star_rating_id")
        .join(cheapest, F.col("id") == F.col("hotel_id"), "left")
        .select("id", "name", "city_name", "star_rating", "location_coeff_room", price.cast("decimal(16,4)").alias("min_price"))
    )


def hotel_category_prices(hotels: DataFrame, rooms: DataFrame, categories_room: DataFrame) -> DataFrame:
    """Distinct categories of each hotel with price times coefficient."""
    return (
        _category_choices(rooms)
        .join(hotels.select(F.col("id").alias("hotel_id"), "location_coeff_room"), "hotel_id")
        .join(_categories(categories_room), "categories_room_id")
        .select(
            "hotel_id",
            F.col("categories_room_id").alias("id"),
            "category_name",
            "guests_capacity",
            (F.col("price_per_night") * F.col("location_coeff_room")).cast("decimal(16,4)").alias("final_price"),
            F.col("category_description").alias("description"),
        )
    )


def hotel_categories_with_counts(hotels: DataFrame, rooms: DataFrame, categories_room: DataFrame) -> DataFrame:
    """Categories a hotel has rooms of, with the count and the rounded price, by base price."""
    base = F.col("base_price")
    return (
        _category_choices(rooms)
        .where("room_count > 0")
        .join(hotels.select(F.col("id").alias("hotel_id"), "location_coeff_room"), "hotel_id")
        .join(_categories(categories_room).withColumnRenamed("price_per_night", "base_price"), "categories_room_id")
        .orderBy("hotel_id", "base_price")
        .select(
            "hotel_id",
            "categories_room_id",
            "category_name",
            "guests_capacity",
            pricing.rounded(base * pricing.coeff_or_one(F.col("location_coeff_room"))).alias("price_per_night"),
            F.col("category_description").alias("description"),
            "location_coeff_room",
            F.col("room_count").alias("total_rooms_count"),
            "room_count",
        )
    )


def room_category_details(wanted: DataFrame, categories_room: DataFrame) -> DataFrame:
    return categories_room.join(wanted.select(F.col("room_category_id").alias("id")), "id", "left_semi")


def category_price_list(categories_room: DataFrame) -> DataFrame:
    """The price list under its printed (Russian) column titles."""
    # Column titles.
    titles = {
        "id": "ID категории",
        "category_name": "Название категории",
        "guests_capacity": "Вместимость",
        "price_per_night": "Цена за ночь",
        "description": "Описание",
    }
    ordered = categories_room.orderBy("price_per_night")
    return ordered.select(*[F.col(name).alias(title) for name, title in titles.items()])


def hotel_rooms(rooms: DataFrame, categories_room: DataFrame) -> DataFrame:
    return (
        rooms.join(_categories(categories_room), "categories_room_id")
        .select(
            *rooms.columns,
            "category_name",
            "guests_capacity",
            "price_per_night",
            F.col("category_description").alias("room_description"),
        )
        .orderBy("hotel_id", "room_number")
    )


def hotel_amenities(amenities: DataFrame, types_amenities: DataFrame) -> DataFrame:
    kinds = types_amenities.select(F.col("id").alias("types_amenities_id"), F.col("name").alias("amenity_name"))
    return (
        amenities.join(kinds, "types_amenities_id")
        .select(*amenities.columns, "amenity_name")
        .orderBy("hotel_id", "amenity_name")
    )


def amenity_prices(amenities: DataFrame, types_amenities: DataFrame, hotels: DataFrame) -> DataFrame:
    kinds = types_amenities.select(F.col("id").alias("types_amenities_id"), F.col("name").alias("amenity_type"))
    return (
        amenities.join(kinds, "types_amenities_id")
        .join(hotels.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi")
        .select("hotel_id", "amenity_type", F.col("price").alias("amenity_price"))
        .orderBy("hotel_id", "amenity_type", "amenity_price")
    )


def cities_hotel_counts(cities: DataFrame, hotels: DataFrame) -> DataFrame:
    """Hotels per city, zero kept. Equal (name, count) pairs of different cities show once."""
    per_city = hotels.groupBy("city_id").agg(F.count("id").alias("n"))
    return (
        _cities(cities)
        .join(per_city, "city_id", "left")
        .select("city_name", F.coalesce("n", F.lit(0)).alias("hotels_count"))
        .distinct()
        .orderBy("city_name")
    )


def city_hotel_stats(cities: DataFrame, hotels: DataFrame, categories_hotel: DataFrame) -> DataFrame:
    """Hotels and mean stars to one decimal per city name, '-' where there is none.

    The mean is rounded half-even from the exact quotient.
    """
    per_city = (
        hotels.join(_stars(categories_hotel), "star_rating_id")
        .groupBy("city_id")
        .agg(F.count("id").alias("n"), F.sum("star_rating").alias("stars"))
    )
    named = (
        _cities(cities)
        .join(per_city, "city_id", "left")
        .groupBy("city_name")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("hotels"), F.sum("stars").alias("stars"))
    )
    mean = F.bround(F.col("stars").cast("decimal(20,0)") / F.nullif("hotels", F.lit(0)).cast("decimal(20,0)"), 1)
    return named.select(
        "city_name", "hotels", F.coalesce(mean.cast("decimal(3,1)").cast("string"), F.lit("-")).alias("mean_stars")
    )


def network_totals(hotel_counts: DataFrame, reservation_counts: DataFrame) -> DataFrame:
    """Cities and sums of the per-city hotel and active-reservation counts, as one row."""
    both = hotel_counts.select(F.lit(True).alias("of_hotels"), F.col("hotels_count").alias("n")).union(
        reservation_counts.select(F.lit(False), "reservations_count")
    )

    def total(of_hotels: bool):
        return F.coalesce(F.sum(F.when(F.col("of_hotels") == of_hotels, F.col("n"))), F.lit(0))

    return both.agg(
        F.count_if("of_hotels").alias("cities"),
        total(True).alias("total_hotels_count"),
        F.count_if(~F.col("of_hotels")).alias("cities_served"),
        total(False).alias("total_reservations_count"),
    )


def hotel_city_route(hotels: DataFrame, cities: DataFrame, city_nodes: DataFrame) -> DataFrame:
    """Hotel, its city and the node that owns it; unmapped cities belong to the centre."""
    return (
        hotels.select(F.col("id").alias("hotel_id"), "city_id")
        .join(_cities(cities), "city_id")
        .join(city_nodes, "city_name", "left")
        .select("hotel_id", "city_name", F.coalesce("node", F.lit(CENTRAL)).alias("node"))
    )


def hotel_teaser(hotels: DataFrame) -> DataFrame:
    return hotels.where("description IS NOT NULL").select(
        F.col("id").alias("hotel_id"), teaser(F.col("description")).alias("teaser")
    )
