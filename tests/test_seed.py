"""A chain of three hotels small enough to answer by hand."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.operators import availability, hotels, quality, reservations
from lodgeframe.schemas import CITY_NODES, DOMAIN_CHECKS, UNIQUE_KEYS

# The sample chain.
CITIES = [(1, "Москва", "RUS"), (2, "Санкт-Петербург", "RUS"), (3, "Казань", "RUS")]
STARS = [(1, 3, Decimal("1.00")), (2, 4, Decimal("1.25")), (3, 5, Decimal("1.50"))]
KINDS = [
    (1, "Стандарт", 2, Decimal("3500.00"), "Базовый двухместный номер"),
    (2, "Улучшенный", 3, Decimal("5000.00"), "Номер с улучшенным дизайном"),
    (3, "Люкс", 4, Decimal("9000.00"), "Высшая категория комфорта"),
]
HOTELS = [
    (1, "First", 1, 1, Decimal("1.25")),
    (2, "Second", 2, 2, Decimal("1.15")),
    (3, "Third", 3, 3, Decimal("1.10")),
]
ROOMS = [
    (1, 1, 1, "101"),
    (4, 1, 1, "102"),
    (7, 1, 2, "201"),
    (10, 1, 2, "202"),
    (13, 1, 3, "301"),
    (16, 1, 3, "302"),
    (2, 2, 1, "103"),
    (5, 2, 1, "104"),
    (8, 2, 1, "105"),
    (11, 2, 2, "203"),
    (14, 2, 2, "204"),
    (17, 2, 3, "303"),
    (20, 2, 3, "304"),
    (3, 3, 1, "106"),
    (6, 3, 1, "107"),
    (9, 3, 1, "108"),
    (12, 3, 2, "205"),
    (15, 3, 2, "206"),
    (18, 3, 2, "207"),
    (21, 3, 3, "305"),
    (24, 3, 3, "306"),
]
RESERVATIONS = [
    (1, 1, "confirmed", "2024-03-10", "2024-03-15"),
    (4, 1, "pending", "2024-04-01", "2024-04-05"),
    (2, 2, "confirmed", "2024-04-20", "2024-04-25"),
    (5, 2, "pending", "2024-05-10", "2024-05-15"),
    (8, 2, "confirmed", "2024-06-01", "2024-06-03"),
    (3, 3, "confirmed", "2024-06-01", "2024-06-05"),
    (6, 3, "pending", "2024-06-15", "2024-06-18"),
    (9, 3, "confirmed", "2024-07-01", "2024-07-03"),
]
LINES = [(1, 1, 1, 1), (4, 4, 4, 3), (2, 2, 2, 1), (5, 5, 5, 3), (8, 8, 8, 2), (3, 3, 21, 3), (6, 6, 6, 1), (9, 9, 24, 3)]


@pytest.fixture(scope="module")
def chain(spark):
    def table(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    stays = table(RESERVATIONS, "id long, hotel_id long, status string, start_date string, end_date string")
    return {
        "cities": table(CITIES, "id long, city_name string, country_name_code string"),
        "city_nodes": table(CITY_NODES, "city_name string, node string"),
        "categories_hotel": table(STARS, "id long, star_rating int, rating_coeff decimal(5,2)"),
        "categories_room": table(
            KINDS,
            "id long, category_name string, guests_capacity int, price_per_night decimal(10,2), description string",
        ),
        "hotels": table(
            HOTELS, "id long, name string, city_id long, star_rating_id long, location_coeff_room decimal(5,2)"
        ),
        "rooms": table(ROOMS, "id long, hotel_id long, categories_room_id long, room_number string").withColumns(
            {"floor": F.lit(1), "view": F.lit("x")}
        ),
        "reservations": stays.withColumns(
            {"start_date": F.to_date("start_date"), "end_date": F.to_date("end_date")}
        ),
        "details": table(LINES, "id long, reservation_id long, room_id long, requested_room_category long"),
    }


def _ask(spark, hotel, kind, first, last):
    dates = [datetime.date.fromisoformat(first), datetime.date.fromisoformat(last)]
    return spark.createDataFrame(
        [(1, hotel, kind, *dates)],
        "request_id long, hotel_id long, room_category_id long, start_date date, end_date date",
    )


def test_room_summary_before_and_after_a_booking(spark, chain):
    ask = _ask(spark, 1, 1, "2024-05-15", "2024-05-18")
    stays = availability.active_stays(chain["reservations"], chain["details"])
    row = availability.room_summary(ask, chain["rooms"], stays).first()
    assert (row.total_rooms, row.available_rooms_count, row.occupied_rooms_count) == (2, 2, 0)
    assert availability.first_free_room(ask, chain["rooms"], stays, "half_open").first().room_id == 1
    booked = spark.createDataFrame(
        [(100, 1, datetime.date(2024, 5, 15), datetime.date(2024, 5, 18), 100, 1, 1)], stays.schema
    )
    row = availability.room_summary(ask, chain["rooms"], stays.unionByName(booked)).first()
    assert (row.total_rooms, row.available_rooms_count, row.occupied_rooms_count) == (2, 1, 1)


def test_back_to_back_stays_differ_between_rules(spark, chain):
    stays = availability.active_stays(chain["reservations"], chain["details"])
    ask = _ask(spark, 1, 1, "2024-03-15", "2024-03-18")
    half = availability.first_free_room(ask, chain["rooms"], stays, "half_open").first().room_id
    closed = availability.first_free_room(ask, chain["rooms"], stays, "closed").first().room_id
    assert (half, closed) == (1, 4)


def test_requested_category_counts_even_when_the_room_is_of_another(spark, chain):
    stays = availability.active_stays(chain["reservations"], chain["details"])
    suite = availability.booking_capacity(_ask(spark, 1, 3, "2024-04-02", "2024-04-03"), chain["rooms"], stays).first()
    standard = availability.booking_capacity(_ask(spark, 1, 1, "2024-04-02", "2024-04-03"), chain["rooms"], stays).first()
    assert (suite.reserved_rooms, suite.available_count) == (1, 1)
    assert (standard.reserved_rooms, standard.available_count) == (0, 2)


def test_star_price(spark, chain):
    row = (
        chain["hotels"].where("id = 1")
        .join(chain["categories_hotel"].selectExpr("id AS star_rating_id", "rating_coeff"), "star_rating_id")
        .crossJoin(chain["categories_room"].where("id = 1").select("price_per_night"))
        .select(
            pricing.stay_price(
                F.col("price_per_night") * F.col("location_coeff_room"), F.col("rating_coeff"), F.lit(3)
            ).alias("price")
        )
        .first()
    )
    assert row.price == Decimal("13125.00")


def test_invalid_dates_are_answered_not_dropped(spark, chain):
    stays = availability.active_stays(chain["reservations"], chain["details"])
    row = availability.check_availability(
        _ask(spark, 1, 1, "2024-05-18", "2024-05-18"),
        chain["hotels"],
        chain["categories_room"],
        chain["rooms"],
        stays,
    ).first()
    assert (row.status, row.error, row.total_price) == (400, "End date must be after start date", None)


def test_unknown_category_quotes_zero(spark, chain):
    stays = availability.active_stays(chain["reservations"], chain["details"])
    row = availability.check_availability(
        _ask(spark, 1, 9, "2024-05-15", "2024-05-18"), chain["hotels"], chain["categories_room"], chain["rooms"], stays
    ).first()
    assert (row.status, row.available, row.total_price) == (200, False, Decimal("0.00"))


def test_routes_fall_back_to_the_centre(chain):
    routes = hotels.hotel_city_route(chain["hotels"], chain["cities"], chain["city_nodes"].where("node <> 'filial3'"))
    assert {r.hotel_id: r.node for r in routes.collect()} == {1: "filial1", 2: "filial2", 3: "central"}


def test_min_price_and_load(chain):
    cheapest = hotels.hotel_min_price(
        chain["hotels"], chain["cities"], chain["categories_hotel"], chain["rooms"], chain["categories_room"]
    )
    assert {r.id: r.min_price for r in cheapest.collect()} == {
        1: Decimal("4375.0000"), 2: Decimal("4025.0000"), 3: Decimal("3850.0000"),
    }
    counts = reservations.cities_reservation_counts(chain["cities"], chain["hotels"], chain["reservations"])
    tiers = reservations.city_load_tier(counts).collect()
    assert {(r.city_name, r.reservations_count, r.load_tier) for r in tiers} == {
        ("Москва", 2, "low"), ("Санкт-Петербург", 3, "low"), ("Казань", 3, "low"),
    }


def test_seed_breaks_no_rule(chain):
    tables = {
        "cities": chain["cities"],
        "categories_hotel": chain["categories_hotel"],
        "categories_room": chain["categories_room"],
        "rooms": chain["rooms"],
    }
    assert quality.broken_domains(tables, [rule for rule in DOMAIN_CHECKS if rule[0] in tables]).isEmpty()
    assert quality.duplicate_keys(tables, [rule for rule in UNIQUE_KEYS if rule[0] in tables]).isEmpty()
    assert quality.bad_shapes(tables).isEmpty()
    for check in (quality.broken_domains, quality.duplicate_keys, quality.broken_references):
        with pytest.raises(ValueError, match="employees"):
            check(tables)


def test_sorted_reads_keep_their_order(spark, data):
    rows = [(r.city_name, -r.star_rating) for r in hotels.hotel_directory(data.hotels, data.cities, data.categories_hotel).collect()]
    assert rows == sorted(rows)
    booked = reservations.active_bookings(
        data.reservations, data.hotels, data.details_reservations, data.rooms, data.categories_room, data.guests
    ).collect()
    keys = [(r.start_date, r.hotel_name, r.room_number) for r in booked]
    assert keys == sorted(keys)


def test_keys_that_read_alike_are_told_apart(spark):
    """A key is a rule's number and one text; parts that join to the same text are unlike keys."""
    form = "id long, a string, b string"
    rows = [(1, "x|y", "z"), (2, "x", "y|z"), (3, "x", "y|z"), (3, None, "z"), (4, "", "q"), (5, "", "q"), (6, "3", "a"), (7, "3", "b")]
    rules = [("t", ["id"]), ("t", ["a", "b"]), ("t", ["b", "a"]), ("u", ["a"])]
    found = quality.duplicate_keys({"t": spark.createDataFrame(rows, form), "u": spark.createDataFrame(rows, form)}, rules)
    assert {tuple(r) for r in found.collect()} == {
        ("t", "id", "3", 2), ("t", "a,b", "x|y|z", 2), ("t", "b,a", "y|z|x", 2), ("t", "a,b", "|q", 2), ("t", "b,a", "q|", 2),
        ("u", "a", "x", 2), ("u", "a", "", 2), ("u", "a", "3", 2),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [rule#" in plan and "key_parts" not in plan
