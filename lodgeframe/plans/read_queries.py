"""Read-model queries with their SQL twins."""

from __future__ import annotations

from lodgeframe.operators import hotels as H
from lodgeframe.operators import reservations as R
from lodgeframe.plans.domain_sql import over
from lodgeframe.sources.projection import HotelData

AS_OF = "2024-02-15"


def _on(run):
    """A query from a function of the loaded tables."""
    return lambda spark, path: run(HotelData(spark, path))


def _routes(d):
    return H.hotel_city_route(d.hotels, d.cities, d.city_nodes)


def _listed(d, newest_first=True):
    return R.city_reservations(
        d.reservations,
        d.guests,
        d.hotels,
        d.details_reservations,
        d.categories_room,
        d.room_reservation_guests,
        _routes(d),
        newest_first,
    )


def _reservation_counts(d):
    return R.cities_reservation_counts(d.cities, d.hotels, d.reservations)


def _network(d):
    return H.network_totals(H.cities_hotel_counts(d.cities, d.hotels), _reservation_counts(d))


def _wide(d):
    return R.reservation_details(
        d.reservations, d.guests, d.hotels, d.cities, d.details_reservations, d.categories_room, d.rooms
    )


QUERIES = {
    "r01_list_hotels": _on(lambda d: H.list_hotels(d.hotels, d.cities, d.categories_hotel)),
    "r02_hotels_by_city": _on(
        lambda d: H.hotels_by_city(d.city_nodes, d.hotels, d.cities, d.categories_hotel)
    ),
    "r03_hotel_details": _on(
        lambda d: H.hotel_details(d.booking_requests, d.hotels, d.cities, d.categories_hotel)
    ),
    "r04_hotel_directory": _on(lambda d: H.hotel_directory(d.hotels, d.cities, d.categories_hotel)),
    "r05_hotel_min_price": _on(
        lambda d: H.hotel_min_price(d.hotels, d.cities, d.categories_hotel, d.rooms, d.categories_room)
    ),
    "r06_hotel_category_prices": _on(lambda d: H.hotel_category_prices(d.hotels, d.rooms, d.categories_room)),
    "r07_hotel_categories_with_counts": _on(
        lambda d: H.hotel_categories_with_counts(d.hotels, d.rooms, d.categories_room)
    ),
    "r08_room_category_details": _on(lambda d: H.room_category_details(d.booking_requests, d.categories_room)),
    "r09_category_price_list": _on(lambda d: H.category_price_list(d.categories_room)),
    "r10_hotel_rooms": _on(lambda d: H.hotel_rooms(d.rooms, d.categories_room)),
    "r11_hotel_amenities": _on(lambda d: H.hotel_amenities(d.amenities, d.types_amenities)),
    "r12_amenity_prices": _on(lambda d: H.amenity_prices(d.amenities, d.types_amenities, d.hotels)),
    "r13_cities_hotel_counts": _on(lambda d: H.cities_hotel_counts(d.cities, d.hotels)),
    "r14_city_hotel_stats": _on(lambda d: H.city_hotel_stats(d.cities, d.hotels, d.categories_hotel)),
    "r15_network_totals": _on(_network),
    "r16_cities_reservation_counts": _on(_reservation_counts),
    "r17_city_load_tier": _on(lambda d: R.city_load_tier(_reservation_counts(d))),
    "r18_city_reservations": _on(_listed),
    "r19_city_status_counts": _on(lambda d: R.status_counts(_listed(d, newest_first=False))),
    "r20_registration_needed": _on(lambda d: R.registration_needed(_listed(d, newest_first=False))),
    "r21_hotel_reservations": _on(
        lambda d: R.hotel_reservations(
            d.reservations, d.guests, d.hotels, d.details_reservations, d.room_reservation_guests
        )
    ),
    "r22_upcoming_reservations": _on(
        lambda d: R.upcoming_reservations(
            d.reservations, d.guests, d.details_reservations, d.room_reservation_guests, d.categories_room, AS_OF
        )
    ),
    "r23_registration_details": _on(
        lambda d: R.registration_details(
            d.reservations, d.details_reservations, d.guests, d.categories_room, d.rooms, d.room_reservation_guests
        )
    ),
    "r24_reservation_details": _on(_wide),
    "r25_payment_info": _on(lambda d: R.payment_info(d.reservations, d.hotels, d.guests)),
    "r26_active_bookings": _on(
        lambda d: R.active_bookings(
            d.reservations, d.hotels, d.details_reservations, d.rooms, d.categories_room, d.guests
        )
    ),
    "r27_payment_history": _on(lambda d: R.payment_history(d.payments, d.reservations, d.hotels)),
    "r28_guest_details": _on(lambda d: R.guest_details(d.booking_requests, d.guests)),
    "r29_hotel_city_route": _on(_routes),
    "r30_latest_booking": _on(
        lambda d: R.latest_booking(d.reservations, d.details_reservations, d.rooms, d.categories_room)
    ),
    "r30_latest_booking_per_hotel": _on(
        lambda d: R.latest_booking_per_hotel(d.reservations, d.details_reservations, d.rooms, d.categories_room)
    ),
    "r31_hotel_teaser": _on(lambda d: H.hotel_teaser(d.hotels)),
}

# The twins count on narrow keys first and look dimensions up last, by shared column names.

# Hotels with their city's and star category's columns.
_FACTS = """
    place AS (SELECT id AS city_id, city_name, country_name_code, node FROM cities),
    stars AS (SELECT id AS star_rating_id, star_rating, rating_coeff FROM categories_hotel),
    facts AS (SELECT * FROM hotels NATURAL JOIN place NATURAL JOIN stars)"""
_FACT_TABLES = "hotels cities categories_hotel"

_KIND = "kind AS (SELECT id AS categories_room_id, * EXCLUDE (id) FROM categories_room)"

_CITY_COUNTS = """
    in_city AS (SELECT city_id AS id, count(*) AS n FROM hotels GROUP BY city_id),
    hotel_counts AS (SELECT DISTINCT city_name, coalesce(n, 0) AS hotels_count FROM cities LEFT JOIN in_city USING (id))"""
_RES_COUNTS = """
    open_in_hotel AS (SELECT hotel_id AS id, count(*) AS n FROM reservations
                      WHERE status IN ('confirmed', 'pending') GROUP BY hotel_id),
    open_in_city AS (SELECT city_id AS id, sum(n) AS n FROM hotels NATURAL JOIN open_in_hotel GROUP BY city_id),
    res_counts AS (SELECT DISTINCT city_name, CAST(coalesce(n, 0) AS BIGINT) AS reservations_count
                   FROM cities LEFT JOIN open_in_city USING (id))"""

# Guests on record per detail line, and lines that look alike taken together.
_OCCUPIED = """
    occupied AS (SELECT room_reservation_id AS id, count(*) AS n FROM room_reservation_guests
                 WHERE guest_id IS NOT NULL GROUP BY 1)"""
_PARTIES = (
    _OCCUPIED
    + """,
    parties AS (SELECT reservation_id, requested_room_category, total_guest_number, room_id,
                       CAST(sum(coalesce(n, 0)) AS BIGINT) AS registered_guests_count
                FROM details_reservations LEFT JOIN occupied USING (id) GROUP BY 1, 2, 3, 4)"""
)
_PAYER = "payer AS (SELECT id AS payer_id, * EXCLUDE (id) FROM guests)"
_HOUSE = "house AS (SELECT id AS hotel_id, name AS hotel_name, city_id FROM hotels)"

_LISTED = (
    _PARTIES
    + f""", {_PAYER}, {_HOUSE},
    town AS (SELECT id AS city_id, node FROM cities),
    chosen AS (SELECT id AS requested_room_category, category_name FROM categories_room),
    listed AS (
        SELECT b.id, hotel_id, create_date, start_date, end_date, status, total_price, payments_status, payer_id,
               first_name, last_name, phone_number, email, hotel_name, requested_room_category, total_guest_number,
               room_id, category_name, coalesce(registered_guests_count, 0) AS registered_guests_count, node
        FROM (SELECT * FROM reservations WHERE list_contains(['confirmed', 'pending'], status)) b
        NATURAL JOIN payer NATURAL JOIN house NATURAL JOIN town
        LEFT JOIN parties p ON b.id = p.reservation_id LEFT JOIN chosen USING (requested_room_category))"""
)
_LISTED_TABLES = (
    "reservations guests hotels cities details_reservations categories_room room_reservation_guests"
)

# Lines that hold a room, with the room's number and category.
PLACED_SQL = f"""{_KIND},
    numbered AS (SELECT id AS room_id, room_number, floor, category_name FROM rooms NATURAL JOIN kind),
    placed AS (SELECT reservation_id AS id, total_guest_number, numbered.* FROM details_reservations NATURAL JOIN numbered)"""
BOOKED_SQL = """SELECT hotel_id, id AS reservation_id, total_price, room_number, category_name, start_date, end_date, status
             FROM placed NATURAL JOIN reservations"""
BOOKED_TABLES = "reservations details_reservations rooms categories_room"

ORACLES = {
    "r01_list_hotels": over(
        _FACT_TABLES,
        "SELECT * EXCLUDE (city_id, star_rating_id, rating_coeff, country_name_code, node) FROM facts",
        _FACTS,
    ),
    "r02_hotels_by_city": over(
        _FACT_TABLES,
        """SELECT * EXCLUDE (city_id, star_rating_id, rating_coeff, country_name_code, node)
           FROM facts SEMI JOIN (SELECT city_name FROM cities WHERE node LIKE 'filial%') USING (city_name)""",
        _FACTS,
    ),
    "r03_hotel_details": over(
        _FACT_TABLES + " booking_requests",
        """SELECT * EXCLUDE (country_name_code, node)
           FROM facts SEMI JOIN (SELECT hotel_id AS id FROM booking_requests) USING (id)""",
        _FACTS,
    ),
    "r04_hotel_directory": over(
        _FACT_TABLES,
        """SELECT * EXCLUDE (city_id, star_rating_id, rating_coeff, node, location_coeff_room, description)
                    RENAME (id AS hotel_id, name AS hotel_name)
           FROM facts""",
        _FACTS,
    ),
    "r05_hotel_min_price": over(
        _FACT_TABLES + " rooms categories_room",
        """SELECT id, name, city_name, star_rating, location_coeff_room,
                  CAST(cheapest * location_coeff_room AS DECIMAL(16,4)) AS min_price
           FROM facts LEFT JOIN (SELECT hotel_id AS id, min(price_per_night) AS cheapest FROM rooms NATURAL JOIN
                                 (SELECT categories_room_id, price_per_night FROM kind) GROUP BY 1) USING (id)""",
        _FACTS + ", " + _KIND,
    ),
    "r06_hotel_category_prices": over(
        "hotels rooms categories_room",
        """SELECT hotel_id, categories_room_id AS id, category_name, guests_capacity,
                  CAST(location_coeff_room * price_per_night AS DECIMAL(16,4)) AS final_price, description
           FROM (SELECT hotel_id, categories_room_id FROM rooms GROUP BY ALL) NATURAL JOIN kind
           NATURAL JOIN (SELECT id AS hotel_id, location_coeff_room FROM hotels)""",
        _KIND,
    ),
    "r07_hotel_categories_with_counts": over(
        "hotels rooms categories_room",
        """SELECT hotel_id, categories_room_id, category_name, guests_capacity,
                  CAST(round_even(price_per_night * coalesce(nullif(location_coeff_room, 0), 1), 2) AS DECIMAL(12,2))
                      AS price_per_night,
                  description, location_coeff_room, n AS total_rooms_count, n AS room_count
           FROM (SELECT hotel_id, categories_room_id, count(*) AS n FROM rooms GROUP BY ALL) NATURAL JOIN kind
           NATURAL JOIN (SELECT id AS hotel_id, location_coeff_room FROM hotels)""",
        _KIND,
    ),
    "r08_room_category_details": over(
        "booking_requests categories_room",
        "SELECT * FROM categories_room SEMI JOIN (SELECT room_category_id AS id FROM booking_requests) USING (id)",
    ),
    "r09_category_price_list": over(
        "categories_room",
        """SELECT id AS "ID категории", category_name AS "Название категории", guests_capacity AS "Вместимость",
                  price_per_night AS "Цена за ночь", description AS "Описание" FROM categories_room""",
    ),
    "r10_hotel_rooms": over(
        "rooms categories_room", "SELECT * RENAME (description AS room_description) FROM rooms NATURAL JOIN kind", _KIND
    ),
    "r11_hotel_amenities": over(
        "amenities types_amenities",
        """SELECT * FROM amenities
           NATURAL JOIN (SELECT id AS types_amenities_id, name AS amenity_name FROM types_amenities)""",
    ),
    "r12_amenity_prices": over(
        "amenities types_amenities hotels",
        """SELECT hotel_id, amenity_type, price AS amenity_price
           FROM amenities SEMI JOIN (SELECT id AS hotel_id FROM hotels) USING (hotel_id)
           JOIN (SELECT id AS types_amenities_id, name AS amenity_type FROM types_amenities) USING (types_amenities_id)""",
    ),
    "r13_cities_hotel_counts": over("cities hotels", "FROM hotel_counts", _CITY_COUNTS),
    "r14_city_hotel_stats": over(
        "cities hotels categories_hotel",
        """SELECT city_name, CAST(sum(coalesce(n, 0)) AS BIGINT) AS hotels,
                  coalesce(CAST(CAST(round_even(sum(stars) / sum(n), 1) AS DECIMAL(3,1)) AS VARCHAR), '-') AS mean_stars
           FROM cities LEFT JOIN
                (SELECT city_id AS id, count(*) AS n, sum(star_rating) AS stars FROM hotels
                 LEFT JOIN (SELECT id AS star_rating_id, star_rating FROM categories_hotel) USING (star_rating_id)
                 GROUP BY city_id) USING (id)
           GROUP BY city_name""",
    ),
    "r15_network_totals": over(
        "cities hotels reservations",
        """SELECT * FROM (SELECT count(*) AS cities, CAST(sum(hotels_count) AS BIGINT) AS total_hotels_count FROM hotel_counts)
           POSITIONAL JOIN (SELECT count(*) AS cities_served, CAST(sum(reservations_count) AS BIGINT)
                                   AS total_reservations_count FROM res_counts)""",
        _CITY_COUNTS + "," + _RES_COUNTS,
    ),
    "r16_cities_reservation_counts": over("cities hotels reservations", "FROM res_counts", _RES_COUNTS),
    "r17_city_load_tier": over(
        "cities hotels reservations",
        """SELECT *, CASE WHEN reservations_count > 15 THEN 'high' WHEN reservations_count > 5 THEN 'medium'
                          WHEN reservations_count > 0 THEN 'low' ELSE 'none' END AS load_tier
           FROM res_counts""",
        _RES_COUNTS,
    ),
    "r18_city_reservations": over(_LISTED_TABLES, "FROM listed", _LISTED),
    "r19_city_status_counts": over(
        _LISTED_TABLES,
        """SELECT node, count(*) AS total, count_if(status = 'pending') AS pending,
                  count_if(status = 'confirmed') AS confirmed, count_if(payments_status = 'paid') AS paid
           FROM listed GROUP BY node""",
        _LISTED,
    ),
    "r20_registration_needed": over(
        _LISTED_TABLES,
        """SELECT id, status, room_id, status <> 'confirmed' OR coalesce(room_id, 0) = 0 AS registration_needed
           FROM listed""",
        _LISTED,
    ),
    "r21_hotel_reservations": over(
        "reservations guests hotels details_reservations room_reservation_guests",
        """SELECT b.*, first_name, last_name, phone_number, hotel_name, CAST(coalesce(n, 0) AS BIGINT) AS total_guests
           FROM (SELECT * FROM reservations WHERE status = 'pending') b NATURAL JOIN house
           JOIN (SELECT payer_id, first_name, last_name, phone_number FROM payer) USING (payer_id)
           LEFT JOIN (SELECT reservation_id AS id, sum(registered_guests_count) AS n FROM parties GROUP BY 1) USING (id)""",
        f"{_PARTIES}, {_PAYER}, house AS (SELECT id AS hotel_id, name AS hotel_name FROM hotels)",
    ),
    "r22_upcoming_reservations": over(
        "reservations guests details_reservations room_reservation_guests categories_room",
        f"""SELECT id AS reservation_id, hotel_id, create_date, start_date, end_date, status, payments_status,
                   total_price, guest_name, coalesce(total_guests, 0) AS total_guests, room_categories
            FROM (SELECT * FROM reservations WHERE NOT start_date < DATE '{AS_OF}')
            JOIN (SELECT id AS payer_id, concat_ws(' ', first_name, last_name) AS guest_name FROM guests) USING (payer_id)
            LEFT JOIN (SELECT reservation_id AS id, string_agg(category_name, ', ' ORDER BY category_name) AS room_categories
                       FROM (SELECT reservation_id, requested_room_category, unnest(range(greatest(coalesce(n, 0), 1)))
                             FROM details_reservations LEFT JOIN occupied USING (id))
                       JOIN (SELECT id AS requested_room_category, category_name FROM categories_room)
                            USING (requested_room_category) GROUP BY 1) USING (id)
            LEFT JOIN (SELECT reservation_id AS id, count(*) AS total_guests
                       FROM (SELECT DISTINCT reservation_id, o.guest_id FROM room_reservation_guests o
                             JOIN details_reservations d ON o.room_reservation_id = d.id) GROUP BY 1) USING (id)""",
        _OCCUPIED,
    ),
    "r23_registration_details": over(
        "reservations details_reservations guests categories_room rooms room_reservation_guests",
        """SELECT reservation_id, concat_ws(' ', first_name, last_name) AS guest_name, phone_number, document,
                  requested_category, total_guest_number, room_number,
                  id IN (SELECT room_reservation_id FROM room_reservation_guests) AS is_registered
           FROM details_reservations SEMI JOIN (SELECT id AS reservation_id FROM reservations) USING (reservation_id)
           JOIN (SELECT id AS requested_room_category, category_name AS requested_category FROM categories_room)
                USING (requested_room_category)
           JOIN (SELECT id AS guest_id, first_name, last_name, phone_number, document FROM guests) USING (guest_id)
           LEFT JOIN (SELECT id AS room_id, room_number FROM rooms) USING (room_id)""",
    ),
    "r24_reservation_details": over(
        "reservations guests hotels cities details_reservations categories_room rooms",
        f"""SELECT b.*, first_name, last_name, phone_number, email, document, loyalty_card_id, bonus_points, hotel_name,
                   city_id, city_name, requested_room_category, total_guest_number, room_id, category_name, room_number,
                   floor, view, CAST(date_diff('day', start_date, end_date) AS INT) AS nights
            FROM reservations b NATURAL JOIN house JOIN (SELECT id AS city_id, city_name FROM cities) USING (city_id)
            JOIN payer USING (payer_id)
            LEFT JOIN (SELECT reservation_id AS id, requested_room_category, total_guest_number, room_id
                       FROM details_reservations) USING (id)
            LEFT JOIN (SELECT id AS room_id, room_number, floor, view FROM rooms) USING (room_id)
            LEFT JOIN (SELECT id AS requested_room_category, category_name FROM categories_room)
                      USING (requested_room_category)""",
        f"{_PAYER}, {_HOUSE}",
    ),
    "r25_payment_info": over(
        "reservations hotels guests",
        """SELECT b.*, hotel_name, first_name, last_name
           FROM reservations b JOIN (SELECT payer_id, first_name, last_name FROM payer) USING (payer_id)
           JOIN (SELECT hotel_id, hotel_name FROM house) USING (hotel_id)""",
        f"{_PAYER}, {_HOUSE}",
    ),
    "r26_active_bookings": over(
        "reservations hotels details_reservations rooms categories_room guests",
        """SELECT status, payments_status, hotel_name, room_number, floor, category_name AS room_category,
                  concat_ws(' ', first_name, last_name) AS guest_name, total_guest_number AS gn, start_date, end_date,
                  total_price
           FROM placed NATURAL JOIN (SELECT * FROM reservations WHERE status = ANY(['pending', 'confirmed']))
           JOIN (SELECT hotel_id, hotel_name FROM house) USING (hotel_id)
           JOIN (SELECT payer_id, first_name, last_name FROM payer) USING (payer_id)""",
        f"{PLACED_SQL}, {_PAYER}, {_HOUSE}",
    ),
    "r27_payment_history": over(
        "payments reservations hotels",
        """SELECT payer_id, CAST(position AS INT) AS position, * EXCLUDE (payer_id, position)
           FROM (SELECT paid.*, payer_id, start_date, end_date, hotel_name,
                        rank() OVER (PARTITION BY payer_id ORDER BY payments_date DESC, paid.id DESC) AS position
                 FROM payments paid
                 JOIN (SELECT id AS reservation_id, payer_id, hotel_id, start_date, end_date FROM reservations)
                      USING (reservation_id)
                 JOIN (SELECT id AS hotel_id, name AS hotel_name FROM hotels) USING (hotel_id))
           WHERE position < 11""",
    ),
    "r28_guest_details": over(
        "booking_requests guests",
        "SELECT * FROM guests SEMI JOIN (SELECT guest_id AS id FROM booking_requests) USING (id)",
    ),
    "r29_hotel_city_route": over(
        "hotels cities",
        """SELECT id AS hotel_id, city_name, node
           FROM (SELECT id, city_id FROM hotels) JOIN (SELECT id AS city_id, city_name, node FROM cities) USING (city_id)""",
    ),
    "r30_latest_booking": over(
        BOOKED_TABLES, BOOKED_SQL + " WHERE id >= ALL(SELECT id FROM reservations)", PLACED_SQL
    ),
    "r30_latest_booking_per_hotel": over(
        BOOKED_TABLES,
        BOOKED_SQL + " SEMI JOIN (SELECT hotel_id, max(id) AS id FROM reservations GROUP BY hotel_id) USING (hotel_id, id)",
        PLACED_SQL,
    ),
    "r31_hotel_teaser": over(
        "hotels",
        """SELECT id AS hotel_id, description[:100] || CASE WHEN length(description) > 100 THEN '...' ELSE '' END AS teaser
           FROM hotels WHERE description IS NOT NULL""",
    ),
}
