"""Availability and pricing queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.functions.intervals import CLOSED, HALF_OPEN
from lodgeframe.operators import availability
from lodgeframe.plans.domain_sql import over
from lodgeframe.sources.projection import HotelData


def _stays(data: HotelData):
    return availability.active_stays(data.reservations, data.details_reservations)


def v01(spark, path):
    d = HotelData(spark, path)
    return availability.check_availability(d.booking_requests, d.hotels, d.categories_room, d.rooms, _stays(d))


def v02(spark, path):
    d = HotelData(spark, path)
    return availability.available_categories(d.booking_requests, d.hotels, d.categories_room, d.rooms, _stays(d))


def v03(spark, path):
    d = HotelData(spark, path)
    return availability.candidate_rooms(d.booking_requests, d.rooms, d.categories_room)


def v03_free(spark, path):
    d = HotelData(spark, path)
    return availability.candidate_rooms(
        d.booking_requests, d.rooms, d.categories_room, exclude_occupied=True, stays=_stays(d)
    )


def v04(spark, path):
    d = HotelData(spark, path)
    return availability.room_flags(d.booking_requests, d.rooms, _stays(d))


def v05(spark, path):
    d = HotelData(spark, path)
    return availability.room_summary(d.booking_requests, d.rooms, _stays(d))


def v06(spark, path):
    d = HotelData(spark, path)
    return availability.first_free_room(d.booking_requests, d.rooms, _stays(d), CLOSED)


def v07(spark, path):
    d = HotelData(spark, path)
    return availability.first_free_room(d.booking_requests, d.rooms, _stays(d), HALF_OPEN)


def v08(spark, path):
    d = HotelData(spark, path)
    return availability.free_room_for_reservation(d.reservations, d.details_reservations, d.rooms, _stays(d))


def v09(spark, path):
    d = HotelData(spark, path)
    return availability.room_conflicts(_stays(d))


def v10(spark, path):
    d = HotelData(spark, path)
    return availability.booking_capacity(d.booking_requests, d.rooms, _stays(d)).select(
        "request_id", "available", "available_count", "total_rooms", "reserved_rooms"
    )


def _priced_requests(d: HotelData):
    return d.booking_requests.join(
        d.hotels.select(F.col("id").alias("hotel_id"), "location_coeff_room", "star_rating_id"), "hotel_id", "left"
    ).join(
        d.categories_room.select(F.col("id").alias("room_category_id"), "guests_capacity", "price_per_night"),
        "room_category_id",
        "left",
    )


def p01(spark, path):
    d = HotelData(spark, path)
    length = pricing.nights(F.col("start_date"), F.col("end_date"))
    # As in the one-request form, a price needs both a known hotel and a known category.
    known_price = F.when(F.col("star_rating_id").isNotNull(), F.col("price_per_night"))
    total = pricing.booking_price(
        known_price, F.col("location_coeff_room"), F.col("guests_capacity"), F.col("total_guests"), length
    )
    return _priced_requests(d).select("request_id", length.alias("nights"), total.alias("total_price"))


def p02(spark, path):
    d = HotelData(spark, path)
    stars = d.categories_hotel.select(F.col("id").alias("star_rating_id"), "rating_coeff")
    length = pricing.nights(F.col("start_date"), F.col("end_date"))
    total = pricing.stay_price(
        F.col("price_per_night") * F.col("location_coeff_room"), F.col("rating_coeff"), length
    )
    return _priced_requests(d).join(stars, "star_rating_id", "left").select("request_id", total.alias("total_price"))


def p03(spark, path):
    d = HotelData(spark, path)
    return availability.with_quote(d.booking_requests, d.hotels, d.categories_room).select(
        "request_id", "total_price", "price_per_night"
    )


def p04(spark, path):
    d = HotelData(spark, path)
    length = pricing.nights(F.col("start_date"), F.col("end_date"))
    quote = (F.col("price_per_night") * length.cast("decimal(6,0)")).cast(pricing.MONEY)
    return _priced_requests(d).select("request_id", quote.alias("total_price"))


def p05(spark, path):
    d = HotelData(spark, path)
    payers = d.guests.select(F.col("id").alias("payer_id"), "loyalty_card_id", "bonus_points")
    cards = d.loyalty_cards.select(F.col("id").alias("loyalty_card_id"), "req_bonus_amount", "discount")
    final = pricing.discounted(
        F.col("total_price"), F.col("bonus_points"), F.col("req_bonus_amount"), F.col("discount")
    )
    return (
        d.reservations.join(payers, "payer_id")
        .join(cards, "loyalty_card_id", "left")
        .select(F.col("id").alias("reservation_id"), "total_price", final.alias("final_amount"))
    )


def p06(spark, path):
    from lodgeframe.operators.payments import loyalty_tier

    d = HotelData(spark, path)
    return loyalty_tier(d.guests, d.loyalty_cards)


def p07(spark, path):
    from lodgeframe.operators.payments import bonus_totals

    d = HotelData(spark, path)
    return bonus_totals(d.payments, d.reservations)


QUERIES = {
    "v01_check_availability": v01,
    "v02_available_categories": v02,
    "v03_candidate_rooms": v03,
    "v03_candidate_rooms_free": v03_free,
    "v04_room_flags": v04,
    "v05_room_summary": v05,
    "v06_first_free_room_closed": v06,
    "v07_first_free_room": v07,
    "v08_free_room_for_reservation": v08,
    "v09_room_conflicts": v09,
    "v10_booking_capacity": v10,
    "p01_booking_price": p01,
    "p02_booking_price_star": p02,
    "p03_availability_quote": p03,
    "p04_base_quote": p04,
    "p05_loyalty_discount": p05,
    "p06_loyalty_tier": p06,
    "p07_bonus_accrual": p07,
}

_ALL = "booking_requests hotels categories_room rooms active_stays"

_COUNTS = """
    totals AS (SELECT hotel_id, categories_room_id AS c, count(*) AS n FROM rooms GROUP BY ALL),
    taken AS (SELECT q.request_id, count(*) AS n FROM booking_requests q JOIN active_stays s
              ON s.hotel_id = q.hotel_id AND s.requested_room_category = q.room_category_id
              AND NOT (s.end_date <= q.start_date OR s.start_date >= q.end_date) GROUP BY 1),
    capacity AS (SELECT q.*, coalesce(t.n, 0) AS total_rooms, coalesce(k.n, 0) AS reserved_rooms,
                        greatest(coalesce(t.n, 0) - coalesce(k.n, 0), 0) AS available_count
                 FROM booking_requests q
                 LEFT JOIN totals t ON t.hotel_id = q.hotel_id AND t.c = q.room_category_id
                 LEFT JOIN taken k ON k.request_id = q.request_id)"""

_WINDOWS = """
    windows AS (SELECT DISTINCT hotel_id, room_category_id, start_date, end_date FROM booking_requests),
    room_stays AS (SELECT DISTINCT room_id, start_date, end_date FROM active_stays WHERE room_id IS NOT NULL)"""


def _free(rule: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM room_stays s WHERE s.room_id = r.id AND {rule})"


_HALF = "NOT (s.end_date <= w.start_date OR s.start_date >= w.end_date)"
_SHUT = "s.start_date <= w.end_date AND s.end_date >= w.start_date"

_BAD_WINDOWS = """SELECT request_id, 400 AS status, 'End date must be after start date' AS error
           FROM booking_requests WHERE start_date >= end_date UNION ALL BY NAME """

_PRICED = """
    priced AS (SELECT q.*, h.location_coeff_room AS coeff, ch.rating_coeff, c.price_per_night AS price,
                      c.guests_capacity, q.end_date - q.start_date AS nights
               FROM booking_requests q LEFT JOIN hotels h ON h.id = q.hotel_id
               LEFT JOIN categories_hotel ch ON ch.id = h.star_rating_id
               LEFT JOIN categories_room c ON c.id = q.room_category_id)"""
_PRICE_TABLES = "booking_requests hotels categories_hotel categories_room"

ORACLES = {
    "v01_check_availability": over(
        _ALL,
        _BAD_WINDOWS + """SELECT k.request_id, 200 AS status, CAST(NULL AS VARCHAR) AS error, available_count > 0 AS available,
                  available_count AS available_rooms_count, total_rooms, reserved_rooms,
                  CAST(k.end_date - k.start_date AS INT) AS nights,
                  CAST(round_even(coalesce(c.price_per_night, 0) * CASE WHEN h.id IS NULL THEN 1 ELSE h.location_coeff_room END
                       * (k.end_date - k.start_date), 2) AS DECIMAL(12,2)) AS total_price,
                  CAST(round_even(coalesce(c.price_per_night, 0) * CASE WHEN h.id IS NULL THEN 1 ELSE h.location_coeff_room END,
                       2) AS DECIMAL(12,2)) AS price_per_night,
                  c.category_name, c.guests_capacity,
                  CASE WHEN available_count > 0 THEN coalesce(f.room_list, '') ELSE '' END AS available_rooms
           FROM capacity k LEFT JOIN hotels h ON h.id = k.hotel_id LEFT JOIN categories_room c ON c.id = k.room_category_id
           LEFT JOIN (SELECT hotel_id, categories_room_id, string_agg(room_number, ',' ORDER BY room_number) AS room_list
                      FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id, categories_room_id
                                                         ORDER BY room_number, id) AS n FROM rooms)
                      WHERE n <= 5 GROUP BY ALL) f
             ON f.hotel_id = k.hotel_id AND f.categories_room_id = k.room_category_id
           WHERE k.start_date < k.end_date""",
        _COUNTS,
    ),
    "v02_available_categories": over(
        _ALL,
        _BAD_WINDOWS + """SELECT q.request_id, 200 AS status, CAST(NULL AS VARCHAR) AS error, q.hotel_id, c.id, c.category_name, c.guests_capacity, c.price_per_night, c.description,
                  h.location_coeff_room, t.n AS total_rooms, coalesce(k.n, 0) AS reserved_rooms,
                  t.n - coalesce(k.n, 0) AS available_rooms_count,
                  CAST(round_even(c.price_per_night * coalesce(nullif(h.location_coeff_room, 0), 1)
                       * (q.end_date - q.start_date), 2) AS DECIMAL(12,2)) AS price_for_period,
                  CAST(round_even(c.price_per_night * coalesce(nullif(h.location_coeff_room, 0), 1), 2)
                       AS DECIMAL(12,2)) AS price_per_night_with_coeff
           FROM booking_requests q
           JOIN (SELECT hotel_id, categories_room_id AS c, count(*) AS n FROM rooms GROUP BY ALL) t
             ON t.hotel_id = q.hotel_id
           LEFT JOIN (SELECT q.request_id, s.requested_room_category AS c, count(*) AS n
                      FROM booking_requests q JOIN active_stays s ON s.hotel_id = q.hotel_id
                       AND NOT (s.end_date <= q.start_date OR s.start_date >= q.end_date) GROUP BY ALL) k
             ON k.request_id = q.request_id AND k.c = t.c
           JOIN categories_room c ON c.id = t.c JOIN hotels h ON h.id = q.hotel_id
           WHERE t.n - coalesce(k.n, 0) > 0 AND q.start_date < q.end_date""",
    ),
    "v03_candidate_rooms": over(
        _ALL,
        _BAD_WINDOWS + """SELECT q.request_id, 200 AS status, CAST(NULL AS VARCHAR) AS error, CAST(n AS INT) AS position, r.id, r.hotel_id, r.categories_room_id, r.room_number, r.floor,
                  r.view, c.category_name, c.guests_capacity, c.price_per_night
           FROM booking_requests q
           JOIN (SELECT *, row_number() OVER (PARTITION BY hotel_id, categories_room_id ORDER BY room_number, id) AS n
                 FROM rooms) r ON r.hotel_id = q.hotel_id AND r.categories_room_id = q.room_category_id AND n <= 5
           JOIN categories_room c ON c.id = r.categories_room_id WHERE q.start_date < q.end_date""",
    ),
    "v03_candidate_rooms_free": over(
        _ALL,
        _BAD_WINDOWS + """SELECT request_id, 200 AS status, CAST(NULL AS VARCHAR) AS error, CAST(n AS INT) AS position, id, hotel_id, categories_room_id, room_number, floor, view,
                  category_name, guests_capacity, price_per_night
           FROM (SELECT w.request_id, r.*, c.category_name, c.guests_capacity, c.price_per_night,
                        row_number() OVER (PARTITION BY w.request_id ORDER BY r.room_number, r.id) AS n
                 FROM booking_requests w JOIN rooms r
                   ON r.hotel_id = w.hotel_id AND r.categories_room_id = w.room_category_id
                 JOIN categories_room c ON c.id = r.categories_room_id
                 WHERE w.start_date < w.end_date AND """
        + _free(_HALF)
        + ") WHERE n <= 5",
        _WINDOWS,
    ),
    "v04_room_flags": over(
        _ALL,
        f"""SELECT w.*, r.id AS room_id, r.room_number, r.floor, r.view, {_free(_SHUT)} AS is_available
            FROM windows w JOIN rooms r ON r.hotel_id = w.hotel_id AND r.categories_room_id = w.room_category_id""",
        _WINDOWS,
    ),
    "v05_room_summary": over(
        _ALL,
        f"""SELECT w.*, count(r.id) AS total_rooms,
                   CAST(sum(CASE WHEN r.id IS NULL THEN NULL WHEN {_free(_HALF)} THEN 1 ELSE 0 END) AS BIGINT)
                       AS available_rooms_count,
                   CAST(count(r.id) - sum(CASE WHEN r.id IS NULL THEN NULL WHEN {_free(_HALF)} THEN 1 ELSE 0 END)
                       AS BIGINT) AS occupied_rooms_count
            FROM windows w LEFT JOIN rooms r ON r.hotel_id = w.hotel_id AND r.categories_room_id = w.room_category_id
            GROUP BY ALL""",
        _WINDOWS,
    ),
    "v06_first_free_room_closed": over(
        _ALL,
        "SELECT w.*, min(r.id) AS room_id FROM windows w JOIN rooms r ON r.hotel_id = w.hotel_id "
        "AND r.categories_room_id = w.room_category_id WHERE "
        + _free(_SHUT)
        + " GROUP BY ALL",
        _WINDOWS,
    ),
    "v07_first_free_room": over(
        _ALL,
        f"""SELECT w.*, min(r.id) AS room_id FROM windows w JOIN rooms r ON r.hotel_id = w.hotel_id
            AND r.categories_room_id = w.room_category_id
            WHERE {_free(_HALF)} GROUP BY ALL""",
        _WINDOWS,
    ),
    "v08_free_room_for_reservation": over(
        "reservations details_reservations rooms active_stays",
        """SELECT a.reservation_id, a.hotel_id, a.room_category_id, min(r.id) AS room_id
           FROM asked a LEFT JOIN rooms r ON r.hotel_id = a.hotel_id AND r.categories_room_id = a.room_category_id
            AND NOT EXISTS (SELECT 1 FROM active_stays s WHERE s.room_id = r.id
                            AND s.reservation_id <> a.reservation_id
                            AND s.start_date <= a.end_date AND s.end_date >= a.start_date)
           GROUP BY ALL""",
        """asked AS (SELECT DISTINCT r.id AS reservation_id, r.hotel_id, d.requested_room_category AS room_category_id,
                            r.start_date, r.end_date
                     FROM reservations r JOIN details_reservations d ON d.reservation_id = r.id)""",
    ),
    "v09_room_conflicts": over(
        "active_stays",
        """SELECT reservation_id, room_id, start_date, end_date, conflicts,
                  CASE WHEN low < reservation_id THEN low ELSE high END AS conflicting_reservation_id
           FROM (SELECT a.reservation_id, a.room_id, a.start_date, a.end_date, count(*) AS conflicts,
                        min(b.reservation_id) AS low, max(b.reservation_id) AS high
                 FROM (SELECT DISTINCT reservation_id, room_id, start_date, end_date FROM active_stays) a
                 JOIN active_stays b ON b.room_id = a.room_id AND b.reservation_id <> a.reservation_id
                  AND NOT (b.end_date <= a.start_date OR b.start_date >= a.end_date)
                 GROUP BY ALL)""",
    ),
    "v10_booking_capacity": over(
        _ALL,
        "SELECT request_id, available_count > 0 AS available, available_count, total_rooms, reserved_rooms FROM capacity",
        _COUNTS,
    ),
    "p01_booking_price": over(
        _PRICE_TABLES,
        """SELECT request_id, CAST(nights AS INT) AS nights,
                  CAST(CASE WHEN price IS NULL OR rating_coeff IS NULL THEN 1000 * nights
                       ELSE round_even(price * coalesce(nullif(coeff, 0), 1) * nights
                            * (1 + 0.2 * greatest(total_guests - guests_capacity, 0)), 2) END AS DECIMAL(12,2))
                      AS total_price
           FROM priced""",
        _PRICED,
    ),
    "p02_booking_price_star": over(
        _PRICE_TABLES,
        """SELECT request_id, CAST(round_even(price * coeff * rating_coeff * nights, 2) AS DECIMAL(12,2)) AS total_price
           FROM priced""",
        _PRICED,
    ),
    "p03_availability_quote": over(
        _PRICE_TABLES,
        """SELECT request_id, CAST(round_even(p * c * nights, 2) AS DECIMAL(12,2)) AS total_price,
                  CAST(round_even(p * c, 2) AS DECIMAL(12,2)) AS price_per_night
           FROM (SELECT *, coalesce(price, 0) AS p, CASE WHEN rating_coeff IS NULL THEN 1 ELSE coeff END AS c FROM priced)""",
        _PRICED,
    ),
    "p04_base_quote": over(
        _PRICE_TABLES,
        "SELECT request_id, CAST(price * nights AS DECIMAL(12,2)) AS total_price FROM priced",
        _PRICED,
    ),
    "p05_loyalty_discount": over(
        "reservations guests loyalty_cards",
        """SELECT reservation_id, total_price,
                  CAST(CASE WHEN bonus_points >= req THEN
                       (x // 10000 + CASE WHEN x % 10000 > 5000 OR (x % 10000 = 5000 AND (x // 10000) % 2 = 1)
                                          THEN 1 ELSE 0 END) / 100.0
                       ELSE total_price END AS DECIMAL(12,2)) AS final_amount
           FROM (SELECT r.id AS reservation_id, r.total_price, g.bonus_points, c.req_bonus_amount AS req,
                        CAST(r.total_price * 100 AS BIGINT) * CAST(10000 - c.discount * 100 AS BIGINT) AS x
                 FROM reservations r JOIN guests g ON g.id = r.payer_id
                 LEFT JOIN loyalty_cards c ON c.id = g.loyalty_card_id)""",
    ),
    "p06_loyalty_tier": over(
        "guests loyalty_cards",
        """SELECT g.id AS guest_id, g.bonus_points, g.loyalty_card_id AS old_card_id,
                  coalesce((SELECT max_by(c.id, c.req_bonus_amount) FROM loyalty_cards c
                            WHERE c.req_bonus_amount <= g.bonus_points), g.loyalty_card_id) AS loyalty_card_id
           FROM guests g""",
    ),
    "p07_bonus_accrual": over(
        "payments reservations",
        """SELECT r.payer_id, count(*) AS payments, CAST(sum(CAST(floor(p.payments_sum / 100) AS BIGINT)) AS BIGINT)
                      AS bonus_points
           FROM payments p JOIN reservations r ON r.id = p.reservation_id GROUP BY 1""",
    ),
}
