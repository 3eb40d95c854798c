"""Booking, registration, payment, guest and hotel-edit queries with their SQL twins.

The SQL twins of the ordered folds walk each key's rows one at a time with a recursive query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodgeframe.operators import availability, booking, guests, hotels, payments, reservations
from lodgeframe.plans.domain_sql import over
from lodgeframe.plans.read_queries import BOOKED_SQL, BOOKED_TABLES, PLACED_SQL
from lodgeframe.plans.search_queries import _COUNTS
from lodgeframe.session import shared_folder
from lodgeframe.sources.projection import HotelData
from lodgeframe.streaming import feeds, requests

# A minute into a day on which reservations were made.
ATTACH_AS_OF = "2000-06-15 00:00:30"


def _on(run):
    return lambda spark, path: run(HotelData(spark, path))


def _stays(d):
    return availability.active_stays(d.reservations, d.details_reservations)


def _bookings(d):
    routes = hotels.hotel_city_route(d.hotels, d.cities, d.city_nodes)
    return booking.create_bookings(
        d.booking_requests, d.hotels, d.cities, d.categories_room, routes, d.rooms, _stays(d)
    )


def _booked(d):
    return booking.booking_tables(_bookings(d), booking.used_numbers(d.reservations, d.details_reservations))


def _new_reservations(d):
    reservations, details, _ = _booked(d)
    lines = details.select("reservation_id", "requested_room_category", "total_guest_number")
    return reservations.join(lines, F.col("id") == F.col("reservation_id")).select(
        "id",
        "node",
        "hotel_id",
        "create_date",
        "status",
        "total_price",
        "payments_status",
        "payer_id",
        "start_date",
        "end_date",
        "requested_room_category",
        "total_guest_number",
    )


def _registrations(d):
    return booking.register_guests(d.registration_requests, d.reservations, d.details_reservations, d.rooms)


def _registered_guests(d):
    return booking.registered_guests(_registrations(d), d.details_reservations, d.guests, d.room_reservation_guests)


def _payments(d):
    return payments.process_payments(d.payment_requests, d.reservations, d.guests, d.loyalty_cards)


def _confirm(d):
    added, updated = payments.confirm_paid(d.payment_requests, d.reservations)
    per_reservation = added.groupBy("reservation_id").agg(
        F.count("*").alias("new_payments"), F.sum("payments_sum").cast("decimal(18,2)").alias("new_payments_sum")
    )
    return updated.join(per_reservation, updated.id == per_reservation.reservation_id, "left").select(
        "id",
        "status",
        "payments_status",
        F.coalesce("new_payments", F.lit(0)).alias("new_payments"),
        "new_payments_sum",
    )


def _assignments(d):
    asked = booking.unassigned(d.reservations, d.details_reservations)
    return booking.assign_free_rooms(asked, d.rooms, _stays(d))


def _latest_placed(d):
    """The latest booking once the reservations without a room got theirs."""
    placed = booking.assigned_details(d.details_reservations, _assignments(d))
    return reservations.latest_placed_booking(d.reservations, placed, d.rooms, d.categories_room)


STREAM_PARTS = 3


def _booking_stream(spark, path):
    """Requests in parts by arrival, each decided by a stream that is started anew on the state the last one left."""
    d = HotelData(spark, path)
    asks = d.booking_requests
    base = f"{shared_folder(spark).rstrip('/')}/lodgeframe-booking-stream-{uuid.uuid4().hex}"
    arrived = F.unix_micros(F.col("requested_at").cast("timestamp"))
    first, last = asks.agg(F.min(arrived), F.max(arrived)).first()
    routes = hotels.hotel_city_route(d.hotels, d.cities, d.city_nodes)
    for part in range(STREAM_PARTS if first is not None else 0):
        own = F.least(F.floor((arrived - first) * STREAM_PARTS / (last - first + 1)), F.lit(STREAM_PARTS - 1))
        asks.where(own == part).write.mode("append").parquet(f"{base}/requests")
        stream = feeds.read_feed(spark, f"{base}/requests", asks.schema, files_per_batch=10_000)
        requests.book_stream(
            stream, d.hotels, d.cities, d.categories_room, routes, d.rooms, _stays(d), f"{base}/decisions", f"{base}/state"
        ).awaitTermination()
    return spark.read.schema(requests.BOOKING_DECISION).parquet(f"{base}/decisions").select(
        "request_id", "hotel_id", "room_category_id", "node", "status", "error", "total_price"
    )


QUERIES = {
    "t01_create_bookings": _on(
        lambda d: _bookings(d).select("request_id", "hotel_id", "room_category_id", "node", "status", "error", "total_price")
    ),
    "t01_new_reservations": _on(_new_reservations),
    "t01_new_guests": _on(lambda d: _booked(d)[2]),
    "t02_register_guests": _on(
        lambda d: _registrations(d).select("request_id", "reservation_id", "room_id", "status", "error")
    ),
    "t02_registered_guests": _on(_registered_guests),
    "t02_registered_details": _on(lambda d: booking.registered_details(d.details_reservations, _registrations(d))),
    "t02_confirmed_reservations": _on(
        lambda d: booking.registered_reservations(d.reservations, _registrations(d)).select("id", "status")
    ),
    "t03_process_payments": _on(lambda d: _payments(d).drop("requested_at")),
    "t03_paid_reservations": _on(
        lambda d: payments.paid_reservations(d.reservations, _payments(d)).select(
            "id", "status", "payments_status", "total_price"
        )
    ),
    "t04_confirm_paid": _on(_confirm),
    "t05_create_guests": _on(lambda d: guests.create_guests(d.guest_forms, d.guests)),
    "t06_update_hotels": _on(lambda d: guests.update_hotels(d.hotels, d.hotel_changes)),
    "t06_rejected_changes": _on(lambda d: guests.rejected_changes(d.hotels, d.hotel_changes)),
    "t07_attach_guest_to_recent": _on(
        lambda d: booking.attach_to_recent(
            d.reservations, d.details_reservations, d.room_reservation_guests, ATTACH_AS_OF
        )
    ),
    "t08_assign_free_room": _on(_assignments),
    "t01_booking_stream": _booking_stream,
    "r30_latest_booking_placed": _on(_latest_placed),
}

_BOOKING_TABLES = "booking_requests hotels cities categories_room rooms active_stays reservations details_reservations"

_BOOKED = (
    _COUNTS
    + """,
    screened AS (
        SELECT *, CASE WHEN guest_id IS NULL THEN 'Missing required fields: guest_id'
                       WHEN hotel_id NOT IN (SELECT id FROM hotels) THEN 'Hotel not found'
                       WHEN room_category_id NOT IN (SELECT id FROM categories_room) THEN 'Room category not found'
                       WHEN start_date >= end_date THEN 'End date must be after start date' END AS refusal
        FROM booking_requests),
    waiting AS MATERIALIZED (
        SELECT *, total_rooms - reserved_rooms AS room_left,
               row_number() OVER (PARTITION BY hotel_id, room_category_id ORDER BY requested_at, request_id) AS n
        FROM capacity SEMI JOIN (SELECT request_id FROM screened WHERE refusal IS NULL) USING (request_id)),
    fold AS (
        SELECT DISTINCT hotel_id, room_category_id, CAST(0 AS BIGINT) AS n,
               CAST([] AS STRUCT(s DATE, e DATE)[]) AS taken, CAST(NULL AS BIGINT) AS request_id, false AS accepted
        FROM waiting
        UNION ALL
        SELECT hotel_id, room_category_id, n,
               CASE WHEN ok THEN list_append(taken, {'s': start_date, 'e': end_date}) ELSE taken END, request_id, ok
        FROM (SELECT q.*, f.taken,
                     len(list_filter(f.taken, lambda x: NOT (x.e <= q.start_date OR x.s >= q.end_date))) < q.room_left
                         AS ok
              FROM fold f JOIN waiting q ON q.hotel_id = f.hotel_id AND q.room_category_id = f.room_category_id
               AND q.n = f.n + 1)),
    decided AS (
        SELECT q.*, coalesce(f.accepted, false) AS accepted, coalesce(c.node, 'central') AS node,
               CASE WHEN f.accepted THEN
                 CAST(round_even(k.price_per_night * coalesce(nullif(h.location_coeff_room, 0), 1)
                      * (q.end_date - q.start_date)
                      * (1 + 0.2 * greatest(q.total_guests - k.guests_capacity, 0)), 2) AS DECIMAL(12,2)) END
                   AS total_price
        FROM screened q LEFT JOIN fold f ON f.request_id = q.request_id LEFT JOIN hotels h ON h.id = q.hotel_id
        LEFT JOIN cities c ON c.id = h.city_id LEFT JOIN categories_room k ON k.id = q.room_category_id),
    past AS (SELECT (id - 1) % 4 + 1 AS writer, max((id - 1) // 4 + 1) AS used
             FROM (SELECT id FROM reservations UNION ALL SELECT id FROM details_reservations) GROUP BY 1),
    fresh AS (
        SELECT writer + 4 * (used + row_number() OVER (PARTITION BY writer ORDER BY request_id) - 1) AS new_id, a.*
        FROM (SELECT *, CASE node WHEN 'central' THEN 4 ELSE CAST(right(node, 1) AS INT) END AS writer
              FROM decided WHERE accepted) a JOIN past USING (writer))"""
)

_REGISTERED = """
    checked AS (
        SELECT q.*, r.id AS known_id, r.hotel_id, r.payer_id, r.start_date, r.end_date, rm.id IS NOT NULL AS room_ok
        FROM registration_requests q LEFT JOIN reservations r ON r.id = q.reservation_id
        LEFT JOIN rooms rm ON rm.id = q.room_id AND rm.hotel_id = r.hotel_id),
    waiting AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY requested_at, request_id) AS n,
               (SELECT coalesce(list(DISTINCT s.reservation_id), CAST([] AS BIGINT[])) FROM active_stays s
                WHERE s.room_id = q.room_id AND s.reservation_id <> q.reservation_id
                  AND NOT (s.end_date <= q.start_date OR s.start_date >= q.end_date)) AS held
        FROM checked q WHERE room_ok),
    fold AS (
        SELECT DISTINCT hotel_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(v BIGINT, r BIGINT, s DATE, e DATE)[]) AS moved,
               CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS conflict
        FROM waiting
        UNION ALL
        SELECT hotel_id, n,
               CASE WHEN clash IS NOT NULL THEN moved
                    ELSE list_append(list_filter(moved, lambda x: x.v <> reservation_id),
                                     {'v': reservation_id, 'r': room_id, 's': start_date, 'e': end_date}) END,
               request_id, clash
        FROM (SELECT q.*, f.moved,
                     list_min(list_concat(
                         list_filter(q.held, lambda h: NOT list_contains(list_transform(f.moved, lambda y: y.v), h)),
                         list_transform(list_filter(f.moved, lambda x: x.r = q.room_id AND x.v <> q.reservation_id
                                                    AND NOT (x.e <= q.start_date OR x.s >= q.end_date)),
                                        lambda y: y.v))) AS clash
              FROM fold f JOIN waiting q ON q.hotel_id = f.hotel_id AND q.n = f.n + 1)),
    decided AS (
        SELECT q.*, CASE WHEN known_id IS NULL THEN 404 WHEN NOT q.room_ok THEN 400 WHEN f.conflict IS NULL THEN 200
                         ELSE 409 END AS status,
               CASE WHEN known_id IS NULL THEN 'Reservation not found' WHEN NOT q.room_ok THEN 'Room not found in this hotel'
                    ELSE 'Room is already occupied by another reservation (ID: ' || f.conflict || ') for these dates' END
                   AS error
        FROM checked q LEFT JOIN fold f ON f.request_id = q.request_id)"""
_REGISTER_TABLES = "registration_requests reservations rooms active_stays guests room_reservation_guests"

_PAID = """
    found AS (
        SELECT q.*, r.payer_id, r.payments_status,
               CASE WHEN q.amount = 0 THEN 400 WHEN r.payer_id IS NULL THEN 404
                    WHEN r.payments_status = 'paid' THEN 400 ELSE 0 END AS code
        FROM payment_requests q LEFT JOIN reservations r ON r.id = q.reservation_id),
    ranked AS (
        SELECT *, CASE WHEN code = 0 THEN row_number() OVER (PARTITION BY reservation_id, code
                                                             ORDER BY requested_at, request_id) END AS turn
        FROM found),
    waiting AS MATERIALIZED (
        SELECT *, CAST(amount * 100 AS BIGINT) AS cents,
               row_number() OVER (PARTITION BY payer_id ORDER BY requested_at, request_id) AS n
        FROM ranked WHERE turn = 1),
    fold AS (
        SELECT DISTINCT g.id AS payer_id, CAST(0 AS BIGINT) AS n, CAST(g.bonus_points AS BIGINT) AS points,
               g.loyalty_card_id AS card, CAST(NULL AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS paid,
               CAST(0 AS BIGINT) AS earned
        FROM guests g JOIN waiting w ON w.payer_id = g.id
        UNION ALL
        SELECT payer_id, n, points + paid // 10000,
               coalesce((SELECT max_by(c.id, c.req_bonus_amount) FROM loyalty_cards c
                         WHERE c.req_bonus_amount <= points + paid // 10000), card), request_id, paid, paid // 10000
        FROM (SELECT q.payer_id, q.n, q.request_id, f.points, f.card,
                     CASE WHEN c.id IS NULL OR f.points < c.req_bonus_amount THEN q.cents
                          ELSE x // 10000 + CASE WHEN x % 10000 > 5000 OR (x % 10000 = 5000 AND (x // 10000) % 2 = 1)
                                                 THEN 1 ELSE 0 END END AS paid
              FROM fold f JOIN waiting q ON q.payer_id = f.payer_id AND q.n = f.n + 1
              LEFT JOIN (SELECT *, CAST(10000 - discount * 100 AS BIGINT) AS keep FROM loyalty_cards) c ON c.id = f.card,
              LATERAL (SELECT q.cents * coalesce(c.keep, 0) AS x))),
    outcome AS (
        SELECT w.request_id, w.reservation_id, w.payer_id, w.method,
               CASE WHEN w.turn = 1 THEN 200 WHEN w.code = 0 THEN 400 ELSE w.code END AS status,
               CASE WHEN w.turn = 1 THEN NULL WHEN w.amount = 0 THEN 'Missing required fields'
                    WHEN w.code = 404 THEN 'Reservation not found'
                    ELSE 'Reservation already paid' END AS error,
               CAST(f.paid / 100.0 AS DECIMAL(12,2)) AS final_amount, f.earned AS bonus_points_added,
               f.points AS points_after, f.card AS card_after
        FROM ranked w LEFT JOIN fold f ON f.request_id = w.request_id)"""
_PAY_TABLES = "payment_requests reservations guests loyalty_cards"

_ASSIGNED = """
    room_stays AS (SELECT DISTINCT room_id, start_date, end_date FROM active_stays WHERE room_id IS NOT NULL),
    asked AS (
        SELECT r.id AS reservation_id, r.create_date, r.hotel_id, r.start_date, r.end_date, d.c AS room_category_id
        FROM reservations r
        JOIN (SELECT DISTINCT reservation_id, requested_room_category AS c FROM details_reservations
              WHERE room_id IS NULL) d ON d.reservation_id = r.id
        WHERE r.status IN ('confirmed', 'pending')),
    waiting AS MATERIALIZED (
        SELECT a.*, row_number() OVER (PARTITION BY hotel_id, room_category_id ORDER BY create_date, reservation_id) AS n,
               (SELECT list(rm.id ORDER BY rm.id) FROM rooms rm
                WHERE rm.hotel_id = a.hotel_id AND rm.categories_room_id = a.room_category_id
                  AND NOT EXISTS (SELECT 1 FROM room_stays s WHERE s.room_id = rm.id
                                  AND s.start_date <= a.end_date AND s.end_date >= a.start_date)) AS candidates
        FROM asked a),
    fold AS (
        SELECT DISTINCT hotel_id, room_category_id, CAST(0 AS BIGINT) AS n,
               CAST([] AS STRUCT(r BIGINT, s DATE, e DATE)[]) AS taken, CAST(NULL AS BIGINT) AS reservation_id,
               CAST(NULL AS BIGINT) AS room_id
        FROM waiting
        UNION ALL
        SELECT hotel_id, room_category_id, n,
               CASE WHEN room IS NULL THEN taken
                    ELSE list_append(taken, {'r': room, 's': start_date, 'e': end_date}) END, reservation_id, room
        FROM (SELECT q.*, f.taken,
                     list_filter(q.candidates, lambda c: NOT list_contains(
                         list_transform(list_filter(f.taken, lambda x: x.s <= q.end_date AND x.e >= q.start_date),
                                        lambda y: y.r), c))[1] AS room
              FROM fold f JOIN waiting q ON q.hotel_id = f.hotel_id AND q.room_category_id = f.room_category_id
               AND q.n = f.n + 1))"""

ORACLES = {
    "t01_create_bookings": over(
        _BOOKING_TABLES,
        """SELECT request_id, hotel_id, room_category_id, node,
                  CASE WHEN accepted THEN 201 WHEN refusal LIKE '%not found' THEN 404 WHEN refusal IS NOT NULL THEN 400
                       ELSE 409 END AS status,
                  CASE WHEN NOT accepted THEN coalesce(refusal,
                      'No available rooms of this category for the selected dates. Available: 0, Required: 1') END
                      AS error, total_price
           FROM decided""",
        _BOOKED,
        recursive=True,
    ),
    "t01_new_reservations": over(
        _BOOKING_TABLES,
        """SELECT new_id AS id, node, hotel_id, requested_at AS create_date, 'pending' AS status, total_price,
                  'unpaid' AS payments_status, guest_id AS payer_id, start_date, end_date,
                  room_category_id AS requested_room_category, total_guests AS total_guest_number
           FROM fresh WHERE new_id NOT IN (SELECT id FROM reservations)
            AND new_id NOT IN (SELECT id FROM details_reservations)""",
        _BOOKED,
        recursive=True,
    ),
    "t01_new_guests": over(
        _BOOKING_TABLES,
        """SELECT DISTINCT new_id AS room_reservation_id, unnest([guest_id] || coalesce(additional_guests, [])) AS guest_id, node
           FROM fresh""",
        _BOOKED,
        recursive=True,
    ),
    "t02_register_guests": over(
        _REGISTER_TABLES,
        "SELECT request_id, reservation_id, room_id, status, error FROM decided",
        _REGISTERED,
        recursive=True,
    ),
    "t02_registered_guests": over(
        _REGISTER_TABLES + " details_reservations",
        """SELECT DISTINCT l.id AS room_reservation_id, p.guest_id
           FROM (SELECT reservation_id, payer_id AS guest_id FROM decided WHERE status = 200
                 UNION SELECT reservation_id, guest_id
                 FROM (SELECT reservation_id, unnest(guest_ids) AS guest_id FROM decided WHERE status = 200)
                 WHERE guest_id IN (SELECT id FROM guests)) p
           JOIN (SELECT reservation_id, min(id) AS id FROM details_reservations GROUP BY 1) l
             ON l.reservation_id = p.reservation_id
           WHERE NOT EXISTS (SELECT 1 FROM room_reservation_guests o
                             WHERE o.room_reservation_id = l.id AND o.guest_id = p.guest_id)""",
        _REGISTERED,
        recursive=True,
    ),
    "t02_registered_details": over(
        _REGISTER_TABLES + " details_reservations",
        """SELECT d.id, d.reservation_id, coalesce(w.room_id, d.room_id) AS room_id, d.guest_id, d.requested_room_category,
                  d.total_guest_number
           FROM details_reservations d
           LEFT JOIN (SELECT reservation_id, max_by(room_id, (requested_at, request_id)) AS room_id FROM decided
                      WHERE status = 200 GROUP BY 1) w USING (reservation_id)""",
        _REGISTERED,
        recursive=True,
    ),
    "t02_confirmed_reservations": over(
        _REGISTER_TABLES,
        """SELECT id, CASE WHEN id IN (SELECT reservation_id FROM decided WHERE status = 200) THEN 'confirmed' ELSE status END
                      AS status
           FROM reservations""",
        _REGISTERED,
        recursive=True,
    ),
    "t03_process_payments": over(_PAY_TABLES, "SELECT * FROM outcome", _PAID, recursive=True),
    "t03_paid_reservations": over(
        _PAY_TABLES,
        """SELECT r.id, CASE WHEN o.request_id IS NULL THEN r.status ELSE 'confirmed' END AS status,
                  CASE WHEN o.request_id IS NULL THEN r.payments_status ELSE 'paid' END AS payments_status,
                  coalesce(o.final_amount, r.total_price) AS total_price
           FROM reservations r LEFT JOIN outcome o ON o.reservation_id = r.id AND o.status = 200""",
        _PAID,
        recursive=True,
    ),
    "t04_confirm_paid": over(
        "payment_requests reservations",
        """SELECT r.id, CASE WHEN p.n IS NULL THEN r.status ELSE 'confirmed' END AS status,
                  CASE WHEN p.n IS NULL THEN r.payments_status ELSE 'paid' END AS payments_status,
                  coalesce(p.n, 0) AS new_payments, CAST(p.s AS DECIMAL(18,2)) AS new_payments_sum
           FROM reservations r
           LEFT JOIN (SELECT reservation_id, count(*) AS n, sum(amount) AS s FROM payment_requests GROUP BY 1) p
             ON p.reservation_id = r.id""",
    ),
    "t05_create_guests": over(
        "guest_forms guests",
        """SELECT form_id, node, CASE WHEN ok THEN 201 ELSE 400 END AS status,
                  CASE WHEN NOT ok THEN 'Phone number is required' END AS error,
                  CASE WHEN ok THEN writer + 4 * (used + row_number() OVER (PARTITION BY writer, ok ORDER BY form_id) - 1) END
                      AS guest_id,
                  CASE WHEN f || l = '' THEN coalesce(parts[1], 'Гость') ELSE f END AS first_name,
                  CASE WHEN f || l = '' THEN CASE WHEN len(parts) > 1 THEN parts[-1] ELSE '' END ELSE l END AS last_name,
                  phone_number, coalesce(email, '') AS email, coalesce(birth_date, DATE '2000-01-01') AS birth_date
           FROM (SELECT *, phone_number IS NOT NULL AS ok, coalesce(first_name, '') AS f, coalesce(last_name, '') AS l,
                        list_filter(regexp_split_to_array(full_name, '\\s+'), lambda w: w <> '') AS parts,
                        CAST(right(node, 1) AS BIGINT) AS writer
                 FROM guest_forms)
           JOIN (SELECT (id - 1) % 4 + 1 AS writer, max((id - 1) // 4 + 1) AS used FROM guests GROUP BY 1) USING (writer)""",
    ),
    "t06_update_hotels": over(
        "hotels hotel_changes",
        """SELECT h.id, coalesce(c.name, h.name) AS name, h.city_id,
                  CASE WHEN c.hotel_id IS NULL THEN h.address ELSE c.address END AS address,
                  CASE WHEN c.hotel_id IS NULL THEN h.phone_number ELSE c.phone_number END AS phone_number,
                  CASE WHEN c.hotel_id IS NULL THEN h.email ELSE c.email END AS email, h.star_rating_id,
                  CASE WHEN c.hotel_id IS NULL THEN h.check_in_time ELSE c.check_in_time END AS check_in_time,
                  CASE WHEN c.hotel_id IS NULL THEN h.check_out_time ELSE c.check_out_time END AS check_out_time,
                  CASE WHEN c.hotel_id IS NULL THEN h.location_coeff_room ELSE c.location_coeff_room END
                      AS location_coeff_room,
                  CASE WHEN c.hotel_id IS NULL THEN h.description ELSE c.description END AS description
           FROM hotels h
           LEFT JOIN (SELECT * FROM hotel_changes
                      QUALIFY row_number() OVER (PARTITION BY hotel_id ORDER BY change_id DESC) = 1) c
             ON c.hotel_id = h.id""",
    ),
    "t06_rejected_changes": over(
        "hotels hotel_changes",
        """SELECT change_id, hotel_id, 404 AS status, 'Hotel not found' AS error FROM hotel_changes
           WHERE hotel_id NOT IN (SELECT id FROM hotels)""",
    ),
    "t07_attach_guest_to_recent": over(
        "reservations details_reservations room_reservation_guests",
        f"""SELECT d.id AS room_reservation_id, d.guest_id
            FROM (SELECT d.guest_id, max(d.id) AS id FROM details_reservations d
                  JOIN reservations r ON r.id = d.reservation_id
                  WHERE r.create_date >= TIMESTAMP '{ATTACH_AS_OF}' - INTERVAL '1 minute'
                    AND r.create_date <= TIMESTAMP '{ATTACH_AS_OF}' GROUP BY 1) d
            WHERE NOT EXISTS (SELECT 1 FROM room_reservation_guests o
                              WHERE o.room_reservation_id = d.id AND o.guest_id = d.guest_id)""",
    ),
    "t08_assign_free_room": over(
        "reservations details_reservations rooms active_stays",
        "SELECT reservation_id, hotel_id, room_category_id, room_id FROM fold WHERE reservation_id IS NOT NULL",
        _ASSIGNED,
        recursive=True,
    ),
}

ORACLES["t01_booking_stream"] = ORACLES["t01_create_bookings"]
ORACLES["r30_latest_booking_placed"] = over(
    f"{BOOKED_TABLES} active_stays",
    BOOKED_SQL + " WHERE id = (SELECT max(id) FROM placed)",
    _ASSIGNED
    + ", "
    + PLACED_SQL.replace("FROM details_reservations NATURAL JOIN numbered", "FROM filled NATURAL JOIN numbered").replace(
        "placed AS", """filled AS (
        SELECT d.* EXCLUDE (room_id), coalesce(d.room_id, f.room_id) AS room_id FROM details_reservations d
        LEFT JOIN fold f ON f.reservation_id = d.reservation_id AND f.room_category_id = d.requested_room_category),
    placed AS"""
    ),
    recursive=True,
)
