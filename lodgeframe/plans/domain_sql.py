"""The hotel model again, as DuckDB common table expressions over the driver's views."""

from __future__ import annotations

TABLES = {
    "consts": """
        SELECT (SELECT count(*) FROM supplier) AS nh, (SELECT count(*) FROM customer) AS ng,
               (SELECT count(*) FROM orders) AS nr""",
    "cities": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS city_name,
               upper(substr(r_name, 1, 3)) AS country_name_code,
               CASE WHEN r_regionkey < 3 THEN 'filial' || (r_regionkey + 1) ELSE 'central' END AS node
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "categories_hotel": """
        SELECT CAST(id AS BIGINT) AS id, CAST(s AS SMALLINT) AS star_rating, CAST(c AS DECIMAL(5,2)) AS rating_coeff
        FROM (VALUES (1, 3, 1.00), (2, 4, 1.25), (3, 5, 1.50)) t(id, s, c)""",
    "categories_room": """
        SELECT CAST(id AS BIGINT) AS id, n AS category_name, g AS guests_capacity,
               CAST(p AS DECIMAL(10,2)) AS price_per_night, d AS description
        FROM (VALUES (1, 'Standard', 2, 3500.00, 'Basic double room'), (2, 'Superior', 3, 5000.00, 'Renewed room'),
                     (3, 'Suite', 4, 9000.00, NULL)) t(id, n, g, p, d)""",
    "loyalty_cards": """
        SELECT CAST(id AS BIGINT) AS id, n AS program_name, r AS req_bonus_amount, CAST(d AS DECIMAL(5,2)) AS discount
        FROM (VALUES (1, 'Silver', 0, 5.0), (2, 'Gold', 1000, 10.0), (3, 'Platinum', 3000, 15.0)) t(id, n, r, d)""",
    "types_amenities": """
        SELECT CAST(id AS BIGINT) AS id, n AS name
        FROM (VALUES (1, 'Pool'), (2, 'Parking'), (3, 'Spa'), (4, 'Gym')) t(id, n)""",
    "positions": """
        SELECT CAST(id AS BIGINT) AS id, n AS position_name
        FROM (VALUES (1, 'Receptionist'), (2, 'Manager'), (3, 'Cleaner')) t(id, n)""",
    "employees": """
        SELECT c_custkey + 1 AS id, c_mktsegment AS first_name, c_name AS last_name, CAST(NULL AS VARCHAR) AS middle_name,
               1 + c_custkey // 10 % 3 AS position_id, '+6' || c_custkey AS phone_number,
               CASE WHEN c_custkey % 40 <> 0 THEN 'e' || c_custkey || '@stay.example' END AS email,
               DATE '2015-01-01' + CAST(c_custkey % 3000 AS INT) AS employment_date, CAST(NULL AS DATE) AS fired_date,
               c_custkey // 10 % nh + 1 AS hotel_id, CAST(30000 + c_custkey % 1000 * 10 AS DECIMAL(12,2)) AS salary
        FROM customer, consts WHERE c_custkey % 10 = 0""",
    "hotels": """
        SELECT s_suppkey + 1 AS id, s_name AS name, CAST(s_nationkey % 20 + 1 AS BIGINT) AS city_id,
               'Street ' || s_suppkey AS address, '+7' || s_suppkey AS phone_number,
               'h' || s_suppkey || '@stay.example' AS email, 1 + s_suppkey % 3 AS star_rating_id,
               CASE WHEN s_suppkey % 2 = 0 THEN '14:00:00' ELSE '15:00:00' END AS check_in_time,
               '12:00:00' AS check_out_time,
               CASE WHEN s_suppkey % 10 <> 9 THEN CAST(1.00 + 0.05 * (s_suppkey % 6) AS DECIMAL(5,2)) END
                   AS location_coeff_room,
               CASE WHEN s_suppkey % 7 <> 0
                    THEN repeat('Comfortable rooms near the old centre. ', CAST(1 + s_suppkey % 5 AS INT)) END
                   AS description
        FROM supplier""",
    "rooms": """
        SELECT p_partkey + 1 AS id, p_partkey % nh + 1 AS hotel_id, 1 + (p_partkey // nh) % 3 AS categories_room_id,
               CAST(101 + p_partkey // nh AS VARCHAR) AS room_number, p_size AS floor, p_brand AS view
        FROM part, consts WHERE p_partkey % nh % 25 <> 24""",
    "guests": """
        SELECT c_custkey + 1 AS id, c_mktsegment AS first_name, c_name AS last_name,
               CAST(NULL AS VARCHAR) AS middle_name, '+7' || c_custkey AS phone_number,
               CASE WHEN c_custkey % 4 <> 0 THEN c_name || '@x.org' END AS email,
               DATE '1960-01-01' + CAST(c_custkey % 15000 AS INT) AS birth_date,
               CASE WHEN c_custkey % 3 <> 0 THEN 'D' || c_custkey END AS document,
               CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END AS loyalty_card_id,
               CAST(greatest(0, floor(c_acctbal)) AS INT) AS bonus_points
        FROM customer""",
    "reservations": """
        SELECT *, start_date + CAST(CASE WHEN (id - 1) % 10 = 3 THEN 0 ELSE 1 + (id - 1) % 7 END AS INT) AS end_date
        FROM (SELECT o_orderkey + 1 AS id, o_orderkey % nh + 1 AS hotel_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % ((ng + 9) // 10) * 10 + 1 END AS employee_id,
                     o_orderdate AS create_date,
                     CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END
                         AS status,
                     CAST(o_totalprice AS DECIMAL(12,2)) AS total_price,
                     CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'unpaid' END AS payments_status,
                     o_custkey + 1 AS payer_id,
                     DATE '2024-01-01' + CAST((CAST(o_orderdate AS DATE) - DATE '1995-01-01') % 90 AS INT)
                         AS start_date
              FROM orders, consts)""",
    "details_reservations": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS reservation_id,
               CASE WHEN pk % 5 <> 0 AND l_orderkey % nh % 25 <> 24
                    THEN pk // nh * nh + l_orderkey % nh + 1 END AS room_id,
               o_custkey + 1 AS guest_id, 1 + (pk // nh) % 3 AS requested_room_category,
               CAST(1 + CAST(q AS BIGINT) % 5 AS INT) AS total_guest_number
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_quantity) AS q
              FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey, consts""",
    "room_reservation_guests": """
        SELECT DISTINCT l_orderkey * 8 + l_linenumber AS room_reservation_id,
               (l_orderkey + l_suppkey) % ng + 1 AS guest_id
        FROM lineitem, consts""",
    "amenities": """
        SELECT (h.id - 1) * 4 + t.id AS id, h.id AS hotel_id, t.id AS types_amenities_id,
               CAST((h.id * t.id) % 7 * 100 AS DECIMAL(10,2)) AS price
        FROM hotels h, types_amenities t""",
    "payments": """
        SELECT id, id AS reservation_id, total_price AS payments_sum, start_date - 5 AS payments_date,
               ['cash', 'card', 'online'][id % 3 + 1] AS payments_method
        FROM reservations WHERE payments_status = 'paid'""",
    "payments_amenities": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey % nh * 4 + 1 + l_linenumber % 4 AS hotel_amenities_id,
               l_orderkey + 1 AS payment_id, CAST(1 + CAST(min(l_quantity) AS BIGINT) % 3 AS INT) AS quantity,
               CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS total_amenities_price
        FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey),
             consts GROUP BY l_orderkey, l_linenumber, nh""",
    "booking_requests": """
        SELECT id AS request_id, create_date AS requested_at,
               CASE WHEN id % 41 = 0 THEN -hotel_id ELSE hotel_id END AS hotel_id,
               CASE WHEN id % 47 <> 0 THEN payer_id END AS guest_id,
               CASE WHEN id % 43 = 0 THEN 9 ELSE 1 + id % 3 END AS room_category_id, start_date, end_date,
               CAST(1 + id % 5 AS INT) AS total_guests,
               CASE WHEN id % 4 = 0 THEN [payer_id + 1, payer_id + 2, payer_id] END AS additional_guests
        FROM reservations WHERE status = 'cancelled'""",
    "payment_requests": """
        SELECT event_id AS request_id, ts AS requested_at, (event_id * 7) % (nr + nr // 50) + 1 AS reservation_id,
               CAST(value AS DECIMAL(12,2)) AS amount, ['cash', 'card', 'online'][event_id % 3 + 1] AS method
        FROM events, consts WHERE event_type = 'purchase'""",
    "guest_changes": """
        SELECT event_id AS seq, ts, 'filial' || (1 + event_id % 3) AS origin,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
               user_id + 1 AS key, CAST(value AS DECIMAL(12,2)) AS value
        FROM events""",
    "guest_forms": """
        SELECT c_custkey AS form_id, 'filial' || (1 + c_custkey % 3) AS node,
               CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS first_name,
               CASE WHEN c_custkey % 10 = 0 THEN c_name END AS last_name,
               CASE WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 4 = 0 THEN c_mktsegment
                    ELSE ' ' || c_mktsegment || '  middle ' || c_name || ' ' END AS full_name,
               CASE WHEN c_custkey % 7 <> 0 THEN '+7' || c_custkey END AS phone_number,
               CASE WHEN c_custkey % 3 = 0 THEN c_name || '@x.org' END AS email,
               CASE WHEN c_custkey % 6 = 0 THEN DATE '1970-01-01' + CAST(c_custkey % 9000 AS INT) END AS birth_date
        FROM customer""",
    "hotel_changes": """
        SELECT c_custkey AS change_id, c_custkey % (nh + 5) + 1 AS hotel_id, c_name AS name,
               'New street ' || c_custkey AS address, '+8' || c_custkey AS phone_number,
               CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey || '@stay.example' END AS email,
               '16:00:00' AS check_in_time, '10:00:00' AS check_out_time,
               CAST(NULL AS DECIMAL(5,2)) AS location_coeff_room, c_mktsegment AS description
        FROM customer, consts""",
    "registration_requests": """
        SELECT r.id * 2 + turn AS request_id, r.create_date + to_days(CAST(turn AS INT)) AS requested_at,
               CASE WHEN r.id % 31 = 0 THEN -r.id ELSE r.id END AS reservation_id,
               ((r.id + turn) % 4) * nh + r.hotel_id + CASE WHEN r.id % 9 = 0 THEN 1 ELSE 0 END AS room_id,
               [r.payer_id, r.payer_id + 1, r.payer_id + 100000000 + turn] AS guest_ids
        FROM reservations r
        JOIN (SELECT reservation_id FROM details_reservations GROUP BY 1 HAVING count(room_id) = 0) d
          ON d.reservation_id = r.id
        JOIN (VALUES (0), (1)) t(turn) ON turn = 0 OR r.id % 5 = 0, consts
        WHERE r.status <> 'cancelled'""",
    "raw_requests": """
        SELECT id AS request_id,
               CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'soon' ELSE CAST(start_date AS VARCHAR) END
                   AS start_date,
               CASE WHEN id % 19 = 0 THEN CAST(start_date AS VARCHAR) WHEN id % 23 = 0 THEN '2024-02-30'
                    ELSE CAST(end_date AS VARCHAR) END AS end_date,
               CASE WHEN id % 11 = 0 THEN '-' || total_price WHEN id % 29 = 0 THEN 'much'
                    ELSE CAST(total_price AS VARCHAR) END AS amount,
               ['cash', 'card', 'online', 'barter'][id % 4 + 1] AS method
        FROM reservations""",
    "offered_payments": """
        SELECT event_id // 2 AS id, (event_id * 7) % (nr + nr // 10) + 1 AS reservation_id,
               CAST(value - 20 AS DECIMAL(12,2)) AS payments_sum,
               CASE WHEN event_id % 31 <> 0 THEN CAST(ts AS DATE) END AS payments_date, event_type AS payments_method
        FROM events, consts""",
    "offered_guests": """
        SELECT c_custkey + 1 AS id,
               CASE WHEN c_custkey % 37 <> 0 THEN repeat(c_mktsegment, CAST(1 + c_custkey % 8 AS INT)) END AS first_name,
               c_name AS last_name, CASE WHEN c_custkey % 61 = 0 THEN repeat('m', 60) END AS middle_name,
               '+7' || (c_custkey % (ng - ng // 10)) AS phone_number,
               CASE WHEN c_custkey % 4 <> 0 THEN 'm' || (c_custkey % (ng - ng // 11)) || '@x.org' END AS email,
               DATE '1960-01-01' + CAST(c_custkey % 15000 AS INT) AS birth_date,
               CASE WHEN c_custkey % 3 <> 0 THEN 'D' || (c_custkey % (ng - ng // 12)) END AS document,
               c_custkey % 5 AS loyalty_card_id, CAST(floor(c_acctbal) AS INT) AS bonus_points
        FROM customer, consts""",
    "offered_employees": """
        SELECT c_custkey + 1 AS id, c_mktsegment AS first_name, CASE WHEN c_custkey % 53 <> 0 THEN c_name END AS last_name,
               CASE WHEN c_custkey % 59 = 0 THEN repeat('m', 51) END AS middle_name, 1 + c_custkey % 4 AS position_id,
               '+6' || c_custkey AS phone_number, 'e' || (c_custkey % (ng - ng // 9)) || '@stay.example' AS email,
               DATE '2015-01-01' + CAST(c_custkey % 3000 AS INT) AS employment_date, CAST(NULL AS DATE) AS fired_date,
               c_custkey % (nh + 2) + 1 AS hotel_id, CAST(c_acctbal AS DECIMAL(12,2)) AS salary
        FROM customer, consts""",
    "offered_payments_amenities": """
        SELECT l_orderkey * 4 + l_linenumber AS id, l_suppkey % (nh * 4 + 8) + 1 AS hotel_amenities_id,
               l_orderkey + 1 AS payment_id, l_linenumber - 1 AS quantity,
               CAST(l_extendedprice - 2000 AS DECIMAL(12,2)) AS total_amenities_price
        FROM lineitem, consts""",
    "offered_rooms": """
        SELECT p_partkey + 1 AS id, p_partkey % (nh + 3) + 1 AS hotel_id, 1 + p_partkey % 4 AS categories_room_id,
               CAST(100 + p_size AS VARCHAR) AS room_number, p_size AS floor, p_brand AS view
        FROM part, consts""",
    "active_stays": """
        SELECT d.id AS detail_id, r.id AS reservation_id, r.hotel_id, d.requested_room_category, d.room_id,
               r.start_date, r.end_date
        FROM reservations r JOIN details_reservations d ON d.reservation_id = r.id
        WHERE r.status IN ('confirmed', 'pending')""",
}

NEEDS = {
    "rooms": ["consts"],
    "reservations": ["consts"],
    "details_reservations": ["consts"],
    "room_reservation_guests": ["consts"],
    "amenities": ["hotels", "types_amenities"],
    "payments": ["reservations"],
    "booking_requests": ["reservations"],
    "hotel_changes": ["consts"],
    "registration_requests": ["consts", "reservations", "details_reservations"],
    "active_stays": ["reservations", "details_reservations"],
    "raw_requests": ["reservations"],
    "offered_rooms": ["consts"],
    "offered_employees": ["consts"],
    "offered_payments_amenities": ["consts"],
    "employees": ["consts"],
    "payments_amenities": ["consts"],
    "offered_payments": ["consts"],
    "offered_guests": ["consts"],
    "payment_requests": ["consts"],
}


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        _closure(NEEDS.get(name, []), seen)
        if name not in seen:
            seen.append(name)
    return seen


def over(tables: str, body: str, ctes: str = "", recursive: bool = False) -> str:
    """``body`` preceded by the tables it names; ``ctes`` are further named steps."""
    parts = [f"{name} AS ({TABLES[name]})" for name in _closure(tables.split(), [])]
    if ctes:
        parts.append(ctes.strip())
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
