"""Ordered folds against one-at-a-time models, with one crowded key and with forced rounds."""

import datetime
import random
from decimal import Decimal

import pytest
from models import assign, book, day, overlap, random_stays

from lodgeframe.functions.ordering import first_rows, rank_by_id, strided_ids, writer_of
from lodgeframe.operators import availability, booking, payments

REQUEST = (
    "request_id long, requested_at timestamp_ntz, hotel_id long, room_category_id long, start_date date, "
    "end_date date, places long"
)
KEY = availability.CATEGORY_KEY


def _requests(seed, count):
    """A third or more of the requests want the same hotel and category."""
    rng = random.Random(seed)
    out = []
    for number in range(count):
        hotel = 1 if rng.random() < 0.5 else rng.randrange(2, 6)
        start = rng.randrange(30)
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(60))
        out.append((number, at, hotel, 1, day(start), day(start + rng.randrange(1, 5)), 4))
    return out


@pytest.mark.parametrize("block_rows", [100_000, 17])
def test_first_come_first_served(spark, block_rows):
    rows = _requests(5, 300)
    held = [(1 + n % 5, 1, s, e) for n, _, s, e in random_stays(6, 60, 3, empty_share=0)]
    got = booking.accept_in_order(
        spark.createDataFrame(rows, REQUEST),
        spark.createDataFrame(held, "hotel_id long, room_category_id long, start_date date, end_date date"),
        KEY,
        block_rows,
    ).collect()
    assert len(got) == len(rows)
    ordered = [(r[0], (r[2], r[3]), r[4], r[5]) for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    won = book(ordered, {(h, 1): 4 for h in range(1, 6)}, [((h, c), s, e) for h, c, s, e in held])
    assert {r.request_id for r in got if r.accepted} == won


@pytest.mark.parametrize(("block_rows", "room_chunk"), [(100_000, 2_000), (13, 2_000), (100_000, 2), (13, 3)])
def test_room_assignment(spark, block_rows, room_chunk):
    rng = random.Random(8)
    rooms = [(n, 1 if n < 9 else 2, 1, str(n)) for n in range(1, 13)]
    held = random_stays(9, 30, 12, horizon=40)
    asked = []
    for number in range(1, 80):
        start = rng.randrange(40)
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(20))
        asked.append((number, at, 1 if rng.random() < 0.7 else 2, day(start), day(start + rng.randrange(1, 6)), 1))
    got = booking.assign_free_rooms(
        spark.createDataFrame(
            asked,
            "reservation_id long, requested_at timestamp_ntz, hotel_id long, start_date date, end_date date, "
            "room_category_id long",
        ),
        spark.createDataFrame(rooms, "id long, hotel_id long, categories_room_id long, room_number string"),
        spark.createDataFrame(held, "reservation_id long, room_id long, start_date date, end_date date"),
        block_rows,
        room_chunk,
    ).collect()
    by_hotel = {}
    for n, hotel, kind, _ in rooms:
        by_hotel.setdefault((hotel, kind), []).append(n)
    ordered = [(a[0], (a[2], a[5]), a[3], a[4]) for a in sorted(asked, key=lambda a: (a[1], a[0]))]
    expected = assign(ordered, by_hotel, [(r, s, e) for _, r, s, e in held])
    assert {(r.reservation_id, (r.hotel_id, r.room_category_id)): r.room_id for r in got} == expected
    assert len(got) == len(asked)


def test_no_two_active_stays_share_a_room_after_registration(spark, data):
    decisions = booking.register_guests(
        data.registration_requests, data.reservations, data.details_reservations, data.rooms
    )
    last = {}
    for r in sorted(decisions.where("status = 200").collect(), key=lambda r: (r.requested_at, r.request_id)):
        last[r.reservation_id] = r.room_id
    dates = {r.id: (r.start_date, r.end_date) for r in data.reservations.collect()}
    won = [(n, room, *dates[n]) for n, room in last.items()]
    assert won
    for i, a in enumerate(won):
        assert not any(a[1] == b[1] and overlap(a[2], a[3], b[2], b[3]) for b in won[i + 1 :])


def test_registration_answers(spark):
    reservations = spark.createDataFrame(
        [(n, 1, 7, "pending", day(0), day(2)) for n in (1, 2, 3, 4)] + [(5, 2, 7, "pending", day(0), day(2))],
        "id long, hotel_id long, payer_id long, status string, start_date date, end_date date",
    )
    details = spark.createDataFrame(
        [(n * 10, n, None, 1) for n in (1, 2, 4, 5)] + [(41, 4, None, 1)],
        "id long, reservation_id long, room_id long, requested_room_category long",
    )
    rooms = spark.createDataFrame([(100, 1), (101, 1), (102, 1), (200, 2)], "id long, hotel_id long")
    at = datetime.datetime(2024, 1, 1)
    asks = [(1, 1, 100), (2, 2, 100), (3, 9, 100), (4, 5, 100), (5, 3, 101), (6, 4, 101), (7, 4, 101), (8, 2, 101), (9, 4, 102), (10, 2, 101)]
    requests = spark.createDataFrame(
        [(n, at, r, room, [7, 8, 999]) for n, r, room in asks],
        "request_id long, requested_at timestamp_ntz, reservation_id long, room_id long, guest_ids array<long>",
    )
    decisions = booking.register_guests(requests, reservations, details, rooms)
    got = {r.request_id: r for r in decisions.collect()}
    # Reservation 2 gets a second choice, but only once 4 has moved out of it.
    assert {n: r.status for n, r in got.items()} == {
        1: 200, 2: 409, 3: 404, 4: 400, 5: 400, 6: 200, 7: 200, 8: 409, 9: 200, 10: 200,
    }
    assert got[8].error == "Room is already occupied by another reservation (ID: 4) for these dates"
    guests = spark.createDataFrame([(7,), (8,)], "id long")
    present = spark.createDataFrame([(10, 7)], "room_reservation_id long, guest_id long")
    added = booking.registered_guests(decisions, details, guests, present).collect()
    assert {tuple(r) for r in added} == {(10, 8), (20, 7), (20, 8), (40, 7), (40, 8)}
    placed = booking.registered_details(details, decisions).collect()
    assert {r.id: r.room_id for r in placed} == {10: 100, 20: 101, 40: 102, 41: 102, 50: None}
    confirmed = booking.registered_reservations(reservations, decisions).collect()
    assert {r.id: r.status for r in confirmed} == {1: "confirmed", 2: "confirmed", 3: "pending", 4: "confirmed", 5: "pending"}


def _one_at_a_time(asks, reservations, lines):
    """Registration as a loop over requests, over lists of rows."""
    active = {r for r, (_, status, _, _) in reservations.items() if status != "cancelled"}
    lines, answers = [list(line) for line in lines], {}
    for number, reservation, room in asks:
        _, _, start, end = reservations[reservation]
        clash = [
            r
            for r, held in lines
            if held == room and r != reservation and r in active
            and reservations[r][2] < end and reservations[r][3] > start
        ]
        answers[number] = (409, min(clash)) if clash else (200, None)
        if not clash:
            active.add(reservation)
            for line in lines:
                if line[0] == reservation:
                    line[1] = room
    return answers, sorted((r, room or 0) for r, room in lines)


@pytest.mark.parametrize("batches", [1, 3])
def test_registration_equals_one_at_a_time(spark, batches):
    rng = random.Random(12)
    reservations, lines = {}, []
    for n in range(1, 61):
        start = rng.randrange(12)
        reservations[n] = (1, rng.choice(["pending", "confirmed", "cancelled"]), day(start), day(start + rng.choice([0, 1, 2, 4])))
        lines += [(n, rng.choice([None, None, *range(100, 106)])) for _ in range(rng.choice([1, 1, 2]))]
    asks = [(n, rng.randrange(1, 61), rng.randrange(100, 106)) for n in range(1, 121)]
    expected, expected_lines = _one_at_a_time(asks, reservations, lines)
    rooms = spark.createDataFrame([(room, 1) for room in range(100, 106)], "id long, hotel_id long")
    known = spark.createDataFrame(
        [(n, h, 7, s, a, b) for n, (h, s, a, b) in reservations.items()],
        "id long, hotel_id long, payer_id long, status string, start_date date, end_date date",
    )
    details = spark.createDataFrame(
        [(k, r, room) for k, (r, room) in enumerate(lines)], "id long, reservation_id long, room_id long"
    )
    at, got = datetime.datetime(2024, 1, 1), {}
    size = len(asks) // batches
    for k in range(batches):
        requests = spark.createDataFrame(
            [(n, at, r, room, [7]) for n, r, room in asks[k * size : (k + 1) * size]],
            "request_id long, requested_at timestamp_ntz, reservation_id long, room_id long, guest_ids array<long>",
        )
        decisions = spark.createDataFrame(booking.register_guests(requests, known, details, rooms).collect(), _DECIDED)
        for r in decisions.collect():
            got[r.request_id] = (r.status, int(r.error.split("ID: ")[1].split(")")[0]) if r.status == 409 else None)
        details = spark.createDataFrame(booking.registered_details(details, decisions).collect(), details.schema)
        known = spark.createDataFrame(booking.registered_reservations(known, decisions).collect(), known.schema)
    assert got == expected
    assert sorted((r.reservation_id, r.room_id or 0) for r in details.collect()) == expected_lines


_DECIDED = (
    "request_id long, requested_at timestamp_ntz, reservation_id long, room_id long, payer_id long, "
    "guest_ids array<long>, status int, error string"
)


LADDER = [(0, 1, 500), (1000, 2, 1000), (3000, 3, 1500)]


@pytest.mark.parametrize("block_rows", [100_000, 9])
def test_payments_carry_points_and_card(spark, block_rows):
    rng = random.Random(4)
    reservations = [(n, 1 if n % 2 else 1 + n % 6, "unpaid" if n % 9 else "paid", "pending") for n in range(1, 121)]
    requests = []
    for number in range(1, 161):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(90))
        cents = rng.choice([0, -500, 995, 12345, 4_000_050, 25_000_000])
        requests.append((number, at, rng.randrange(1, 131), Decimal(cents) / 100, rng.choice(["cash", "card", "coin"])))
    guests = [(n, None if n % 2 else 3, 900 * (n % 3)) for n in range(1, 7)]
    outcomes = payments.process_payments(
        spark.createDataFrame(
            requests,
            "request_id long, requested_at timestamp_ntz, reservation_id long, amount decimal(12,2), method string",
        ),
        spark.createDataFrame(reservations, "id long, payer_id long, payments_status string, status string"),
        spark.createDataFrame(guests, "id long, loyalty_card_id long, bonus_points int"),
        spark.createDataFrame(
            [(1, 0, Decimal("5.00")), (2, 1000, Decimal("10.00")), (3, 3000, Decimal("15.00"))],
            "id long, req_bonus_amount int, discount decimal(5,2)",
        ),
        block_rows,
    )
    got = outcomes.collect()
    owner = {n: p for n, p, _, _ in reservations}
    paid = {n for n, _, s, _ in reservations if s == "paid"}
    accounts = {n: [points, card] for n, card, points in guests}
    expected = {}
    for number, at, reservation, amount, method in sorted(requests, key=lambda r: (r[1], r[0])):
        if amount <= 0 or method == "coin":
            expected[number] = (400, None, None, None)
        elif reservation not in owner:
            expected[number] = (404, None, None, None)
        elif reservation in paid:
            expected[number] = (400, None, None, None)
        else:
            paid.add(reservation)
            points, card = accounts[owner[reservation]]
            due = amount
            for required, name, share in LADDER:
                if name == card and points >= required:
                    due = round(amount * (Decimal(1) - Decimal(share) / 10_000), 2)
            points += int(due * Decimal("0.01"))
            card = [name for required, name, _ in LADDER if required <= points][-1]
            accounts[owner[reservation]] = [points, card]
            expected[number] = (200, due, points, card)
    assert {r.request_id: (r.status, r.final_amount, r.points_after, r.card_after) for r in got} == expected
    payers = {r.payer_id for r in got if r.status == 200}
    balances = {r.payer_id: [r.bonus_points, r.loyalty_card_id] for r in payments.payer_balances(outcomes).collect()}
    assert balances == {payer: accounts[payer] for payer in payers}


def test_ranks_and_strided_ids(spark):
    rows = [(n * 37 % 1009, 1 + n % 3) for n in range(1000)]
    df = spark.createDataFrame(rows, "id long, writer long")
    ranks = rank_by_id(df, ["writer"], "id", "rank", block=64).collect()
    for writer in (1, 2, 3):
        own = sorted((r.id, r.rank) for r in ranks if r.writer == writer)
        assert [rank for _, rank in own] == list(range(1, len(own) + 1))
    numbered = strided_ids(df, "writer", "id", 3, "new_id").withColumn("decoded", writer_of(_col("new_id"), 3))
    found = numbered.collect()
    assert len({r.new_id for r in found}) == len(rows)
    assert all(r.decoded == r.writer for r in found)


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_first_rows_of_a_crowded_key(spark):
    df = spark.createDataFrame([(1 if n % 3 else 2, n * 7919 % 1000) for n in range(1000)], "k long, v long")
    got = first_rows(df, ["k"], ["v"], 10, salts=5).collect()
    for key in (1, 2):
        mine = sorted(r.v for r in got if r.k == key)
        assert mine == sorted(n * 7919 % 1000 for n in range(1000) if (1 if n % 3 else 2) == key)[:10]


def test_bookings_reject_with_reasons(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [
        (1, at, 1, 7, 1, day(0), day(2), 5),
        (2, at, 1, 7, 1, day(1), day(2), 1),
        (3, at, 9, 7, 1, day(0), day(2), 1),
        (4, at, 1, 7, 8, day(0), day(2), 1),
        (5, at, 1, 7, 1, day(2), day(2), 1),
        (6, at, 1, 0, None, day(0), day(2), 1),
        (7, at, 1, 7, 1, day(2), day(4), None),
    ]
    requests = spark.createDataFrame(
        rows,
        "request_id long, requested_at timestamp_ntz, hotel_id long, guest_id long, room_category_id long, "
        "start_date date, end_date date, total_guests int",
    )
    hotels = spark.createDataFrame([(1, 3, Decimal("1.10"))], "id long, city_id long, location_coeff_room decimal(5,2)")
    cities = spark.createDataFrame([(3, "A")], "id long, city_name string")
    kinds = spark.createDataFrame(
        [(1, 2, Decimal("100.00"))], "id long, guests_capacity int, price_per_night decimal(10,2)"
    )
    routes = spark.createDataFrame([(1, "filial2")], "hotel_id long, node string")
    rooms = spark.createDataFrame([(1, 1, 1)], "id long, hotel_id long, categories_room_id long")
    stays = spark.createDataFrame([], "hotel_id long, room_category_id long, start_date date, end_date date")
    decisions = booking.create_bookings(requests, hotels, cities, kinds, routes, rooms, stays)
    got = {r.request_id: r for r in decisions.collect()}
    assert {n: r.status for n, r in got.items()} == {1: 201, 2: 409, 3: 404, 4: 404, 5: 400, 6: 400, 7: 201}
    # Two nights at 100 x 1.10, and 20 % on top for each of three extra guests.
    assert got[1].total_price == Decimal("352.00")
    assert got[7].total_price == Decimal("220.00")
    assert got[6].error == "Missing required fields: guest_id, room_category_id"
    seen = spark.createDataFrame([(1,), (2,), (7,)], "id long")
    reservations, details, occupancy = booking.booking_tables(decisions, booking.used_numbers(seen))
    # Writer 2 has gone past 2; its series goes on with 6.
    assert sorted(r.id for r in reservations.collect()) == [6, 10]
    assert details.where("room_id IS NULL").count() == 2
    assert {tuple(r)[:2] for r in occupancy.collect()} == {(6, 7), (10, 7)}
