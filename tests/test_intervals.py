"""Overlap counts, room search and conflicts against brute force, stays without nights included."""

import pytest
from models import day, overlap, random_stays

from lodgeframe.functions.intervals import CLOSED, HALF_OPEN, count_overlaps
from lodgeframe.operators import availability

WINDOW = "hotel_id long, room_category_id long, start_date date, end_date date"
STAY = "reservation_id long, room_id long, start_date date, end_date date"


@pytest.mark.parametrize("bounds", [HALF_OPEN, CLOSED])
def test_count_overlaps(spark, bounds):
    stays = random_stays(1, 150, 3)
    windows = [(key, day(s), day(s + n)) for key in (1, 2, 3, 4) for s in range(-2, 28, 3) for n in (1, 4, 9)]
    got = count_overlaps(
        spark.createDataFrame(windows, "room_id long, start_date date, end_date date"),
        spark.createDataFrame(stays, STAY),
        ["room_id"],
        bounds,
    ).collect()
    assert len(got) == len(windows)
    for row in got:
        expected = sum(
            overlap(s, e, row.start_date, row.end_date, bounds == CLOSED) for _, r, s, e in stays if r == row.room_id
        )
        assert row.overlap_count == expected


@pytest.mark.parametrize("bounds", [HALF_OPEN, CLOSED])
def test_free_rooms(spark, bounds):
    stays = random_stays(2, 60, 12, horizon=40)
    rooms = [(n, 1 + n % 2, 1 + n % 3, f"{100 + n}", 1, "x") for n in range(1, 13)]
    windows = [(h, c, day(s), day(s + n)) for h in (1, 2) for c in (1, 2, 3) for s in range(-3, 45, 5) for n in (1, 3)]
    frame = spark.createDataFrame(windows, WINDOW)
    room_frame = spark.createDataFrame(
        rooms, "id long, hotel_id long, categories_room_id long, room_number string, floor int, view string"
    )
    got = {
        (r.hotel_id, r.room_category_id, r.start_date, r.end_date): (r.free_count, r.free_room_id)
        for r in availability.free_rooms(frame, room_frame, spark.createDataFrame(stays, STAY), bounds).collect()
    }
    assert len(got) == len(windows)
    for h, c, s, e in windows:
        free = [
            n
            for n, rh, rc, *_ in rooms
            if (rh, rc) == (h, c) and not any(r == n and overlap(a, b, s, e, bounds == CLOSED) for _, r, a, b in stays)
        ]
        assert got[h, c, s, e] == (len(free), min(free, default=None))


def test_half_open_frees_no_fewer_rooms_than_closed(spark, data):
    stays = availability.active_stays(data.reservations, data.details_reservations)
    windows = availability.search_windows(data.booking_requests)
    keys = [*availability.CATEGORY_KEY, *availability.DATES]
    open_ = availability.free_rooms(windows, data.rooms, stays, HALF_OPEN).select(*keys, "free_count")
    shut = availability.free_rooms(windows, data.rooms, stays, CLOSED).withColumnRenamed("free_count", "shut_count")
    assert open_.join(shut, keys).where("free_count < shut_count").count() == 0
    summary = availability.room_summary(data.booking_requests, data.rooms, stays)
    assert summary.where("total_rooms <> available_rooms_count + occupied_rooms_count").count() == 0


def test_room_conflicts(spark):
    stays = random_stays(3, 120, 5)
    # A second line of the same reservation in its room must not count as a conflict.
    stays += [stays[0], stays[7]]
    got = {(r.reservation_id, r.room_id): r for r in availability.room_conflicts(spark.createDataFrame(stays, STAY)).collect()}
    for number, room, start, end in set(stays):
        others = [n for n, r, s, e in stays if r == room and n != number and overlap(s, e, start, end)]
        row = got.pop((number, room), None)
        if not others:
            assert row is None
        else:
            assert row.conflicts == len(others)
            assert row.conflicting_reservation_id == (min(others) if min(others) < number else max(others))
    assert not got


def test_own_room_counts_as_free_for_its_reservation(spark):
    reservations = spark.createDataFrame(
        [(1, 1, "confirmed", day(0), day(3)), (2, 1, "pending", day(1), day(2)), (3, 1, "cancelled", day(1), day(2))],
        "id long, hotel_id long, status string, start_date date, end_date date",
    )
    details = spark.createDataFrame(
        [(10, 1, 5, 1), (11, 2, None, 1), (12, 3, None, 1), (13, 1, 5, 1)],
        "id long, reservation_id long, room_id long, requested_room_category long",
    )
    rooms = spark.createDataFrame(
        [(5, 1, 1, "1", 1, "x"), (6, 1, 1, "2", 1, "x")],
        "id long, hotel_id long, categories_room_id long, room_number string, floor int, view string",
    )
    stays = availability.active_stays(reservations, details)
    found = availability.free_room_for_reservation(reservations, details, rooms, stays).collect()
    assert {(r.reservation_id, r.room_id) for r in found} == {(1, 5), (2, 6), (3, 6)}
