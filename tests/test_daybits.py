"""The day tree, islands and linked groups against plain loops; the operators built on them on crowded keys."""

import datetime
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from models import day, overlap
from test_folds import _one_at_a_time

from lodgeframe.functions.daybits import DayBits, RoomCalendar, each, lowest
from lodgeframe.functions.graph import islands, linked_groups
from lodgeframe.operators import availability, booking

STRETCH = st.tuples(st.integers(-40, 40), st.integers(0, 30))


@settings(max_examples=200, deadline=None)
@given(st.lists(STRETCH, max_size=25), st.sets(st.integers(0, 24)), st.lists(STRETCH, max_size=10))
def test_day_tree(stretches, removed, asked):
    tree, kept = DayBits(), {}
    for member, (first, length) in enumerate(stretches):
        tree.add(member, first, first + length)
        kept[member] = first, first + length
    for member in removed & set(kept):
        tree.remove(member, *kept.pop(member))
    for first, length in asked:
        expected = {m for m, (a, b) in kept.items() if a < b and max(a, first) < min(b, first + length)}
        found = tree.busy(first, first + length)
        assert set(each(found)) == expected
        assert not found or lowest(found) == min(expected)


def test_day_tree_over_ages():
    """Stretches beyond the largest block, and days far apart."""
    tree = DayBits()
    tree.add(0, -719_162, 2_932_897)
    tree.add(1, 100_000, 100_001)
    assert tree.busy(99_999, 100_002) == 3 and tree.busy(0, 1) == 1 and tree.busy(3_000_000, 3_000_001) == 0
    tree.remove(0, -719_162, 2_932_897)
    assert tree.busy(-719_162, 2_932_897) == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15), st.tuples(st.integers(0, 12), st.integers(0, 12)))
def test_room_calendar_keeps_the_half_open_rule(stays, window):
    room = RoomCalendar()
    for member, (first, last) in enumerate(stays):
        room.hold(member, first, last)
    for gone in (set(), set(range(0, len(stays), 2))):
        for member in gone:
            room.release(member, *stays[member])
        expected = {m for m, (s, e) in enumerate(stays) if m not in gone and s < window[1] and e > window[0]}
        assert set(each(room.clashes(*window))) == expected


def test_islands_and_groups(spark):
    rng = random.Random(3)
    rows = [(n, rng.randrange(1, 9), rng.randrange(60), rng.randrange(5)) for n in range(150)]
    rows = [(n, room, a, a + length) for n, room, a, length in rows]
    found = islands(spark.createDataFrame(rows, "n long, room long, a long, b long"), "room", "a", "b", "n").collect()
    parent = {n: n for n, *_ in rows}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for n, room, a, b in rows:
        for m, other, c, d in rows:
            if room == other and (a == c or a < c < b or c < a < d):
                parent[max(root(n), root(m))] = min(root(n), root(m))
    assert {r.n: r.island for r in found} == {n: root(n) for n, *_ in rows}


def test_linked_groups_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(501, 600)] + [(7, 7), (900, 901), (950, 950)]
    found = linked_groups(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.linked_group, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(500, 600)), [900, 901]]
    assert linked_groups(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").collect() == []


RESERVATION = "id long, hotel_id long, payer_id long, status string, start_date date, end_date date"
ASK = "request_id long, requested_at timestamp_ntz, reservation_id long, room_id long, guest_ids array<long>"


@pytest.mark.parametrize("seed", [1, 2])
def test_one_large_hotel_in_groups_equals_one_at_a_time(spark, seed):
    """All rows in one hotel: the answers stay, and the work falls apart into many groups."""
    rng = random.Random(seed)
    reservations, lines = {}, []
    for n in range(1, 201):
        start = rng.randrange(200)
        reservations[n] = (1, rng.choice(["pending", "confirmed", "cancelled"]), day(start), day(start + rng.choice([0, 1, 2, 4])))
        lines += [(n, rng.choice([None, None, *range(100, 130)])) for _ in range(rng.choice([1, 1, 2]))]
    asks = [(n, rng.randrange(1, 201), rng.randrange(100, 130)) for n in range(1, 401)]
    expected, expected_lines = _one_at_a_time(asks, reservations, lines)
    at = datetime.datetime(2024, 1, 1)
    requests = spark.createDataFrame([(n, at, r, room, [7]) for n, r, room in asks], ASK)
    known = spark.createDataFrame([(n, h, 7, s, a, b) for n, (h, s, a, b) in reservations.items()], RESERVATION)
    details = spark.createDataFrame([(k, r, room) for k, (r, room) in enumerate(lines)], "id long, reservation_id long, room_id long")
    rooms = spark.createDataFrame([(room, 1) for room in range(100, 130)], "id long, hotel_id long")
    decided = booking.register_guests(requests, known, details, rooms, hotel_rows=10)
    got = {r.request_id: (r.status, int(r.error.split("ID: ")[1].split(")")[0]) if r.status == 409 else None) for r in decided.collect()}
    assert got == expected and 409 in {s for s, _ in got.values()}
    placed = booking.registered_details(details, decided).collect()
    assert sorted((r.reservation_id, r.room_id or 0) for r in placed) == expected_lines
    rows = requests.join(known.withColumnRenamed("id", "reservation_id"), "reservation_id").selectExpr(
        "reservation_id", "room_id", "datediff(start_date, '1970-01-01') AS first_day", "datediff(end_date, '1970-01-01') AS last_day"
    )
    sizes = [r["count"] for r in booking.dependent_groups(rows).groupBy("decided_with").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 200


def test_many_reservations_of_one_category():
    """A hundred thousand answers of one key: first fit, with no walk over gaps or rooms."""
    rng = random.Random(4)
    rooms = booking.OpenRooms(None)
    for room in range(1000, 3000):
        rooms.add_room(room)
    begun = time.perf_counter()
    for _ in range(100_000):
        first = rng.randrange(4000)
        rooms.take(first, first + rng.randrange(1, 15))
    assert time.perf_counter() - begun < 60
    small, taken = booking.OpenRooms(None), []
    for room in (3, 5, 9):
        small.add_room(room)
    small.occupy(5, 2, 4)
    taken.append((5, 2, 4))
    for _ in range(300):
        first = rng.randrange(60)
        last = first + rng.randrange(6)
        free = [r for r in (3, 5, 9) if not any(q == r and overlap(a, b, first, last, True) for q, a, b in taken)]
        room = small.take(first, last)
        assert room == min(free, default=None)
        if room:
            taken.append((room, first, last))
    assert small.take(70, 60) is None


@pytest.mark.parametrize("nights", [5, 300_000])
def test_room_conflicts_of_long_stays(spark, nights):
    """Rows are bounded by stays: a stay of centuries costs what a short one does."""
    rng = random.Random(6)
    stays = []
    for n in rng.sample(range(1, 500), 120):
        start = rng.randrange(60)
        stays.append((n, rng.randrange(1, 5), day(start), day(start + rng.choice([0, 1, 3, nights if n % 10 == 0 else 2]))))
    got = availability.room_conflicts(
        spark.createDataFrame(stays, "reservation_id long, room_id long, start_date date, end_date date")
    )
    expected = set()
    for n, room, a, b in stays:
        others = [m for m, r, c, d in stays if m != n and r == room and c < b and d > a]
        if others:
            expected.add((n, room, len(others), min(others) if min(others) < n else max(others)))
    columns = ["reservation_id", "room_id", "conflicts", "conflicting_reservation_id"]
    assert {tuple(r) for r in got.select(*columns).collect()} == expected
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
