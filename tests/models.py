"""One-at-a-time models of the operators, and small random inputs for them."""

from __future__ import annotations

import datetime
import random

DAY0 = datetime.date(2024, 1, 1)


def day(n: int) -> datetime.date:
    return DAY0 + datetime.timedelta(days=n)


def random_stays(seed: int, count: int, rooms: int, horizon: int = 25, empty_share: float = 0.2):
    """(reservation_id, room_id, start, end); some stays have no night."""
    rng = random.Random(seed)
    out = []
    for number in range(1, count + 1):
        start = rng.randrange(horizon)
        length = 0 if rng.random() < empty_share else rng.randrange(1, 6)
        out.append((number, rng.randrange(1, rooms + 1), day(start), day(start + length)))
    return out


def overlap(start, end, first, last, closed=False):
    if closed:
        return start <= last and end >= first
    return not (end <= first or start >= last)


def book(requests, places, held):
    """Accepted request ids; requests are (id, key, start, end) in arrival order."""
    taken = {}
    for key, start, end in held:
        taken.setdefault(key, []).append((start, end))
    won = set()
    for number, key, start, end in requests:
        busy = sum(overlap(s, e, start, end) for s, e in taken.get(key, []))
        if busy < places.get(key, 0):
            taken.setdefault(key, []).append((start, end))
            won.add(number)
    return won


def assign(asked, rooms, held):
    """Room per (reservation, key) in order; rooms maps key to room ids, held is (room, start, end)."""
    taken = list(held)
    out = {}
    for number, key, start, end in asked:
        out[number, key] = None
        for room in sorted(rooms.get(key, [])):
            if not any(r == room and overlap(s, e, start, end, True) for r, s, e in taken):
                taken.append((room, start, end))
                out[number, key] = room
                break
    return out
