"""Who is busy on some stretch of days: a dyadic tree over days with sets of members as integers."""

from __future__ import annotations

from collections.abc import Iterator

# Blocks of up to 2**TOP cells have a parent; longer stretches are runs of the largest blocks.
TOP = 14


class DayBits:
    """Members that are busy on stretches of cells, such as rooms on days.

    A stretch is cut into at most two aligned blocks of each size. ``whole`` has the members busy on
    all of a block by one stretch, ``part`` those busy on some smaller block inside it. Sets are
    integers with a bit per member, so adding a stretch and asking for one both take a number of set
    operations that grows with the logarithm of the stretch, and the lowest member is the lowest bit.
    """

    def __init__(self):
        self.whole: list[dict[int, int]] = [{} for _ in range(TOP + 1)]
        self.part: list[dict[int, int]] = [{} for _ in range(TOP + 1)]

    @staticmethod
    def _blocks(first: int, end: int) -> Iterator[tuple[int, int]]:
        """The aligned blocks (size exponent, number) that make up the cells first .. end - 1."""
        for level in range(TOP):
            if first >= end:
                return
            if first & 1:
                yield level, first
                first += 1
            if end & 1:
                end -= 1
                yield level, end
            first, end = first >> 1, end >> 1
        for block in range(first, end):
            yield TOP, block

    def add(self, member: int, first: int, end: int) -> None:
        bit = 1 << member
        for level, block in self._blocks(first, end):
            self.whole[level][block] = self.whole[level].get(block, 0) | bit
            for above in range(level + 1, TOP + 1):
                block >>= 1
                held = self.part[above].get(block, 0)
                if held & bit:
                    break
                self.part[above][block] = held | bit

    def remove(self, member: int, first: int, end: int) -> None:
        """Takes back a stretch, which must be the member's only one."""
        bit = 1 << member
        blocks = list(self._blocks(first, end))
        for level, block in blocks:
            self.whole[level][block] &= ~bit
        for level, block in blocks:
            for above in range(level + 1, TOP + 1):
                below = above - 1
                block >>= 1
                children = 0
                for child in (2 * block, 2 * block + 1):
                    children |= self.whole[below].get(child, 0) | self.part[below].get(child, 0)
                if children & bit:
                    break
                self.part[above][block] &= ~bit

    def busy(self, first: int, end: int) -> int:
        """The members busy on at least one of the cells first .. end - 1."""
        found = 0
        if first < end:
            for level, block in self._blocks(first, end):
                found |= self.whole[level].get(block, 0) | self.part[level].get(block, 0)
            for level in range(TOP + 1):
                found |= self.whole[level].get(first >> level, 0) | self.whole[level].get((end - 1) >> level, 0)
        return found


def lowest(members: int) -> int:
    return (members & -members).bit_length() - 1


def each(members: int) -> Iterator[int]:
    while members:
        yield lowest(members)
        members &= members - 1


class RoomCalendar:
    """One room's stays under the half-open rule ``start < other.end and end > other.start``, a member for each stay.

    Days are even cells and nights the odd cells between them. A stay fills the cells strictly between
    its ends, a stay without a night the cell of its day. Stays that end before they start clash with
    windows around them only and are kept apart.
    """

    def __init__(self):
        self.nights, self.days = DayBits(), DayBits()
        self.backward: dict[int, tuple[int, int]] = {}

    def _place(self, first: int, last: int) -> tuple[DayBits, int, int]:
        if first == last:
            return self.days, 2 * first, 2 * first + 1
        return self.nights, 2 * first + 1, 2 * last

    def hold(self, member: int, first: int, last: int) -> None:
        if last < first:
            self.backward[member] = first, last
        else:
            tree, start, end = self._place(first, last)
            tree.add(member, start, end)

    def release(self, member: int, first: int, last: int) -> None:
        if last < first:
            del self.backward[member]
        else:
            tree, start, end = self._place(first, last)
            tree.remove(member, start, end)

    def clashes(self, first: int, last: int) -> int:
        """The members whose stays clash with the window."""
        if last < first:
            return self.nights.busy(2 * first, 2 * first + 1) & self.nights.busy(2 * last, 2 * last + 1)
        if first == last:
            return self.nights.busy(2 * first, 2 * first + 1)
        found = self.nights.busy(2 * first + 1, 2 * last) | self.days.busy(2 * first + 1, 2 * last)
        for member, (start, end) in self.backward.items():
            if start < last and end > first:
                found |= 1 << member
        return found
