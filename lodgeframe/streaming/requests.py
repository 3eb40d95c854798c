"""Booking and payment requests decided as they arrive.

Bookings: the state store keeps, per hotel and category, how many stays start and end on each day, in
a tree of day blocks; no batch reads stays or decisions of earlier ones.
Payments: points, card and paid reservations are kept per payer in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from lodgeframe.functions.intervals import boundary_marks, per_day
from lodgeframe.operators.availability import CATEGORY_KEY, DATES
from lodgeframe.operators.booking import answers, check_bookings, day_number, with_places
from lodgeframe.operators.payments import card_ladder, look_up_payments, settle_payment, start_account
from lodgeframe.schemas import struct

BOOKING_DECISION = struct(
    "request_id BIGINT, requested_at TIMESTAMP_NTZ, hotel_id BIGINT, guest_id BIGINT, room_category_id BIGINT, "
    "start_date DATE, end_date DATE, total_guests INT, node STRING, status INT, error STRING, "
    "total_price DECIMAL(12,2)"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FAN_BITS = 4
_LEVELS = 6
# Days are counted from here, so that the tree's 2 ** 24 days reach from long before the year 1 to long after 9999.
_DAY_ZERO = 1 << 23
# A node as it is saved: its level and block, then its counts.
_NODE_NUMBERS = 2 + (2 << _FAN_BITS)
# Hotels and categories are held in so many groups of the state store: fixed, as the state is found by it again.
STATE_GROUPS = 4096


class DayCounts:
    """How many stays start and end before a day, from a tree of day blocks kept in a state map.

    A node covers sixteen blocks of one size and holds their counts of starts and of ends. A count up
    to a day reads one node of each of six sizes, and a stay changes six nodes for its start and six
    for its end, however many stays and days there are. Nodes read in a batch are remembered and
    written once, by :meth:`save`.
    """

    def __init__(self, nodes):
        self.nodes = nodes
        self.read: dict[tuple[int, int], list[int]] = {}
        self.changed: set[tuple[int, int]] = set()

    def _node(self, level: int, block: int) -> list[int]:
        key = level, block
        if key not in self.read:
            self.read[key] = list(self.nodes.getValue(key)[0]) if self.nodes.containsKey(key) else [0] * (2 << _FAN_BITS)
        return self.read[key]

    def add(self, day: int, starts: int, ends: int) -> None:
        at = day + _DAY_ZERO
        for level in range(_LEVELS):
            slot, at = at & (1 << _FAN_BITS) - 1, at >> _FAN_BITS
            node = self._node(level, at)
            node[slot] += starts
            node[slot + (1 << _FAN_BITS)] += ends
            self.changed.add((level, at))

    def before(self, day: int, ends: bool) -> int:
        """Starts, or ends, on all days before that one."""
        at, found, shift = day + _DAY_ZERO, 0, (1 << _FAN_BITS) * ends
        for level in range(_LEVELS):
            slot, at = at & (1 << _FAN_BITS) - 1, at >> _FAN_BITS
            found += sum(self._node(level, at)[shift : shift + slot])
        return found

    def save(self) -> None:
        for key in self.changed:
            self.nodes.updateValue(key, (self.read[key],))
        self.changed.clear()


_ASKED = (
    "request_id bigint, requested_at timestamp_ntz, hotel_id bigint, room_category_id bigint, first_day bigint, "
    "last_day bigint, places bigint, carried string"
)


class _PackedNodes(dict):
    """A key's tree of day blocks as one value of a state map."""

    getValue, containsKey, updateValue = dict.__getitem__, dict.__contains__, dict.__setitem__

    @classmethod
    def opened(cls, packed: bytes | None) -> _PackedNodes:
        nodes = cls()
        for level, block, *counts in np.frombuffer(packed or b"", dtype="<i8").reshape(-1, _NODE_NUMBERS).tolist():
            nodes[level, block] = (counts,)
        return nodes

    def packed(self) -> bytes:
        return np.array([[*key, *counts] for key, (counts,) in self.items()], dtype="<i8").tobytes()


def packed_trees(days: pd.DataFrame) -> tuple[list[list[int]], list[bytes]]:
    """The hotels and categories of ``hotel_id, room_category_id, day, starts, ends`` rows, and the nodes of their trees."""
    kinds, of_kind = np.unique(days[CATEGORY_KEY].to_numpy("i8"), axis=0, return_inverse=True)
    at, fan = days["day"].to_numpy("i8") + _DAY_ZERO, 1 << _FAN_BITS
    names, slots = [], []
    for level in range(_LEVELS):
        slots.append(at & fan - 1)
        at = at >> _FAN_BITS
        names.append(np.stack([of_kind.ravel(), np.full_like(at, level), at], axis=1))
    nodes, of_node = np.unique(np.concatenate(names), axis=0, return_inverse=True)
    counts, slot = np.zeros((len(nodes), 2 * fan), "i8"), np.concatenate(slots)
    np.add.at(counts, (of_node.ravel(), slot), np.tile(days["starts"].to_numpy("i8"), _LEVELS))
    np.add.at(counts, (of_node.ravel(), slot + fan), np.tile(days["ends"].to_numpy("i8"), _LEVELS))
    rows = np.concatenate([nodes[:, 1:], counts], axis=1).astype("<i8")
    parts = np.split(rows, np.searchsorted(nodes[:, 0], np.arange(1, len(kinds))))
    return kinds.tolist(), [part.tobytes() for part in parts]


class KeptCounts(StatefulProcessor):
    """Accepts requests in order while the stays of their hotel and category leave a room, and counts those accepted.

    The state is grouped by :data:`STATE_GROUPS`; a group's map has the tree of each hotel and category as one value,
    bounded by the calendar, so that a hotel and category costs a batch one read and one write.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trees = handle.getMapState("day_counts", "hotel_id bigint, room_category_id bigint", "nodes binary")

    def _counts(self, kind: tuple[int, int]) -> DayCounts:
        held = self.trees.getValue(kind)
        return DayCounts(_PackedNodes.opened(None if held is None else bytes(held[0])))

    def _save(self, every: dict[tuple[int, int], DayCounts]) -> None:
        for kind, counts in every.items():
            if counts.changed:
                counts.save()
                self.trees.updateValue(kind, (counts.nodes.packed(),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        kinds, nodes = packed_trees(initialState)
        for (hotel, category), packed in zip(kinds, nodes, strict=True):
            held = self.trees.getValue((hotel, category))
            if held is None:
                self.trees.updateValue((hotel, category), (packed,))
            else:  # a group that comes in several parts
                own = (initialState["hotel_id"] == hotel) & (initialState["room_category_id"] == category)
                counts = DayCounts(_PackedNodes.opened(bytes(held[0])))
                for row in initialState[own].itertuples(index=False):
                    counts.add(row.day, row.starts, row.ends)
                self._save({(hotel, category): counts})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["requested_at", "request_id"])
        every: dict[tuple[int, int], DayCounts] = {}
        accepted = []
        for row in asked.itertuples(index=False):
            kind = row.hotel_id, row.room_category_id
            if kind not in every:
                every[kind] = self._counts(kind)
            counts = every[kind]
            taken = counts.before(row.last_day, ends=False) - counts.before(row.first_day + 1, ends=True)
            accepted.append(taken < row.places)
            if accepted[-1]:
                counts.add(row.first_day, 1, 0)
                counts.add(row.last_day, 0, 1)
        self._save(every)
        yield asked.drop(columns="state_group").assign(accepted=accepted)

    def close(self) -> None:
        pass


def booking_decisions(
    requests: DataFrame,
    hotels: DataFrame,
    cities: DataFrame,
    categories_room: DataFrame,
    routes: DataFrame,
    rooms: DataFrame,
    stays: DataFrame,
) -> DataFrame:
    """The columns of ``BOOKING_DECISION`` for a stream of requests.

    ``stays`` are counted into the state once, when the stream first starts. A stay overlaps a window
    unless it starts at or after the window's end or ended by its start, so two counts answer a
    request. Requests must arrive in time order from batch to batch; within a batch they are put in
    order. A batch's requests of one group of hotels and categories are held by one task.
    """
    columns = ["request_id", "requested_at", "hotel_id", "guest_id", "room_category_id", *DATES, "total_guests"]
    checked = check_bookings(requests.select(*columns), hotels, cities, categories_room, routes)
    carried = [c for c in checked.columns if c not in ("request_id", "requested_at", *CATEGORY_KEY)]
    kinds = dict(checked.dtypes)
    # Values that only pass through travel as one text, so that no pandas type changes them.
    asked = with_places(checked.where("status = 0"), rooms).select(
        "request_id",
        "requested_at",
        *CATEGORY_KEY,
        day_number("start_date").alias("first_day"),
        day_number("end_date").alias("last_day"),
        F.col("places").cast("bigint").alias("places"),
        F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in carried])).alias("carried"),
    )
    known = per_day(boundary_marks(stays.select(*CATEGORY_KEY, *DATES), CATEGORY_KEY), CATEGORY_KEY).select(
        *CATEGORY_KEY, day_number("day").alias("day"), F.col("starts").cast("bigint"), F.col("ends").cast("bigint")
    )
    # Calls of the state store go by group; a call per hotel and category took most of the time.
    group = F.pmod(F.xxhash64(*CATEGORY_KEY), F.lit(STATE_GROUPS)).alias("state_group")
    # After the first batch Spark looks at the plan of the initial state without having put shuffles into it, and then
    # refuses a join whose sides are dealt otherwise. It does not look below a shuffle, and the state needs this one anyway.
    counted = known.dropna(subset=CATEGORY_KEY).select("*", group).repartition("state_group")
    decided = asked.select("*", group).groupBy("state_group").transformWithStateInPandas(
        statefulProcessor=KeptCounts(),
        outputStructType=f"{_ASKED}, accepted boolean",
        outputMode="append",
        timeMode="none",
        initialState=counted.groupBy("state_group"),
    )
    passed = F.from_json("carried", ", ".join(f"{c} string" for c in carried))
    taken = decided.select(
        "request_id",
        "requested_at",
        *CATEGORY_KEY,
        *[passed[c].cast(kinds[c]).alias(c) for c in carried],
        "accepted",
    )
    refused = checked.where("status <> 0").withColumn("accepted", F.lit(None).cast("boolean"))
    every = answers(taken.unionByName(refused), columns)
    return every.select(*[F.col(f.name).cast(f.dataType) for f in BOOKING_DECISION.fields])


def book_stream(
    requests: DataFrame,
    hotels: DataFrame,
    cities: DataFrame,
    categories_room: DataFrame,
    routes: DataFrame,
    rooms: DataFrame,
    stays: DataFrame,
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Writes the decisions to ``out``; started again on its checkpoint it goes on where it ended."""
    decided = booking_decisions(requests, hotels, cities, categories_room, routes, rooms, stays)
    # The tables may belong to another session than the stream.
    decided.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        decided.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_ACCOUNT = "points BIGINT, card BIGINT, paid ARRAY<BIGINT>"
_ANSWER = (
    "request_id BIGINT, requested_at TIMESTAMP_NTZ, reservation_id BIGINT, payer_id BIGINT, method STRING, "
    "status INT, error STRING, cents BIGINT, earned BIGINT, points BIGINT, card BIGINT"
)


def _settle_micro_batch(open_account: Callable):
    """Settles a payer's payments of one micro-batch, in order, on top of the account kept in the state."""

    def settle(_key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["requested_at", "request_id"])
        first = next(rows.itertuples(index=False))
        points, card, ladder = open_account(first)
        paid: set[int] = set()
        if state.exists:
            points, kept, numbers = state.get
            card, paid = (None if kept < 0 else kept), set(numbers)
        account = [points, card, ladder]
        answers = []
        for row in rows.itertuples(index=False):
            given = (row.request_id, row.requested_at, row.reservation_id, row.payer_id, row.method)
            if row.status:
                answers.append((*given, row.status, row.error, None, None, None, None))
            elif row.reservation_id in paid:
                answers.append((*given, 400, "Reservation already paid", None, None, None, None))
            else:
                paid.add(row.reservation_id)
                answers.append((*given, 200, None, *settle_payment(account, row)[2:]))
        state.update((account[0], -1 if account[1] is None else account[1], sorted(paid)))
        names = [part.split()[0] for part in _ANSWER.split(", ")]
        out = pd.DataFrame(answers, columns=names)
        counts = ["cents", "earned", "points", "card"]
        yield out.astype(dict.fromkeys(counts, "Int64"))

    return settle


def settled_payments(requests: DataFrame, reservations: DataFrame, guests: DataFrame, cards: DataFrame) -> DataFrame:
    """Payment outcomes of a stream of requests; accounts live in the state store, one per payer.

    The state holds a payer's points, card and the reservations paid on this stream. Requests must
    arrive in time order from batch to batch; within a batch they are put in order. Requests
    without a payer's account are answered without state.
    """
    settle = _settle_micro_batch(start_account(card_ladder(cards)))
    accounts = guests.select(
        F.col("id").alias("payer_id"),
        F.coalesce("bonus_points", F.lit(0)).cast("bigint").alias("bonus_points"),
        F.coalesce("loyalty_card_id", F.lit(-1)).cast("bigint").alias("loyalty_card_id"),
    )
    checked = look_up_payments(requests, reservations).withColumn("cents", (F.col("amount") * 100).cast("bigint"))
    looked_up = checked.join(accounts, "payer_id", "left")
    owned = looked_up.where("bonus_points IS NOT NULL")
    settled = owned.groupBy("payer_id").applyInPandasWithState(
        settle, _ANSWER, _ACCOUNT, "append", GroupStateTimeout.NoTimeout
    )
    unsettled = F.col("status") == 0
    unowned = looked_up.where("bonus_points IS NULL").select(
        "request_id",
        "requested_at",
        "reservation_id",
        "payer_id",
        "method",
        F.when(unsettled, 404).otherwise(F.col("status")).alias("status"),
        F.when(unsettled, "Reservation not found").otherwise(F.col("error")).alias("error"),
        *[F.lit(None).cast("bigint").alias(name) for name in ("cents", "earned", "points", "card")],
    )
    return settled.union(unowned).select(
        "request_id",
        "requested_at",
        "reservation_id",
        "payer_id",
        "method",
        "status",
        "error",
        (F.col("cents") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").alias("final_amount"),
        F.col("earned").alias("bonus_points_added"),
        F.col("points").alias("points_after"),
        F.nullif("card", F.lit(-1)).alias("card_after"),
    )


def pay_stream(
    requests: DataFrame,
    reservations: DataFrame,
    guests: DataFrame,
    cards: DataFrame,
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    return (
        settled_payments(requests, reservations, guests, cards)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
