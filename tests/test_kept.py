"""Counts kept from feeds equal full counts after every micro-batch, whatever the order versions come in."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from lodgeframe.schemas import struct
from lodgeframe.sources import copies
from lodgeframe.sources.copies import SignedCounts
from lodgeframe.sources.store import files_under
from lodgeframe.streaming import feeds, kept

FEED = "table_name string, key long, seq long, ts timestamp_ntz, origin string, op string, "
T0 = datetime.datetime(2024, 1, 1)


def winners(changes):
    """The last version of each row among those that came so far."""
    last = {}
    for c in changes:
        if c[:2] not in last or (c[3], c[4], c[2]) > (last[c[:2]][3], last[c[:2]][4], last[c[:2]][2]):
            last[c[:2]] = c
    return [c for c in last.values() if c[5] != "D"]


def test_reservation_counts_follow_status_changes(spark, tmp_path):
    rng = random.Random(1)
    changes = [
        ("reservations", rng.randrange(60), n, T0 + datetime.timedelta(hours=n), "filial1", rng.choice("IUUUD"),
         rng.choice([1, 2, 3, None]), rng.choice(["pending", "confirmed", "cancelled"]))
        for n in range(400)
    ]
    rng.shuffle(changes)  # versions come out of order
    ddl = FEED + "hotel_id long, status string"
    counts = SignedCounts(spark, str(tmp_path / "counts"), ["hotel_id", "status"], buckets=4)
    for part in range(4):
        spark.createDataFrame(changes[100 * part : 100 * part + 100], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = feeds.read_feed(spark, str(tmp_path / "feed"), struct(ddl.upper().replace("LONG", "BIGINT")))
        signed = kept.signed_rows(stream, ["hotel_id", "status"])
        kept.keep_counts(signed, kept.by_columns("hotel_id", "status"), counts, str(tmp_path / "check")).awaitTermination()
        full = Counter((None if c[6] is None else str(c[6]), c[7]) for c in winners(changes[: 100 * part + 100]))
        assert {(r.hotel_id, r.status): r.n for r in counts.current().collect()} == full


def test_a_batch_counts_once_and_touches_its_own_buckets(spark, tmp_path):
    counts = SignedCounts(spark, str(tmp_path), ["k"], buckets=16)
    first = spark.createDataFrame([(str(k), 1) for k in range(40)] + [("0", 2), (None, 5)], "k string, n long")
    counts.add(first, 0)
    counts.add(first, 0)
    full = {**{str(k): 1 for k in range(40)}, "0": 3, None: 5}
    assert {r.k: r.n for r in counts.current().collect()} == full
    before = set(files_under(spark, f"{counts.root}/counts"))
    second = spark.createDataFrame([("7", -1), ("8", 4)], "k string, n long")
    assert counts.add(second, 1) in (1, 2)
    counts.add(second, 1)
    assert {r.k: r.n for r in counts.current().collect()} == {k: n + {"7": -1, "8": 4}.get(k, 0) for k, n in full.items() if k != "7"}
    assert len({f.split("/")[0] for f in set(files_under(spark, f"{counts.root}/counts")) ^ before}) <= 2
    counts.add(spark.createDataFrame([("7", 1)], "k string, n long"), 2)
    assert {r.k: r.n for r in counts.current().collect()}["7"] == 1
    assert counts.add(second.limit(0), 3) == 0


def test_key_rules_from_the_feed(spark, tmp_path):
    """Duplicates and orphans after every batch, with deletes of parents and of children."""
    rng = random.Random(7)
    unique, foreign = [("rooms", ["hotel_id", "room_number"])], [("rooms", "hotel_id", "hotels")]
    changes = []
    for n in range(300):
        table = rng.choice(["rooms", "rooms", "hotels"])
        hotel, number = (rng.choice([None, *range(8)]), rng.choice([None, "1", "2", "3"])) if table == "rooms" else (None, None)
        changes.append((table, rng.randrange(30 if table == "rooms" else 8), n, T0 + datetime.timedelta(hours=n), "c", rng.choice("IUUD"), hotel, number))
    ddl = FEED + "hotel_id long, room_number string"
    counts = SignedCounts(spark, str(tmp_path / "counts"), ["rule", "value"], buckets=4)
    for part in range(3):
        spark.createDataFrame(changes[100 * part : 100 * part + 100], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = feeds.read_feed(spark, str(tmp_path / "feed"), struct(ddl.upper().replace("LONG", "BIGINT")))
        signed = kept.signed_rows(stream, ["hotel_id", "room_number"])
        kept.keep_counts(signed, kept.key_uses(unique, foreign), counts, str(tmp_path / "check")).awaitTermination()
        rows = winners(changes[: 100 * part + 100])
        rooms, hotels = [c for c in rows if c[0] == "rooms"], {c[1] for c in rows if c[0] == "hotels"}
        uses = Counter(f"{c[6]}|{c[7]}" for c in rooms if None not in c[6:])
        got = kept.duplicates(counts.current()).collect()
        assert {r.key_value: r.rows_found for r in got} == {k: n for k, n in uses.items() if n > 1}
        lost = Counter(str(c[6]) for c in rooms if c[6] is not None and c[6] not in hotels)
        found = kept.orphans(counts.current(), foreign).select("value", F.col("rows_found")).collect()
        assert {r.value: r.rows_found for r in found} == lost


def test_versions_meet_the_same_rows_when_a_batch_comes_again(spark, tmp_path):
    """Late versions, deletes, absent keys and a repeated batch."""
    ddl = FEED + "hotel_id long"
    def batch(*rows):
        data = [("t", key, seq, T0 + datetime.timedelta(hours=hour), "c", op, hotel) for key, seq, hour, op, hotel in rows]
        return kept.signed_rows(spark.createDataFrame(data, ddl), ["hotel_id"])
    def signs(batch, number):
        return Counter((r.key, r.sign, r.hotel_id) for r in batch.of_batch(batch.feed, number, versions).collect())
    first = batch((1, 0, 0, "I", 5), (1, 1, 1, "U", 6), (2, 0, 3, "I", 5), (None, 0, 0, "I", 7))
    versions = copies.RowVersions(spark, str(tmp_path), first.feed.schema["version"].dataType, buckets=4)
    second = batch((1, 2, 2, "D", 6), (2, 9, 2, "U", 8), (3, 0, 0, "D", 1), (None, 1, 1, "U", None))
    made = {("1", 1, "6"): 1, ("2", 1, "5"): 1, (None, 1, "7"): 1}
    told = {("1", -1, "6"): 1, (None, -1, "7"): 1, (None, 1, None): 1}
    assert signs(first, 0) == made and signs(first, 0) == made
    assert signs(second, 1) == told and signs(second, 1) == told
    assert signs(batch((2, 10, 4, "U", 4)), 2) == {("2", -1, "5"): 1, ("2", 1, "4"): 1}
    assert signs(batch((1, 3, 5, "I", 3)), 3) == {("1", 1, "3"): 1}
