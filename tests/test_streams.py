"""Streams end in the state the batch operators give; replays change nothing."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from lodgeframe.operators import availability, booking, hotels, payments, replication
from lodgeframe.schemas import struct
from lodgeframe.sources.store import ChangeLog, read_table, write_by_node, write_json
from lodgeframe.streaming import feeds
from lodgeframe.streaming import requests as live


def _split(df, path, parts=3, column="seq"):
    """The same rows as several files, in arrival order."""
    for number in range(parts):
        df.where(F.col("part") == number).drop("part").coalesce(1).write.mode("append").parquet(path)


def _parts(df, order, parts=3):
    from pyspark.sql import Window

    return df.withColumn("part", F.ntile(parts).over(Window.orderBy(*order)) - 1)


def test_feed_reaches_the_batch_state(spark, data, tmp_path):
    source, out = str(tmp_path / "feed"), str(tmp_path / "log")
    feed = data.guest_feed
    _split(_parts(feed, ["seq"]), source)
    log = ChangeLog(spark, out, data.guest_changes.schema)
    stream = feeds.read_feed(spark, source, feed.schema, files_per_batch=1)
    feeds.follow_mesh([stream], log, str(tmp_path / "check")).awaitTermination()
    expected = {tuple(r) for r in replication.sync_tables([feed]).select(*data.guest_changes.columns).collect()}
    columns = data.guest_changes.columns
    assert {tuple(r) for r in log.current().select(*columns).collect()} == expected
    # A batch written again, or changes arriving twice, leave the state as it is.
    log.append(data.guest_changes, 0)
    log.append(data.guest_changes, 99)
    assert {tuple(r) for r in log.current().select(*columns).collect()} == expected
    compacted = log.compact(str(tmp_path / "compacted"))
    assert {tuple(r) for r in compacted.current().select(*columns).collect()} == expected


def test_applying_a_feed_twice_changes_nothing(spark, data):
    target = data.guests.select("id", "first_name", "bonus_points")
    changes = data.guest_changes.withColumn("bonus_points", F.col("value").cast("int"))
    once = replication.apply_changes(target, changes, ["bonus_points"])
    twice = replication.apply_changes(once, changes, ["bonus_points"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_rollup_stream_equals_batch_for_closed_windows(spark, data, tmp_path):
    source = str(tmp_path / "payments")
    rows = data.payment_requests.select(
        F.col("request_id").alias("payment_id"),
        F.concat(F.lit("filial"), 1 + F.col("request_id") % 3).alias("node"),
        F.col("requested_at").alias("ts"),
        "amount",
    )
    last = rows.agg(F.max("ts")).first()[0] + datetime.timedelta(days=1)
    closing = spark.createDataFrame([(-1, "filial1", last)], "payment_id long, node string, ts timestamp_ntz").select(
        "*", F.lit(0).cast("decimal(12,2)").alias("amount")
    )
    _split(_parts(rows.unionByName(rows.where("payment_id % 10 = 0")), ["ts", "payment_id"]), source)
    closing.coalesce(1).write.mode("append").parquet(source)
    stream = feeds.read_feed(spark, source, rows.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    feeds.write_rollup(feeds.rollup_stream(stream), out, str(tmp_path / "check")).awaitTermination()
    got = {(r.node, r.window_start, r.payments, r.total) for r in spark.read.parquet(out).collect()}
    batch = replication.payments_rollup(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got == {(r.node, r.window_start, r.payments, r.total) for r in batch.collect()}


def test_bookings_one_batch_at_a_time(spark, data, tmp_path):
    source, out = str(tmp_path / "asks"), str(tmp_path / "out")
    asks = data.booking_requests
    _split(_parts(asks, ["requested_at", "request_id"]), source)
    stays = availability.active_stays(data.reservations, data.details_reservations)
    routes = hotels.hotel_city_route(data.hotels, data.cities, data.city_nodes)
    tables = (data.hotels, data.cities, data.categories_room, routes, data.rooms, stays)
    stream = feeds.read_feed(spark, source, asks.schema, files_per_batch=1)
    live.book_stream(stream, *tables, out, str(tmp_path / "check")).awaitTermination()
    got = {(r.request_id, r.status, r.total_price) for r in spark.read.parquet(out).collect()}
    batch = booking.create_bookings(asks, *tables)
    assert got == {(r.request_id, r.status, r.total_price) for r in batch.collect()}


def test_bookings_go_on_after_a_restart_without_their_history(spark, data, tmp_path):
    """Stopped after each part and started again without stays on record: the state alone knows them."""
    source, check, out = (str(tmp_path / name) for name in ("asks", "check", "out"))
    asks = data.booking_requests
    stays = availability.active_stays(data.reservations, data.details_reservations)
    routes = hotels.hotel_city_route(data.hotels, data.cities, data.city_nodes)
    tables = (data.hotels, data.cities, data.categories_room, routes, data.rooms)
    for number, held in enumerate([stays, stays.limit(0), stays.limit(0)]):  # one micro-batch each
        _parts(asks, ["requested_at", "request_id"]).where(F.col("part") == number).drop("part").coalesce(1).write.mode(
            "append"
        ).parquet(source)
        stream = feeds.read_feed(spark, source, asks.schema)
        live.book_stream(stream, *tables, held, out, check).awaitTermination()
    got = spark.read.parquet(out).collect()
    batch = booking.create_bookings(asks, *tables, stays).select(*live.BOOKING_DECISION.fieldNames())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert {201, 409} <= {r.status for r in got}


def test_bookings_go_on_whatever_plan_the_stays_have(spark, tmp_path):
    """Stays joined from sides that are dealt otherwise: later batches and a restart plan them without their shuffles."""
    source, check, out = (str(tmp_path / name) for name in ("asks", "check", "out"))

    def rows(values, ddl):
        return spark.createDataFrame(values, ddl)

    def day(number):
        return datetime.date(2024, 1, 1) + datetime.timedelta(days=number)

    rng = random.Random(5)
    tables = (
        rows([(1, 1), (2, 1)], "id bigint, city_id bigint").withColumn("location_coeff_room", F.lit(None).cast("decimal(5,2)")),
        rows([(1,)], "id bigint"),
        rows([(1, 2), (2, 3)], "id bigint, guests_capacity int").withColumn("price_per_night", F.lit(10).cast("decimal(10,2)")),
        rows([(1, "filial1")], "hotel_id bigint, node string"),
        rows([(1, 1), (1, 1), (1, 2), (2, 2)], "hotel_id bigint, categories_room_id bigint"),
    )
    active = rows([(n, 1 + n % 2, day(3 * n), day(3 * n + 2)) for n in range(9)], "reservation_id bigint, hotel_id bigint, start_date date, end_date date")
    lines = rows([(n, 1 + n % 3 % 2) for n in range(9)], "reservation_id bigint, room_category_id bigint")
    stays = lines.repartition(7, "reservation_id").join(active.hint("merge"), "reservation_id")
    asks = []
    for n in range(90):
        start = rng.randrange(28)
        times = datetime.datetime(2023, 1, 1) + datetime.timedelta(hours=n)
        asks.append((n + 1, times, rng.choice([1, 1, 2, 7]), n + 1, rng.choice([1, 2]), day(start), day(start + rng.randrange(4)), n % 5, n // 30))
    asks = rows(
        asks,
        "request_id bigint, requested_at timestamp_ntz, hotel_id bigint, guest_id bigint, room_category_id bigint, "
        "start_date date, end_date date, total_guests int, part int",
    )
    for parts in ([0, 1], [2]):
        for number in parts:
            asks.where(F.col("part") == number).drop("part").coalesce(1).write.mode("append").parquet(source)
        stream = feeds.read_feed(spark, source, asks.drop("part").schema, files_per_batch=1)
        live.book_stream(stream, *tables, stays, out, check).awaitTermination()
    got = spark.read.parquet(out).collect()
    batch = booking.create_bookings(asks.drop("part"), *tables, stays).select(*live.BOOKING_DECISION.fieldNames())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert {201, 400, 404, 409} == {r.status for r in got}


class _Map(dict):
    """A state map in memory."""

    getValue, containsKey, updateValue = dict.__getitem__, dict.__contains__, dict.__setitem__


def test_day_counts_equal_sums():
    rng, nodes, events = random.Random(2), _Map(), []
    for _ in range(40):
        counts = live.DayCounts(nodes)
        for _ in range(5):
            day, starts, ends = rng.choice([-719_162, 2_932_896, *range(19_000, 19_200)]), rng.randrange(3), rng.randrange(3)
            counts.add(day, starts, ends)
            events.append((day, starts, ends))
        counts.save()
        limit = rng.choice([-719_163, 2_932_897, *range(18_990, 19_210)])
        fresh = live.DayCounts(nodes)
        assert fresh.before(limit, False) == sum(s for d, s, _ in events if d < limit)
        assert fresh.before(limit, True) == sum(e for d, _, e in events if d < limit)
        assert len(fresh.read) <= 6


def test_packed_trees_equal_trees_filled_day_by_day():
    """Many days of many hotels and categories at once, as one value for each."""
    rng = random.Random(4)
    days = [(rng.randrange(9), rng.randrange(3), rng.choice([-719_162, 2_932_896, *range(19_000, 19_400)]), rng.randrange(4), rng.randrange(4)) for _ in range(900)]
    kinds, packed = live.packed_trees(pd.DataFrame(days, columns=["hotel_id", "room_category_id", "day", "starts", "ends"]))
    assert sorted(map(tuple, kinds)) == sorted({d[:2] for d in days})
    for kind, nodes in zip(kinds, packed, strict=True):
        plain = live.DayCounts(_Map())
        for d in days:
            if d[:2] == tuple(kind):
                plain.add(*d[2:])
        plain.save()
        assert live._PackedNodes.opened(nodes) == plain.nodes
        assert live._PackedNodes.opened(live._PackedNodes.opened(nodes).packed()) == plain.nodes
    assert live._PackedNodes.opened(None) == {}


def test_payments_one_batch_at_a_time(spark, data, tmp_path):
    source, out = str(tmp_path / "asks"), str(tmp_path / "out")
    asks = data.payment_requests
    _split(_parts(asks, ["requested_at", "request_id"]), source)
    tables = (data.reservations, data.guests, data.loyalty_cards)
    stream = feeds.read_feed(spark, source, asks.schema, files_per_batch=1)
    live.pay_stream(stream, *tables, out, str(tmp_path / "check")).awaitTermination()
    columns = ["request_id", "status", "final_amount", "points_after", "card_after"]
    got = {tuple(r) for r in spark.read.parquet(out).select(*columns).collect()}
    batch = payments.process_payments(asks, *tables)
    assert got == {tuple(r) for r in batch.select(*columns).collect()}


def test_a_node_scan_reads_only_its_folder(spark, data, tmp_path):
    root = str(tmp_path)
    routes = hotels.hotel_city_route(data.hotels, data.cities, data.city_nodes)
    owned = replication.split_by_node(data.reservations, routes)
    write_by_node(owned, f"{root}/reservations", "overwrite")
    stored = read_table(spark, root, "reservations")
    scan = replication.node_scan(stored, "filial2")
    assert scan.count() == owned.where("node = 'filial2'").count()
    files = [r[0] for r in scan.select(F.input_file_name()).distinct().collect()]
    assert files and all("node=filial2" in name for name in files)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node" in plan


def test_json_rows(spark, data, tmp_path):
    path = str(tmp_path / "hotels.json")
    write_json(hotels.list_hotels(data.hotels, data.cities, data.categories_hotel), path, ("check_in_time",))
    row = spark.read.json(path).orderBy("id").first()
    assert (row.check_in_time, row.check_out_time, row.location_coeff_room) == ("14:00", "12:00:00", 1.0)


def test_struct_matches_ddl(spark):
    assert struct("a BIGINT NOT NULL, b STRING").simpleString() == "struct<a:bigint,b:string>"
