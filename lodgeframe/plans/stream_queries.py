"""Queries answered from counts that a stream keeps current, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.operators import reservations
from lodgeframe.plans.domain_sql import over
from lodgeframe.plans.read_queries import ORACLES as READ_SQL
from lodgeframe.schemas import ACTIVE
from lodgeframe.session import shared_folder
from lodgeframe.sources.copies import SignedCounts
from lodgeframe.sources.projection import HotelData
from lodgeframe.streaming import feeds, kept

PARTS = 2
# What the requests are held against as they come in.
REQUEST_KEYS = [("booking_requests", ["hotel_id", "room_category_id", "start_date"])]
REQUEST_PARENTS = [
    ("booking_requests", "hotel_id", "hotels"),
    ("booking_requests", "room_category_id", "categories_room"),
]


def _followed(spark: SparkSession, feed: DataFrame, part, columns: list[str], counted, keys: list[str]) -> DataFrame:
    """Counts after the feed came in parts, each a micro-batch of a stream that goes on where it ended."""
    base = f"{shared_folder(spark).rstrip('/')}/lodgeframe-kept-{uuid.uuid4().hex}"
    counts = SignedCounts(spark, f"{base}/counts", keys)
    for number in range(PARTS):
        feed.where(part == number).write.mode("append").parquet(f"{base}/feed")
        stream = feeds.read_feed(spark, f"{base}/feed", feed.schema, files_per_batch=10_000)
        signed = kept.signed_rows(stream, columns)
        kept.keep_counts(signed, counted, counts, f"{base}/state").awaitTermination()
    return counts.current()


def _version(table: str, key: str, step: int, op: str, moment: str, *values: str) -> list:
    given = [F.expr(v) for v in values]
    return [
        F.lit(table).alias("table_name"), F.col(key).alias("key"), F.lit(step).alias("seq"),
        F.expr(moment).cast("timestamp_ntz").alias("ts"), F.lit("central").alias("origin"), F.lit(op).alias("op"), *given,
    ]


def kept_reservation_counts(spark, path):
    """Reservations are made pending, get their status later, and some cancelled ones go; half of it comes the wrong way round."""
    d = HotelData(spark, path)
    made = d.reservations.select(*_version("reservations", "id", 0, "I", "create_date", "hotel_id", "'pending' AS status"))
    told = d.reservations.select(*_version("reservations", "id", 1, "U", "create_date + INTERVAL 10 DAYS", "hotel_id", "status"))
    gone = d.reservations.where("status = 'cancelled' AND id % 7 = 0").select(
        *_version("reservations", "id", 2, "D", "create_date + INTERVAL 30 DAYS", "hotel_id", "status")
    )
    feed = made.union(told).union(gone)
    part = (F.col("key") + F.col("seq")) % PARTS
    counts = _followed(spark, feed, part, ["hotel_id", "status"], kept.by_columns("hotel_id", "status"), ["hotel_id", "status"])
    active = counts.where(F.col("status").isin(ACTIVE)).groupBy(F.col("hotel_id").cast("bigint").alias("hotel_id"))
    return reservations.counts_per_city(d.cities, d.hotels, active.agg(F.sum("n").alias("n")))


def kept_key_rules(spark, path):
    """Requests that share a hotel, category and first day, and those whose hotel or category is not there (any more)."""
    d = HotelData(spark, path)
    columns = ["hotel_id", "room_category_id", "start_date"]
    none = [f"CAST(NULL AS STRING) AS {c}" for c in columns]
    asked = d.booking_requests.select(
        *_version("booking_requests", "request_id", 0, "I", "requested_at", *[f"CAST({c} AS STRING) AS {c}" for c in columns])
    )
    feed = asked
    for table in ("hotels", "categories_room"):
        feed = feed.union(getattr(d, table).select(*_version(table, "id", 0, "I", "TIMESTAMP_NTZ'1990-01-01 00:00:00'", *none)))
    closed = d.hotels.where("id % 10 = 0").select(*_version("hotels", "id", 1, "D", "TIMESTAMP_NTZ'2024-01-01 00:00:00'", *none))
    counted = kept.key_uses(REQUEST_KEYS, REQUEST_PARENTS)
    counts = _followed(spark, feed.union(closed), F.pmod("key", F.lit(PARTS)), columns, counted, ["rule", "value"])
    twice = kept.duplicates(counts).select(F.lit("duplicate").alias("fault"), "key_columns", F.col("key_value").alias("value"), "rows_found")
    lost = kept.orphans(counts, REQUEST_PARENTS).select(F.lit("orphan").alias("fault"), "column_name", "value", "rows_found")
    return twice.union(lost)


QUERIES = {"r16_kept_reservation_counts": kept_reservation_counts, "q02_kept_key_rules": kept_key_rules}

ORACLES = {
    "r16_kept_reservation_counts": READ_SQL["r16_cities_reservation_counts"],
    "q02_kept_key_rules": over(
        "booking_requests hotels categories_room",
        """SELECT 'duplicate' AS fault, 'hotel_id,room_category_id,start_date' AS key_columns,
                  hotel_id || '|' || room_category_id || '|' || start_date AS value, count(*) AS rows_found
           FROM booking_requests WHERE hotel_id IS NOT NULL AND room_category_id IS NOT NULL AND start_date IS NOT NULL
           GROUP BY hotel_id, room_category_id, start_date HAVING count(*) > 1
           UNION ALL
           SELECT 'orphan', 'hotel_id', CAST(hotel_id AS VARCHAR), count(*) FROM booking_requests
           WHERE hotel_id NOT IN (SELECT id FROM hotels WHERE id % 10 <> 0) GROUP BY hotel_id
           UNION ALL
           SELECT 'orphan', 'room_category_id', CAST(room_category_id AS VARCHAR), count(*) FROM booking_requests
           WHERE room_category_id NOT IN (SELECT id FROM categories_room) GROUP BY room_category_id""",
    ),
}
