"""New guests from forms and edits of hotels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions.text import UNNAMED_GUEST, words
from lodgeframe.operators.booking import next_ids, node_number, used_numbers

DEFAULT_BIRTH_DATE = "2000-01-01"
EDITABLE = [
    "name",
    "address",
    "phone_number",
    "email",
    "check_in_time",
    "check_out_time",
    "location_coeff_room",
    "description",
]


def create_guests(forms: DataFrame, guests: DataFrame) -> DataFrame:
    """One row per form: a new guest with an id of its node past those of ``guests``, or status 400 without a phone.

    A full name fills in when both name parts are empty: its first word and, if there are several,
    its last. A full name of blanks gives the stock first name.
    """
    first, last = F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))
    parts = words(F.col("full_name"))
    from_full = (F.coalesce("full_name", F.lit("")) != "") & (first == "") & (last == "")
    phone_missing = F.coalesce("phone_number", F.lit("")) == ""
    named = forms.select(
        "form_id",
        "node",
        node_number(F.col("node")).alias("writer"),
        F.when(from_full, F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(UNNAMED_GUEST)))
        .otherwise(first)
        .alias("first_name"),
        F.when(from_full, F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-1))).otherwise(""))
        .otherwise(last)
        .alias("last_name"),
        "phone_number",
        F.coalesce("email", F.lit("")).alias("email"),
        F.coalesce("birth_date", F.lit(DEFAULT_BIRTH_DATE).cast("date")).alias("birth_date"),
        phone_missing.alias("rejected"),
    )
    accepted = next_ids(named.where("NOT rejected"), "form_id", "guest_id", used_numbers(guests))
    rejected = named.where("rejected").withColumn("guest_id", F.lit(None).cast("bigint"))
    return accepted.unionByName(rejected).select(
        "form_id",
        "node",
        F.when(F.col("rejected"), 400).otherwise(201).alias("status"),
        F.when(F.col("rejected"), "Phone number is required").alias("error"),
        "guest_id",
        "first_name",
        "last_name",
        "phone_number",
        "email",
        "birth_date",
    )


def update_hotels(hotels: DataFrame, changes: DataFrame, null_overwrites: bool = True) -> DataFrame:
    """Hotels after the last change of each; by default absent values overwrite too."""
    latest = changes.groupBy("hotel_id").agg(F.max_by(F.struct(*EDITABLE), "change_id").alias("new"))
    changed = F.col("new").isNotNull()

    def value(name: str):
        new = F.col(f"new.{name}")
        if not null_overwrites:
            new = F.coalesce(new, F.col(name))
        return F.when(changed, new).otherwise(F.col(name)).alias(name)

    return hotels.join(latest, F.col("id") == F.col("hotel_id"), "left").select(
        *[value(c) if c in EDITABLE else c for c in hotels.columns]
    )


def rejected_changes(hotels: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that name no known hotel."""
    known = hotels.select(F.col("id").alias("hotel_id"))
    return changes.join(known, "hotel_id", "left_anti").select(
        "change_id", "hotel_id", F.lit(404).alias("status"), F.lit("Hotel not found").alias("error")
    )
