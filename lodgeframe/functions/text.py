"""Small text and output-format expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

TEASER_LENGTH = 100
# Whitespace as the name rule understands it: Unicode spaces and the separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]+"
UNNAMED_GUEST = "Гость"


def teaser(text: Column, length: int = TEASER_LENGTH) -> Column:
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda word: word != "")


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def json_rows(df: DataFrame, time_columns: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per row: money as numbers, ISO dates, times of day as ``HH:mm``."""
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.name in time_columns:
            value = F.substring(value, 1, 5)
        elif isinstance(field.dataType, DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(value.alias(field.name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("value"))
