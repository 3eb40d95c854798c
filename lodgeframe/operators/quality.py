"""Integrity rules as jobs that return what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.schemas import (
    DOMAIN_CHECKS,
    FOREIGN_KEYS,
    PARTIAL_UNIQUE_KEYS,
    PAYMENT_METHODS,
    TEXT_WIDTHS,
    UNIQUE_KEYS,
    key_column,
    schema,
)

DATE_FORMAT = "yyyy-MM-dd"
BAD_FORMAT = "Invalid date format. Use YYYY-MM-DD"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _demand(tables: dict[str, DataFrame], names) -> None:
    """A rule without its table would pass unnoticed, so a missing table is an error."""
    missing = sorted(set(names) - set(tables))
    if missing:
        raise ValueError(f"tables to check are missing: {', '.join(missing)}")


def _far(rules: list[tuple[str, str, str]], table: str, passed: tuple[str, ...] = ()) -> int:
    """How many references lead from a table to one without any, at most; the farther, the larger it tends to be."""
    parents = {parent for child, _, parent in rules if child == table} - {table, *passed}
    return max((1 + _far(rules, parent, (*passed, table)) for parent in parents), default=0)


def broken_references(tables: dict[str, DataFrame], rules: list[tuple[str, str, str]] = FOREIGN_KEYS) -> DataFrame:
    """Child rows whose non-null key has no parent.

    A child is read once for all its rules. Its rows meet the lookup tables first, then what refers to those only, then
    the rest: keys of tables that Spark broadcasts never travel, and the others travel once, with their rule's number.
    """
    _demand(tables, [name for child, _, parent in rules for name in (child, parent)])
    parts = []
    for child in dict.fromkeys(rule[0] for rule in rules):
        own = [(column, parent) for owner, column, parent in rules if owner == child]
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(c).cast("bigint").alias("value")) for n, (c, _) in enumerate(own)])
        left = tables[child].select(F.col(key_column(child)).alias("row_key"), F.explode(pairs).alias("p")).select("p.*", "row_key")
        left = left.where("value IS NOT NULL")
        known: dict[int, list[DataFrame]] = {}
        for number, (_, parent) in enumerate(own):
            ids = tables[parent].select(F.lit(number).alias("rule"), F.col("id").cast("bigint").alias("value"))
            known.setdefault(min(_far(rules, parent), 2), []).append(ids)
        for far in sorted(known):
            left = left.join(_union(known[far]), ["rule", "value"], "left_anti")
        names = F.array(*[F.lit(column) for column, _ in own])
        parts.append(
            left.select(F.lit(child).alias("table_name"), F.element_at(names, F.col("rule") + 1).alias("column_name"), "row_key", "value")
        )
    return _union(parts)


def duplicate_keys(tables: dict[str, DataFrame], rules: list[tuple[str, list[str]]] = UNIQUE_KEYS) -> DataFrame:
    """Key values used by more than one row; keys with an absent part never collide.

    All keys of a table are read in one pass. A key travels as its rule's number and one text, so that unlike keys
    share the shuffle and the groups, most of which hold one row, stay small. The text of several parts begins
    with their lengths, which tells ``a|b, c`` from ``a, b|c``.
    """
    _demand(tables, [table for table, _ in rules])
    parts = []
    for table in dict.fromkeys(rule[0] for rule in rules):
        keys = []
        for owner, columns in rules:
            if owner == table:
                whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
                values = [F.col(c).cast("string") for c in columns]
                text = F.concat_ws("|", *values)
                if len(columns) > 1:
                    text = F.concat_ws("|", F.concat_ws(",", *[F.length(v) for v in values[:-1]]), text)
                number = rules.index((owner, columns))
                keys.append(F.when(whole, F.struct(F.lit(number).alias("rule"), text.alias("key"))))
        parts.append(tables[table].select(F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.*"))
    named = F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"), F.lit(len(columns) > 1).alias("lengths"))
        for table, columns in rules
    ])
    return (
        _union(parts)
        .groupBy("rule", "key")
        .agg(F.count("*").alias("rows_found"))
        .where("rows_found > 1")
        .select(F.element_at(named, F.col("rule") + 1).alias("of"), "key", "rows_found")
        .select(
            "of.table_name",
            "of.key_columns",
            F.when(F.col("of.lengths"), F.expr("substring(key, instr(key, '|') + 1)")).otherwise(F.col("key")).alias("key_value"),
            "rows_found",
        )
    )


def duplicate_present_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """The same for keys that must be unique only where present."""
    return duplicate_keys(tables, PARTIAL_UNIQUE_KEYS)


def _violations(df: DataFrame, table: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One output row per row and broken rule, from a single pass over the table."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]))
    return df.select(
        F.lit(table).alias("table_name"), F.col(key_column(table)).alias("row_key"), F.explode(broken).alias("rule")
    )


def broken_domains(tables: dict[str, DataFrame], rules: list[tuple[str, str, str]] = DOMAIN_CHECKS) -> DataFrame:
    """Rows that make a value rule false; an unknown outcome passes."""
    _demand(tables, [table for table, _, _ in rules])
    parts = []
    for table, df in tables.items():
        own = [(name, F.expr(f"NOT ({condition})")) for owner, name, condition in rules if owner == table]
        if own:
            parts.append(_violations(df, table, own))
    return _union(parts)


def bad_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Absent values in mandatory columns and texts wider than their column, in each table given."""
    parts = []
    for table, df in tables.items():
        rules = [
            (f"{field.name} is missing", F.col(field.name).isNull())
            for field in schema(table).fields
            if not field.nullable
        ]
        rules += [(f"{name} is too long", F.length(name) > width) for name, width in TEXT_WIDTHS.get(table, {}).items()]
        parts.append(_violations(df, table, rules))
    return _union(parts)


def check_requests(raw: DataFrame) -> DataFrame:
    """``status`` and ``error`` for raw text requests: dates, amount and method.

    Needs ``request_id, start_date, end_date, amount, method`` as text.
    """
    start, end = F.try_to_date("start_date", DATE_FORMAT), F.try_to_date("end_date", DATE_FORMAT)
    amount = F.expr("try_cast(amount AS DECIMAL(12,2))")
    absent = F.array_join(
        F.array_compact(
            F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("start_date", "end_date", "amount")])
        ),
        ", ",
    )
    steps = [
        (absent != "", F.concat(F.lit("Missing required fields: "), absent)),
        (start.isNull() | end.isNull(), F.lit(BAD_FORMAT)),
        (start >= end, F.lit("End date must be after start date")),
        (amount.isNull(), F.lit("Amount is not a number")),
        (amount <= 0, F.lit("Amount must be greater than zero")),
        (~F.coalesce(F.col("method").isin(PAYMENT_METHODS), F.lit(False)), F.lit("Unknown payment method")),
    ]
    error = F.coalesce(*[F.when(condition, text) for condition, text in steps])
    return raw.select(
        "request_id",
        F.when(error.isNull(), 200).otherwise(400).alias("status"),
        error.alias("error"),
        start.alias("start_date"),
        end.alias("end_date"),
        amount.cast(pricing.MONEY).alias("amount"),
    )
