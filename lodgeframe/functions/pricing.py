"""Prices, discounts, tiers and points as column expressions, decimal from end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the price rules.
EXTRA_GUEST_SHARE = "0.2"
FALLBACK_PER_NIGHT = 1000
MONEY = "decimal(12,2)"


def nights(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def coeff_or_one(coeff: Column) -> Column:
    """A missing or zero coefficient counts as one."""
    return F.coalesce(F.nullif(coeff, F.lit(0)), F.lit(1).cast("decimal(5,2)"))


def rounded(amount: Column) -> Column:
    """Half-even to cents."""
    return F.bround(amount, 2).cast(MONEY)


def stay_price(price: Column, coeff: Column, night_count: Column) -> Column:
    return rounded(price * coeff * night_count.cast("decimal(6,0)"))


def booking_price(price: Column, coeff: Column, capacity: Column, guests: Column, night_count: Column) -> Column:
    """Price of a booking with 20 % on top per guest over the capacity.

    Without a price (unknown hotel or category) a night costs a fixed amount.
    """
    extra = F.greatest(guests - capacity, F.lit(0)).cast("decimal(6,0)")
    base = price * coeff_or_one(coeff) * night_count.cast("decimal(6,0)")
    fallback = (night_count * FALLBACK_PER_NIGHT).cast(MONEY)
    return F.coalesce(rounded(base * (F.lit(1) + F.lit(EXTRA_GUEST_SHARE).cast("decimal(2,1)") * extra)), fallback)


def discounted(amount: Column, bonus_points: Column, required: Column, discount: Column) -> Column:
    """Amount after the card's discount; ``required`` and ``discount`` are NULL without a card."""
    reduced = rounded(amount * (F.lit(1) - discount / F.lit(100).cast("decimal(3,0)")))
    return F.when(bonus_points >= required, reduced).otherwise(amount).cast(MONEY)


def bonus_for(paid: Column) -> Column:
    """One point per full hundred paid."""
    return F.floor(paid * F.lit("0.01").cast("decimal(3,2)")).cast("bigint")
