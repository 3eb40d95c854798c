"""Loyalty tiers, points and payment folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions import pricing
from lodgeframe.functions.ordering import BLOCK_ROWS, fold_sorted, ordered_fold
from lodgeframe.schemas import PAYMENT_METHODS
from lodgeframe.session import cut_lineage

ARRIVAL = ["requested_at", "request_id"]


# Loyalty programmes at most; more of them is an error, as each task gets the whole list.
MOST_CARDS = 1_000


def card_ladder(cards: DataFrame) -> list[tuple[int, int, int]]:
    """(required points, card, discount in hundredths of a per cent) of all cards, ordered by requirement."""
    rows = cards.select(
        F.col("req_bonus_amount").cast("bigint"), F.col("id").cast("bigint"), (F.col("discount") * 100).cast("bigint")
    ).take(MOST_CARDS + 1)
    if len(rows) > MOST_CARDS:
        raise ValueError(f"more than {MOST_CARDS} loyalty cards")
    return sorted(tuple(row) for row in rows)


def loyalty_tier(guests: DataFrame, cards: DataFrame) -> DataFrame:
    """The card with the greatest requirement the points meet; with none met the old card stays."""
    reached = [
        F.when(F.col("bonus_points") >= required, F.lit(card).cast("bigint"))
        for required, card, _ in reversed(card_ladder(cards))
    ]
    return guests.select(
        F.col("id").alias("guest_id"),
        "bonus_points",
        F.col("loyalty_card_id").alias("old_card_id"),
        F.coalesce(*reached, F.col("loyalty_card_id")).alias("loyalty_card_id"),
    )


def bonus_totals(payments: DataFrame, reservations: DataFrame) -> DataFrame:
    """Points earned per payer over their payments."""
    payers = reservations.select(F.col("id").alias("reservation_id"), "payer_id")
    return (
        payments.join(payers, "reservation_id")
        .groupBy("payer_id")
        .agg(
            F.count("*").alias("payments"),
            F.sum(pricing.bonus_for(F.col("payments_sum"))).alias("bonus_points"),
        )
    )


def pay_in_cents(cents: int, points: int, card: int | None, ladder: list) -> tuple[int, int, int | None]:
    """One payment: amount after discount (half-even), points earned, and the card afterwards.

    The discount looks at points and card before the payment, the new card at points after it.
    """
    paid = cents
    for required, number, discount in ladder:
        if number == card and points >= required:
            whole, rest = divmod(cents * (10_000 - discount), 10_000)
            paid = whole + (1 if rest > 5_000 or (rest == 5_000 and whole % 2) else 0)
    earned = paid // 10_000
    for required, number, _ in ladder:
        if required <= points + earned:
            card = number
    return paid, earned, card


def start_account(ladder: list[tuple[int, int, int]]):
    """Makes a payer's account, (points, card, ladder), from their first row."""

    def start(row) -> list:
        card = row.loyalty_card_id
        return [int(row.bonus_points), None if card < 0 else int(card), ladder]

    return start


def settle_payment(account: list, row) -> tuple:
    points, card, ladder = account
    paid, earned, card = pay_in_cents(int(row.cents), points, card, ladder)
    account[0], account[1] = points + earned, card
    return row.request_id, row.payer_id, paid, earned, account[0], -1 if card is None else card


_SETTLED = "request_id bigint, payer_id bigint, cents bigint, earned bigint, points bigint, card bigint"


def look_up_payments(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """Adds payer, ``status`` and ``error`` from input checks, unknown and already paid reservations."""
    found = reservations.select(F.col("id").alias("reservation_id"), "payer_id", "payments_status")
    method = F.coalesce("method", F.lit("card"))
    lacking = F.col("reservation_id").isNull() | (F.col("reservation_id") == 0) | F.col("amount").isNull() | (
        F.col("amount") == 0
    )
    negative = F.col("amount") < 0
    odd_method = ~F.col("method").isin(PAYMENT_METHODS)
    unknown = F.col("payer_id").isNull()
    settled = F.col("payments_status") == "paid"
    bad = lacking | negative | odd_method
    return (
        requests.withColumn("method", method)
        .join(found, "reservation_id", "left")
        .withColumns(
            {
                "status": F.when(bad, 400).when(unknown, 404).when(settled, 400).otherwise(0),
                "error": F.when(lacking, "Missing required fields")
                .when(negative, "Amount must be greater than zero")
                .when(odd_method, "Unknown payment method")
                .when(unknown, "Reservation not found")
                .when(settled, "Reservation already paid"),
            }
        )
    )


def check_payments(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """The same, and of several requests for one unpaid reservation only the earliest valid one pays."""
    # Saved once: the first request per reservation, the folds and the answers all read it.
    looked_up = cut_lineage(look_up_payments(requests, reservations))
    first = (
        looked_up.where("status = 0").groupBy("reservation_id").agg(F.min(F.struct(*ARRIVAL)).alias("first_request"))
    )
    late = (F.col("status") == 0) & (F.struct(*ARRIVAL) != F.col("first_request"))
    return looked_up.join(first, "reservation_id", "left").withColumns(
        {
            "status": F.when(late, 400).otherwise(F.col("status")),
            "error": F.when(late, "Reservation already paid").otherwise(F.col("error")),
        }
    ).drop("first_request")


def process_payments(
    requests: DataFrame,
    reservations: DataFrame,
    guests: DataFrame,
    cards: DataFrame,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Outcome per request; each payer's points and card carry from one payment to the next."""
    checked = check_payments(requests, reservations)
    start = start_account(card_ladder(cards))
    accounts = guests.select(
        F.col("id").alias("payer_id"),
        F.coalesce("bonus_points", F.lit(0)).cast("bigint").alias("bonus_points"),
        F.coalesce("loyalty_card_id", F.lit(-1)).cast("bigint").alias("loyalty_card_id"),
    )
    valid = checked.where("status = 0").select(*ARRIVAL, "payer_id", (F.col("amount") * 100).cast("bigint").alias("cents"))

    def prepare(pending, state):
        return pending.join(state, "payer_id")

    def decide(rows, state):
        columns = ["request_id", "cents", "bonus_points", "loyalty_card_id"]
        return fold_sorted(rows, ["payer_id"], ARRIVAL, columns, _SETTLED, start, settle_payment)

    def advance(state, decided):
        last = (
            decided.join(valid.select(*ARRIVAL), "request_id")
            .groupBy("payer_id")
            .agg(F.max_by(F.struct("points", "card"), F.struct(*ARRIVAL)).alias("last"))
        )
        return state.join(last, "payer_id", "left").select(
            "payer_id",
            F.coalesce("last.points", "bonus_points").alias("bonus_points"),
            F.coalesce("last.card", "loyalty_card_id").alias("loyalty_card_id"),
        )

    settled = ordered_fold(
        valid, accounts, ["payer_id"], ARRIVAL, prepare, decide, advance, block_rows=block_rows
    ).drop("payer_id")
    done = F.col("cents").isNotNull()
    return checked.drop("amount").join(settled, "request_id", "left").select(
        "request_id",
        "requested_at",
        "reservation_id",
        "payer_id",
        "method",
        F.when(done, 200).when(F.col("status") == 0, 404).otherwise(F.col("status")).alias("status"),
        F.when(~done & (F.col("status") == 0), "Reservation not found").otherwise(F.col("error")).alias("error"),
        (F.col("cents") / F.lit(100).cast("decimal(3,0)")).cast(pricing.MONEY).alias("final_amount"),
        F.col("earned").alias("bonus_points_added"),
        F.col("points").alias("points_after"),
        F.nullif("card", F.lit(-1)).alias("card_after"),
    )


def paid_reservations(reservations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Reservations after the accepted payments: paid, confirmed, priced at what was paid."""
    paid = outcomes.where("status = 200").select(F.col("reservation_id").alias("id"), "final_amount")
    hit = F.col("final_amount").isNotNull()
    changed = {
        "status": F.when(hit, "confirmed").otherwise(F.col("status")),
        "total_price": F.coalesce("final_amount", "total_price"),
        "payments_status": F.when(hit, "paid").otherwise(F.col("payments_status")),
    }
    return reservations.join(paid, "id", "left").select(
        *[changed[c].alias(c) if c in changed else c for c in reservations.columns]
    )


def payer_balances(outcomes: DataFrame) -> DataFrame:
    """Points and card of every payer after their last accepted payment."""
    last = F.max_by(F.struct("points_after", "card_after"), F.struct(*ARRIVAL)).alias("last")
    return (
        outcomes.where("status = 200")
        .groupBy("payer_id")
        .agg(last)
        .select("payer_id", F.col("last.points_after").alias("bonus_points"), F.col("last.card_after").alias("loyalty_card_id"))
    )


def confirm_paid(requests: DataFrame, reservations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unchecked form: a payment row per request and its reservation set to paid and confirmed."""
    payments = requests.select(
        F.col("request_id").alias("id"),
        "reservation_id",
        F.col("amount").alias("payments_sum"),
        F.to_date("requested_at").alias("payments_date"),
        F.col("method").alias("payments_method"),
    )
    hit = requests.select(F.col("reservation_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    changed = {
        "status": F.when(F.col("hit"), "confirmed").otherwise(F.col("status")),
        "payments_status": F.when(F.col("hit"), "paid").otherwise(F.col("payments_status")),
    }
    updated = reservations.join(hit, "id", "left").select(
        *[changed[c].alias(c) if c in changed else c for c in reservations.columns]
    )
    return payments, updated
