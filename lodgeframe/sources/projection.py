"""The hotel model as a projection of the star-schema tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.session import raise_partitions, task_sized_session

BASE_DATE = "DATE'2024-01-01'"

# The source files' columns, declared so that opening a table reads no footer.
RAW_DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


# Tables with many rows for each customer, part or supplier.
LARGE = ("orders", "lineitem", "events")


def _money(name: str, precision: int = 12) -> Column:
    return F.col(name).cast(f"decimal({precision},2)")


class HotelData:
    """Lazy tables; nothing is read until a query uses it.

    They belong to a session of their own, whose tasks are cut by the rows of the large tables in use.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = task_sized_session(spark)
        self.path = path
        self._raw: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            self._raw[table] = self.spark.read.schema(RAW_DDL[table]).parquet(f"{self.path}/{table}.parquet")
            if table in LARGE:
                raise_partitions(self.spark, self._raw[table].count())
        return self._raw[table]

    def _values(self, rows: str, ddl: str) -> DataFrame:
        names = [part.split()[0] for part in ddl.split(", ")]
        casts = [f"CAST({part.split()[0]} AS {part.split()[1]}) AS {part.split()[0]}" for part in ddl.split(", ")]
        return self.spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {rows} AS t({', '.join(names)})")

    # Row counts come from the Parquet footers, so asking for them up front is cheap.

    @cached_property
    def _hotel_count(self) -> Column:
        return F.lit(self.raw("supplier").count())

    @cached_property
    def _guest_count(self) -> Column:
        return F.lit(self.raw("customer").count())

    @cached_property
    def _reservation_count(self) -> Column:
        return F.lit(self.raw("orders").count())

    @cached_property
    def cities(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
            F.col("n_name").alias("city_name"),
            F.upper(F.substring("r_name", 1, 3)).alias("country_name_code"),
            F.expr("CASE WHEN r_regionkey < 3 THEN concat('filial', r_regionkey + 1) ELSE 'central' END").alias(
                "node"
            ),
        )

    @cached_property
    def city_nodes(self) -> DataFrame:
        """Only mapped cities; the others fall back to the central node."""
        return self.cities.where("node <> 'central'").select("city_name", "node")

    @cached_property
    def categories_hotel(self) -> DataFrame:
        return self._values(
            "(1, 3, 1.00), (2, 4, 1.25), (3, 5, 1.50)",
            "id BIGINT, star_rating SMALLINT, rating_coeff DECIMAL(5,2)",
        )

    @cached_property
    def categories_room(self) -> DataFrame:
        return self._values(
            "(1, 'Standard', 2, 3500.00, 'Basic double room'), (2, 'Superior', 3, 5000.00, 'Renewed room'), "
            "(3, 'Suite', 4, 9000.00, NULL)",
            "id BIGINT, category_name STRING, guests_capacity INT, price_per_night DECIMAL(10,2), description STRING",
        )

    @cached_property
    def loyalty_cards(self) -> DataFrame:
        return self._values(
            "(1, 'Silver', 0, 5.0), (2, 'Gold', 1000, 10.0), (3, 'Platinum', 3000, 15.0)",
            "id BIGINT, program_name STRING, req_bonus_amount INT, discount DECIMAL(5,2)",
        )

    @cached_property
    def types_amenities(self) -> DataFrame:
        return self._values("(1, 'Pool'), (2, 'Parking'), (3, 'Spa'), (4, 'Gym')", "id BIGINT, name STRING")

    @cached_property
    def positions(self) -> DataFrame:
        return self._values("(1, 'Receptionist'), (2, 'Manager'), (3, 'Cleaner')", "id BIGINT, position_name STRING")

    @cached_property
    def employees(self) -> DataFrame:
        """Every tenth customer works for a hotel."""
        keyed = self.raw("customer").where("c_custkey % 10 = 0").withColumn("nh", self._hotel_count)
        return keyed.select(
            (F.col("c_custkey") + 1).alias("id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.lit(None).cast("string").alias("middle_name"),
            F.expr("1 + c_custkey DIV 10 % 3").alias("position_id"),
            F.expr("concat('+6', c_custkey)").alias("phone_number"),
            F.expr("CASE WHEN c_custkey % 40 <> 0 THEN concat('e', c_custkey, '@stay.example') END").alias("email"),
            F.expr("date_add(DATE'2015-01-01', CAST(c_custkey % 3000 AS INT))").alias("employment_date"),
            F.lit(None).cast("date").alias("fired_date"),
            F.expr("c_custkey DIV 10 % nh + 1").alias("hotel_id"),
            F.expr("CAST(30000 + c_custkey % 1000 * 10 AS DECIMAL(12,2))").alias("salary"),
        )

    @cached_property
    def hotels(self) -> DataFrame:
        return self.raw("supplier").select(
            (F.col("s_suppkey") + 1).alias("id"),
            F.col("s_name").alias("name"),
            F.expr("CAST(s_nationkey % 20 + 1 AS BIGINT)").alias("city_id"),
            F.expr("concat('Street ', s_suppkey)").alias("address"),
            F.expr("concat('+7', s_suppkey)").alias("phone_number"),
            F.expr("concat('h', s_suppkey, '@stay.example')").alias("email"),
            F.expr("1 + s_suppkey % 3").alias("star_rating_id"),
            F.expr("CASE WHEN s_suppkey % 2 = 0 THEN '14:00:00' ELSE '15:00:00' END").alias("check_in_time"),
            F.lit("12:00:00").alias("check_out_time"),
            F.expr(
                "CASE WHEN s_suppkey % 10 <> 9 THEN CAST(1.00 + 0.05 * (s_suppkey % 6) AS DECIMAL(5,2)) END"
            ).alias("location_coeff_room"),
            F.expr(
                "CASE WHEN s_suppkey % 7 <> 0 "
                "THEN repeat('Comfortable rooms near the old centre. ', CAST(1 + s_suppkey % 5 AS INT)) END"
            ).alias("description"),
        )

    @cached_property
    def rooms(self) -> DataFrame:
        keyed = self.raw("part").withColumn("nh", self._hotel_count)
        return keyed.where("p_partkey % nh % 25 <> 24").select(
            (F.col("p_partkey") + 1).alias("id"),
            F.expr("p_partkey % nh + 1").alias("hotel_id"),
            F.expr("1 + (p_partkey DIV nh) % 3").alias("categories_room_id"),
            F.expr("CAST(101 + p_partkey DIV nh AS STRING)").alias("room_number"),
            F.col("p_size").alias("floor"),
            F.col("p_brand").alias("view"),
        )

    @cached_property
    def guests(self) -> DataFrame:
        return self.raw("customer").select(
            (F.col("c_custkey") + 1).alias("id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.lit(None).cast("string").alias("middle_name"),
            F.expr("concat('+7', c_custkey)").alias("phone_number"),
            F.expr("CASE WHEN c_custkey % 4 <> 0 THEN concat(c_name, '@x.org') END").alias("email"),
            F.expr("date_add(DATE'1960-01-01', CAST(c_custkey % 15000 AS INT))").alias("birth_date"),
            F.expr("CASE WHEN c_custkey % 3 <> 0 THEN concat('D', c_custkey) END").alias("document"),
            F.expr("CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END").alias("loyalty_card_id"),
            F.expr("CAST(greatest(0, floor(c_acctbal)) AS INT)").alias("bonus_points"),
        )

    @cached_property
    def reservations(self) -> DataFrame:
        keyed = self.raw("orders").withColumn("nh", self._hotel_count).withColumn("ng", self._guest_count)
        dated = keyed.withColumn(
            "start_date",
            F.expr(f"date_add({BASE_DATE}, pmod(datediff(o_orderdate, DATE'1995-01-01'), 90))"),
        )
        return dated.select(
            (F.col("o_orderkey") + 1).alias("id"),
            F.expr("o_orderkey % nh + 1").alias("hotel_id"),
            F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % ((ng + 9) DIV 10) * 10 + 1 END").alias("employee_id"),
            F.col("o_orderdate").alias("create_date"),
            F.expr(
                "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END"
            ).alias("status"),
            _money("o_totalprice").alias("total_price"),
            F.expr("CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'unpaid' END").alias("payments_status"),
            (F.col("o_custkey") + 1).alias("payer_id"),
            "start_date",
            F.expr(
                "date_add(start_date, CAST(CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE 1 + o_orderkey % 7 END AS INT))"
            ).alias("end_date"),
        )

    @cached_property
    def details_reservations(self) -> DataFrame:
        # Dealt by order, lines are told apart and meet their order where they are.
        lines = (
            self.raw("lineitem")
            .repartition("l_orderkey")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min("l_partkey").alias("pk"), F.min("l_quantity").alias("q"))
            .withColumn("nh", self._hotel_count)
            .withColumn("k", F.expr("pk DIV nh"))
        )
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.expr("l_orderkey * 8 + l_linenumber").alias("id"),
            (F.col("l_orderkey") + 1).alias("reservation_id"),
            F.expr(
                "CASE WHEN pk % 5 <> 0 AND l_orderkey % nh % 25 <> 24 THEN k * nh + l_orderkey % nh + 1 END"
            ).alias("room_id"),
            (F.col("o_custkey") + 1).alias("guest_id"),
            F.expr("1 + k % 3").alias("requested_room_category"),
            F.expr("CAST(1 + CAST(q AS BIGINT) % 5 AS INT)").alias("total_guest_number"),
        )

    @cached_property
    def occupancy_lines(self) -> DataFrame:
        """``room_reservation_guests`` before equal rows go."""
        keyed = self.raw("lineitem").withColumn("ng", self._guest_count)
        return keyed.select(
            F.expr("l_orderkey * 8 + l_linenumber").alias("room_reservation_id"),
            F.expr("(l_orderkey + l_suppkey) % ng + 1").alias("guest_id"),
        )

    @cached_property
    def room_reservation_guests(self) -> DataFrame:
        return self.occupancy_lines.distinct()

    @cached_property
    def amenities(self) -> DataFrame:
        kinds = F.explode(F.expr("sequence(1L, 4L)")).alias("types_amenities_id")
        return self.hotels.select(F.col("id").alias("hotel_id"), kinds).select(
            F.expr("(hotel_id - 1) * 4 + types_amenities_id").alias("id"),
            "hotel_id",
            "types_amenities_id",
            F.expr("CAST((hotel_id * types_amenities_id) % 7 * 100 AS DECIMAL(10,2))").alias("price"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.reservations.where("payments_status = 'paid'").select(
            "id",
            F.col("id").alias("reservation_id"),
            F.col("total_price").alias("payments_sum"),
            F.expr("date_sub(start_date, 5)").alias("payments_date"),
            F.expr("element_at(array('cash', 'card', 'online'), CAST(id % 3 AS INT) + 1)").alias("payments_method"),
        )

    @cached_property
    def payments_amenities(self) -> DataFrame:
        """Amenities on paid reservations: one of the hotel's four per detail line."""
        lines = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("x")
        )
        paid = self.raw("orders").where("o_orderstatus = 'F'").select("o_orderkey")
        return lines.join(paid, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("nh", self._hotel_count).select(
            F.expr("l_orderkey * 8 + l_linenumber").alias("id"),
            F.expr("l_orderkey % nh * 4 + 1 + l_linenumber % 4").alias("hotel_amenities_id"),
            F.expr("l_orderkey + 1").alias("payment_id"),
            F.expr("CAST(1 + CAST(q AS BIGINT) % 3 AS INT)").alias("quantity"),
            _money("x").alias("total_amenities_price"),
        )

    @cached_property
    def booking_requests(self) -> DataFrame:
        """Some name no known hotel or category or no guest, some dates hold no night."""
        return self.reservations.where("status = 'cancelled'").select(
            F.col("id").alias("request_id"),
            F.col("create_date").alias("requested_at"),
            F.expr("CASE WHEN id % 41 = 0 THEN -hotel_id ELSE hotel_id END").alias("hotel_id"),
            F.expr("CASE WHEN id % 47 <> 0 THEN payer_id END").alias("guest_id"),
            F.expr("CASE WHEN id % 43 = 0 THEN 9 ELSE 1 + id % 3 END").cast("bigint").alias("room_category_id"),
            "start_date",
            "end_date",
            F.expr("CAST(1 + id % 5 AS INT)").alias("total_guests"),
            F.expr("CASE WHEN id % 4 = 0 THEN array(payer_id + 1, payer_id + 2, payer_id) END").alias(
                "additional_guests"
            ),
        )

    @cached_property
    def payment_requests(self) -> DataFrame:
        """Spread over all reservations; a few name none."""
        keyed = self.raw("events").where("event_type = 'purchase'").withColumn("nr", self._reservation_count)
        return keyed.select(
            F.col("event_id").alias("request_id"),
            F.col("ts").alias("requested_at"),
            F.expr("(event_id * 7) % (nr + nr DIV 50) + 1").alias("reservation_id"),
            _money("value").alias("amount"),
            F.expr("element_at(array('cash', 'card', 'online'), CAST(event_id % 3 AS INT) + 1)").alias("method"),
        )

    @cached_property
    def guest_changes(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            "ts",
            F.expr("concat('filial', 1 + event_id % 3)").alias("origin"),
            F.expr("CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END").alias("op"),
            (F.col("user_id") + 1).alias("key"),
            _money("value").alias("value"),
        )

    @cached_property
    def reservation_changes(self) -> DataFrame:
        """What the branches wrote: every reservation when made, and some cancelled ones' removal a month later."""
        seen = F.struct(F.lit("I").alias("op"), F.col("create_date").alias("ts"))
        removal = F.struct(F.lit("D").alias("op"), F.expr("create_date + INTERVAL 30 DAYS").alias("ts"))
        gone = F.expr("status = 'cancelled' AND id % 7 = 0")
        return self.reservations.select(
            F.col("id").alias("seq"),
            F.col("id").alias("key"),
            "hotel_id",
            F.explode(F.when(gone, F.array(seen, removal)).otherwise(F.array(seen))).alias("c"),
        ).select("seq", "key", "hotel_id", "c.*")

    @cached_property
    def guest_forms(self) -> DataFrame:
        """Sign-up forms: some lack a phone, some carry only a full name, some a blank one."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("form_id"),
            F.expr("concat('filial', 1 + c_custkey % 3)").alias("node"),
            F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END").alias("first_name"),
            F.expr("CASE WHEN c_custkey % 10 = 0 THEN c_name END").alias("last_name"),
            F.expr(
                "CASE WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 4 = 0 THEN c_mktsegment "
                "ELSE concat(' ', c_mktsegment, '  middle ', c_name, ' ') END"
            ).alias("full_name"),
            F.expr("CASE WHEN c_custkey % 7 <> 0 THEN concat('+7', c_custkey) END").alias("phone_number"),
            F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '@x.org') END").alias("email"),
            F.expr("CASE WHEN c_custkey % 6 = 0 THEN date_add(DATE'1970-01-01', CAST(c_custkey % 9000 AS INT)) END").alias(
                "birth_date"
            ),
        )

    @cached_property
    def hotel_changes(self) -> DataFrame:
        """Edits keyed by hotel; the last one per hotel counts and some name no known hotel."""
        keyed = self.raw("customer").withColumn("nh", self._hotel_count)
        return keyed.select(
            F.col("c_custkey").alias("change_id"),
            F.expr("c_custkey % (nh + 5) + 1").alias("hotel_id"),
            F.col("c_name").alias("name"),
            F.expr("concat('New street ', c_custkey)").alias("address"),
            F.expr("concat('+8', c_custkey)").alias("phone_number"),
            F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('n', c_custkey, '@stay.example') END").alias("email"),
            F.lit("16:00:00").alias("check_in_time"),
            F.lit("10:00:00").alias("check_out_time"),
            F.lit(None).cast("decimal(5,2)").alias("location_coeff_room"),
            F.col("c_mktsegment").alias("description"),
        )

    @cached_property
    def registration_requests(self) -> DataFrame:
        """Unplaced bookings asking for one of their hotel's rooms; every fifth asks again a day later.

        Some ask for a room of the next hotel, and some name no known reservation.
        """
        lines = self.details_reservations.groupBy("reservation_id").agg(F.count("room_id").alias("held"))
        open_lines = lines.where("held = 0")
        return (
            self.reservations.where("status <> 'cancelled'")
            .join(open_lines, F.col("reservation_id") == F.col("id"))
            .withColumn("nh", self._hotel_count)
            .withColumn("turn", F.explode(F.expr("CASE WHEN id % 5 = 0 THEN array(0, 1) ELSE array(0) END")))
            .select(
                F.expr("id * 2 + turn").alias("request_id"),
                F.expr("create_date + make_dt_interval(turn)").alias("requested_at"),
                F.expr("CASE WHEN id % 31 = 0 THEN -id ELSE id END").alias("reservation_id"),
                F.expr("((id + turn) % 4) * nh + hotel_id + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END").alias("room_id"),
                F.expr("array(payer_id, payer_id + 1, payer_id + 100000000 + turn)").alias("guest_ids"),
            )
        )

    @cached_property
    def raw_requests(self) -> DataFrame:
        """Requests as typed into a form: texts, some absent, malformed or out of range."""
        return self.reservations.select(
            F.col("id").alias("request_id"),
            F.expr(
                "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'soon' ELSE CAST(start_date AS STRING) END"
            ).alias("start_date"),
            F.expr(
                "CASE WHEN id % 19 = 0 THEN CAST(start_date AS STRING) WHEN id % 23 = 0 THEN '2024-02-30' "
                "ELSE CAST(end_date AS STRING) END"
            ).alias("end_date"),
            F.expr(
                "CASE WHEN id % 11 = 0 THEN concat('-', total_price) WHEN id % 29 = 0 THEN 'much' "
                "ELSE CAST(total_price AS STRING) END"
            ).alias("amount"),
            F.expr("element_at(array('cash', 'card', 'online', 'barter'), CAST(id % 4 AS INT) + 1)").alias("method"),
        )

    @cached_property
    def guest_feed(self) -> DataFrame:
        """The change feed as sent: every node passes on what it wrote and what it received."""
        return self.guest_changes.select(
            "*", F.explode(F.array(*[F.lit(f"filial{n}") for n in (1, 2, 3)])).alias("source")
        )

    @cached_property
    def base_tables(self) -> dict[str, DataFrame]:
        names = (
            "types_amenities cities categories_hotel categories_room loyalty_cards positions hotels guests employees rooms "
            "amenities reservations details_reservations payments room_reservation_guests payments_amenities"
        )
        return {name: getattr(self, name) for name in names.split()}

    @cached_property
    def incoming_tables(self) -> dict[str, DataFrame]:
        """Rows offered for loading, faults included: requests and changes in the shape of the tables."""
        nh = self._hotel_count
        offered = dict(self.base_tables)
        offered["payments"] = self.raw("events").withColumn("nr", self._reservation_count).select(
            F.expr("event_id DIV 2").alias("id"),
            F.expr("(event_id * 7) % (nr + nr DIV 10) + 1").alias("reservation_id"),
            F.expr("CAST(value - 20 AS DECIMAL(12,2))").alias("payments_sum"),
            F.expr("CASE WHEN event_id % 31 <> 0 THEN CAST(ts AS DATE) END").alias("payments_date"),
            F.col("event_type").alias("payments_method"),
        )
        offered["guests"] = self.raw("customer").withColumn("ng", self._guest_count).select(
            (F.col("c_custkey") + 1).alias("id"),
            F.expr("CASE WHEN c_custkey % 37 <> 0 THEN repeat(c_mktsegment, CAST(1 + c_custkey % 8 AS INT)) END").alias(
                "first_name"
            ),
            F.col("c_name").alias("last_name"),
            F.expr("CASE WHEN c_custkey % 61 = 0 THEN repeat('m', 60) END").alias("middle_name"),
            F.expr("concat('+7', c_custkey % (ng - ng DIV 10))").alias("phone_number"),
            F.expr("CASE WHEN c_custkey % 4 <> 0 THEN concat('m', c_custkey % (ng - ng DIV 11), '@x.org') END").alias("email"),
            F.expr("date_add(DATE'1960-01-01', CAST(c_custkey % 15000 AS INT))").alias("birth_date"),
            F.expr("CASE WHEN c_custkey % 3 <> 0 THEN concat('D', c_custkey % (ng - ng DIV 12)) END").alias("document"),
            F.expr("c_custkey % 5").alias("loyalty_card_id"),
            F.expr("CAST(floor(c_acctbal) AS INT)").alias("bonus_points"),
        )
        offered["employees"] = self.raw("customer").withColumn("nh", nh).withColumn("ng", self._guest_count).select(
            F.expr("c_custkey + 1").alias("id"),
            F.col("c_mktsegment").alias("first_name"),
            F.expr("CASE WHEN c_custkey % 53 <> 0 THEN c_name END").alias("last_name"),
            F.expr("CASE WHEN c_custkey % 59 = 0 THEN repeat('m', 51) END").alias("middle_name"),
            F.expr("1 + c_custkey % 4").alias("position_id"),
            F.expr("concat('+6', c_custkey)").alias("phone_number"),
            F.expr("concat('e', c_custkey % (ng - ng DIV 9), '@stay.example')").alias("email"),
            F.expr("date_add(DATE'2015-01-01', CAST(c_custkey % 3000 AS INT))").alias("employment_date"),
            F.lit(None).cast("date").alias("fired_date"),
            F.expr("c_custkey % (nh + 2) + 1").alias("hotel_id"),
            _money("c_acctbal").alias("salary"),
        )
        offered["payments_amenities"] = self.raw("lineitem").withColumn("nh", nh).select(
            F.expr("l_orderkey * 4 + l_linenumber").alias("id"),
            F.expr("l_suppkey % (nh * 4 + 8) + 1").alias("hotel_amenities_id"),
            F.expr("l_orderkey + 1").alias("payment_id"),
            F.expr("l_linenumber - 1").alias("quantity"),
            F.expr("CAST(l_extendedprice - 2000 AS DECIMAL(12,2))").alias("total_amenities_price"),
        )
        offered["rooms"] = self.raw("part").withColumn("nh", nh).select(
            (F.col("p_partkey") + 1).alias("id"),
            F.expr("p_partkey % (nh + 3) + 1").alias("hotel_id"),
            F.expr("1 + p_partkey % 4").alias("categories_room_id"),
            F.expr("CAST(100 + p_size AS STRING)").alias("room_number"),
            F.col("p_size").alias("floor"),
            F.col("p_brand").alias("view"),
        )
        return offered
