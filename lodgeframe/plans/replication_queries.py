"""Distribution, consolidation, change-feed and integrity queries with their SQL twins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodgeframe.functions.ordering import strided_ids, writer_of
from lodgeframe.operators import hotels, quality, replication
from lodgeframe.operators.booking import NODE_NUMBERS
from lodgeframe.operators.guests import EDITABLE
from lodgeframe.plans.domain_sql import over
from lodgeframe.schemas import BRANCHES, DOMAIN_CHECKS, FOREIGN_KEYS, PARTIAL_UNIQUE_KEYS, TEXT_WIDTHS
from lodgeframe.schemas import UNIQUE_KEYS, key_column, schema
from lodgeframe.session import shared_folder
from lodgeframe.sources import copies, store
from lodgeframe.sources.projection import HotelData

SCANNED_NODE = "filial2"
# How far the centre has received the branches' changes and payments.
DELIVERED_UNTIL = "2000-01-01 00:00:00"
ROLLED_UP_UNTIL = "2024-03-01"
STRIDE = len(NODE_NUMBERS)

# Columns of the reference tables as they are copied.
COPIED = {
    "hotels": "name city_id address phone_number email star_rating_id check_in_time check_out_time "
    "location_coeff_room description",
    "cities": "city_name country_name_code",
    "categories_hotel": "star_rating rating_coeff",
    "categories_room": "category_name guests_capacity price_per_night description",
    "loyalty_cards": "program_name req_bonus_amount discount",
    "positions": "position_name",
    "types_amenities": "name",
}


def _on(run):
    return lambda spark, path: run(HotelData(spark, path))


def _routes(d):
    return hotels.hotel_city_route(d.hotels, d.cities, d.city_nodes)


def _with_nodes(d):
    """Branch tables as (hotel_id, id) pairs with the owning node."""
    stays = d.reservations.select(F.col("id").alias("reservation_id"), "hotel_id")
    keyed = {
        "rooms": d.rooms.select("hotel_id", "id"),
        "reservations": d.reservations.select("hotel_id", "id"),
        "details_reservations": d.details_reservations.select("id", "reservation_id")
        .join(stays, "reservation_id")
        .select("hotel_id", "id"),
        "amenities": d.amenities.select("hotel_id", "id"),
        "employees": d.employees.select("hotel_id", "id"),
        "payments": d.payments.select("id", "reservation_id").join(stays, "reservation_id").select("hotel_id", "id"),
    }
    return {name: replication.split_by_node(df, _routes(d)) for name, df in keyed.items()}


def _distribute(d):
    tables = {name: getattr(d, name).select("id", *columns.split()) for name, columns in COPIED.items()}
    sent = replication.distribute_reference(tables)
    return reduce(DataFrame.unionByName, [replication.stacked(name, df) for name, df in sent.items()])


def _consolidate(d):
    parts = [df.select(F.lit(name).alias("table_name"), "node", "id") for name, df in _with_nodes(d).items()]
    return reduce(DataFrame.unionByName, parts)


def _apply(d):
    changes = d.guest_changes.withColumn("bonus_points", F.col("value").cast("int"))
    return replication.apply_changes(
        d.guests.select("id", "first_name", "last_name", "bonus_points"), changes, ["bonus_points"]
    )


def _rollup(d):
    stays = d.reservations.select(F.col("id").alias("reservation_id"), "hotel_id")
    paid = d.payment_requests.join(stays, "reservation_id").join(_routes(d), "hotel_id")
    return replication.payments_rollup(paid.select("node", F.col("requested_at").alias("ts"), "amount"))


def _new_ids(d):
    signups = d.guest_changes.where("op = 'I'").select(
        "seq", "origin", F.substring("origin", 7, 1).cast("bigint").alias("writer")
    )
    return strided_ids(signups, "writer", "seq", STRIDE, "new_id").select(
        "seq", "origin", "new_id", writer_of(F.col("new_id"), STRIDE).alias("decoded_writer")
    )


def _routed(d):
    return replication.split_by_node(d.booking_requests, _routes(d)).select("request_id", "hotel_id", "node")


def _scan(spark, path):
    """Reservations in a folder per node, of which the scan opens one."""
    d = HotelData(spark, path)
    folder = f"{shared_folder(spark).rstrip('/')}/lodgeframe-nodes-{uuid.uuid4().hex}/reservations"
    store.write_by_node(replication.split_by_node(d.reservations, _routes(d)), folder)
    stored = spark.read.schema(store.node_schema("reservations")).parquet(folder)
    return replication.node_scan(stored, SCANNED_NODE).select("node", *d.reservations.columns)


def _hotel_feed(d):
    """The centre's edits of hotels in order, some of them removals and some putting a hotel (back) in place."""
    return d.hotel_changes.select(
        F.col("change_id").alias("seq"),
        F.expr("CASE WHEN change_id % 5 = 0 THEN 'D' WHEN change_id % 3 = 0 THEN 'I' ELSE 'U' END").alias("op"),
        F.col("hotel_id").alias("key"),
        *EDITABLE,
    )


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lodgeframe-{name}-{uuid.uuid4().hex}"


def _changes_after_copy(spark, path):
    """Each branch copies the hotels at a place of its own in the feed and is sent what follows, some of it twice."""
    d = HotelData(spark, path)
    base, feed = _folder(spark, "copies"), _hotel_feed(d)
    rows = d.hotels.select("id", *COPIED["hotels"].split())
    last = feed.agg(F.max("seq")).first()[0] or 0
    parts = []
    for number, node in enumerate(BRANCHES, 1):
        position = last * number // 4
        own = copies.SubscribedCopy(spark, f"{base}/{node}", rows.schema, EDITABLE)
        own.take(replication.replay(rows, feed.where(F.col("seq") <= position), EDITABLE), position)
        own.deliver(feed.where(F.col("seq").between(position // 2, (position + last) // 2)))
        own.deliver(feed)
        parts.append(replication.stacked("hotels", own.current().withColumn("node", F.lit(node))))
    return reduce(DataFrame.unionByName, parts)


def _at_branches(d):
    """Whole rows of the branch tables that the centre follows, each as the insert its branch sent, and removals."""
    routes, here = _routes(d), F.col("node").isin(BRANCHES)
    stays = d.reservations.select(F.col("id").alias("reservation_id"), "hotel_id", "create_date")

    def owned(df):
        return replication.split_by_node(df, routes).where(here)

    seen = owned(d.reservation_changes).select("key", "op", "ts")
    day = F.datediff("ts", F.lit("1970-01-01")).cast("bigint")
    # One number for each change of a branch, greater on later days.
    number = day * (1 << 36) + F.col("key") * 2 + (F.col("op") == "D").cast("int")
    reservations = (
        owned(d.reservations).withColumn("key", F.col("id")).join(seen, "key")
        .select(number.alias("seq"), "ts", F.col("node").alias("origin"), "op", "key", *d.reservations.columns[1:])
    )
    guests = d.room_reservation_guests
    span = (d.occupancy_lines.agg(F.max("guest_id")).first()[0] or 0) + 1
    lines = d.details_reservations.select(F.col("id").alias("room_reservation_id"), "reservation_id")
    occupancy = owned(
        guests.join(lines, "room_reservation_id").join(stays, "reservation_id")
        .withColumn("id", F.col("room_reservation_id") * span + F.col("guest_id"))
    ).select("id", "node", "room_reservation_id", "guest_id", "create_date")
    paid = owned(d.payments.join(stays.drop("create_date"), "reservation_id")).select("node", *d.payments.columns)
    return {
        "rooms": copies.whole_rows(owned(d.rooms).select("node", *d.rooms.columns), "TIMESTAMP_NTZ'1990-01-01 00:00:00'"),
        "reservations": reservations,
        "payments": copies.whole_rows(paid, "payments_date"),
        "room_reservation_guests": copies.whole_rows(occupancy, "create_date").drop("create_date"),
    }


def _sent(spark, d):
    """The branches' changes as they lie on shared storage, put together once."""
    base = _folder(spark, "sent")
    return {name: _saved(changes, f"{base}/{name}") for name, changes in _at_branches(d).items()}


def _saved(rows, folder):
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _centre(spark, sent, batches):
    """The centre's tables after each branch's changes came in batches; ``batches`` gives them for a table's changes."""
    base, made = _folder(spark, "centre"), {}
    for name, changes in sent.items():
        values = [f for f in changes.schema.fields if f.name not in replication.FEED]
        made[name] = copies.CentreTable(spark, f"{base}/{name}", StructType(values))
        for batch in batches(name, changes):
            made[name].apply(batch)
    return made


def _until(name: str) -> str:
    return f"ts <= TIMESTAMP_NTZ'{ROLLED_UP_UNTIL if name == 'payments' else DELIVERED_UNTIL}'"


def _centre_rows(spark, path):
    """Reservations at the centre, from batches of which one is sent again and one overlaps what came before."""
    d = HotelData(spark, path)
    base = _folder(spark, "centre")
    changes = _at_branches(d)["reservations"]
    values = [f for f in changes.schema.fields if f.name not in replication.FEED]
    centre = copies.CentreTable(spark, base, StructType(values))
    early = changes.where(_until("reservations"))
    for batch in (early, early, changes):
        centre.apply(batch)
    return centre.current()


def _sides(spark, sent):
    """Per table the rows of the branches, as they are there now, and of the centre, as far as changes were delivered.

    Branches have given some rooms another floor since.
    """
    centre = _centre(spark, sent, lambda name, changes: [changes.where(_until(name))])
    out = {}
    for name, changes in sent.items():
        values = centre[name].columns
        here = replication.latest_changes(changes).where("op <> 'D'").withColumnRenamed("origin", "node")
        if name == "rooms":
            here = here.withColumn("floor", F.expr("CASE WHEN key % 97 = 0 THEN floor + 1 ELSE floor END").cast(here.schema["floor"].dataType))
        digest = F.xxhash64(*values).alias("digest")
        out[name] = here.select("node", "key", digest), centre[name].current().select("node", "key", digest)
    return out


def _parity(spark, path):
    # Needs few columns of the changes, so that saving them whole would write more than it spares.
    sides = _sides(spark, _at_branches(HotelData(spark, path)))
    return reduce(DataFrame.unionByName, [replication.fragment_parity(*both, name) for name, both in sides.items()])


def _differences(spark, path):
    # Every level reads both sides, so their digests are made once.
    base, parts = _folder(spark, "digests"), []
    for name, (here, there) in _sides(spark, _sent(spark, HotelData(spark, path))).items():
        parts.append(replication.differing_keys(_saved(here, f"{base}/{name}/here"), _saved(there, f"{base}/{name}/there"), name))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "s01_distribute_reference": _on(_distribute),
    "s02_consolidate_branches": _on(_consolidate),
    "s03_sync_guests": _on(lambda d: replication.sync_tables([d.guest_feed])),
    "s04_apply_changes": _on(_apply),
    "s05_payments_rollup": _on(_rollup),
    "s06_strided_ids": _on(_new_ids),
    "s07_route_writes": _on(_routed),
    "s08_node_scan": _scan,
    "q01_foreign_keys": _on(lambda d: quality.broken_references(d.incoming_tables)),
    "q02_unique_keys": _on(lambda d: quality.duplicate_keys(d.incoming_tables)),
    "q03_partial_unique": _on(lambda d: quality.duplicate_present_keys(d.incoming_tables)),
    "q04_domain_checks": _on(lambda d: quality.broken_domains(d.incoming_tables)),
    "q05_shapes": _on(lambda d: quality.bad_shapes(d.incoming_tables)),
    "q06_request_checks": _on(lambda d: quality.check_requests(d.raw_requests)),
    "q07_consolidation_parity": _parity,
    "q07_differing_keys": _differences,
    "s01_changes_after_copy": _changes_after_copy,
    "s02_centre_rows": _centre_rows,
}

# Where the SQL twins find each table of ``HotelData.incoming_tables``.
_INCOMING = {
    name: name
    for name in (
        "types_amenities cities categories_hotel categories_room loyalty_cards positions hotels amenities reservations "
        "details_reservations room_reservation_guests"
    ).split()
} | {name: f"offered_{name}" for name in ("payments", "guests", "rooms", "employees", "payments_amenities")}
_INCOMING_TABLES = " ".join(_INCOMING.values())


def _cells_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, b.node, id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {table}, branches b"
        for c in COPIED[table].split()
    )


def _references_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, {key_column(child)} AS row_key, "
        f"CAST({column} AS BIGINT) AS value FROM {_INCOMING[child]} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {_INCOMING[parent]})"
        for child, column, parent in FOREIGN_KEYS
    )


def _duplicates_sql(rules) -> str:
    parts = []
    for table, columns in rules:
        if table in _INCOMING:
            text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
            present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
            parts.append(
                f"SELECT '{table}' AS table_name, '{','.join(columns)}' AS key_columns, {text} AS key_value, "
                f"count(*) AS rows_found FROM {_INCOMING[table]} WHERE {present} "
                f"GROUP BY {', '.join(columns)} HAVING count(*) > 1"
            )
    return " UNION ALL ".join(parts)


def _rule_sql(table: str, rule: str, broken: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, {key_column(table)} AS row_key, '{rule}' AS rule "
        f"FROM {_INCOMING[table]} WHERE {broken}"
    )


def _domains_sql() -> str:
    return " UNION ALL ".join(
        _rule_sql(table, name, f"NOT ({condition})") for table, name, condition in DOMAIN_CHECKS
    )


def _shapes_sql() -> str:
    parts = []
    for table in _INCOMING:
        for field in schema(table).fields:
            if not field.nullable:
                parts.append(_rule_sql(table, f"{field.name} is missing", f"{field.name} IS NULL"))
        for name, width in TEXT_WIDTHS.get(table, {}).items():
            parts.append(_rule_sql(table, f"{name} is too long", f"length({name}) > {width}"))
    return " UNION ALL ".join(parts)


_NODES = "hotel_nodes AS (SELECT h.id AS hotel_id, c.node FROM hotels h JOIN cities c ON c.id = h.city_id)"
_NODE_TABLES = "hotels cities rooms reservations details_reservations amenities payments employees"
_KEYED = (
    _NODES
    + """,
    keyed AS (
        SELECT 'rooms' AS table_name, hotel_id, id FROM rooms
        UNION ALL SELECT 'reservations', hotel_id, id FROM reservations
        UNION ALL SELECT 'details_reservations', r.hotel_id, d.id
                  FROM details_reservations d JOIN reservations r ON r.id = d.reservation_id
        UNION ALL SELECT 'amenities', hotel_id, id FROM amenities
        UNION ALL SELECT 'employees', hotel_id, id FROM employees
        UNION ALL SELECT 'payments', r.hotel_id, p.id FROM payments p JOIN reservations r ON r.id = p.reservation_id)"""
)

_SIDES = f""",
    dated AS (
        SELECT id, hotel_id, create_date <= TIMESTAMP '{DELIVERED_UNTIL}' AS known, status = 'cancelled' AND id % 7 = 0 AS gone,
               create_date + INTERVAL 30 DAY <= TIMESTAMP '{DELIVERED_UNTIL}' AS told FROM reservations),
    sides AS (
        SELECT 'rooms' AS table_name, hotel_id, id AS key, true AS here, true AS there FROM rooms
        UNION ALL SELECT 'reservations', hotel_id, id, NOT gone, known AND NOT (gone AND told) FROM dated
        UNION ALL SELECT 'payments', r.hotel_id, p.id, true, p.payments_date <= DATE '{ROLLED_UP_UNTIL}'
                  FROM payments p JOIN reservations r ON r.id = p.reservation_id
        UNION ALL SELECT 'room_reservation_guests', r.hotel_id,
                         o.room_reservation_id * (SELECT max(guest_id) + 1 FROM room_reservation_guests) + o.guest_id,
                         true, r.known
                  FROM room_reservation_guests o JOIN details_reservations d ON d.id = o.room_reservation_id
                  JOIN dated r ON r.id = d.reservation_id)"""

ORACLES = {
    "s01_distribute_reference": over(
        " ".join(COPIED),
        " UNION ALL ".join(_cells_sql(table) for table in COPIED),
        "branches AS (SELECT * FROM (VALUES ('filial1'), ('filial2'), ('filial3')) t(node))",
    ),
    "s02_consolidate_branches": over(
        _NODE_TABLES,
        "SELECT table_name, node, id FROM keyed JOIN hotel_nodes USING (hotel_id)",
        _KEYED,
    ),
    "s03_sync_guests": over(
        "guest_changes",
        """SELECT * FROM (SELECT * FROM guest_changes
                          QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, origin DESC, seq DESC) = 1)
           WHERE op <> 'D'""",
    ),
    "s04_apply_changes": over(
        "guests guest_changes",
        """SELECT coalesce(g.id, c.key) AS id, g.first_name, g.last_name,
                  CASE WHEN c.key IS NULL THEN g.bonus_points ELSE CAST(trunc(c.value) AS INT) END AS bonus_points
           FROM guests g FULL JOIN (SELECT * FROM guest_changes QUALIFY row_number() OVER (
                    PARTITION BY key ORDER BY ts DESC, origin DESC, seq DESC) = 1) c ON c.key = g.id
           WHERE c.op IS NULL OR c.op = 'I' OR (c.op = 'U' AND g.id IS NOT NULL)""",
    ),
    "s05_payments_rollup": over(
        "payment_requests reservations hotels cities",
        """SELECT n.node, time_bucket(INTERVAL '3 hours', q.requested_at) AS window_start, count(*) AS payments,
                  CAST(sum(q.amount) AS DECIMAL(18,2)) AS total
           FROM payment_requests q JOIN reservations r ON r.id = q.reservation_id JOIN hotel_nodes n USING (hotel_id)
           GROUP BY ALL""",
        _NODES,
    ),
    "s06_strided_ids": over(
        "guest_changes",
        """SELECT seq, origin, writer + 4 * (row_number() OVER (PARTITION BY writer ORDER BY seq) - 1) AS new_id,
                  writer AS decoded_writer
           FROM (SELECT *, CAST(right(origin, 1) AS BIGINT) AS writer FROM guest_changes WHERE op = 'I')""",
    ),
    "s07_route_writes": over(
        "booking_requests hotels cities",
        "SELECT q.request_id, q.hotel_id, n.node FROM booking_requests q JOIN hotel_nodes n USING (hotel_id)",
        _NODES,
    ),
    "s08_node_scan": over(
        "reservations hotels cities",
        f"SELECT n.node, r.* FROM reservations r JOIN hotel_nodes n USING (hotel_id) WHERE n.node = '{SCANNED_NODE}'",
        _NODES,
    ),
    "q01_foreign_keys": over(_INCOMING_TABLES, _references_sql()),
    "q02_unique_keys": over(_INCOMING_TABLES, _duplicates_sql(UNIQUE_KEYS)),
    "q03_partial_unique": over(_INCOMING_TABLES, _duplicates_sql(PARTIAL_UNIQUE_KEYS)),
    "q04_domain_checks": over(_INCOMING_TABLES, _domains_sql()),
    "q05_shapes": over(_INCOMING_TABLES, _shapes_sql()),
    "q06_request_checks": over(
        "raw_requests",
        """SELECT request_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error, s AS start_date,
                  e AS end_date, a AS amount
           FROM (SELECT *, CASE
                   WHEN start_date IS NULL THEN 'Missing required fields: start_date'
                   WHEN s IS NULL OR e IS NULL THEN 'Invalid date format. Use YYYY-MM-DD'
                   WHEN s >= e THEN 'End date must be after start date'
                   WHEN a IS NULL THEN 'Amount is not a number'
                   WHEN a <= 0 THEN 'Amount must be greater than zero'
                   WHEN method NOT IN ('cash', 'card', 'online') THEN 'Unknown payment method' END AS error
                 FROM (SELECT request_id, start_date, method, TRY_CAST(start_date AS DATE) AS s,
                              TRY_CAST(end_date AS DATE) AS e, TRY_CAST(amount AS DECIMAL(12,2)) AS a
                       FROM raw_requests))""",
    ),
    "q07_consolidation_parity": over(
        _NODE_TABLES + " room_reservation_guests",
        """SELECT table_name, node, count_if(here AND there) AS matched, count_if(here AND NOT there) AS missing_at_centre,
                  count_if(there AND NOT here) AS only_at_centre
           FROM sides JOIN hotel_nodes USING (hotel_id) WHERE node <> 'central' AND (here OR there) GROUP BY 1, 2""",
        _NODES + _SIDES,
    ),
    "q07_differing_keys": over(
        _NODE_TABLES + " room_reservation_guests",
        """SELECT table_name, node, key, CASE WHEN NOT there THEN 'missing at centre' WHEN NOT here THEN 'only at centre'
                  ELSE 'different' END AS difference
           FROM sides JOIN hotel_nodes USING (hotel_id)
           WHERE node <> 'central' AND (here <> there OR (table_name = 'rooms' AND key % 97 = 0))""",
        _NODES + _SIDES,
    ),
    "s01_changes_after_copy": over(
        "hotels hotel_changes",
        " UNION ALL ".join(
            f"SELECT 'hotels' AS table_name, node, id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM after, branches"
            for c in COPIED["hotels"].split()
        ),
        f"""branches AS (SELECT * FROM (VALUES ('filial1'), ('filial2'), ('filial3')) t(node)),
    feed AS (SELECT *, CASE WHEN change_id % 5 = 0 THEN 'D' WHEN change_id % 3 = 0 THEN 'I' ELSE 'U' END AS op FROM hotel_changes),
    turned AS (SELECT hotel_id, max(change_id) FILTER (op = 'D') AS gone, max(change_id) FILTER (op = 'I') AS made,
                      max(change_id) FILTER (op <> 'D') AS last FROM feed GROUP BY hotel_id),
    after AS (
        SELECT coalesce(h.id, t.hotel_id) AS id,
               {", ".join(f"CASE WHEN t.last IS NULL THEN h.{c} ELSE f.{c} END AS {c}" for c in EDITABLE)},
               {", ".join(f"CASE WHEN t.made IS NULL OR t.gone IS NULL THEN h.{c} END AS {c}" for c in ("city_id", "star_rating_id"))}
        FROM hotels h FULL JOIN turned t ON t.hotel_id = h.id LEFT JOIN feed f ON f.change_id = t.last
        WHERE CASE WHEN t.made IS NULL AND t.gone IS NULL THEN h.id IS NOT NULL
                   ELSE t.made IS NOT NULL AND t.made > coalesce(t.gone, -1) END)""",
    ),
    "s02_centre_rows": over(
        "reservations hotels cities",
        """SELECT n.node, r.id AS key, r.* EXCLUDE (id) FROM reservations r JOIN hotel_nodes n USING (hotel_id)
           WHERE n.node <> 'central' AND NOT (r.status = 'cancelled' AND r.id % 7 = 0)""",
        _NODES,
    ),
}
