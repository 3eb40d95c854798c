"""The sixteen tables: columns, keys and value rules.

Keys are BIGINT everywhere, times of day are ``HH:mm:ss`` strings and money is decimal.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Table columns, nullability and types.
DDL = {
    "types_amenities": "id BIGINT NOT NULL, name STRING NOT NULL",
    "cities": "id BIGINT NOT NULL, city_name STRING NOT NULL, country_name_code STRING NOT NULL",
    "categories_hotel": "id BIGINT NOT NULL, star_rating SMALLINT NOT NULL, rating_coeff DECIMAL(5,2) NOT NULL",
    "categories_room": "id BIGINT NOT NULL, category_name STRING NOT NULL, guests_capacity INT NOT NULL, "
    "price_per_night DECIMAL(10,2) NOT NULL, description STRING",
    "loyalty_cards": "id BIGINT NOT NULL, program_name STRING NOT NULL, req_bonus_amount INT NOT NULL, "
    "discount DECIMAL(5,2) NOT NULL",
    "positions": "id BIGINT NOT NULL, position_name STRING NOT NULL",
    "hotels": "id BIGINT NOT NULL, name STRING NOT NULL, city_id BIGINT NOT NULL, address STRING NOT NULL, "
    "phone_number STRING NOT NULL, email STRING NOT NULL, star_rating_id BIGINT NOT NULL, "
    "check_in_time STRING, check_out_time STRING, location_coeff_room DECIMAL(5,2), description STRING",
    "guests": "id BIGINT NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL, middle_name STRING, "
    "phone_number STRING NOT NULL, email STRING, birth_date DATE NOT NULL, document STRING, "
    "loyalty_card_id BIGINT, bonus_points INT",
    "employees": "id BIGINT NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL, middle_name STRING, "
    "position_id BIGINT NOT NULL, phone_number STRING NOT NULL, email STRING, employment_date DATE NOT NULL, "
    "fired_date DATE, hotel_id BIGINT NOT NULL, salary DECIMAL(12,2) NOT NULL",
    "rooms": "id BIGINT NOT NULL, hotel_id BIGINT NOT NULL, categories_room_id BIGINT NOT NULL, "
    "room_number STRING NOT NULL, floor INT NOT NULL, view STRING",
    "amenities": "id BIGINT NOT NULL, hotel_id BIGINT NOT NULL, types_amenities_id BIGINT NOT NULL, "
    "price DECIMAL(10,2) NOT NULL",
    "reservations": "id BIGINT NOT NULL, hotel_id BIGINT NOT NULL, employee_id BIGINT, "
    "create_date TIMESTAMP_NTZ NOT NULL, status STRING NOT NULL, total_price DECIMAL(12,2), "
    "payments_status STRING NOT NULL, payer_id BIGINT NOT NULL, start_date DATE NOT NULL, end_date DATE NOT NULL",
    "details_reservations": "id BIGINT NOT NULL, reservation_id BIGINT NOT NULL, room_id BIGINT, "
    "guest_id BIGINT NOT NULL, requested_room_category BIGINT NOT NULL, total_guest_number INT NOT NULL",
    "payments": "id BIGINT NOT NULL, reservation_id BIGINT NOT NULL, payments_sum DECIMAL(12,2) NOT NULL, "
    "payments_date DATE NOT NULL, payments_method STRING NOT NULL",
    "room_reservation_guests": "room_reservation_id BIGINT NOT NULL, guest_id BIGINT NOT NULL",
    "payments_amenities": "id BIGINT NOT NULL, hotel_amenities_id BIGINT NOT NULL, payment_id BIGINT NOT NULL, "
    "quantity INT NOT NULL, total_amenities_price DECIMAL(12,2) NOT NULL",
}

# Who writes a table and where its rows travel.
REFERENCE_TABLES = [
    "hotels",
    "cities",
    "categories_hotel",
    "categories_room",
    "positions",
    "loyalty_cards",
    "types_amenities",
]
BRANCH_TABLES = ["rooms", "employees", "reservations", "details_reservations", "amenities", "payments"]
BRANCHES = ["filial1", "filial2", "filial3"]
CENTRAL = "central"
# The node that owns each city; every other city belongs to the centre.
CITY_NODES = [("Москва", "filial1"), ("Санкт-Петербург", "filial2"), ("Казань", "filial3")]

# Fixed values: (child table, column, parent table); every parent key is ``id``.
FOREIGN_KEYS = [
    ("hotels", "city_id", "cities"),
    ("hotels", "star_rating_id", "categories_hotel"),
    ("guests", "loyalty_card_id", "loyalty_cards"),
    ("employees", "position_id", "positions"),
    ("employees", "hotel_id", "hotels"),
    ("rooms", "hotel_id", "hotels"),
    ("rooms", "categories_room_id", "categories_room"),
    ("amenities", "hotel_id", "hotels"),
    ("amenities", "types_amenities_id", "types_amenities"),
    ("reservations", "hotel_id", "hotels"),
    ("reservations", "employee_id", "employees"),
    ("reservations", "payer_id", "guests"),
    ("details_reservations", "reservation_id", "reservations"),
    ("details_reservations", "room_id", "rooms"),
    ("details_reservations", "guest_id", "guests"),
    ("details_reservations", "requested_room_category", "categories_room"),
    ("payments", "reservation_id", "reservations"),
    ("room_reservation_guests", "room_reservation_id", "details_reservations"),
    ("room_reservation_guests", "guest_id", "guests"),
    ("payments_amenities", "hotel_amenities_id", "amenities"),
    ("payments_amenities", "payment_id", "payments"),
]

# Unique keys. A key with a NULL part never collides.
UNIQUE_KEYS = [
    ("types_amenities", ["id"]),
    ("types_amenities", ["name"]),
    ("cities", ["id"]),
    ("categories_hotel", ["id"]),
    ("categories_room", ["id"]),
    ("categories_room", ["category_name"]),
    ("loyalty_cards", ["id"]),
    ("loyalty_cards", ["program_name"]),
    ("positions", ["id"]),
    ("positions", ["position_name"]),
    ("hotels", ["id"]),
    ("hotels", ["phone_number"]),
    ("hotels", ["email"]),
    ("guests", ["id"]),
    ("employees", ["id"]),
    ("rooms", ["id"]),
    ("rooms", ["hotel_id", "room_number"]),
    ("amenities", ["id"]),
    ("reservations", ["id"]),
    ("details_reservations", ["id"]),
    ("details_reservations", ["reservation_id", "room_id", "guest_id"]),
    ("payments", ["id"]),
    ("room_reservation_guests", ["room_reservation_id", "guest_id"]),
    ("payments_amenities", ["id"]),
]
PARTIAL_UNIQUE_KEYS = [
    ("guests", ["document"]),
    ("guests", ["email"]),
    ("employees", ["email"]),
]

# Fixed values: (table, rule name, SQL condition). A NULL condition passes.
DOMAIN_CHECKS = [
    ("categories_hotel", "star_rating", "star_rating BETWEEN 1 AND 5"),
    ("categories_room", "guests_capacity", "guests_capacity > 0"),
    ("categories_room", "price_per_night", "price_per_night >= 0"),
    ("loyalty_cards", "req_bonus_amount", "req_bonus_amount >= 0"),
    ("loyalty_cards", "discount", "discount >= 0"),
    ("guests", "bonus_points", "bonus_points >= 0"),
    ("employees", "salary", "salary >= 0"),
    ("amenities", "price", "price >= 0"),
    ("reservations", "status", "status IN ('confirmed', 'pending', 'cancelled')"),
    ("reservations", "payments_status", "payments_status IN ('paid', 'unpaid')"),
    ("reservations", "end_date", "end_date >= start_date"),
    ("details_reservations", "total_guest_number", "total_guest_number > 0"),
    ("payments", "payments_sum", "payments_sum >= 0"),
    ("payments", "payments_method", "payments_method IN ('cash', 'card', 'online')"),
    ("payments_amenities", "quantity", "quantity > 0"),
    ("payments_amenities", "total_amenities_price", "total_amenities_price >= 0"),
]

# Widest text per column.
TEXT_WIDTHS = {
    "types_amenities": {"name": 50},
    "cities": {"city_name": 100, "country_name_code": 3},
    "categories_room": {"category_name": 255, "description": 255},
    "loyalty_cards": {"program_name": 100},
    "positions": {"position_name": 100},
    "hotels": {"name": 100, "address": 150, "phone_number": 30, "email": 30, "description": 300},
    "guests": {
        "first_name": 50,
        "last_name": 50,
        "middle_name": 50,
        "phone_number": 20,
        "email": 255,
        "document": 255,
    },
    "employees": {"first_name": 50, "last_name": 50, "middle_name": 50, "phone_number": 20, "email": 255},
    "rooms": {"room_number": 10, "view": 30},
    "reservations": {"status": 50, "payments_status": 50},
    "payments": {"payments_method": 50},
}

ACTIVE = ["confirmed", "pending"]
PAYMENT_METHODS = ["cash", "card", "online"]


_TYPES = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "SMALLINT": ShortType(),
    "STRING": StringType(),
    "DATE": DateType(),
    "TIMESTAMP_NTZ": TimestampNTZType(),
    "DECIMAL(5,2)": DecimalType(5, 2),
    "DECIMAL(10,2)": DecimalType(10, 2),
    "DECIMAL(12,2)": DecimalType(12, 2),
}


def struct(columns: str) -> StructType:
    """A schema from ``name TYPE [NOT NULL], ...`` that needs no running session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *rest = column.split(" ")
        fields.append(StructField(name, _TYPES[kind], nullable=not rest))
    return StructType(fields)


def schema(table: str) -> StructType:
    return struct(DDL[table])


def key_column(table: str) -> str:
    """The column that names a row in reports; occupancy rows have no id of their own."""
    return "room_reservation_id" if table == "room_reservation_guests" else "id"
