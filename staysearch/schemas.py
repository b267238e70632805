"""Table schemas, keys and the fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the contract.
DEFAULT_CURRENCY = "RUB"
MAX_RANGE_DAYS = 366
MAX_ADULTS = 255
MAX_CHILD_AGE = 17
DEFAULT_STAY_DAYS = 7
DEFAULT_ADULTS = 2
ADULTS_OPTIONS = (1, 2, 3, 4)
CHILDREN_OPTIONS = ("", "5", "10", "5,10", "3,7")

PRICE = T.DecimalType(12, 2)
TOTAL = T.DecimalType(18, 2)

DAY_KEY = ["placement_id", "date"]
VARIANT_KEY = ["placement_id", "adults", "children_ages"]
SEARCH_KEY = ["placement_id", "date", "adults", "children_ages"]

HOTELS = T.StructType(
    [
        T.StructField("hotel_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)

PLACEMENTS = T.StructType(
    [
        T.StructField("placement_id", T.LongType()),
        T.StructField("hotel_id", T.LongType()),
        T.StructField("name", T.StringType()),
    ]
)

VARIANTS = T.StructType(
    [
        T.StructField("placement_id", T.LongType()),
        T.StructField("adults", T.ShortType()),
        T.StructField("children_ages", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)

AVAILABILITY = T.StructType(
    [
        T.StructField("placement_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("available", T.ShortType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("placement_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("price", PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)

SEARCH = T.StructType(
    [
        T.StructField("placement_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("adults", T.ShortType()),
        T.StructField("children_ages", T.StringType()),
        T.StructField("available", T.ShortType()),
        T.StructField("price", PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)

# Availability and price of a placement's day, which its search rows share.
DAY_STATE = T.StructType([f for f in SEARCH.fields if f.name not in ("adults", "children_ages")])

QUARANTINE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("placement_id", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# One message of a topic, whichever source format delivers it.
RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.StringType()),
    ]
)
