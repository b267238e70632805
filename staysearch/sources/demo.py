"""Demo inventory: hotels, placements, variants and a calendar of days, made on the executors.

Values follow from ids by integer mixing, so that any part can be made again anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staysearch.schemas import ADULTS_OPTIONS, CHILDREN_OPTIONS, DEFAULT_CURRENCY, PRICE

# Fixed values of the demo data.
HOTELS = 100
PLACEMENTS_PER_HOTEL = 20
DAYS = 365
FIRST_DAY = date(2026, 1, 1)
CITIES = ("Москва", "Санкт-Петербург", "Сочи")
AVAILABLE_PERCENT = 80
BASE_PRICE, DAY_STEP, DAY_CYCLE, EXTRA_STEP, EXTRA_STEPS = 5000, 100, 30, 50, 21
HOTEL_NAME, HOTEL_ADDRESS, PLACEMENT_NAME = "Отель ", "ул. Демо, ", "Размещение "

MASK = 0xFFFFFFFF
MIX = 0x45D9F3B


@dataclass(frozen=True)
class Demo:
    hotels: DataFrame
    placements: DataFrame
    variants: DataFrame
    availability: DataFrame
    prices: DataFrame


def mixed(a: Column, b: Column, seed: int) -> Column:
    """A 32-bit number that depends on both inputs and the seed."""
    x = (F.pmod(a, F.lit(MASK)) * 1_000_003 + b * 8_191 + F.lit(seed * 131_071)).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def variant_templates(placements: DataFrame) -> DataFrame:
    """Every placement with each number of adults and each list of ages."""
    adults = F.explode(F.array(*[F.lit(n).cast("smallint") for n in ADULTS_OPTIONS]))
    ages = F.explode(F.array(*[F.lit(a) for a in CHILDREN_OPTIONS]))
    return placements.select("placement_id", adults.alias("adults")).select(
        "*", ages.alias("children_ages")
    )


def calendar_days(placements: DataFrame, days: int = DAYS, first_day: date = FIRST_DAY) -> DataFrame:
    """(placement_id, day number, date) for every placement and day."""
    numbers = placements.select("placement_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d"))
    return numbers.withColumn("date", F.date_add(F.lit(first_day), F.col("d")))


def demo_availability(days: DataFrame, seed: int = 1) -> DataFrame:
    draw = F.pmod(mixed(F.col("placement_id"), F.col("d"), seed), F.lit(100))
    return days.select(
        "placement_id", "date", (draw < AVAILABLE_PERCENT).cast("smallint").alias("available")
    )


def demo_prices(days: DataFrame, seed: int = 2) -> DataFrame:
    extra = F.pmod(mixed(F.col("placement_id"), F.col("d"), seed), F.lit(EXTRA_STEPS)) * EXTRA_STEP
    price = F.lit(BASE_PRICE) + F.pmod(F.col("d"), F.lit(DAY_CYCLE)) * DAY_STEP + extra
    return days.select(
        "placement_id",
        "date",
        price.cast(PRICE).alias("price"),
        F.lit(DEFAULT_CURRENCY).alias("currency"),
    )


def demo_inventory(
    spark: SparkSession,
    hotels: int = HOTELS,
    placements_per_hotel: int = PLACEMENTS_PER_HOTEL,
    days: int = DAYS,
    seed: int = 42,
) -> Demo:
    number = F.col("id") + 1
    city = F.element_at(
        F.array(*[F.lit(c) for c in CITIES]),
        (F.pmod(mixed(number, F.lit(0), seed), F.lit(len(CITIES))) + 1).cast("int"),
    )
    hotel_rows = spark.range(hotels).select(
        number.alias("hotel_id"),
        F.concat(F.lit(HOTEL_NAME), number).alias("name"),
        F.concat(F.lit(HOTEL_ADDRESS), number).alias("address"),
        city.alias("city"),
    )
    placement_rows = spark.range(hotels * placements_per_hotel).select(
        number.alias("placement_id"),
        (F.floor(F.col("id") / placements_per_hotel) + 1).cast("bigint").alias("hotel_id"),
        F.concat(F.lit(PLACEMENT_NAME), F.col("id") % placements_per_hotel + 1).alias("name"),
    )
    calendar = calendar_days(placement_rows, days)
    return Demo(
        hotel_rows,
        placement_rows,
        variant_templates(placement_rows),
        demo_availability(calendar, seed),
        demo_prices(calendar, seed + 1),
    )
