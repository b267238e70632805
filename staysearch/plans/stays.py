"""Stay searches over the search table, and the price calendar."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.functions.ages import canonical_ages, normalize_ages
from staysearch.operators.joins import lookup_join
from staysearch.operators.nest import nest, page_of
from staysearch.schemas import (
    DAY_KEY,
    DEFAULT_ADULTS,
    DEFAULT_STAY_DAYS,
    MAX_ADULTS,
    MAX_CHILD_AGE,
    MAX_RANGE_DAYS,
    TOTAL,
)


@dataclass(frozen=True)
class Stay:
    """A search request: inclusive dates and who travels."""

    date_from: date = field(default_factory=date.today)
    date_to: date | None = None
    adults: int = DEFAULT_ADULTS
    children_ages: str | Iterable[int] = ""
    placement_id: int | None = None

    def __post_init__(self) -> None:
        if self.date_to is None:
            object.__setattr__(self, "date_to", self.date_from + timedelta(days=DEFAULT_STAY_DAYS))
        object.__setattr__(self, "children_ages", canonical_ages(self.children_ages))
        if self.date_to < self.date_from:
            raise ValueError("date_to is before date_from")
        if (self.date_to - self.date_from).days + 1 > MAX_RANGE_DAYS:
            raise ValueError(f"a stay covers at most {MAX_RANGE_DAYS} days")
        if not 1 <= self.adults <= MAX_ADULTS:
            raise ValueError(f"adults must be 1 to {MAX_ADULTS}")
        if any(not 0 <= int(a) <= MAX_CHILD_AGE for a in self.children_ages.split(",") if a):
            raise ValueError(f"children are 0 to {MAX_CHILD_AGE}")

    @property
    def dates(self) -> tuple[date, date]:
        return self.date_from, self.date_to


def in_dates(rows: DataFrame, dates: tuple[date, date]) -> DataFrame:
    low, high = dates
    return rows.where(F.col("date").between(F.lit(low), F.lit(high)))


def matching(search: DataFrame, stay: Stay) -> DataFrame:
    """Search rows of the stay: equality and range predicates that reach the scan."""
    rows = in_dates(search, stay.dates).where(
        (F.col("adults") == F.lit(stay.adults).cast("smallint"))
        & (F.col("children_ages") == stay.children_ages)
    )
    if stay.placement_id is not None:
        rows = rows.where(F.col("placement_id") == stay.placement_id)
    return rows


def _typed_days(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        *extra,
        "date",
        F.col("available").cast("boolean").alias("available"),
        F.col("price").cast("double").alias("price"),
        "currency",
    )


def stay_days(search: DataFrame, stay: Stay) -> DataFrame:
    """Per-day availability and price; all placements unless the stay names one."""
    if stay.placement_id is not None:
        return _typed_days(matching(search, stay)).orderBy("date")
    return _typed_days(matching(search, stay), "placement_id").orderBy(*DAY_KEY)


def placement_directory(placements: DataFrame, hotels: DataFrame) -> DataFrame:
    """Placements with their hotel; placements of unknown hotels are left out."""
    named = placements.withColumnRenamed("name", "placement_name")
    return lookup_join(
        named,
        hotels.select("hotel_id", F.col("name").alias("hotel_name"), "city"),
        "hotel_id",
        ["placement_id"],
    )


def stay_days_by_hotel(
    search: DataFrame, placements: DataFrame, hotels: DataFrame, stay: Stay
) -> DataFrame:
    rows = _typed_days(matching(search, stay), "placement_id")
    return rows.join(placement_directory(placements, hotels), "placement_id")


def stay_totals(search: DataFrame, stay: Stay) -> DataFrame:
    """Total price per placement; available only if every listed day is.

    Days without a row do not count; ``days_found`` shows how many there are.
    """
    return (
        matching(search, stay)
        .groupBy("placement_id")
        .agg(
            F.sum("price").cast(TOTAL).alias("total_price"),
            F.min("available").cast("boolean").alias("available"),
            F.min("currency").alias("currency"),
            F.count("*").alias("days_found"),
        )
    )


def stay_totals_by_hotel(
    search: DataFrame, placements: DataFrame, hotels: DataFrame, stay: Stay
) -> DataFrame:
    return stay_totals(search, stay).join(placement_directory(placements, hotels), "placement_id")


def stay_summary(totals_by_hotel: DataFrame) -> DataFrame:
    return totals_by_hotel.agg(
        F.count_distinct("hotel_id").alias("hotels_found"),
        F.count("*").alias("placements_found"),
    )


def stay_nested(
    search: DataFrame, placements: DataFrame, hotels: DataFrame, stay: Stay, pages: int = 1
) -> DataFrame:
    """Hotels → placements → dates: one row per hotel and page of its placements.

    A placement has at most 366 dates. ``pages`` spreads hotels with very many placements.
    """
    dated = nest(
        _typed_days(matching(search, stay), "placement_id"),
        ["placement_id"],
        ["date", "available", "price", "currency"],
        "dates",
    )
    return _by_hotel(dated, placements, hotels, ["dates"], pages)


def stay_totals_nested(
    search: DataFrame, placements: DataFrame, hotels: DataFrame, stay: Stay, pages: int = 1
) -> DataFrame:
    """Hotels → placements with their totals: one row per hotel and page of its placements."""
    totals = stay_totals(search, stay)
    return _by_hotel(totals, placements, hotels, ["total_price", "available", "currency", "days_found"], pages)


def _by_hotel(
    found: DataFrame, placements: DataFrame, hotels: DataFrame, values: list[str], pages: int
) -> DataFrame:
    rows = found.join(placement_directory(placements, hotels), "placement_id").select(
        "hotel_id",
        F.col("hotel_name").alias("name"),
        "city",
        page_of(F.col("placement_id"), pages).alias("page"),
        "placement_id",
        "placement_name",
        *values,
    )
    items = ["placement_id", F.col("placement_name").alias("name"), *values]
    return nest(rows, ["hotel_id", "name", "city", "page"], items, "placements")


def calendar(
    availability: DataFrame, prices: DataFrame, placement_id: int, date_from: date, date_to: date
) -> DataFrame:
    """Availability and price per day of one placement; days without a price show NULL."""
    days, quotes = (
        in_dates(side, (date_from, date_to)).where(F.col("placement_id") == placement_id)
        for side in (availability, prices)
    )
    joined = days.select(*DAY_KEY, "available").join(
        quotes.select(*DAY_KEY, "price", "currency"), DAY_KEY, "left"
    )
    return (
        joined.groupBy(*DAY_KEY)
        .agg(
            F.max("available").alias("available"),
            F.max("price").alias("price"),
            F.max_by("currency", "price").alias("currency"),
        )
        .drop("placement_id")
        .orderBy("date")
    )


def checked_stays(requests: DataFrame, placements: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, placement_id?, date_from, date_to, adults, children_ages) with
    canonical ages and ``errors``, an array that is empty for those that may run.

    With ``placements``, a request for a placement that is not there is refused as well.
    """
    ages = normalize_ages(F.col("children_ages"))
    in_range = F.forall(
        F.split(ages, ","), lambda a: (a == "") | a.try_cast("int").between(0, MAX_CHILD_AGE)
    )
    days = F.datediff("date_to", "date_from") + 1
    rules = {
        "date_required": F.col("date_from").isNull() | F.col("date_to").isNull(),
        "range_reversed": days < 1,
        "range_too_long": days > MAX_RANGE_DAYS,
        "adults_invalid": ~F.coalesce(F.col("adults").between(1, MAX_ADULTS), F.lit(False)),
        "ages_invalid": ~in_range,
    }
    rows = requests
    if placements is not None:
        known = placements.select("placement_id").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "placement_id", "left")
        rules["placement_unknown"] = F.col("placement_id").isNotNull() & F.col("_known").isNull()
    failed = F.array(*[F.when(rule, name) for name, rule in rules.items()])
    return rows.select(
        *[c for c in requests.columns if c != "children_ages"],
        ages.alias("children_ages"),
        F.filter(failed, lambda e: e.isNotNull()).alias("errors"),
    )


def valid_stays(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def rejected_stays(checked: DataFrame) -> DataFrame:
    """Refused requests with their reasons."""
    return checked.where(F.size("errors") > 0).select(
        "request_id", "placement_id", F.array_join("errors", ",").alias("errors")
    )


def request_dates(requests: DataFrame) -> tuple[date, date] | None:
    """First and last date of valid requests: what a stored search table is read with."""
    first, last = requests.agg(F.min("date_from"), F.max("date_to")).first()
    return None if first is None else (first, last)


# Requests that one row may hold.
LIST_ROWS = 1000


def request_lists(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests of equal ``keys`` as lists (``ids``) of some ``LIST_ROWS``; ids may be NULL."""
    counted = requests.groupBy(*keys).agg(F.ceil(F.count("*") / LIST_ROWS).alias("_lists"))
    part = F.pmod(F.xxhash64("request_id"), F.col("_lists"))
    return (
        requests.join(counted, keys)
        .groupBy(*keys, part.alias("_list"))
        .agg(F.collect_list(F.struct("request_id")).alias("ids"))
        .drop("_list")
    )


def stay_requests(
    search: DataFrame, requests: DataFrame, salts: int = 16, shown: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Answers many valid stay requests in one pass: request_id plus one row per matching day.

    The search rows are first cut to the requests' dates and occupancies, which reaches the
    scan of the days and the variants. Requests become days (at most 366 each) and join on
    equality. Requests that name a placement join on the full key. The others match every
    placement of a date and occupancy, which are few distinct keys, so search rows spread
    over salts by placement. Requests of one such key are a list, repeated once per salt, which
    is taken apart after the join: the answers, which are many more rows than both inputs, are
    made last and neither shuffled nor sorted. ``shown`` gives the search rows the form that the
    answers are to have (it keeps their columns' names), once a row and not once an answer.
    """
    days = requests.withColumn("date", F.explode(F.sequence("date_from", "date_to"))).select(
        "request_id",
        "placement_id",
        F.unix_date("date").alias("_day"),
        F.col("adults").cast("smallint").alias("adults"),
        "children_ages",
    )
    columns = ["request_id", "placement_id", "date", "available", "price", "currency"]
    travellers = ["adults", "children_ages"]
    rows = search.select("placement_id", "date", *travellers, "available", "price", "currency")
    dates = request_dates(requests)
    if dates is not None:
        rows = in_dates(rows, dates)
    rows = rows.join(days.select(*travellers).distinct(), travellers, "left_semi")
    rows = rows.withColumn("_day", F.unix_date("date"))
    rows = rows if shown is None else shown(rows)

    occupancy = ["_day", *travellers]
    placed = days.where(F.col("placement_id").isNotNull()).join(rows, ["placement_id", *occupancy])

    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("placement_id"), F.lit(salts)).cast("int"))
    anywhere = request_lists(days.where(F.col("placement_id").isNull()), occupancy)
    anywhere = anywhere.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = anywhere.join(spread, [*occupancy, "_salt"]).select(F.inline("ids"), *columns[1:])
    return placed.select(*columns).unionByName(found)
