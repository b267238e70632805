"""Bulk changes: validation, expansion to days, upsert and insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staysearch.functions.wire import iso_date, wire_currency, wire_flag
from staysearch.operators.joins import lookup_join
from staysearch.operators.latest import first_by_key, latest_by_key
from staysearch.schemas import MAX_RANGE_DAYS, PRICE

FLAGS = ("0", "1", "true", "false")


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def validate_changes(requests: DataFrame, placements: DataFrame) -> DataFrame:
    """Requests with parsed values and ``errors``, an array that is empty for valid ones.

    A request names one date or an inclusive range of at most 366 days; a date wins
    over a range given with it. Availability requests need a flag, price requests a
    non-negative price and, if any, a three-letter currency.
    """
    known = placements.select("placement_id").distinct().withColumn("_known", F.lit(True))
    checked = lookup_join(
        requests, known, "placement_id", ["request_id"], how="left"
    )

    one, first, last = _text("date"), _text("date_from"), _text("date_to")
    given = {"date": one, "date_from": first, "date_to": last}
    flag = F.lower(_text("available"))
    is_price = F.col("kind") == "price"

    def bad_format(text: Column) -> Column:
        return text.isNotNull() & iso_date(text).isNull()

    days = F.datediff(iso_date(last), iso_date(first)) + 1
    rules = {
        "placement_unknown": F.col("_known").isNull(),
        "date_required": one.isNull() & (first.isNull() | last.isNull()),
        "date_format": bad_format(one) | bad_format(first) | bad_format(last),
        "range_reversed": iso_date(last) < iso_date(first),
        "range_too_long": days > MAX_RANGE_DAYS,
        "available_invalid": ~is_price & ~F.coalesce(flag.isin(*FLAGS), F.lit(False)),
        "price_invalid": is_price & ~F.coalesce(F.col("price") >= 0, F.lit(False)),
        "currency_invalid": is_price & (F.length(_text("currency")) != 3),
    }
    errors = F.filter(
        F.array(*[F.when(failed, name) for name, failed in rules.items()]), lambda e: e.isNotNull()
    )
    return checked.select(
        "request_id",
        "kind",
        "placement_id",
        *[iso_date(text).alias(name) for name, text in given.items()],
        F.when(~is_price, wire_flag(flag)).alias("available"),
        F.when(is_price, F.col("price").cast(PRICE)).alias("price"),
        F.when(is_price, wire_currency(F.col("currency"))).alias("currency"),
        errors.alias("errors"),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0).select(
        "request_id", "kind", "placement_id", F.array_join("errors", ",").alias("errors")
    )


def request_days(changes: DataFrame) -> Column:
    """The days of an accepted request, at most 366."""
    # A reversed sequence would count down, hence the guard even after validation.
    span = F.when(F.col("date_from") <= F.col("date_to"), F.sequence("date_from", "date_to"))
    return F.when(F.col("date").isNotNull(), F.array("date")).otherwise(span)


def expand_days(changes: DataFrame) -> DataFrame:
    """One row per accepted request and day."""
    days = changes.withColumn("_days", request_days(changes)).drop("date", "date_from", "date_to")
    return days.withColumn("date", F.explode("_days")).drop("_days")


def receipts(changes: DataFrame) -> DataFrame:
    """What each accepted request touched: number of days, and the days."""
    days = request_days(changes)
    return changes.select(
        "request_id", "kind", "placement_id", F.size(days).alias("count"), days.alias("dates")
    )


def upsert(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str | Sequence[str]
) -> DataFrame:
    """Current rows with the changes applied; among changes of one key the last in ``order`` wins.

    ``current`` holds one row per key.
    """
    values = current.columns
    final_changes = latest_by_key(changes.select(*dict.fromkeys([*values, *_list(order)])), keys, order)
    both = (
        current.withColumn("_generation", F.lit(0))
        .unionByName(final_changes.select(*values).withColumn("_generation", F.lit(1)))
    )
    return latest_by_key(both, keys, "_generation").select(*values)


def insert_if_absent(
    current: DataFrame, rows: DataFrame, keys: Sequence[str], order: str | Sequence[str]
) -> DataFrame:
    """Rows to append: keys that ``current`` lacks, each once, the first in ``order``."""
    absent = rows.join(current.select(*keys).distinct(), list(keys), "left_anti")
    return first_by_key(absent, keys, _list(order)).select(*rows.columns)


def _list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)
