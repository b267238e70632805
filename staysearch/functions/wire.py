"""Decoding of single wire fields. Every function takes the field's text and never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staysearch.schemas import DEFAULT_CURRENCY, PRICE

# Fixed: the range of days that the analytic store can hold, and its last day's number.
EPOCH, LAST_DAY, LAST_DAY_NUMBER = "1970-01-01", "2149-06-06", 65535


def wire_id(text: Column) -> Column:
    return text.try_cast("bigint")


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` and nothing else: a plain cast would read "20514" as a year."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def wire_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or days since the epoch, 1970 to 2149; anything else is NULL."""
    number = text.try_cast("int")
    number = F.when(number.between(0, LAST_DAY_NUMBER), number)
    named = iso_date(text)
    named = F.when(named.between(F.lit(EPOCH).cast("date"), F.lit(LAST_DAY).cast("date")), named)
    return F.coalesce(named, F.date_add(F.lit(EPOCH).cast("date"), number))


def wire_price(text: Column) -> Column:
    """Price text or number; a missing price is 0, unreadable text is NULL."""
    text = F.nullif(F.trim(text), F.lit(""))
    return F.when(text.isNull(), F.lit(0).cast(PRICE)).otherwise(text.try_cast(PRICE))


def wire_currency(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(DEFAULT_CURRENCY))


def wire_flag(text: Column) -> Column:
    """0/1, "0"/"1", true/false → 0 or 1; missing or unreadable is 0."""
    number = text.try_cast("int")
    flag = F.coalesce(number != 0, text.try_cast("boolean"), F.lit(False))
    return flag.cast("smallint")


def update_version(updated_at: Column) -> Column:
    """Version of a row from its update time, in milliseconds."""
    return F.unix_millis(updated_at)
