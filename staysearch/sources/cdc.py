"""Change events → typed rows, with a reason for every event that is not usable.

An event is decoded once, right after it is read; nothing downstream parses JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staysearch.functions.wire import wire_currency, wire_date, wire_flag, wire_id, wire_price
from staysearch.functions.ages import normalize_ages
from staysearch.schemas import MAX_ADULTS

FIELDS = ["placement_id", "date", "available", "price", "currency", "adults", "children_ages"]

_MESSAGE = "schema STRING, payload STRING, _corrupt STRING"


def _payload(fields: Sequence[str]) -> str:
    """A payload's members. All are read as text: the wire carries numbers, quoted numbers and
    dates alike."""
    row = ", ".join(f"{field}: STRING" for field in fields)
    return f"{row}, op: STRING, after: STRUCT<{row}>"


_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

GENERATION_BITS = 48
# A moment's version: milliseconds since 2000 above the low bits of an offset. Two versions
# add up without overflow for 139 years.
OFFSET_BITS = 20
VERSION_EPOCH_MS = 946_684_800_000


def event_version(offset: Column, generation: int = 0, timestamp: Column | None = None) -> Column:
    """Version of an event: the moment its record was written, then its offset.

    Offsets count within a partition only, so they order records of one millisecond and no
    others: a key that moves to another partition keeps growing versions. Records without a
    timestamp are versioned by their offset alone, in the numbering of the topic's
    generation; such a topic must have one partition, and its replay after a new snapshot
    runs with the next generation.
    """
    numbered = F.lit(snapshot_version(generation)) + offset + F.lit(1)
    if timestamp is None:
        return numbered
    return F.coalesce(moment_version(timestamp) + F.pmod(offset, F.lit(1 << OFFSET_BITS)), numbered)


def moment_version(timestamp: Column) -> Column:
    """The lowest version of records written at this moment."""
    return F.shiftleft(F.unix_millis(timestamp) - F.lit(VERSION_EPOCH_MS), OFFSET_BITS)


def snapshot_version(generation: int = 0) -> int:
    """Version of rows loaded as a snapshot: below all events of their generation.

    Never 0, which stands for "absent" where versions of two sides are added.
    """
    return (generation << GENERATION_BITS) + 1


def _once(parsed: Column) -> Column:
    """A parse that runs once per row.

    Filters on its fields would otherwise be pushed below the projection, each with a
    parse of its own; they stop at a generator.
    """
    return F.explode(F.array(parsed))


def unwrap(records: DataFrame, generation: int = 0, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """After-image of every message: the fields as text, ``payload`` and ``corrupt``.

    Accepts flat payloads and before/after envelopes. Tombstones and deletes are
    dropped, as deletes do not reach the analytic side. A topic's own ``fields`` make the
    parse shorter; the others are then NULL.
    """
    timestamp = F.col("timestamp") if "timestamp" in records.columns else None
    # The whole message at once, for payloads that are objects.
    nested = f"payload STRUCT<{_payload(fields)}>, _corrupt STRING"
    message = records.where(F.col("value").isNotNull()).select(
        "topic",
        "value",
        event_version(F.col("offset"), generation, timestamp).alias("version"),
        _once(F.from_json("value", nested, _OPTIONS)).alias("whole"),
    )
    # Quoted payloads and messages that do not fit are parsed again, step by step.
    fits = F.col("whole").isNotNull() & F.col("whole._corrupt").isNull() & F.col("whole.payload").isNotNull()
    text = F.from_json("value", _MESSAGE, _OPTIONS)
    quoted = F.from_json(text["payload"], f"STRUCT<{_payload(fields)}, _corrupt: STRING>", _OPTIONS)
    rows = message.select(
        "topic",
        "value",
        "version",
        fits.alias("fits"),
        F.when(fits, F.col("whole.payload")).alias("object"),
        _once(F.when(~fits, F.struct(text.alias("message"), quoted.alias("row")))).alias("odd"),
    )
    live = rows.where(F.coalesce(F.col("object.op"), F.col("odd.row.op"), F.lit("")) != "d")
    broken = (
        F.col("odd.message").isNull()
        | F.col("odd.message._corrupt").isNotNull()
        | F.col("odd.row._corrupt").isNotNull()
    )
    sides = ("object", "object.after", "odd.row", "odd.row.after")
    return live.select(
        "topic",
        "version",
        # Only quarantined rows show their payload; others never compute it.
        F.coalesce(F.when(F.col("fits"), text["payload"]).otherwise(F.col("odd.message.payload")), "value").alias("payload"),
        (~F.col("fits") & F.coalesce(broken, F.lit(False))).alias("corrupt"),
        *[
            (F.coalesce(*[F.col(f"{side}.{f}") for side in sides]) if f in fields else F.lit(None).cast("string")).alias(f)
            for f in FIELDS
        ],
    )


def _decoded(events: DataFrame, source: str, columns: dict[str, Column], reason: Column) -> DataFrame:
    key = wire_id(F.col("placement_id"))
    typed = events.select(
        F.lit(source).alias("source"),
        key.alias("placement_id"),
        *[column.alias(name) for name, column in columns.items()],
        F.current_timestamp().alias("updated_at"),
        "version",
        "payload",
        "corrupt",
    )
    return typed.withColumn(
        "reason",
        F.when(F.col("corrupt"), "corrupt")
        .when(F.col("placement_id").isNull() | (F.col("placement_id") <= 0), "bad_key")
        .otherwise(reason),
    ).drop("corrupt")


def decode_availability(events: DataFrame) -> DataFrame:
    columns = {
        "date": wire_date(F.col("date")),
        "available": wire_flag(F.col("available")),
    }
    return _decoded(events, "availability", columns, F.when(F.col("date").isNull(), "bad_date"))


def decode_prices(events: DataFrame) -> DataFrame:
    columns = {
        "date": wire_date(F.col("date")),
        "price": wire_price(F.col("price")),
        "currency": wire_currency(F.col("currency")),
    }
    reason = F.when(F.col("date").isNull(), "bad_date").when(F.col("price").isNull(), "bad_price")
    return _decoded(events, "prices_by_day", columns, reason)


def decode_variants(events: DataFrame) -> DataFrame:
    """Variants without adults are not search options and are left out."""
    columns = {
        "adults": F.coalesce(F.col("adults").try_cast("int"), F.lit(0)).cast("int"),
        "children_ages": normalize_ages(F.col("children_ages")),
    }
    reason = F.when(F.col("adults") > MAX_ADULTS, "bad_adults")
    decoded = _decoded(events, "placement_variants", columns, reason)
    return decoded.where(F.col("reason").isNotNull() | (F.col("adults") > 0)).withColumn(
        "adults", F.col("adults").try_cast("smallint")
    )


# What each topic's payload has.
TOPIC_FIELDS = {
    "availability": ("placement_id", "date", "available"),
    "prices_by_day": ("placement_id", "date", "price", "currency"),
    "placement_variants": ("placement_id", "adults", "children_ages"),
}

DECODERS = {
    "availability": decode_availability,
    "prices_by_day": decode_prices,
    "placement_variants": decode_variants,
}


def decoded(records: DataFrame, topic: str, generation: int = 0) -> DataFrame:
    """A topic's messages as typed rows, with a ``reason`` for those that are not usable."""
    return DECODERS[topic](unwrap(records, generation, TOPIC_FIELDS[topic]))


def usable(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).drop("source", "payload", "reason")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNotNull()).select(
        "source",
        F.coalesce("placement_id", F.lit(0)).cast("bigint").alias("placement_id"),
        "payload",
        "reason",
        F.col("updated_at").alias("ts"),
    )
