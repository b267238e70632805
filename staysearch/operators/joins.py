"""Joins against reference data that hold up when one key carries much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of rows in memory, which the driver holds several times while it makes the broadcast.
BROADCAST_BYTES = 8 << 20
# What a short row of a broadcast takes there. Sorted keys take a twentieth of it on disk.
ROW_BYTES = 64
SALTS = 32


def hot_keys(keys: DataFrame, key: str, salts: int = SALTS) -> list:
    """Values of ``key`` that more than 1 / ``salts`` of the rows have: fewer than ``salts``."""
    counts = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [row[key] for row in counts.where(F.col("n") > total / salts).collect()]


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "inner",
    size: int | None = None,
    keys: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts to a lookup table on ``key``.

    ``size`` is what the lookup takes in memory, where that is known. Up to ``BROADCAST_BYTES``
    the lookup is broadcast and the facts are not shuffled. Beyond that both sides shuffle
    on the key; only the hot keys, counted over ``keys`` (a frame with the facts' keys that
    is cheaper to read than the facts), are spread over salts, and only their lookup rows are
    repeated. Without a size Spark plans the join by its own statistics.
    """
    if size is None:
        return facts.join(lookup, key, how)
    if size <= BROADCAST_BYTES:
        return facts.join(F.broadcast(lookup), key, how)
    hot = hot_keys(facts if keys is None else keys, key, salts)
    if not hot:
        return facts.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    repeated = lookup.where(is_hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = facts.where(is_hot).withColumn("_salt", salt).join(repeated, [key, "_salt"], how).drop("_salt")
    return facts.where(~is_hot).join(lookup, key, how).unionByName(spread)
