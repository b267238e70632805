"""Latest version per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types a hash aggregate can keep in its buffer; others make Spark sort instead.
FIXED_WIDTH = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)


def latest_by_key(
    df: DataFrame, keys: Sequence[str], version: str | Sequence[str], keep_version: bool = False
) -> DataFrame:
    """One row per key: the one with the highest version (ties are the caller's to rule out).

    Both plans drop superseded rows before the shuffle, so a key that holds a large
    share of the log reaches its reducer as one row per map task: a hash aggregate
    where every column is fixed-width, else a ranked window, which Spark limits to
    the first row per key on the map side. Filters on the key columns pass through
    both plans to the scan.
    """
    order = [version] if isinstance(version, str) else list(version)
    values = [c for c in df.columns if c not in keys and (keep_version or c not in order)]
    needed = df.select(*dict.fromkeys([*keys, *values, *order]))

    fixed = all(isinstance(needed.schema[c].dataType, FIXED_WIDTH) for c in [*values, *order])
    if fixed and len(order) == 1 and values:
        top = F.col(order[0])
        picks = [
            (F.max(top) if c == order[0] else F.max_by(F.col(c), top)).alias(c) for c in values
        ]
        return needed.groupBy(*keys).agg(*picks)

    return _top(needed, keys, [F.col(c).desc() for c in order]).select(*keys, *values)


def latest_in_parts(df: DataFrame, keys: Sequence[str], version: str, parts: int) -> DataFrame:
    """:func:`latest_by_key`, versions kept, in tasks that hold about one of ``parts`` of the rows.

    The plans above hold all rows (or all keys) of a map task's input at once, and stored rows
    take a tenth of the bytes that they take in memory. Here rows are dealt out by key and
    version before anything holds them, and what is left of them by key, so that memory does
    not follow the size of the scan's tasks, and a key that holds much of the log reaches its
    reducer as one row per part.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(version), F.lit(parts))).repartition(parts, *keys, "_part")
    some = latest_by_key(dealt, [*keys, "_part"], version, keep_version=True).drop("_part")
    return latest_by_key(some.repartition(parts, *keys), keys, version, keep_version=True)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the first in ``order``."""
    return _top(df, keys, [F.col(c) for c in order])


def _top(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")
