"""Backfill: rows keyed by hotel move to the hotel's first placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staysearch.operators.joins import lookup_join

DEFAULT_PLACEMENT_NAME = "Размещение по умолчанию"  # fixed value
BLOCKS = 256


def block_bounds(ids: DataFrame, column: str, blocks: int = BLOCKS) -> list[int]:
    """Values that cut the ids into at most ``blocks`` ranges of similar size."""
    shares = [i / blocks for i in range(1, blocks)]
    bounds = ids.agg(F.percentile_approx(column, shares).alias("bounds")).first().bounds
    return sorted(set(bounds or []))


def default_placements(hotels: DataFrame, placements: DataFrame) -> DataFrame:
    """A default placement for every hotel that has none, ids following the highest one.

    Ids are dense and in hotel order. Hotels are numbered within ranges of their ids,
    each in its own task; only the count per range is summed up in order.
    """
    missing = hotels.select("hotel_id").join(
        placements.select("hotel_id").distinct(), "hotel_id", "left_anti"
    )
    bounds = F.array(*[F.lit(b) for b in block_bounds(missing, "hotel_id")]).cast("array<bigint>")
    passed = F.filter(bounds, lambda b: b <= F.col("hotel_id"))
    blocked = missing.withColumn("_block", F.size(passed))
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # at most BLOCKS rows
    offsets = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    highest = placements.agg(F.coalesce(F.max("placement_id"), F.lit(0)).alias("_highest"))
    within = Window.partitionBy("_block").orderBy("hotel_id")
    return (
        blocked.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(offsets), "_block")  # at most BLOCKS rows
        .join(F.broadcast(highest))  # one row
        .select(
            (F.col("_highest") + F.col("_offset") + F.col("_n")).cast("bigint").alias("placement_id"),
            "hotel_id",
            F.lit(DEFAULT_PLACEMENT_NAME).alias("name"),
        )
    )


def first_placements(hotels: DataFrame, placements: DataFrame) -> DataFrame:
    """hotel_id → its lowest placement id, default placements included."""
    own = placements.groupBy("hotel_id").agg(F.min("placement_id").alias("placement_id"))
    known = own.join(hotels.select("hotel_id"), "hotel_id", "left_semi")
    added = default_placements(hotels, placements)
    return known.unionByName(added.select("hotel_id", "placement_id"))


def rekey_to_placement(rows: DataFrame, hotels: DataFrame, placements: DataFrame) -> DataFrame:
    """Rows of known hotels with ``hotel_id`` replaced by ``placement_id``."""
    spread = [c for c in rows.columns if c != "hotel_id"]
    moved = lookup_join(
        rows, first_placements(hotels, placements), "hotel_id", spread
    )
    return moved.select("placement_id", *spread)
