"""Hotel listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.functions.ages import variant_label
from staysearch.operators.joins import lookup_join
from staysearch.operators.nest import nest, page_of


def hotel_placement_counts(hotels: DataFrame, placements: DataFrame) -> DataFrame:
    """Hotels by name with their number of placements, 0 included."""
    counts = placements.groupBy("hotel_id").agg(F.count("*").alias("placements_count"))
    return (
        hotels.join(counts, "hotel_id", "left")
        .select(
            "hotel_id",
            "name",
            "city",
            F.coalesce("placements_count", F.lit(0)).cast("bigint").alias("placements_count"),
        )
        .orderBy("name")
    )


def placement_list(placements: DataFrame, hotels: DataFrame) -> DataFrame:
    """Placements with their hotel's name, by hotel and name."""
    return lookup_join(
        placements,
        hotels.select("hotel_id", F.col("name").alias("hotel_name")),
        "hotel_id",
        ["placement_id"],
        how="left",
    ).orderBy("hotel_id", "name")


def _options(variants: DataFrame) -> DataFrame:
    label = variant_label(F.col("adults"), F.col("children_ages"))
    return variants.select("placement_id", "adults", "children_ages", label.alias("label"))


def hotel_detail(hotels: DataFrame, placements: DataFrame, variants: DataFrame) -> DataFrame:
    """Hotels, their placements and labelled variants; empty hotels and placements stay.

    The empty ones come in by union: the other joins are then inner ones, which can
    spread a hotel or placement that holds much of the data.
    """
    named = hotels.select("hotel_id", F.col("name").alias("hotel_name"))
    directory = lookup_join(
        placements.select("placement_id", "hotel_id", F.col("name").alias("placement_name")),
        named,
        "hotel_id",
        ["placement_id"],
    )
    filled = lookup_join(
        _options(variants), directory, "placement_id", ["adults", "children_ages"]
    )
    with_variants = variants.select("placement_id").distinct()
    bare = directory.join(with_variants, "placement_id", "left_anti")
    empty = named.join(placements.select("hotel_id").distinct(), "hotel_id", "left_anti")
    rows = filled.unionByName(bare, allowMissingColumns=True)
    return rows.unionByName(empty, allowMissingColumns=True)


def placement_variants_nested(placements: DataFrame, variants: DataFrame, pages: int = 1) -> DataFrame:
    """Placements with their variants as an array: one row per placement and page of its
    variants; placements without any keep one row with an empty array."""
    options = _options(variants).withColumn("page", page_of(F.struct("adults", "children_ages"), pages))
    nested = nest(options, ["placement_id", "page"], ["adults", "children_ages", "label"], "variants")
    return placements.join(nested, "placement_id", "left").select(
        "hotel_id",
        "placement_id",
        "name",
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("variants", F.array()).alias("variants"),
    )
