"""The engine's tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staysearch.operators.joins import BROADCAST_BYTES, ROW_BYTES, lookup_join
from staysearch.plans.search import fan_out, occupancy_bits, take_options, with_options
from staysearch.schemas import (
    AVAILABILITY,
    DAY_KEY,
    DAY_STATE,
    PRICES,
    QUARANTINE,
    SEARCH,
    SEARCH_KEY,
    VARIANT_KEY,
    VARIANTS,
)
from staysearch.sources.state import VersionedTable


class SearchTable(VersionedTable):
    """The search rows. Changes are kept as days: they meet the variants when they are read or
    folded, so that a batch of a stream writes a row a day, not one a day and variant."""

    def __init__(self, store: Store, period: str, buckets: int) -> None:
        super().__init__(
            store.spark,
            f"{store.root}/search_by_variant",
            SEARCH,
            SEARCH_KEY,
            period=period,
            buckets=buckets,
            changes=(DAY_STATE, DAY_KEY),
            expand=self._expanded,
        )
        self.variants = store.variants

    def _variants_size(self) -> int:
        return max(self.variants.stored_bytes(), ROW_BYTES * self.variants.stored_rows())

    def _expanded(self, days: DataFrame) -> DataFrame:
        return fan_out(days, self.variants.latest(), self._variants_size())

    def _merged(self, rows: DataFrame, changes: DataFrame, few: bool, tasks: int) -> DataFrame:
        """With many changes the stored rows are put together to days again where they are read,
        and days meet: no shuffle sees the multiplied rows."""
        options = self.variants.latest().where(F.col("adults") > 0)
        bits = None if few else occupancy_bits(options, rows)
        if bits is None:
            return super()._merged(rows, changes, few, tasks)
        columns = self.change_schema.fieldNames()
        offered = bits.gathered(options, ["placement_id"])
        changed = lookup_join(
            self._collapsed(changes, tasks).select(*columns), offered, "placement_id", ["date"], size=self._variants_size(), keys=changes
        )
        stored = bits.gathered(rows, columns)
        return bits.rows(bits.latest(stored.unionByName(changed)))

    def multiplied(self, days: DataFrame, keys: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
        """Days in the order of the files, then times the variants: the multiplied rows are
        neither shuffled nor sorted. Variants of more than ``most`` bytes in memory are not broadcast but
        come to the days as a list, before the days are put in order. ``keys`` has the days'
        placements and dates."""
        variants, size = self.variants.latest(), self._variants_size()
        weights = variants.where(F.col("adults") > 0).groupBy("placement_id").agg(F.count("*").alias("weight"))
        if size <= most:
            return fan_out(self.arrange_weighted(days, keys, weights), variants, size)
        return take_options(self.arrange_weighted(with_options(days, variants, size, keys), keys, weights))

    def arranged_changes(self, changes: DataFrame, tasks: int = 1) -> DataFrame:
        days = self._collapsed(changes, tasks)
        return self.multiplied(days, days, BROADCAST_BYTES)


class Store:
    """Finals, the search table and the quarantine log.

    ``period`` (year, month or day) and ``buckets`` (by placement) set the folders of
    the dated tables; pick them so that a folder holds some gigabytes. Files are in key
    order: the rows of a day's variants are neighbours, which Parquet stores in a
    fraction of the space.
    """

    def __init__(self, spark: SparkSession, root: str, period: str = "month", buckets: int = 1) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.variants = VersionedTable(spark, f"{self.root}/placement_variants", VARIANTS, VARIANT_KEY)
        self.availability = VersionedTable(
            spark, f"{self.root}/availability_final", AVAILABILITY, DAY_KEY, period=period, buckets=buckets
        )
        self.prices = VersionedTable(spark, f"{self.root}/prices_by_day_final", PRICES, DAY_KEY, period=period, buckets=buckets)
        self.search = SearchTable(self, period, buckets)
        self.quarantine = VersionedTable(spark, f"{self.root}/quarantine", QUARANTINE, [])

    def final(self, topic: str) -> VersionedTable:
        return {
            "availability": self.availability,
            "prices_by_day": self.prices,
            "placement_variants": self.variants,
        }[topic]

    def quarantine_log(self) -> DataFrame:
        return self.quarantine.log()
