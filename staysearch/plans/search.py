"""The search table: one row per placement, date and occupancy variant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staysearch.operators.joins import lookup_join
from staysearch.operators.latest import latest_by_key
from staysearch.schemas import DAY_KEY, DAY_STATE, DEFAULT_CURRENCY, PRICE, SEARCH


def _side(df: DataFrame, values: list[str], tag: str) -> DataFrame:
    stamps = [F.col(c).alias(f"{tag}_{c}") for c in ("updated_at", "version")]
    return df.select(*DAY_KEY, *values, *stamps)


def _greatest(*columns: Column) -> Column:
    return F.greatest(*columns)  # skips NULLs


def day_state(availability: DataFrame, prices: DataFrame, how: str) -> DataFrame:
    """Availability and price of each (placement, date), from the latest rows of both.

    ``left``: days with availability, price 0 where there is none. ``right``: days
    with a price, unavailable where nothing says otherwise. ``full``: both.
    Versions add up: each side's version only grows, so a later state of a day always
    carries a higher version than an earlier one, whatever changed.
    """
    joined = _side(availability, ["available"], "a").join(
        _side(prices, ["price", "currency"], "p"), DAY_KEY, how
    )
    return joined.select(
        *DAY_KEY,
        F.coalesce("available", F.lit(0)).cast("smallint").alias("available"),
        F.coalesce("price", F.lit(0).cast(PRICE)).alias("price"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        _greatest(F.col("a_updated_at"), F.col("p_updated_at")).alias("updated_at"),
        (F.coalesce("a_version", F.lit(0)) + F.coalesce("p_version", F.lit(0))).alias("version"),
    )


def fan_out(
    days: DataFrame, variants: DataFrame, size: int | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Every day of a placement times every variant of that placement.

    Runs last, on collapsed and joined days, so that no shuffle sees the multiplied
    rows. ``size`` is what the variants take in memory; ``keys`` has the days' placements.
    """
    options = variants.where(F.col("adults") > 0).select("placement_id", "adults", "children_ages")
    rows = lookup_join(days, options, "placement_id", ["date"], size=size, keys=keys)
    folders = [c for c in ("period", "bucket") if c in days.columns]
    return rows.select(*SEARCH.fieldNames(), *folders)


def with_options(days: DataFrame, variants: DataFrame, size: int, keys: DataFrame | None = None) -> DataFrame:
    """The days with their placement's variants as one sorted list, ``options``: what
    :func:`take_options` makes rows of once the days lie where they are to be written."""
    options = variants.where(F.col("adults") > 0).groupBy("placement_id")
    lists = options.agg(F.sort_array(F.collect_list(F.struct("adults", "children_ages"))).alias("options"))
    return lookup_join(days, lists, "placement_id", ["date"], size=size, keys=keys)


# Kinds of occupancy that a table's rows may have to be read as days with bits, 64 in a number.
MOST_KINDS, WORD = 512, 64


class OccupancyBits:
    """The occupancies (adults, children_ages) that there are, each with a number: those of a day
    or a placement are then a few numbers' bits (``_bits0`` and on), which no list or sort is
    needed for. There are few kinds, however many placements have them."""

    def __init__(self, spark: SparkSession, kinds: list[tuple[int, str | None]]) -> None:
        self.kinds = sorted(kinds, key=lambda k: (k[0], k[1] is not None, k[1] or ""))
        self.names = [f"_bits{w}" for w in range(max(1, -(-len(kinds) // WORD)))]
        table = [(adults, ages, i // WORD, _bit(i % WORD)) for i, (adults, ages) in enumerate(self.kinds)]
        self._table = spark.createDataFrame(table, "_adults smallint, _ages string, _word int, _bit bigint")

    def gathered(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """One row per ``keys`` with the bits of its occupancies."""
        same = F.col("adults").eqNullSafe(F.col("_adults")) & F.col("children_ages").eqNullSafe(F.col("_ages"))
        own = [F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(0)).alias(name) for w, name in enumerate(self.names)]
        return rows.join(F.broadcast(self._table), same).groupBy(*keys).agg(*own)

    def latest(self, states: DataFrame) -> DataFrame:
        """Of each day's states, those bits that no later state of the day has."""
        later = Window.partitionBy(*DAY_KEY).orderBy(F.col("version").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return states.withColumns(
            {n: F.col(n).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(n).over(later), F.lit(0)))) for n in self.names}
        )

    def rows(self, states: DataFrame) -> DataFrame:
        """A row for each bit."""
        kinds = [F.struct(F.lit(n).cast("smallint").alias("adults"), F.lit(a).cast("string").alias("children_ages")) for n, a in self.kinds]

        def chosen(w: int, bits: Column) -> Column:
            return F.filter(F.array(*kinds[w * WORD : (w + 1) * WORD]), lambda _, i: F.getbit(bits, i) == 1)

        parts = [chosen(w, F.col(name)) for w, name in enumerate(self.names)]
        return states.select(*DAY_STATE.fieldNames(), F.inline(F.concat(*parts))).select(*SEARCH.fieldNames())


def _bit(i: int) -> int:
    return 1 << i if i < WORD - 1 else -(1 << i)


def occupancy_bits(*frames: DataFrame) -> OccupancyBits | None:
    """Numbers for the occupancies of all frames; None if there are none or too many kinds."""
    pairs = reduce(DataFrame.unionByName, [f.select("adults", "children_ages") for f in frames])
    found = pairs.distinct().limit(MOST_KINDS + 1).collect()
    return OccupancyBits(pairs.sparkSession, [tuple(r) for r in found]) if 0 < len(found) <= MOST_KINDS else None


def take_options(days: DataFrame) -> DataFrame:
    """The rows that :func:`fan_out` gives, in the order of the days."""
    folders = [c for c in ("period", "bucket") if c in days.columns]
    return days.select("*", F.inline("options")).select(*SEARCH.fieldNames(), *folders)


def build_search(
    variants: DataFrame,
    availability: DataFrame,
    prices: DataFrame,
    how: str = "left",
    size: int | None = None,
) -> DataFrame:
    """Search rows from the latest variants, availability and prices.

    ``how="left"`` is the rebuild: it starts from availability. ``how="full"`` is
    what incremental maintenance converges to: days that only have a price are there,
    unavailable.
    """
    return fan_out(day_state(availability, prices, how), variants, size)


def build_search_from_feeds(
    variants: DataFrame, availability: DataFrame, prices: DataFrame, size: int | None = None
) -> DataFrame:
    """The incremental table as its two writers produce it: both feeds' rows, latest per key."""
    days = day_state(availability, prices, "left").unionByName(
        day_state(availability, prices, "right")
    )
    return fan_out(latest_by_key(days, DAY_KEY, "version", keep_version=True), variants, size)


def recompute_days(touched: DataFrame, availability: DataFrame, prices: DataFrame) -> DataFrame:
    """State of the touched (placement, date) keys.

    ``availability`` and ``prices`` hold few rows per key, the latest among them, and are cut
    down to what was touched before they are collapsed.
    """

    def current(rows: DataFrame) -> DataFrame:
        hit = rows.join(touched, DAY_KEY, "left_semi")
        return latest_by_key(hit, DAY_KEY, "version", keep_version=True)

    return day_state(current(availability), current(prices), "full")
