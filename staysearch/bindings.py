"""The driver's tables seen as inventory: the inputs of the registered queries.

Every line item is one change event: lines with status F change an availability, lines
with status O a price, so that days exist with both, and with either one alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staysearch.functions.wire import wire_currency
from staysearch.operators.latest import latest_by_key
from staysearch.schemas import DAY_KEY, PRICE, VARIANT_KEY
from staysearch.sources.demo import variant_templates
from staysearch.sources.topics import to_records

# Order of log rows: (l_orderkey, l_linenumber) alone repeats.
LOG_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
CURRENCIES = {"A": "USD", "R": "EUR"}  # N rows carry an empty currency
RAW_AGES = ("", "5", "10", "10, 5", "7,3,0")


@dataclass(frozen=True)
class Inventory:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- reference data --------------------------------------------------------

    @cached_property
    def hotels(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("bigint").alias("hotel_id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("city"),
        )

    @cached_property
    def placements(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").cast("bigint").alias("placement_id"),
            F.col("s_nationkey").cast("bigint").alias("hotel_id"),
            F.col("s_name").alias("name"),
        )

    @cached_property
    def variants(self) -> DataFrame:
        return variant_templates(self.placements.where(F.col("placement_id") > 0))

    # -- change logs -----------------------------------------------------------

    def _log(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        shipped = F.col("l_shipdate").cast("timestamp")
        return rows.select(
            F.col("l_suppkey").alias("placement_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            *[column.alias(name) for name, column in values.items()],
            F.timestamp_add("HOUR", F.col("l_linenumber"), shipped).alias("updated_at"),
            *LOG_ORDER,
        )

    @cached_property
    def availability_log(self) -> DataFrame:
        return self._log(
            self.table("lineitem").where(F.col("l_linestatus") == "F"),
            {"available": (F.col("l_returnflag") != "R").cast("smallint")},
        )

    @cached_property
    def price_log(self) -> DataFrame:
        currency = F.lit("")
        for flag, code in CURRENCIES.items():
            currency = F.when(F.col("l_returnflag") == flag, code).otherwise(currency)
        return self._log(
            self.table("lineitem").where(F.col("l_linestatus") == "O"),
            {"price": F.col("l_extendedprice").cast(PRICE), "currency": currency},
        )

    @cached_property
    def variant_log(self) -> DataFrame:
        """Variant changes with raw ages, 0 to 4 adults."""
        raw = F.element_at(F.array(*[F.lit(a) for a in RAW_AGES]), (F.col("l_quantity") % 5 + 1).cast("int"))
        return self._log(
            self.table("lineitem"),
            {
                "adults": (F.col("l_partkey") % 5).cast("smallint"),
                "children_ages": raw,
            },
        ).drop("date")

    # -- latest state ----------------------------------------------------------

    def latest(self, log: DataFrame, keys: list[str]) -> DataFrame:
        usable = log.where(F.col("placement_id") > 0)
        return latest_by_key(usable, keys, LOG_ORDER)

    @cached_property
    def availability(self) -> DataFrame:
        return self.latest(self.availability_log, DAY_KEY)

    @cached_property
    def prices(self) -> DataFrame:
        latest = self.latest(self.price_log, DAY_KEY)
        return latest.withColumn("currency", wire_currency(F.col("currency")))

    # -- requests --------------------------------------------------------------

    @cached_property
    def change_requests(self) -> DataFrame:
        """Orders as bulk changes: priority picks the dates' form, status the kind."""
        orders = self.table("orders")
        day = F.col("o_orderdate").cast("date")
        priority = F.col("o_orderpriority")
        kind = F.when(F.col("o_orderstatus") == "O", "availability").otherwise("price")

        def text(column: Column) -> Column:
            return F.date_format(column, "yyyy-MM-dd")

        starts = priority.isin("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
        return orders.select(
            F.col("o_orderkey").alias("request_id"),
            kind.alias("kind"),
            F.col("o_custkey").alias("placement_id"),
            F.when(priority == "1-URGENT", text(day)).alias("date"),
            F.when(starts, text(day)).alias("date_from"),
            F.when(priority == "2-HIGH", text(F.date_add(day, 9)))
            .when(priority == "3-MEDIUM", text(F.date_add(day, (F.col("o_custkey") % 400).cast("int"))))
            .when(priority == "4-NOT SPECIFIED", text(F.date_add(day, (2 - F.col("o_custkey") % 4).cast("int"))))
            .alias("date_to"),
            F.when(F.col("o_custkey") % 7 == 0, "2")
            .when(F.col("o_custkey") % 7 < 4, "1")
            .otherwise("false")
            .alias("available"),
            (F.col("o_totalprice").cast(PRICE) - 20_000).alias("price"),
            F.when(F.col("o_orderstatus") == "F", "EUR")
            .when(F.col("o_custkey") % 5 == 0, "RU")
            .alias("currency"),
        )

    @cached_property
    def stay_requests(self) -> DataFrame:
        """Orders as stays of up to three nights; urgent ones take any placement."""
        day = F.col("o_orderdate").cast("date")
        placement = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("request_id"),
            placement.alias("placement_id"),
            day.alias("date_from"),
            F.date_add(day, (F.col("o_custkey") % 3).cast("int")).alias("date_to"),
            (F.col("o_custkey") % 5).cast("int").alias("adults"),
            F.when(F.col("o_orderstatus") == "F", "10, 5").when(F.col("o_orderstatus") == "O", "5").otherwise("").alias("children_ages"),
        )

    # -- messages --------------------------------------------------------------

    def records(self, topic: str, ordered: bool = True) -> DataFrame:
        """A topic's messages. Only what keeps the latest row per key needs ordered offsets."""
        logs = {
            "availability": (self.availability_log, ["placement_id", "date", "available"]),
            # Prices travel as text, the way the connector sends decimals.
            "prices_by_day": (
                self.price_log.withColumn("price", F.col("price").cast("string")),
                ["placement_id", "date", "price", "currency"],
            ),
            "placement_variants": (self.variant_log, VARIANT_KEY),
        }
        rows, columns = logs[topic]
        messages = to_records(rows, topic, columns, LOG_ORDER if ordered else None)
        # As a topic deals them out to its partitions, whatever files the rows came from.
        return messages if ordered else messages.repartition(self.spark.sparkContext.defaultParallelism)

    def price_records(self, wanted: Column) -> DataFrame:
        """Messages of the price log's rows that are wanted, with offsets of their own."""
        rows = self.price_log.where(wanted).withColumn("price", F.col("price").cast("string"))
        return to_records(rows, "prices_by_day", ["placement_id", "date", "price", "currency"], LOG_ORDER)

    @cached_property
    def event_records(self) -> DataFrame:
        """The events table as availability changes; ``props`` holds the placement."""
        rows = self.table("events").select(
            F.get_json_object("props", "$.k").alias("placement_id"),
            F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("date"),
            (F.col("event_type") != "error").alias("available"),
            "event_id",
        )
        columns = ["placement_id", "date", "available"]
        return to_records(rows, "availability", columns, ["event_id"])

    @cached_property
    def prose_records(self) -> DataFrame:
        """Documents as messages: what a topic with broken content looks like."""
        return self.table("documents").select(
            F.lit("availability").alias("topic"),
            F.lit(1).alias("partition"),
            F.col("doc_id").alias("offset"),
            F.lit(None).cast("timestamp").alias("timestamp"),
            F.col("text").alias("value"),
        )
