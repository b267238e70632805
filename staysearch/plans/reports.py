"""Counts, reconciliation, profiles and diagnosis."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

TOP = 10
SAMPLE_DAYS = 3


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; the frames are already one row per key."""
    counts = [
        df.agg(F.count("*").alias("cnt")).select(F.lit(name).alias("entity"), "cnt")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def reconciliation(source: dict[str, DataFrame], analytic: dict[str, DataFrame]) -> DataFrame:
    """Source and analytic counts side by side; entities on one side only show NULL."""
    left = table_counts(source).withColumnRenamed("cnt", "source_cnt")
    right = table_counts(analytic).withColumnRenamed("cnt", "analytic_cnt")
    return left.join(right, "entity", "full").withColumn(
        "diff", F.col("source_cnt") - F.col("analytic_cnt")
    )


def variant_profile(variants: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return variants.agg(
        F.count("*").alias("total_rows"),
        distinct(F.col("placement_id")).cast("bigint").alias("unique_placements"),
        F.min("placement_id").alias("min_placement_id"),
        F.max("placement_id").alias("max_placement_id"),
        F.min("adults").alias("min_adults"),
        F.max("adults").alias("max_adults"),
    )


def variants_by_adults(variants: DataFrame) -> DataFrame:
    return (
        variants.where(F.col("adults") > 0)
        .groupBy("adults")
        .agg(F.count("*").alias("cnt"))
        .orderBy("adults")
        .limit(TOP)
    )


def sample_days(availability: DataFrame, placement_id: int = 1) -> DataFrame:
    """The first days of one placement."""
    return (
        availability.where(F.col("placement_id") == placement_id)
        .select("date", "available", "updated_at")
        .orderBy("date")
        .limit(SAMPLE_DAYS)
    )


def search_by_adults(search: DataFrame, placement_id: int = 1) -> DataFrame:
    return (
        search.where((F.col("placement_id") == placement_id) & (F.col("adults") > 0))
        .groupBy("adults", "available")
        .agg(F.count("*").alias("cnt"))
        .orderBy("adults", "available")
        .limit(TOP)
    )


SKETCH_BITS = 12  # a relative standard error of about 1.6 %


def placement_sketches(rows: DataFrame, period: Column) -> DataFrame:
    """One HLL sketch of the placements of each period: stored, they are merged on read."""
    return rows.groupBy(period.alias("period")).agg(F.hll_sketch_agg("placement_id", SKETCH_BITS).alias("sketch"))


def placements_in(sketches: DataFrame) -> DataFrame:
    """Approximate number of placements over all the given periods' sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("placements"))


def content_cells(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Row count and checksums of each (month, bucket), whatever the rows' order."""
    mark = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return (
        rows.withColumn("_mark", mark)
        .groupBy(*_cell(buckets))
        .agg(
            F.count("*").alias("n"),
            F.bit_xor("_mark").alias("xored"),
            F.sum(F.shiftright("_mark", 16)).alias("added"),
        )
    )


def _cell(buckets: int) -> list[Column]:
    return [
        F.trunc("date", "MM").alias("month"),
        F.pmod(F.xxhash64("placement_id"), F.lit(buckets)).cast("int").alias("bucket"),
    ]


def content_differences(source: DataFrame, analytic: DataFrame, keys: list[str], buckets: int = 8) -> DataFrame:
    """Keys whose rows differ, with the reason; both sides hold one row per key.

    Both are first reduced to checksums of cells. Only the cells that differ are compared row by
    row: equal ones, which should be nearly all, are not exchanged.
    """
    cells = [content_cells(rows, keys, buckets) for rows in (source, analytic)]
    where = ["month", "bucket"]
    left, right = (c.select(*where, F.struct("n", "xored", "added").alias(side)) for c, side in zip(cells, "ab", strict=True))
    differing = left.join(right, where, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*where)

    def kept(rows: DataFrame, side: str) -> DataFrame:
        values = F.struct(*[c for c in sorted(rows.columns) if c not in keys])
        placed = rows.select("*", *_cell(buckets)).join(F.broadcast(differing), where, "left_semi")
        return placed.select(*keys, values.alias(side))

    both = kept(source, "source").join(kept(analytic, "analytic"), keys, "full")
    reason = (
        F.when(F.col("analytic").isNull(), "missing").when(F.col("source").isNull(), "surplus").otherwise("changed")
    )
    return both.where(~F.col("source").eqNullSafe(F.col("analytic"))).select(*keys, reason.alias("reason"))


def quarantine_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "reason").agg(F.count("*").alias("cnt"))


def stream_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Recent micro-batches of a query; Spark itself keeps only the last hundred."""
    rows = [
        (p["name"], p["batchId"], p["numInputRows"], json.dumps([s["endOffset"] for s in p["sources"]]))
        for p in (json.loads(x.json) for x in query.recentProgress)
    ]
    return spark.createDataFrame(
        rows, "name STRING, batch_id BIGINT, input_rows BIGINT, end_offsets STRING"
    )


class ProgressLog(StreamingQueryListener):
    """Keeps every micro-batch's progress as a row of a Parquet table; Spark forgets them."""

    SCHEMA = "name STRING, batch_id BIGINT, input_rows BIGINT, state_rows BIGINT, end_offsets STRING"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = (
            p.name,
            p.batchId,
            p.numInputRows,
            sum(s.numRowsTotal for s in p.stateOperators),
            json.dumps([s.endOffset for s in p.sources]),
        )
        name = f"{p.name}-{p.runId}-{p.batchId}"
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/part={name}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).select("name", "batch_id", "input_rows", "state_rows", "end_offsets")


def diagnosis(
    variants: DataFrame, availability: DataFrame, search: DataFrame, placement_id: int = 1
) -> DataFrame:
    """The parts of :func:`diagnose` as rows: part, what and value."""
    parts = [
        df.select(
            F.lit(name).alias("part"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c != "updated_at"]).alias("what"),
        )
        for name, df in diagnose(variants, availability, search, placement_id).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def diagnose(
    variants: DataFrame, availability: DataFrame, search: DataFrame, placement_id: int = 1
) -> dict[str, DataFrame]:
    return {
        "variants_by_adults": variants_by_adults(variants),
        "sample_days": sample_days(availability, placement_id),
        "search_by_adults": search_by_adults(search, placement_id),
    }
