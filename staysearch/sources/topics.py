"""Topic sources: one record per message, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staysearch.schemas import RECORD

TOPICS = ("availability", "prices_by_day", "placement_variants")


def read_topic(
    spark: SparkSession,
    topic: str,
    location: str,
    source_format: str = "kafka",
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Records of one topic as (topic, partition, offset, timestamp, value).

    ``kafka``: ``location`` is the broker list and the topic's own offsets order the
    messages (changes of a row share a partition). ``json`` and ``parquet``:
    ``location`` is a folder of files that hold those record columns. Each reader is
    its own consumer: progress lives in the checkpoint of the query that uses it.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(source_format).options(**options)
    if source_format == "kafka":
        records = (
            reader.option("kafka.bootstrap.servers", location).option("subscribe", topic).load()
        )
    else:
        records = reader.schema(RECORD).load(location)
    return records.select(
        F.lit(topic).alias("topic"),
        "partition",
        "offset",
        "timestamp",
        F.col("value").cast("string").alias("value"),
    )


def to_records(
    rows: DataFrame, topic: str, columns: list[str], order: list[str] | None = None
) -> DataFrame:
    """Rows as wire messages, with offsets that follow ``order`` if one is given.

    A range sort followed by ``monotonically_increasing_id`` numbers the rows in
    order on every executor at once.
    """
    ordered = rows if order is None else rows.orderBy(*order)
    message = F.struct(F.lit(None).cast("string").alias("schema"), F.struct(*columns).alias("payload"))
    return ordered.select(
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.to_json(message).alias("value"),
    )
