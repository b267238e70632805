"""Tab-separated exports and JSON-lines loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an export. Short rows are filled up with NULL, surplus fields are cut."""
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
        .csv(path)
    )


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
