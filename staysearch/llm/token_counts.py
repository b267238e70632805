"""Token counts for every context limit from one exact histogram of encoded lengths.

Documents are reduced to their encoded length and counted by it. Suffix sums of the histogram
answer, for any limit L, how many documents and tokens there are, how many documents are
longer, and how many tokens remain if every document is truncated at L. The sums are taken in
two levels (spans of lengths, then within a span), so no task holds the whole histogram.

Nulls and empty texts have length 0; a table without rows has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staysearch.llm.bpe import coder
from staysearch.llm.common import freeing, saved, text_blocks

SPAN = 1024


def lengths(docs: DataFrame, definition: str) -> DataFrame:
    """length and n_docs per Arrow batch: texts are counted where they are read."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, units = coder(definition)
        for batch in batches:
            counts = [units.counts(offsets, data) for _, _, offsets, data in text_blocks(batch.column(0))]
            if counts:
                length, n = np.unique(np.concatenate(counts), return_counts=True)
                yield pa.record_batch([pa.array(length), pa.array(n.astype(np.int64))], ["length", "n_docs"])

    return docs.select("text").mapInArrow(freeing(step), "length long, n_docs long")


def histogram(docs: DataFrame, definition: str) -> DataFrame:
    return lengths(docs, definition).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counted: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length that occurs, as a limit: documents and tokens at least that long, all
    documents and tokens, the tokens left after truncation at it, and the share of documents
    that fit."""
    rows = counted.select(
        "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("length") / span).alias("span"),
    )
    whole = Window.orderBy(F.col("span").desc())
    # One row a span of lengths: the longest document's length / 1024.
    above = rows.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        F.col("span"),
        (F.sum("d").over(whole) - F.col("d")).alias("docs_above"),
        (F.sum("t").over(whole) - F.col("t")).alias("tokens_above"),
        F.sum("d").over(Window.partitionBy()).alias("total_docs"),
        F.sum("t").over(Window.partitionBy()).alias("total_tokens"),
    )
    inside = Window.partitionBy("span").orderBy(F.col("length").desc())
    summed = rows.join(above, "span").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("tokens_above")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return summed.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias(
            "truncated_tokens"
        ),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_fitting"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit_tokens, docs that are longer, and truncated totals for any limits.

    The rows at or above a limit decide: the shortest of them carries its suffix sums.
    """
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(x,) for x in limits], "limit_tokens long")
    total = sums.groupBy().agg(F.max("total_tokens").alias("total_tokens"), F.max("total_docs").alias("total_docs"))
    first = (
        sums.join(F.broadcast(wanted), F.col("length") > F.col("limit_tokens"))
        .groupBy("limit_tokens")
        .agg(F.max("docs_at_least").alias("longer"), F.max("tokens_at_least").alias("longer_tokens"))
    )
    return (
        wanted.join(first, "limit_tokens", "left")
        .join(F.broadcast(total))
        .select(
            "limit_tokens",
            F.coalesce("longer", F.lit(0)).alias("docs_longer"),
            (
                F.col("total_tokens")
                - F.coalesce("longer_tokens", F.lit(0))
                + F.col("limit_tokens") * F.coalesce("longer", F.lit(0))
            ).alias("truncated_tokens"),
            "total_docs",
            "total_tokens",
        )
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and the shortest length that at least this share of documents fits into."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return (
        sums.join(F.broadcast(wanted), F.col("share_fitting") >= F.col("share"))
        .groupBy("share")
        .agg(F.min("length").alias("length"))
    )


def count_report(docs: DataFrame, definition: str) -> DataFrame:
    return suffix_sums(saved(histogram(docs, definition), "lengths"))
