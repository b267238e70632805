"""Nesting child rows under a parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_of(child_id: Column, pages: int) -> Column:
    """Page of a child within its parent.

    The caller chooses the number of pages, the same for all parents, so that the shape of a
    result does not depend on its size: one page is one row per parent, more pages bound what
    one task gathers of a parent with very many children.
    """
    return F.pmod(F.xxhash64(child_id), F.lit(pages)).cast("int")


def nest(df: DataFrame, by: Sequence[str], items: Sequence[str], alias: str) -> DataFrame:
    """One row per ``by`` with the other columns as a sorted array of structs."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*items))).alias(alias))
