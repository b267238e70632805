"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of all linked nodes but the roots.

    ``links`` has the columns a and b. Each round attaches all larger neighbours of a node,
    then all its smaller ones, to its smallest neighbour; the number of rounds grows with the
    logarithm of the longest path. Rounds are written to the shared folder.
    """
    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = _state(edges)
    while True:
        both = edges.selectExpr("u AS x", "v AS y").unionAll(edges.selectExpr("v AS x", "u AS y"))
        least = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, F.col("x") == F.col("node")).where("y > x").selectExpr("y AS u", "m AS v").distinct()
        low = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("node")).where("v <> m").selectExpr("v AS u", "m AS v")
        edges = saved(small.unionAll(low.selectExpr("node AS u", "m AS v")).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            return edges.selectExpr("u AS node", "v AS component")
