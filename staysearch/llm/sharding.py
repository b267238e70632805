"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours. A
splitter is a key prefix that is refined round by round: each round counts the exact bytes
of every 10-bit bin inside the prefixes that are still open, and puts the splitter at the
bin edge nearest its target if that is within the tolerance. What cannot be met inside the
text's hash (a large group of copies) is refined through the id's hash. The histograms
have at most ``shards * 1024`` rows, whatever the input. The documents are exchanged once,
after all splitters are known.

Nulls: a null text has no bytes, a null id hashes as a value of its own. Repeated rows have
equal keys and stay together. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staysearch.llm.common import saved

BITS = 10
BINS = 1 << BITS
LEVELS = 12  # six digits of 10 bits from each of the two hashes
HOT_SHARE = 256


@dataclass(frozen=True)
class Splitter:
    """Rows whose key is smaller than ``digits``, padded with zeros, lie below it."""

    digits: tuple[int, ...]
    below: int

    def halves(self) -> tuple[int, int]:
        """The first key of the shard above, in the two 60-bit halves of a key."""
        padded = (*self.digits, *[0] * (LEVELS - len(self.digits)))
        return divmod(_number(padded), 1 << (BITS * LEVELS // 2))


def _digit(level: int) -> Column:
    half = LEVELS // 2
    shift = BITS * (half - 1 - level % half)
    return F.shiftright(F.col("k1" if level < half else "k2"), shift).bitwiseAND(F.lit(BINS - 1)).cast("int")


def _number(digits: tuple[int, ...]) -> int:
    whole = 0
    for d in digits:
        whole = whole * BINS + d
    return whole


def _key(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BITS * LEVELS // 2)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, checksum and sort key of each document."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        _key(raw).alias("k1"),
        _key(F.lit(4), F.col(doc_id).cast("long")).alias("k2"),
    )


def splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[Splitter], list[int]]:
    """``shards - 1`` splitters and the first-digit bins that hold a hot group.

    ``tolerance`` is a share of the ideal shard size. One job a round; a round's result has
    at most one prefix for each open splitter, times 1024 bins.
    """
    histogram = keys.groupBy(_digit(0).alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    total, rows = sum(r.b for r in histogram), sum(r.n for r in histogram)
    hot = sorted(r.d for r in histogram if r.n > 4 and r.n * HOT_SHARE > rows)
    allowed = tolerance * total / shards
    found: dict[int, Splitter] = {}
    todo = {i: ((), 0) for i in range(1, shards)}
    bins = {(): {r.d: (r.b, r.n) for r in histogram}}
    for level in range(LEVELS):
        for i, (prefix, below) in list(todo.items()):
            target = total * i / shards
            best, at = None, below
            inside, alone = below, False
            for d in [*sorted(bins.get(prefix, {})), BINS]:
                # The edge before bin d; the last edge closes the prefix.
                if best is None or abs(inside - target) < abs(best.below - target):
                    best = Splitter((*prefix, d), inside)
                size, n = bins.get(prefix, {}).get(d, (0, 0))
                if inside <= target < inside + size:
                    todo[i], alone = ((*prefix, d), inside), n == 1
                inside += size
            if abs(best.below - target) <= allowed or alone or level == LEVELS - 1 or len(todo[i][0]) == level:
                found[i] = best
                del todo[i]
        if not todo:
            break
        half = LEVELS // 2
        depth = level + 1
        # The open prefixes as numbers: of the first key, and of the second one below it.
        open_ = {p: (_number(p[:half]), _number(p[half:])) for p, _ in todo.values()}
        high = F.shiftright("k1", BITS * (half - min(depth, half)))
        low = F.shiftright("k2", BITS * (LEVELS - depth)) if depth > half else F.lit(0).cast("long")
        counted = (
            keys.select(high.alias("high"), low.alias("low"), _digit(depth).alias("d"), "size")
            .where(F.col("high").isin(sorted({x for x, _ in open_.values()})))
            .where(F.col("low").isin(sorted({x for _, x in open_.values()})))
            .groupBy("high", "low", "d")
            .agg(F.sum("size").alias("b"), F.count("*").alias("n"))
            .collect()
        )
        bins = {p: {r.d: (r.b, r.n) for r in counted if (r.high, r.low) == number} for p, number in open_.items()}
    return [found[i] for i in sorted(found)], hot


def _shard(edges: list[Splitter]) -> Column:
    """The number of splitters at or below a row's key."""
    shard = F.lit(0)
    for edge in edges:
        high, low = edge.halves()
        above = (F.col("k1") > high) | ((F.col("k1") == high) & (F.col("k2") >= low))
        shard = shard + above.cast("int")
    return shard.cast("int")


def sharded(docs: DataFrame, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document.

    Within a shard, slots follow the key order bin by bin. A slot is the number of rows in
    earlier cells of the shard plus the rank within the cell; cells are first-digit bins, and
    those that hold a hot group are split by the id's hash, so no task numbers a whole shard.
    """
    keys = saved(keyed(docs), "shard-keys")
    edges, hot = splitters(keys, shards, tolerance)
    part = F.when(_digit(0).isin(hot), _digit(LEVELS // 2) + 1).otherwise(0) if hot else F.lit(0)
    cells = keys.select("*", _shard(edges).alias("shard"), (_digit(0) * (BINS + 1) + part).cast("int").alias("cell"))
    before = (
        cells.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select(
            "shard",
            "cell",
            (
                F.sum("n").over(
                    Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
                )
                - F.col("n")
            ).alias("before"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k1", "k2", "doc_id", "text_crc32"))
    return (
        cells.withColumn("rank", rank - 1)
        # At most 1024 bins and the split hot ones: a bounded side.
        .join(F.broadcast(before), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))
    )


def arranged(docs: DataFrame, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """The documents themselves with ``shard``, for writing one folder a shard; the only
    exchange of whole rows. Input columns of that name are replaced."""
    edges, _ = splitters(saved(keyed(docs), "shard-keys"), shards, tolerance)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.struct("*").alias("doc"), _key(raw).alias("k1"), _key(F.lit(4), F.col("doc_id").cast("long")).alias("k2")
    ).withColumn("shard", _shard(edges))
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "shard"]
    return rows.repartitionByRange(8 * shards, "shard", "k1", "k2").select(*kept, "shard")


def shard_report(docs: DataFrame) -> DataFrame:
    """The query's columns: the law is ``bytes``, sizes near equal."""
    return sharded(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
