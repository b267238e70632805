"""Packs token pieces into sequences: exact complements first, best fit for the rest.

Only lengths decide a packing, so the plan is made from the histogram of piece lengths, which
has at most ``capacity`` entries however many pieces there are. Lengths are taken from the
longest down; the gap that one leaves is looked up in an index of the sums of single lengths,
pairs and triples, and filled exactly as often as the counts allow. What has no complement is packed best fit
decreasing, also by counts. The pieces then look their places up by (length, rank among the
pieces of that length); ranks are counted in cells of bounded size, so a length that half of
all pieces have is not numbered in one task.

Nulls and empty texts become the end mark alone. Repeated rows are pieces of their own, told
apart by rank. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staysearch.llm.common import freeing, id_text, saved, text_blocks
from staysearch.llm.units import UnitEncoder

CAPACITY = 2048
END_ID = 0
CELLS = 4096
ENCODED_UNITS = 1000


@lru_cache(maxsize=2)
def library_encoder(definition: str) -> UnitEncoder:
    """Ids of the tokenizers library, unit by unit; one for all tasks of a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        # Each unit of a list is normalized and encoded by itself, into one result that says which
        # unit an id is of. Results are large objects: some units at a time.
        for at in range(0, len(units), ENCODED_UNITS):
            texts = [u.decode("utf-8", "replace") for u in units[at : at + ENCODED_UNITS]]
            found = tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(found.ids, np.int32))
            lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts)))
        return np.concatenate(flat), np.concatenate(lengths)

    return UnitEncoder(encode)


def pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, and its ids if wanted."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(definition)
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(1)):
                ids, counts = encoder.block(offsets, data)
                ids = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4")
                sizes = counts + 1
                parts = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc)), *map(pa.array, (piece, start, length))]
                columns.append(pa.array(crcs, pa.int64()))
                if with_ids:
                    edges = pa.array(np.append(0, np.cumsum(length)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return id_text(docs).mapInArrow(freeing(step), schema)


class SumIndex:
    """Which available lengths add up to a sum: alone, in pairs and in triples.

    For every sum the index points at the pair with the shortest member, and at the triple with
    the longest member, that may still be available. Counts only fall while the index is used,
    so a pointer only moves on: each pair is passed over once, however many gaps are asked for.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        size = len(self.counts)
        self.short = [1] * size  # of the pair for each sum
        self.long = [size - 1] * size  # of the triple for each sum

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n

    def _free(self, length: int, used: tuple[int, ...], times: int = 1) -> bool:
        return self.counts[length] - used.count(length) >= times

    def pair(self, total: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths, the first the longest possible, beside the ``used`` ones."""
        first = True
        low = self.short[total]
        while low <= total // 2:
            high, times = total - low, 1 + (2 * low == total)
            if self._free(low, used, times) and self._free(high, used, times):
                return high, low
            if first and self._free(low, (), times) and self._free(high, (), times):
                first = False  # only the used ones are in its way
            low += 1
            if first:
                self.short[total] = low
        return None

    def complement(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill ``gap`` exactly, beside ``used``."""
        if self._free(gap, used):
            return (gap,)
        if pair := self.pair(gap, used):
            return pair
        first = True
        longest = min(self.long[gap], gap - 2)
        while 3 * longest >= gap and longest > 0:
            if self.counts[longest]:
                if self._free(longest, used) and (pair := self.pair(gap - longest, (*used, longest))):
                    return longest, *pair
                if first and self.pair(gap - longest, ()):
                    first = False
            longest -= 1
            if first:
                self.long[gap] = longest
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) patterns that use every piece exactly once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = []
    if counts[capacity]:
        patterns.append((int(counts[capacity]), [(capacity, 1)]))
        counts[capacity] = 0
    index = SumIndex(counts)
    for length in range(capacity - 1, 0, -1):
        while index.counts[length] and (rest := index.complement(capacity - length, (length,))):
            items = [length, *rest]
            copies = [(x, items.count(x)) for x in sorted(set(items), reverse=True)]
            times = min(index.counts[x] // k for x, k in copies)
            for x, k in copies:
                index.take(x, k * times)
            patterns.append((times, copies))
    return patterns + _best_fit(np.array(index.counts, np.int64), capacity)


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing; open sequences with the same content are handled together."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(gap: int, times: int, items: list[tuple[int, int]]) -> None:
        if gap not in open_:
            bisect.insort(gaps, gap)
            open_[gap] = []
        open_[gap].append((times, items))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                copies = capacity // length
                if left >= copies:
                    put(capacity - copies * length, left // copies, [(length, copies)])
                if left % copies:
                    put(capacity - left % copies * length, 1, [(length, left % copies)])
                break
            gap = gaps[at]
            times, items = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[at]
            copies = gap // length
            if left >= copies * times:
                put(gap - copies * length, times, [*items, (length, copies)])
                left -= copies * times
            else:
                full, some = divmod(left, copies)
                if full:
                    put(gap - copies * length, full, [*items, (length, copies)])
                if some:
                    put(gap - some * length, 1, [*items, (length, some)])
                if times - full - bool(some):
                    put(gap, times - full - bool(some), items)
                left = 0
    return [group for groups in open_.values() for group in groups]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of every place."""
    rows, used, sequence = [], {}, 0
    for times, items in patterns:
        offset = 0
        for length, copies in items:
            for _ in range(copies):
                rank = used.get(length, 0)
                rows.append((length, rank, rank + times, sequence, offset))
                used[length] = rank + times
                offset += length
        sequence += times
    return rows


def packed(found: DataFrame, capacity: int = CAPACITY, cells: int = CELLS) -> DataFrame:
    """The pieces with sequence_id and offset.

    ``found`` has doc_id, piece, length and ids_crc32, and is read several times: save it.
    """
    spark = found.sparkSession
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = spark.createDataFrame(
        places(plan(histogram, capacity)), "length long, low long, high long, first long, offset long"
    )
    total = sum(histogram.values())
    split = spark.createDataFrame([(x, -(-n * cells // total)) for x, n in histogram.items()], "length long, cells long")
    # One row a length, and one row a cell, of which there are at most cells + capacity: bounded sides.
    rows = found.join(F.broadcast(split), "length").withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells"))
    ).drop("cells")
    before = (
        rows.groupBy("length", "cell")
        .agg(F.count("*").alias("n"))
        .select(
            "length",
            "cell",
            (
                F.sum("n").over(
                    Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
                )
                - F.col("n")
            ).alias("before"),
        )
    )
    number = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        rows.withColumn("number", number)
        .join(F.broadcast(before), ["length", "cell"])
        .withColumn("rank", F.col("before") + F.col("number") - 1)
    )
    return (
        ranked.join(
            F.broadcast(table.withColumnRenamed("length", "size")),
            (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
        )
        .withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low"))
        .select(*found.columns, "sequence_id", "offset")
    )


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, for pieces that carry ``ids``; at most ``capacity`` ids each."""
    return packed_pieces.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
        ).alias("ids")
    )


def pack_report(docs: DataFrame, definition: str) -> DataFrame:
    return packed(saved(pieces(docs, definition), "pieces"))
