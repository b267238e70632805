"""Tables, shared intermediate results and Arrow helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staysearch.session import work_dir, work_root

BLOCK_BYTES = 1 << 18
BLOCK_ROWS = 2048
# Rows that Spark sends to Python at a time. Texts and sets are wide: Spark's own 10 000 rows
# would be tens of megabytes, held several times on both sides.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what wide rows need."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: a cut of the lineage that
    survives the loss of executors. Only a local session without a named folder gets one."""
    spark = df.sparkSession
    small_batches(spark)
    if not work_root(spark) and spark.conf.get("spark.master", "").startswith("local["):
        spark.conf.set("staysearch.work.dir", tempfile.mkdtemp(prefix="llm-"))
    path = work_dir(spark, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that operators read; whatever else a table has cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, wanted: Column) -> DataFrame:
    """label_id, text and y of about ``bound`` labelled documents at most, one row each.

    ``wanted`` says which rows of ``labels`` may be learned from. Of an id's repeated labels
    the largest holds; null labels and ids are no labels. The ids are chosen by their hash, so
    the choice does not depend on how the rows are dealt out. Of an id's repeated rows one text is
    taken, that with the smallest hash.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & wanted)
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    share = bound / max(known.count(), 1)
    chosen = known.where(sampled(F.col("label_id"), share))
    # The choice is bounded, so that one scan of the documents finds its texts.
    return (
        id_text(docs)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .groupBy("label_id", "y")
        .agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
        .sortWithinPartitions("label_id")
        .select("label_id", "least.text", "y")
    )


def sampled(key: Column, share: float) -> Column:
    """Whether a row belongs to a sample of this share, chosen by its key's hash (63 bits)."""
    if share >= 1:
        return key.isNotNull()
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), key), 1) < F.lit(int(share * (1 << 63)))


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """The whole rows whose text ``keep`` accepts; it maps a text column to booleans."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at))))

    return docs.mapInArrow(freeing(step), docs.schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and UTF-8 bytes of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kinds = column.buffers()
    offsets = np.frombuffer(kinds[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(kinds[2], np.uint8) if kinds[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, block_bytes: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``block_bytes`` bytes and ``rows`` rows, of one row at least.

    The arrays made from a block are a small multiple of it, so a task's memory depends
    on this bound and on the longest text, not on the size of the batch.
    """
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + block_bytes, "right")) - 1
        end = min(max(end, start + 1), start + rows, n)
        yield start, end
        start = end


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    """glibc's function, where there is glibc."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None


def freed() -> None:
    """Gives memory that this worker does not use back to the system.

    Workers are kept from stage to stage; without this each holds the most that any stage took.
    """
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freeing(step: Step) -> Step:
    """The step, with its memory given back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            freed()

    return run


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets, bytes) of each block of a text column."""
    offsets, data = text_buffers(column)
    for a, b in blocks(offsets):
        yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
    freed()
