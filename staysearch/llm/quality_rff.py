"""Quality classifier on document statistics: random Fourier features, ridge, isotonic steps.

Each text is read once and reduced to a few statistics. Their standardised values are mapped
to random Fourier features, whose inner products approximate a Gaussian kernel; ridge scores
come from normal equations summed over the partitions, and an isotonic regression over the
histogram of the scores makes them probabilities. All labelled rows outside the held-out fold
take part: a quarter of them, chosen by hash, only calibrates. What reaches the driver depends
on the number of features and histogram bins alone.

Null and empty texts have zero statistics and are scored like others. Of an id's repeated
labels the largest holds. Without labels of both kinds every score is the labels' mean (0.5
without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import fold, freeing, id_text, saved, text_blocks
from staysearch.llm.quality_rules import SYMBOL, measures
from staysearch.llm.textbytes import SPACE, Fingerprints, code_points, mixed, per_text, words
from staysearch.llm.toxicity import with_verdict

FOLDS, HELD_OUT = 3, 1
FEATURES, BANDWIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 6
BINS = 2000
CLIP = 4.0
STATISTICS = (
    "bytes words word_length capitals digits marks symbols spaces feeds wide lines repeated_lines "
    "repeated_words distinct_words doubled_words exclamations longest_word"
).split()
KINDS = {
    "capitals": np.arange(65, 91),
    "digits": np.arange(48, 58),
    "marks": np.frombuffer(b"!\"'(),-./:;?[]_{}~", np.uint8),
    "feeds": np.array([10]),
    "exclamations": np.frombuffer(b"!?", np.uint8),
}


def _share(marks: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(marks))[offsets]) / np.maximum(total, 1)


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a block."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    if len(data) == 0:
        return out
    m = measures(offsets, data)
    size, count = np.diff(offsets), m["n_words"]
    starts, ends, texts = words(offsets, data)
    prints = Fingerprints(data).spans(starts, ends)
    keys = mixed(prints ^ mixed(texts.astype(np.uint64)))
    distinct = per_text(texts[np.unique(keys, return_index=True)[1]], n)
    doubled = per_text(texts[1:][keys[1:] == keys[:-1]], n)
    longest = np.zeros(n)
    np.maximum.at(longest, texts, ends - starts)
    lines = np.diff(np.append(0, np.cumsum(data == 10))[offsets]) + (size > 0)
    values = {
        "bytes": np.log1p(size),
        "words": np.log1p(count),
        "word_length": np.log1p(m["word_chars"] / np.maximum(count, 1)),
        "symbols": _share(SYMBOL[data], offsets, size),
        "spaces": _share(SPACE[data], offsets, size),
        "wide": _share(~code_points(data), offsets, size),
        "lines": np.log1p(count / np.maximum(lines, 1)),
        "repeated_lines": m["n_dup_lines"] / np.maximum(lines, 1),
        "repeated_words": m["n_repeat_words"] / np.maximum(count, 1),
        "distinct_words": distinct / np.maximum(count, 1),
        "doubled_words": doubled / np.maximum(count, 1),
        "longest_word": np.log1p(longest),
    }
    for name, kind in KINDS.items():
        table = np.zeros(256, bool)
        table[kind] = True
        values[name] = _share(table[data], offsets, size)
    for k, name in enumerate(STATISTICS):
        out[:, k] = values[name]
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one column for each statistic."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(1)):
                rows = statistics(offsets, data)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), *(pa.array(x) for x in rows.T)], ["doc_id", *STATISTICS]
                )

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return id_text(docs).mapInArrow(freeing(step), schema)


@dataclass(frozen=True)
class Kernel:
    """Standardises statistics and maps them to random Fourier features."""

    mean: np.ndarray
    deviation: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(0, 1 / BANDWIDTH, (rows.shape[1], FEATURES))
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((rows - self.mean) / self.deviation, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), np.ones((len(rows), 1))])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows: first in each partition, then row by row of the
    matrix over partitions. The driver gets one matrix."""
    size = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size + 1)), False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            z = kernel.features(_rows(batch))
            total += z.T @ np.column_stack([z, batch.column("y").to_numpy().astype(float)])
        if any_rows:
            yield _as_rows(np.arange(size), total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + row.values.to_numpy()
        if sums:
            yield _as_rows(np.array(list(sums)), np.array(list(sums.values())))

    schema = "i int, sums array<double>"
    parts = rows.mapInArrow(freeing(partial), schema).repartition("i").mapInArrow(merged, schema)
    total = np.zeros((size, size + 1))
    for row in parts.collect():
        total[row.i] = row.sums
    return total[:, :-1], total[:, -1]


def _as_rows(index: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    edges = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    sums = pa.ListArray.from_arrays(edges, pa.array(rows.ravel()))
    return pa.record_batch([pa.array(index, pa.int32()), sums], ["i", "sums"])


def isotonic(bins: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps through (score, rows, positives) bins: centres and heights."""
    blocks: list[list[float]] = []
    for x, n, positives in sorted(bins):
        blocks.append([x * n, n, positives])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


@dataclass(frozen=True)
class Quality:
    kernel: Kernel
    weights: np.ndarray
    centres: np.ndarray
    heights: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel.features(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between two steps' centres the probability is interpolated."""
        return np.clip(np.interp(self.raw(rows), self.centres, self.heights), 0, 1)


def fitted(stats: DataFrame, labels: DataFrame, wanted: Column) -> Quality:
    """``stats`` is read several times: save it. ``wanted`` says which labels may be used."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & wanted)
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("quality").cast("int").alias("y"))
    )
    rows = stats.join(known, F.col("doc_id") == F.col("label_id")).drop("label_id")
    calibrates = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(4)) == 0
    moments = stats.agg(*[f(s).alias(f"{f.__name__}_{s}") for s in STATISTICS for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([moments[f"avg_{s}"] or 0.0 for s in STATISTICS])
    kernel = Kernel(mean, np.array([max(moments[f"stddev_pop_{s}"] or 0.0, 1e-6) for s in STATISTICS]))
    gram, target = normal_equations(rows.where(~calibrates), kernel)
    n = max(gram[-1, -1], 1.0)
    penalty = RIDGE * n * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + penalty, target)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel.features(_rows(batch)) @ weights
            bins = np.clip(np.floor((raw + 0.5) * (BINS / 2)), 0, BINS - 1).astype(np.int64)
            yield pa.record_batch([pa.array(bins), batch.column("y").cast(pa.int64())], ["bin", "y"])

    counted = (
        rows.where(calibrates)
        .mapInArrow(freeing(scored), "bin long, y long")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
        .collect()
    )
    if not counted:
        return Quality(kernel, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]) if gram[-1, -1] else np.full(2, 0.5))
    return Quality(kernel, weights, *isotonic([((r.bin + 0.5) / (BINS / 2) - 0.5, r.n, r.positives) for r in counted]))


def score_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = saved(document_statistics(docs), "statistics")
    model = fitted(stats, labels, fold(F.col("doc_id"), FOLDS) != HELD_OUT)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(_rows(batch)))], ["doc_id", "score"])

    return with_verdict(stats.mapInArrow(freeing(step), "doc_id long, score double"), FOLDS, HELD_OUT)
