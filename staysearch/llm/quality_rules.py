"""Quality rules: exact text measures, and a hashed n-gram model against fixed thresholds.

The base rules measure words, symbols and repetition and fail texts that are too short or too
repetitive. The others are judged by a logistic regression over hashed word and character
n-grams, trained on labelled rows, calibrated (Platt) on rows that it has not seen, and
compared with fixed thresholds on the probability.

Labels for fitting come from a sample of ``FIT_ROWS`` rows at most, chosen by hash of the id.
Null texts count as empty; texts without words fail the base rules. Without labels of both
kinds the model accepts everything. A task's memory is a multiple of a block: 256 KB or the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import freeing, id_text, kept_rows, labelled, text_blocks
from staysearch.llm.textbytes import (
    GRAM,
    LOWER,
    SPACE,
    Fingerprints,
    code_points,
    mixed,
    owners,
    per_text,
    windows,
    words,
)

FIT_ROWS = 6000
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
KEEP_AT = 0.3
BITS = 12
GRAMS = 1 << BITS
CHARACTERS = 3
STEPS, RATE, DECAY = 300, 0.05, 1e-3
# Fixed: the symbols that are counted.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of each text."""
    return np.diff(np.append(0, np.cumsum(marks))[offsets])


def measures(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text of a block, as int64."""
    n = len(offsets) - 1
    if len(data) == 0:
        return {name: np.zeros(n, np.int64) for name in MEASURES}
    inside = ~SPACE[data]
    starts, ends, texts = words(offsets, data)
    prints = Fingerprints(data)
    return {
        "n_words": per_text(texts, n),
        "word_chars": _sums(inside & code_points(data), offsets),
        "n_symbols": _sums(SYMBOL[data], offsets),
        "n_dup_lines": _repeated_lines(offsets, data, inside, prints),
        "n_repeat_words": _repeated_words(prints.spans(starts, ends), texts, n),
    }


def _repeated_lines(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, prints: Fingerprints) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 0x0A)
    # A line ends at a line feed or where its text ends; empty texts have an empty line.
    ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1]
    starts[1:] += (starts[1:] < len(data)) & (data[np.minimum(starts[1:], len(data) - 1)] == 0x0A)
    # The next text may begin with a line feed right where this one ends.
    starts = np.minimum(starts, ends)
    some = np.append(0, np.cumsum(inside))
    full = some[ends] > some[starts]
    starts, ends = starts[full], ends[full]
    texts = owners(offsets, starts)
    keys = mixed(prints.spans(starts, ends) ^ mixed(texts.astype(np.uint64)))
    first = np.unique(keys, return_index=True)[1]
    return per_text(texts, n) - per_text(texts[first], n)


def _repeated_words(hashes: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a window of five words found at least twice in their text."""
    first, grams = windows(hashes, texts, WINDOW)
    if len(first) == 0:
        return np.zeros(n, np.int64)
    keys = mixed(grams ^ mixed(texts[first].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, first[again] + WINDOW, -1)
    return per_text(texts[np.cumsum(edge[:-1]) > 0], n)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def gram_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed words and of hashed character n-grams."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * GRAMS), np.float32)
    if len(data) == 0:
        return out
    starts, ends, texts = words(offsets, data)
    buckets = (Fingerprints(LOWER[data]).spans(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    size = len(data) - CHARACTERS + 1
    parts = [(texts * GRAMS + buckets, per_text(texts, n))]
    if size > 0:
        rolled = np.zeros(size, np.uint64)
        for k in range(CHARACTERS):
            rolled += data[k : k + size] * GRAM[k]
        grams = ((rolled * GRAM[8]) >> np.uint64(64 - BITS)).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        within = owner[:size] == owner[CHARACTERS - 1 :]
        parts.append((owner[:size][within] * GRAMS + grams[within], np.maximum(np.diff(offsets) - CHARACTERS + 1, 0)))
    for k, (key, total) in enumerate(parts):
        counted = np.bincount(key, minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, k * GRAMS : (k + 1) * GRAMS] = np.sqrt(counted / np.maximum(total, 1)[:, None])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Shares:
    """Some rows of features, as (row, bucket, share) of their non-zero entries."""

    row: np.ndarray
    bucket: np.ndarray
    share: np.ndarray
    y: np.ndarray

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, self.share * w[self.bucket], len(self.y)) + b


def logistic(parts: list[Shares], size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression (full-batch Adam, fixed steps)."""
    w, b, n = np.zeros(size, np.float32), 0.0, sum(len(part.y) for part in parts)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        grad = np.append(DECAY * w.astype(float), 0.0)
        for part in parts:
            error = ((_sigmoid(part.logits(w, b)) - part.y) / n).astype(np.float32)
            grad[:-1] += np.bincount(part.bucket, part.share * error[part.row], size)
            grad[-1] += error.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make the logits' sigmoid a probability (Newton steps).

    The targets are smoothed by the class counts, so separable rows do not diverge.
    """
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([logits, np.ones(len(logits))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ theta)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - target))
    return float(max(theta[0], 1e-3)), float(theta[1])


@dataclass(frozen=True)
class GramModel:
    weights: np.ndarray | None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def probabilities(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(offsets) - 1)
        logits = gram_features(offsets, data) @ self.weights + self.bias
        return _sigmoid(self.scale * logits.astype(float) + self.shift)


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> GramModel:
    """Trains on three quarters of the sampled labelled rows and calibrates on the others."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(0)):
                rows = gram_features(offsets, data)
                text, bucket = np.nonzero(rows)
                edges = pa.array(np.searchsorted(text, np.arange(b - a + 1)), pa.int32())
                yield pa.record_batch(
                    [
                        batch.column(1).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.ListArray.from_arrays(edges, pa.array(bucket, pa.int16())),
                        pa.ListArray.from_arrays(edges, pa.array(rows[text, bucket], pa.float32())),
                    ],
                    ["label_id", "y", "buckets", "shares"],
                )

    found = labelled(docs, labels, "quality", fit_rows, F.lit(True)).select("text", "label_id", "y")
    rows = found.mapInArrow(freeing(step), "label_id long, y int, buckets array<short>, shares array<float>").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return GramModel(None)
    order = np.argsort(rows.column("label_id").to_numpy(), kind="stable")
    held = np.zeros(len(y), bool)
    held[order[::4]] = True
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    train, check, at = [], [], 0
    for chunk in rows.to_batches():
        buckets, shares = chunk.column("buckets"), chunk.column("shares")
        row = np.repeat(np.arange(len(chunk)), np.diff(buckets.offsets.to_numpy()))
        bucket, share = buckets.flatten().to_numpy(), shares.flatten().to_numpy()
        here = slice(at, at + len(chunk))
        for side, parts in ((~held[here], train), (held[here], check)):
            if side.any():
                mine, place = side[row], np.cumsum(side) - 1
                parts.append(Shares(place[row[mine]].astype(np.int32), bucket[mine], share[mine], y[here][side]))
        at += len(chunk)
    del rows
    w, b = logistic(train, 2 * GRAMS)
    check = check or train
    return GramModel(w, b, *platt(np.concatenate([c.logits(w, b) for c in check]), np.concatenate([c.y for c in check])))


def verdicts(model: GramModel, column: pa.Array, keep_at: float = KEEP_AT) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All measures, base_failed, probability and kept of every text of a column."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, offsets, data in text_blocks(column):
        m = measures(offsets, data)
        m["base_failed"] = base_failed(m)
        m["probability"] = model.probabilities(offsets, data)
        parts.append(m)
    names = (*MEASURES, "base_failed", "probability")
    out = {name: np.concatenate([m[name] for m in parts]) if parts else np.zeros(0) for name in names}
    out["base_failed"] = out["base_failed"].astype(bool)
    return out, ~out["base_failed"] & (out["probability"] >= keep_at)


def rule_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, the calibrated probability and kept."""
    model = fitted(docs, labels)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = verdicts(model, batch.column(1))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(x) for x in found.values()), pa.array(kept)],
                ["doc_id", *found, "kept"],
            )

    schema = ", ".join(f"{name} long" for name in ("doc_id", *MEASURES))
    return id_text(docs).mapInArrow(freeing(step), f"{schema}, base_failed boolean, probability double, kept boolean")


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass all rules."""
    model = fitted(docs, labels)
    return kept_rows(docs, lambda column: verdicts(model, column)[1])
