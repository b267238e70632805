"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all text, whether someone labelled it or not, and the
positives among it, is the unlabelled side, so its risk is that of the whole population. Linear classifiers are trained in numpy on the risk

    prior * R(positive as toxic) + max(0, R(unlabelled as clean) - prior * R(positive as clean))

whose second term is the clean class's risk, corrected by the share of toxic texts among the
unlabelled (the class prior) and kept from becoming negative. The prior is the share of toxic
rows among the labels that may be learned from. Features are hashed letter runs and their
beginnings, which generalise over inflected words.

Features are chosen by the document counts of all unlabelled text. Steps are made on bounded samples
(``POSITIVES`` labelled rows, ``UNLABELLED`` others, chosen by hash), but follow the risk of all
unlabelled text: before each of ``PASSES`` turns, its slope at the present weights is summed over the
partitions of all documents, and the turn's steps take the sample's slope plus the difference between
the two at the turn's start (variance reduction). The weights of the least risk over all unlabelled
text, measured so, are kept. Scoring reads every whole text in Arrow batches.

Null and empty texts have no features and get the score of the bias. Repeated rows count as often as
they occur in the counts and slopes, once in the sample. Without positives, every text scores 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import fold, freeing, id_text, kept_rows, labelled, sampled, saved, text_blocks
from staysearch.llm.textbytes import LOWER, Fingerprints, owners
from staysearch.llm.units import letters

FOLDS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED = 3000, 9000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
SELECTED = 1500
LEAST_POSITIVES, LEAST_RATIO, LEAST_EXCESS = 3, 2.0, 3.0
MEMBERS = 3
ROUNDS, RATE, DECAY = 300, 0.05, 2e-4
PASSES, STEPS = 6, 60
UNIT = 1 << 20


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters."""
    low = LOWER[data]
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[second] += 0x20
    return low


def letter_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters and non-ASCII bytes within a text."""
    n = len(data)
    inside = letters(data) | (data >= 0x80)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and count of all features of a block, by text and bucket."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = lowered(data)
    starts, ends = letter_runs(offsets, low)
    prints, texts = Fingerprints(low), owners(offsets, starts)
    found, owner = [prints.spans(starts, ends)], [texts]
    for size in PREFIXES:
        long = ends - starts > size
        found.append(prints.spans(starts[long], starts[long] + size) + np.uint64(size))
        owner.append(texts[long])
    bucket = (np.concatenate(found) >> np.uint64(44)).astype(np.int64)
    key, count = np.unique(np.concatenate(owner) * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _hit_rows(texts: DataFrame, chosen: np.ndarray, empty: bool) -> DataFrame:
    """Each text's features among the ``chosen`` ones: their places there and their values.

    ``empty`` says whether texts without any get a row.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(0)):
                text, bucket, count = features(offsets, data)
                at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
                hit = chosen[at] == bucket
                rows = np.arange(b - a) if empty else np.unique(text[hit])
                edges = pa.array(np.append(np.searchsorted(text[hit], rows), hit.sum()), pa.int32())
                columns = pa.array(at[hit], pa.int32()), pa.array(np.log1p(count[hit]), pa.float32())
                yield pa.record_batch([pa.ListArray.from_arrays(edges, c) for c in columns], ["at", "value"])

    return texts.select("text").mapInArrow(freeing(step), "at array<int>, value array<float>")


@dataclass(frozen=True)
class Toxicity:
    buckets: np.ndarray
    weights: np.ndarray  # member x bucket
    bias: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """The members' mean score of every text of a column, 0 to 1."""
        out = [np.zeros(0)]
        for a, b, offsets, data in text_blocks(column):
            if not len(self.buckets):
                out.append(np.zeros(b - a))
                continue
            text, bucket, count = features(offsets, data)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            text, at, value = text[hit], at[hit], np.log1p(count[hit])
            logits = np.array([np.bincount(text, w[at] * value, b - a) for w in self.weights]) + self.bias[:, None]
            out.append(_sigmoid(logits).mean(axis=0))
        return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _selected(positive: np.ndarray, n_positive: int, counts: np.ndarray, n: int) -> np.ndarray:
    """Buckets whose share of the positives exceeds that of the unlabelled most clearly: by a
    factor, and by standard deviations of a count at the unlabelled rate. ``positive`` and
    ``counts`` have the numbers of the ``n_positive`` and ``n`` documents with each bucket."""
    some = np.flatnonzero(positive >= LEAST_POSITIVES)
    rate_p, rate_u = (positive[some] + 0.5) / (n_positive + 1), (counts[some] + 0.5) / (n + 1)
    expected = rate_u * n_positive
    excess = (positive[some] - expected) / np.sqrt(expected)
    clear = (rate_p >= LEAST_RATIO * rate_u) & (excess >= LEAST_EXCESS)
    order = np.argsort(-excess[clear], kind="stable")[:SELECTED]
    return np.sort(some[clear][order])


def _document_counts(texts: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of documents with each of the ``wanted`` buckets (others 0), and of documents.

    Counted within tasks first, so that at most one row a bucket and task is exchanged.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, offsets, data in text_blocks(batch.column(0)):
                found += np.bincount(features(offsets, data)[1], minlength=BUCKETS)
        some = wanted[found[wanted] > 0]
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(freeing(step), "bucket long, n long")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (sums.column(name).to_numpy() for name in ("bucket", "n"))
    counts = np.zeros(BUCKETS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return counts, int(n[bucket < 0].sum())


def _slope(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Gradient of the mean of the sigmoids ``s`` of the rows."""
    steep = (s * (1 - s)).astype(np.float32)
    return np.append(x.T @ steep, steep.sum()) / len(x)


def train(
    x_p: np.ndarray,
    x_u: np.ndarray,
    prior: float,
    seed: int,
    start: tuple[np.ndarray, float] | None = None,
    whole: tuple[np.ndarray, float] | None = None,
    rounds: int = ROUNDS,
    rate: float = RATE,
) -> tuple[np.ndarray, float]:
    """One linear classifier by the non-negative risk with the sigmoid loss (Adam steps).

    Each member sees its own four fifths of the rows. If the clean class's risk estimate is
    negative, the step ascends it instead. ``whole`` has the slope and the mean of the sigmoids
    of all unlabelled rows at ``start``; the sample's are shifted by what they differ there.
    """
    rng = np.random.default_rng(seed)
    x_p, x_u = (x[rng.random(len(x)) < 0.8] if len(x) > 50 else x for x in (x_p, x_u))
    w, b = start or (np.zeros(x_p.shape[1], np.float32), np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    tilt, lift = 0.0, 0.0
    if whole:
        s_u = _sigmoid(x_u @ w + b)
        tilt, lift = whole[0] - _slope(x_u, s_u), whole[1] - s_u.mean()
    for t in range(1, rounds + 1):
        s_p, s_u = _sigmoid(x_p @ w + b), _sigmoid(x_u @ w + b)
        up_p, up_u = _slope(x_p, s_p), _slope(x_u, s_u) + tilt
        part = up_u - prior * up_p
        grad = part - prior * up_p if s_u.mean() + lift >= prior * s_p.mean() else -part
        grad[:-1] += DECAY * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def risk(x_p: np.ndarray, member: tuple[np.ndarray, float], mean: float, prior: float) -> float:
    """The non-negative risk, given the mean of the sigmoids of all unlabelled rows."""
    s_p = _sigmoid(x_p @ member[0] + member[1]).mean()
    return prior * (1 - s_p) + max(0.0, mean - prior * s_p)


def turned(
    x_p: np.ndarray,
    x_u: np.ndarray,
    prior: float,
    members: list[tuple[np.ndarray, float]],
    slopes: Callable[[list[tuple[np.ndarray, float]]], list[tuple[np.ndarray, float]]],
) -> list[tuple[np.ndarray, float]]:
    """The members after ``PASSES`` turns; ``slopes`` measures them on all unlabelled rows.

    Each turn starts from the member's least risk so far; one that does not lower it halves the rate.
    """
    best: list[tuple[float, tuple[np.ndarray, float], tuple[np.ndarray, float]] | None] = [None] * len(members)
    rates = [RATE / 2] * len(members)
    for turn in range(PASSES + 1):
        for k, (member, whole) in enumerate(zip(members, slopes(members), strict=True)):
            now = risk(x_p, member, whole[1], prior)
            if best[k] is None or now < best[k][0]:
                best[k] = now, member, whole
            else:
                rates[k] /= 2
        if turn < PASSES:
            members = [
                train(x_p, x_u, prior, k, member, whole, STEPS, rates[k]) for k, (_, member, whole) in enumerate(best)
            ]
    return [member for _, member, _ in best]


def whole_slopes(
    hits: DataFrame, n: int, members: list[tuple[np.ndarray, float]]
) -> list[tuple[np.ndarray, float]]:
    """For each classifier the slope and mean of the sigmoids of all ``n`` texts.

    ``hits`` has a row for each text with a feature; the others only have the bias. Sums are
    made within tasks, then added as whole numbers of 2**-20, so their order does not matter.
    """
    weights, bias = np.array([w for w, _ in members]), np.array([b for _, b in members])
    size = weights.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((len(bias), size + 2)), 0
        for batch in batches:
            rows += batch.num_rows
            places, values = batch.column(0), batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            at, value = places.flatten().to_numpy(), values.flatten().to_numpy()
            for w, b, sums in zip(weights, bias, total, strict=True):
                s = _sigmoid(np.bincount(row, w[at] * value, batch.num_rows) + b)
                steep = s * (1 - s)
                sums[:size] += np.bincount(at, value * steep[row], size)
                sums[size] += steep.sum()
                sums[size + 1] += s.sum()
        parts = np.append(np.rint(total.ravel() * UNIT).astype(np.int64), rows)
        some = np.flatnonzero(parts)
        yield pa.record_batch([pa.array(some), pa.array(parts[some])], ["slot", "part"])

    sums = hits.mapInArrow(freeing(step), "slot long, part long").groupBy("slot").agg(F.sum("part").alias("n")).toArrow()
    flat = np.zeros(len(bias) * (size + 2) + 1)
    flat[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    total, bare = flat[:-1].reshape(len(bias), size + 2) / UNIT, _sigmoid(bias)
    rest = n - flat[-1]
    total[:, size] += rest * bare * (1 - bare)
    total[:, size + 1] += rest * bare
    return [(sums[: size + 1] / n, float(sums[size + 1] / n)) for sums in total]


def fitted(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learns from the labels outside the held-out fold and from all text outside it."""
    wanted = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & wanted)
    n, toxic = usable.selectExpr("count(*)", "count_if(toxic = 1)").first()
    none = Toxicity(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([-30.0]))
    if not toxic:
        return none
    confirmed = labelled(docs, labels.where("toxic = 1"), "toxic", POSITIVES, wanted).select("text")
    confirmed = saved(confirmed, "confirmed")
    positive, n_positive = _document_counts(confirmed, np.arange(BUCKETS))
    if not n_positive:
        return none
    texts = id_text(docs).where(wanted)
    counts, total = _document_counts(texts, np.flatnonzero(positive >= LEAST_POSITIVES))
    chosen = _selected(positive, n_positive, counts, total)
    if not len(chosen):
        return none
    # One row of each text of an id, so that a frequent row does not come to the driver as often.
    key = F.xxhash64("doc_id", "text")
    sample = texts.where(sampled(key, UNLABELLED / total)).groupBy(key).agg(F.first("text").alias("text"))
    x_p, x_u = (_matrix(_hit_rows(x, chosen, True).toArrow(), len(chosen)) for x in (confirmed, sample))
    if not len(x_u):
        raise RuntimeError(f"none of {total} unlabelled documents was chosen")
    prior = min(max(toxic / n, 0.001), 0.9)
    members = [train(x_p, x_u, prior, seed) for seed in range(MEMBERS)]
    hits = saved(_hit_rows(texts, chosen, False), "toxicity-hits")
    members = turned(x_p, x_u, prior, members, lambda now: whole_slopes(hits, total, now))
    return Toxicity(chosen, np.array([w for w, _ in members]), np.array([b for _, b in members]))


def _matrix(rows: pa.Table, size: int) -> np.ndarray:
    """Rows of places and values as a dense matrix, in an order that only depends on the rows."""
    out = np.zeros((rows.num_rows, size), np.float32)
    places, values = (rows.column(name).combine_chunks() for name in ("at", "value"))
    lengths = places.value_lengths().to_numpy()
    out[np.repeat(np.arange(rows.num_rows), lengths), places.flatten().to_numpy()] = values.flatten().to_numpy()
    order = sorted(range(len(out)), key=lambda i: out[i].tobytes())
    return out[order]


def score_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fitted(docs, labels)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    return with_verdict(id_text(docs).mapInArrow(freeing(step), "doc_id long, score double"), FOLDS, HELD_OUT)


def with_verdict(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic."""
    model = fitted(docs, labels)
    return kept_rows(docs, lambda column: model.scores(column) < 0.5)
