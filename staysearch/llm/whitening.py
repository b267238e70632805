"""Whitening of embeddings by a covariance weighted with multiplicities.

Each entry becomes an integer, x = floor(1024 * entry) + 100000. Identical x vectors are grouped
with their count; everything that follows works on the distinct vectors, with the counts (or
one) as weights:

1. exact integer sums of the weighted vectors, partition by partition;
2. the weighted covariance as a matrix product of centred vectors, again summed over the
   partitions (rows of the matrix are merged cell by cell, so no task gets all matrices);
3. its eigenvectors, on the driver: a matrix of dimension x dimension;
4. the projection of each distinct vector on the leading components, over the square root of
   their eigenvalues, and its exact squared deviation;
5. the covariance of these results, as a check that they are white;
6. a join back to the rows. Vectors that a large share of the rows has are broadcast (there
   are few of them by definition), so no task gets all their rows.

Centred values are (n * x - S) / n with an exact integer numerator, n being the weight of all
vectors and S their sum.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of different
lengths are fitted apart, each length with its own n. A component whose eigenvalue is below
1e-12 of the trace has no direction that could be whitened and is left out, so a table without
spread (one row, all rows equal, empty vectors) and an empty table give no rows. Repeated rows
and repeated or null ids are rows of their own. Entries beyond 2**40 in x are set to that bound;
a deviation that does not fit 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import freeing, saved

SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 40
COMPONENTS = 8
LEAST_SHARE = 1e-12
# A vector that more than 1 / HOT of the rows has is joined by broadcast: fewer than HOT vectors.
HOT = 64


def integer_vectors(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    entries = F.col("v")

    def whole(c):
        return F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))) + SHIFT

    # The infinities and NaN are no less and no greater than all finite numbers.
    sound = F.forall(entries, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    return rows.where(entries.isNotNull() & sound).select("vec_id", F.transform(entries, whole).alias("x"))


def _matrix(column: pa.Array, dim: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten(), dtype).reshape(len(column), dim)


def sums(distinct: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Weight of all vectors of one length, and their exact sum."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            w = batch.column(1).to_numpy()
            n += int(w.sum())
            total += w @ _matrix(batch.column(0), dim, np.int64)
        if n:
            yield pa.record_batch([pa.array(np.arange(-1, dim)), pa.array(np.append(n, total))], ["cell", "value"])

    rows = distinct.select("x", "weight").mapInArrow(freeing(step), "cell long, value long")
    found = rows.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(dim + 1, np.int64)
    out[found.column("cell").to_numpy() + 1] = found.column("value").to_numpy()
    return int(out[0]), out[1:]


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """(n * x - S) / n in double precision, from an exact numerator."""
    if float(np.abs(x).max(initial=0)) * n < 2**62:
        return (x * n - total) / n
    wide = x.astype(object) * n - total.astype(object)
    return (wide / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S)**2; None beyond 64 bits."""
    most = max(float(np.abs(x).max(initial=0)) * n, 1.0)
    if most < 2**62:
        apart = x * n - total
        if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2**62:
            return (apart * apart).sum(axis=1).tolist()
    wide = x.astype(object) * n - total.astype(object)
    found = [sum(int(v) ** 2 for v in row) for row in wide]
    return [v if v < 2**63 else None for v in found]


def covariance(rows: DataFrame, dim: int, n: int, read) -> np.ndarray:
    """Weighted covariance, divisor ``n``, of what ``read`` makes of a batch: centred vectors
    and weights."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((dim, dim)), False
        for batch in batches:
            if batch.num_rows:
                c, w = read(batch)
                total += c.T @ (c * w[:, None])
                some = True
        if some:
            yield pa.record_batch([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "value"])

    found = rows.mapInArrow(freeing(step), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(dim * dim)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    out = out.reshape(dim, dim) / n
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """The fit of one vector length."""

    dim: int
    n: int
    total: np.ndarray
    eigenvalues: np.ndarray  # of the components that are kept, falling
    axes: np.ndarray  # dimension x component
    trace: float

    def white(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ self.axes / np.sqrt(self.eigenvalues)


def fitted(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """``distinct`` has x and weight: distinct vectors of one length."""
    n, total = sums(distinct, dim)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return centred(_matrix(batch.column(0), dim, np.int64), n, total), batch.column(1).to_numpy().astype(float)

    v = covariance(distinct.select("x", "weight"), dim, n, read)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(v))
    kept = e > LEAST_SHARE * trace
    return Whitening(dim, n, total, e[kept], axes[:, kept], trace)


def whitened(distinct: DataFrame, fit: Whitening) -> DataFrame:
    """x, weight, white (array) and deviation of each distinct vector."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), fit.dim, np.int64)
            z = fit.white(x)
            edges = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.int32())
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(edges, pa.array(z.ravel())),
                    pa.array(deviations(x, fit.n, fit.total), pa.int64()),
                ],
                ["x", "weight", "white", "deviation"],
            )

    return distinct.select("x", "weight").mapInArrow(freeing(step), "x array<long>, weight long, white array<double>, deviation long")


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(fit.eigenvalues)
    cells = rows.select(F.posexplode("white").alias("cell", "value"), "weight")
    mean = np.zeros(k)
    for cell, value in cells.groupBy("cell").agg(F.sum(F.col("value") * F.col("weight"))).collect():
        mean[cell] = value / fit.n

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(batch.column(0), k, np.float64) - mean, batch.column(1).to_numpy().astype(float)

    return float(np.abs(covariance(rows.select("white", "weight"), k, fit.n, read) - np.eye(k)).max())


def white_rows(vectors: DataFrame, weighted: bool = True, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error.

    ``vectors`` has vec_id and x. ``weighted`` fits on all rows, else on distinct vectors.
    """
    rows = saved(vectors.withColumn("dim", F.size("x")), "vectors")
    grouped = saved(rows.groupBy("dim", "x").agg(F.count("*").alias("copies")), "distinct-vectors")
    # One row a length.
    lengths = [r.dim for r in grouped.where("dim > 0").select("dim").distinct().orderBy("dim").collect()]
    parts = [_part(grouped, rows, dim, weighted, components) for dim in lengths]
    parts = [p for p in parts if p is not None]
    if parts:
        return reduce(DataFrame.unionAll, parts)
    kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    return rows.where("false").select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])


def _part(grouped: DataFrame, rows: DataFrame, dim: int, weighted: bool, components: int) -> DataFrame | None:
    own = grouped.where(F.col("dim") == dim)
    distinct = own.select("x", (F.col("copies") if weighted else F.lit(1).cast("long")).alias("weight"))
    fit = fitted(distinct, dim, components)
    if not len(fit.eigenvalues):
        return None
    done = saved(whitened(distinct, fit), "whitened")
    error = identity_error(done, fit)
    total = own.agg(F.sum("copies")).first()[0]
    hot = own.where(F.col("copies") * HOT > total).select("x")
    mine = rows.where(F.col("dim") == dim).select("vec_id", "x")
    values = done.select("x", "white", "deviation")
    often = F.broadcast(values.join(F.broadcast(hot), "x", "left_semi"))
    rare = mine.join(F.broadcast(hot), "x", "left_anti").join(values, "x")
    joined = mine.join(often, "x").unionByName(rare)
    explained = F.element_at(F.array(*[F.lit(float(e / fit.trace)) for e in fit.eigenvalues]), F.col("at") + 1)
    return joined.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whitening_report(embeddings: DataFrame) -> DataFrame:
    return white_rows(integer_vectors(embeddings))
