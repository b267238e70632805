"""Exact top-k by inner product: ball trees per shard, branch and bound.

Nested median splits of a bounded sample (``SAMPLE`` rows) cut space into at most ``REGIONS``
regions. Every vector is dealt to its region and, within it, at random into shards of bounded
size, however many vectors are alike. A shard's task builds a ball tree and visits its nodes by
their upper bound q·c + |q|r, best first, until no bound reaches the current k-th score. Each
query first searches one shard of the region with the highest bound, its home; the k-th score
found there is shared: it drops all regions whose ball cannot reach it before the query is sent
to them, and prunes the trees of the others from the start. Queries go to the shards in blocks
of bounded size. The sample decides only where vectors lie; the result is the same without it.

Scores are integers: inner products of floor(scale * x). Vectors that are null, or hold null
or non-finite components, take no part, nor do rows without an id; only vectors of equal
length meet. Ties go to the smaller id. A query's own id is no candidate. Repeated ids: each row
is a candidate and a query of its own, and what the rows of one query id find is ranked together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staysearch.llm.common import freeing, saved, small_batches

K, SCALE = 10, 1024
SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 4096, 128
SAMPLE, REGIONS = 4096, 256
EXACT = 2**53


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim and v (array of long) of the vectors that take part."""
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE))
    broken = F.exists(
        F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
        .where(~broken)
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("dim"), whole.alias("v"))
    )


def reach(product: np.ndarray, norm: np.ndarray, radius: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Upper bound of q·x in a ball, from q·c, |q|, r and the sum of c's absolute components.

    Wider than any rounding error, so that no candidate is lost by it.
    """
    value = product + norm * radius
    return value + 1e-9 * (abs(value) + norm * (radius + size)) + 1e-6


@dataclass(frozen=True)
class Regions:
    """Nested splits of vectors of one length; the children of node i are 2i + 1 and 2i + 2."""

    axes: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, wanted: int) -> Regions:
        """At least ``wanted`` regions, unless that is more than ``REGIONS``. Copies count once."""
        sample = np.unique(sample, axis=0) if sample.shape[1] else sample[:1]
        depth = (min(wanted, REGIONS) - 1).bit_length() if sample.shape[1] else 0
        inner = 2**depth - 1
        axes, cuts = np.zeros(inner, np.int64), np.zeros(inner)
        parts, centres = [sample], [sample.mean(axis=0)]
        for node in range(inner):
            part, centre = parts[node], centres[node]
            if len(part):
                axes[node] = np.argmax(part.std(axis=0))
                cuts[node] = np.median(part[:, axes[node]])
            above = part[:, axes[node]] > cuts[node]
            for half in (part[~above], part[above]):
                parts.append(half)
                centres.append(half.mean(axis=0) if len(half) else centre)
        return Regions(axes, cuts, np.array(centres[inner:]))

    def place(self, points: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range((len(self.axes) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[rows, self.axes[node]] > self.cuts[node])
        return node - len(self.axes)

    def reaches(self, queries: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Upper bound of each query's scores in each region."""
        norms = np.sqrt((queries**2).sum(axis=1))[:, None]
        return reach(queries @ self.centres.T, norms, radii, np.abs(self.centres).sum(axis=1))


@dataclass
class Ball:
    start: int
    end: int
    centre: np.ndarray
    radius: float
    children: list[Ball] = field(default_factory=list)


class BallTree:
    """Points split at the median along their widest direction, down to leaves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.floats = points.astype(float)
        self.root = self._ball(0, len(ids))

    def _ball(self, start: int, end: int) -> Ball:
        part = self.floats[start:end]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())) if end > start else 0.0
        ball = Ball(start, end, centre, radius)
        if end - start > LEAF and radius > 0:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order = np.argsort(part[:, axis], kind="stable")
            self._reorder(start, end, order)
            middle = (start + end) // 2
            ball.children = [self._ball(start, middle), self._ball(middle, end)]
        return ball

    def _reorder(self, start: int, end: int, order: np.ndarray) -> None:
        for name in ("ids", "points", "floats"):
            values = getattr(self, name)
            values[start:end] = values[start:end][order]

    def _scores(self, start: int, end: int, query: np.ndarray) -> np.ndarray:
        reach = float(np.abs(query).astype(float).sum()) * float(np.abs(self.floats[start:end]).max(initial=0))
        if reach < EXACT:
            return (self.floats[start:end] @ query.astype(float)).astype(np.int64)
        whole = self.points[start:end].astype(object) @ query.astype(object)
        limit = np.iinfo(np.int64)
        return np.array([min(max(x, limit.min), limit.max) for x in whole], np.int64)

    def search(self, own: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k that reach ``floor``, best first."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = query.astype(float)
        norm = float(np.sqrt(q @ q))

        def bound(ball: Ball) -> float:
            return reach(float(q @ ball.centre), norm, ball.radius, float(np.abs(ball.centre).sum()))

        number = 0
        queue = [(-bound(self.root), number, self.root)]
        while queue and -queue[0][0] >= floor:
            _, _, ball = heapq.heappop(queue)
            for child in ball.children:
                if (highest := bound(child)) >= floor:
                    number += 1
                    heapq.heappush(queue, (-highest, number, child))
            if ball.children:
                continue
            found = self._scores(ball.start, ball.end, query)
            good = (found >= floor) & (self.ids[ball.start : ball.end] != own)
            if good.any():
                ids = np.concatenate([ids, self.ids[ball.start : ball.end][good]])
                scores = np.concatenate([scores, found[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = max(floor, float(scores[-1]))
        return ids, scores


def _found(queries: DataFrame, candidates: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, vec_id and score for every (query, shard) pair of the query rows.

    ``queries`` has the shard (region and part) it is for, its block and the floor that its
    score must reach.
    """

    def search(key, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(found) and len(asked):
            tree = BallTree(found["vec_id"].to_numpy().copy(), np.array(found["v"].tolist(), np.int64))
            for own, vector, floor in zip(asked["query_id"], asked["v"], asked["floor"], strict=True):
                ids, scores = tree.search(own, np.asarray(vector, np.int64), k, -np.inf if np.isnan(floor) else floor)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    copies = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shard = ["dim", "region", "part", "block"]
    return copies.groupBy(*shard).cogroup(queries.groupBy(*shard)).applyInPandas(
        search, "query_id long, vec_id long, score long"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _by_length(batch: pa.RecordBatch, dims: str = "dim") -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """length, rows and vectors (as floats) of each length in a batch."""
    lengths = batch.column(dims).to_numpy()
    for dim in np.unique(lengths).tolist():
        rows = batch.filter(pa.array(lengths == dim))
        yield dim, rows, rows.column("v").flatten().to_numpy().astype(float).reshape(len(rows), dim)


def regions_of(rows: DataFrame, total: int, wanted: int) -> dict[int, Regions]:
    """Regions for each length in a sample of about ``SAMPLE`` rows."""
    some = rows.select("dim", "v").sample(min(1.0, SAMPLE / max(total, 1)), 8).limit(2 * SAMPLE).toArrow()
    out = {}
    for batch in some.combine_chunks().to_batches():
        for dim, _, points in _by_length(batch):
            out.setdefault(dim, []).append(points)
    return {dim: Regions.of(np.concatenate(parts), wanted) for dim, parts in out.items()}


def _alone(dim: int) -> Regions:
    """One region, for a length that the sample does not have."""
    return Regions(np.zeros(0, np.int64), np.zeros(0), np.zeros((1, dim)))


def placed(rows: DataFrame, regions: dict[int, Regions]) -> DataFrame:
    """The vectors with their region, their distance from its centre and a random salt.

    Save it: a second run would deal other salts.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng()
        for batch in batches:
            for dim, part, points in _by_length(batch):
                known = regions.get(dim) or _alone(dim)
                region = known.place(points)
                far = np.sqrt(((points - known.centres[region]) ** 2).sum(axis=1))
                columns = [region, far, random.integers(0, 2**62, len(part))]
                yield pa.record_batch([*part.columns, *map(pa.array, columns)], names)

    small_batches(rows.sparkSession)
    names = [*rows.columns, "region", "far", "salt"]
    schema = "vec_id long, dim int, v array<long>, region long, far double, salt long"
    return rows.mapInArrow(freeing(step), schema)


class Shards:
    """What is known of the regions: their balls and how many shards each has."""

    def __init__(self, regions: dict[int, Regions], found: list, shard_rows: int):
        self.regions, self.radii, self.parts = {}, {}, {}
        for row in found:
            known = self.regions.setdefault(row.dim, regions.get(row.dim) or _alone(row.dim))
            empty = len(known.centres)
            self.radii.setdefault(row.dim, np.zeros(empty))[row.region] = row.radius
            self.parts.setdefault(row.dim, np.zeros(empty, np.int64))[row.region] = -(-row.n // shard_rows)

    def bounds(self, dim: int, queries: np.ndarray) -> np.ndarray:
        return np.where(self.parts[dim], self.regions[dim].reaches(queries, self.radii[dim]), -np.inf)


def _homes(queries: DataFrame, shards: Shards) -> DataFrame:
    """query_id, dim, v and the home: a region that has the highest bound, and a part of it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, points in _by_length(batch):
                if dim in shards.regions:
                    region = np.argmax(shards.bounds(dim, points), axis=1)
                    part = np.abs(rows.column("query_id").to_numpy() % shards.parts[dim][region])
                    yield pa.record_batch([*rows.columns, pa.array(region), pa.array(part)], names)

    names = ["query_id", "dim", "v", "home", "home_part"]
    return queries.mapInArrow(freeing(step), "query_id long, dim int, v array<long>, home long, home_part long")


def _elsewhere(asked: DataFrame, shards: Shards) -> DataFrame:
    """One row for each shard but the home that may hold a score of the query's floor."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, points in _by_length(batch):
                floor = rows.column("floor").to_numpy(zero_copy_only=False)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                parts = shards.parts[dim]
                reached = (shards.bounds(dim, points) >= floor[:, None]) & (parts > 0)
                home, home_part = (rows.column(c).to_numpy() for c in ("home", "home_part"))
                # As many rows at a time as are one query's shards, or a batch's queries.
                for region in np.flatnonzero(reached.any(axis=0)).tolist():
                    for part in range(int(parts[region])):
                        wanted = reached[:, region] & ~((home == region) & (home_part == part))
                        if some := int(wanted.sum()):
                            sent = rows.select(["query_id", "dim", "v", "block", "floor"]).filter(pa.array(wanted))
                            place = [pa.array(np.full(some, x, np.int64)) for x in (region, part)]
                            yield pa.record_batch([*sent.columns, *place], names)

    names = ["query_id", "dim", "v", "block", "floor", "region", "part"]
    schema = "query_id long, dim int, v array<long>, block int, floor double, region long, part long"
    return asked.mapInArrow(freeing(step), schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best among all other vectors.

    Both inputs have vec_id, dim and v.
    """
    vectors = saved(vectors.select("vec_id", "dim", "v"), "vectors")
    total = vectors.count()
    regions = regions_of(vectors, total, max(1, -(-total // shard_rows)))
    rows = saved(placed(vectors, regions), "placed")
    # One row a region and length of vectors.
    balls = rows.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    shards = Shards(regions, balls, shard_rows)
    parts = rows.sparkSession.createDataFrame(
        [(b.dim, b.region, -(-b.n // shard_rows)) for b in balls], "dim int, region long, parts long"
    )
    candidates = rows.join(F.broadcast(parts), ["dim", "region"]).select(
        "vec_id", "dim", "v", "region", F.pmod("salt", "parts").alias("part")
    )
    asked = saved(_homes(queries.select(F.col("vec_id").alias("query_id"), "dim", "v"), shards), "queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "query_id"), F.lit(blocks)).cast("int"))
    home = asked.withColumnsRenamed({"home": "region", "home_part": "part"}).withColumn("floor", F.lit(None).cast("double"))
    at_home = saved(_found(home, candidates, blocks, k), "home")
    kth = _best(at_home, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    elsewhere = _elsewhere(asked.join(kth, "query_id", "left"), shards)
    return _best(at_home.unionByName(_found(elsewhere, candidates, blocks, k)), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def search_report(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100."""
    vectors = integer_vectors(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = f"""
WITH vectors AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
