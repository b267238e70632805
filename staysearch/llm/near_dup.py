"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each text becomes its set of five-word shingles (64-bit fingerprints) and a MinHash
   signature; equal sets are one class, found by a 128-bit digest, and go on as the class's
   smallest doc_id.
2. Signatures are cut into bands. Members of a bucket are compared with the bucket's smallest
   member first, and linked ones are joined to components. A bucket that still holds several
   components is compared block by block inside tasks, between components only, and each pair
   in the first band that it shares. A block returns its links, not its pairs. No pair of a
   bucket stays unexamined that could add a link.
3. A pair's signatures are compared in batches of 32 hashes. After each batch the posterior of
   the similarity (uniform prior) prunes the pair if it reaches the threshold with less
   probability than ``MISS``.
4. Survivors are verified on their full shingle sets: 100 * intersection >= 75 * union.
5. Links make components; a document is kept if its id is its component's smallest.

With 32 bands of 4 hashes a pair at the threshold itself shares no band with probability
5e-6; more similar pairs are lost less often.

Null and empty texts, and texts without words, have no shingles and are linked with nothing;
the same holds for rows without an id, which keep a null component. Rows with one id count as
one document. Repeated rows are exact copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staysearch.llm.common import freeing, id_text, saved, text_blocks
from staysearch.llm.components import components
from staysearch.llm.textbytes import GRAM, LOWER, Fingerprints, mixed, per_text, windows, words

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
PERCENT = 75
MISS = 1e-6
CELL = 256
BROADCAST_IDS = 200_000
# Odd multipliers of the hash functions and salts of the digests.
MULTIPLIERS = np.random.Generator(np.random.PCG64(2)).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)
SALTS = np.random.Generator(np.random.PCG64(3)).integers(1, 2**63, 2, dtype=np.uint64)


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingles, one text after the other, and the size of each set."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, texts = words(offsets, low)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    hashes = Fingerprints(low).spans(starts, ends)
    first, grams = windows(hashes, texts, SHINGLE)
    count = per_text(texts, n)
    begin = np.cumsum(count) - count
    owner, values = [texts[first]], [grams]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        total = np.full(len(short), size, np.uint64) * GRAM[9]
        for k in range(size):
            total += hashes[begin[short] + k] * GRAM[k]
        owner.append(short)
        values.append(mixed(total))
    owner, values = np.concatenate(owner), np.concatenate(values)
    by_text = np.argsort(owner, kind="stable")
    owner, values = owner[by_text], values[by_text]
    edges = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], per_text(owner[new], n)


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32) of the sets; empty sets have zeros."""
    out = np.zeros((len(sizes), HASHES), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for h in range(HASHES):
            hashed = (values * MULTIPLIERS[h]) >> np.uint64(32)
            out[full, h] = np.minimum.reduceat(hashed.astype(np.uint32), starts)
    return out


def digests(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, which identify it."""
    full = np.flatnonzero(sizes)
    out = []
    for salt in SALTS:
        sums = np.zeros(len(sizes), np.uint64)
        if len(full):
            sums[full] = np.add.reduceat(mixed(values ^ salt), (np.cumsum(sizes) - sizes)[full])
        out.append(sums.view(np.int64))
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (d1, d2), band hashes and signature (16 bits a hash)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(1)):
                values, sizes = shingle_sets(offsets, data)
                rows = signatures(values, sizes).astype("<u2")
                wide = rows.astype(np.uint64).reshape(b - a, BANDS, ROWS)
                bands = mixed((wide * GRAM[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * GRAM[10])
                raw = rows.tobytes()
                width = 2 * HASHES
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        *map(pa.array, digests(values, sizes)),
                        _lists(bands.view(np.int64).ravel(), np.full(b - a, BANDS)),
                        pa.array([raw[i * width : (i + 1) * width] for i in range(b - a)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "signature"],
                )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"
    return id_text(docs).mapInArrow(freeing(step), schema)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    edges = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(values))


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch end, the fewest matches whose posterior still allows the threshold.

    With m of n hashes equal and a uniform prior, the similarity is at least t with the
    probability that a Binomial(n + 1, t) is at most m.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs (left[a], right[b]) that no batch of hashes prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, least in enumerate(least_matches()):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), HASHES)


def likely(pairs: DataFrame, signature: DataFrame) -> DataFrame:
    """The pairs (a, b) that survive the comparison of their signatures."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                rows = [_signature_rows(batch.column(k)) for k in (2, 3)]
                yield batch.select([0, 1]).take(pa.array(surviving(*rows, at, at)))

    joined = pairs.join(signature.selectExpr("rep AS a", "signature AS sa"), "a").join(
        signature.selectExpr("rep AS b", "signature AS sb"), "b"
    )
    return joined.select("a", "b", "sa", "sb").mapInArrow(freeing(step), "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and shingles (sorted) of the documents in ``nodes``, whose texts are read again."""
    wanted = saved(nodes.select("node").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = (
        id_text(docs)
        .withColumnRenamed("doc_id", "node")
        .join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(1)):
                values, sizes = shingle_sets(offsets, data)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), _lists(values.view(np.int64), sizes)], ["node", "shingles"]
                )

    return saved(texts.mapInArrow(freeing(step), "node long, shingles array<long>"), "shingles")


def similar(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets reach the threshold with the set x; all are sorted (unsigned)."""
    if not others or not len(x):
        return np.zeros(len(others), bool)
    sizes = np.array([len(y) for y in others])
    x, flat = x.view(np.uint64), np.concatenate(others).view(np.uint64)
    hit = np.append(0, np.cumsum(x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat))
    ends = np.cumsum(sizes)
    common = hit[ends] - hit[ends - sizes]
    return (100 * common >= PERCENT * (len(x) + sizes - common)) & (common > 0)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                similar(x.values.to_numpy(), [y.values.to_numpy()])[0]
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    sets = full_sets(docs, pairs.selectExpr("a AS node").union(pairs.selectExpr("b")))
    return (
        pairs.join(sets.selectExpr("node AS a", "shingles AS sa"), "a")
        .join(sets.selectExpr("node AS b", "shingles AS sb"), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(freeing(step), "a long, b long")
    )


def _cells(members: DataFrame, linked: DataFrame) -> DataFrame:
    """bucket, band, cell, rep and component: the blocks of buckets that hold several components.

    ``members`` has bucket, band, rep and pivot. Pairs with the pivot have been examined. A
    bucket's largest component needs no comparison with itself, so its members meet the others
    only: others' chunk i meets chunk j of the largest component, and chunk i' >= i of the
    others.
    """
    rows = (
        members.where("rep <> pivot")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component"))
    )
    counted = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = (
        counted.groupBy("bucket")
        .agg(
            F.count("*").alias("parts"),
            F.sum("n").alias("all"),
            F.max(F.struct("n", "component")).alias("most"),
        )
        .where("parts > 1")
        .selectExpr(
            "bucket",
            "most.component AS main",
            f"CASE WHEN all <= {CELL} THEN 0 ELSE ceil(most.n / {CELL}) END AS mains",
            f"CASE WHEN all <= {CELL} THEN 1 ELSE ceil((all - most.n) / {CELL}) END AS others",
        )
    )
    # Without chunks of the main component (mains = 0) everything is in the cell (0, 0).
    placed = rows.join(open_, "bucket").selectExpr(
        "bucket",
        "band",
        "rep",
        "component",
        "mains",
        "others",
        "mains > 0 AND component = main AS is_main",
        "CASE WHEN mains > 0 AND component = main THEN pmod(xxhash64(rep), mains) "
        "ELSE pmod(xxhash64(rep), others) END AS chunk",
    )
    return placed.selectExpr(
        "bucket",
        "band",
        "explode(CASE WHEN is_main THEN transform(sequence(0, others - 1), i -> struct(i AS i, chunk AS j)) "
        "ELSE transform(sequence(0, mains + others - 1), k -> CASE "
        "WHEN k < mains THEN struct(chunk AS i, k AS j) "
        "ELSE struct(least(chunk, k - mains) AS i, mains + greatest(chunk, k - mains) AS j) END) END) AS cell",
        "rep",
        "component",
    )


def _gathered(cells: DataFrame, *columns: str) -> DataFrame:
    """One row a cell: its key, and its members as lists of equal length."""
    return (
        cells.groupBy("bucket", "band", "cell")
        .agg(F.collect_list(F.struct("rep", "component", *columns)).alias("members"))
        .selectExpr(
            "bucket", "band", "cell.i AS i", "cell.j AS j", *[f"members.{c} AS {c}" for c in ("rep", "component", *columns)]
        )
    )


def _open_pairs(rows: np.ndarray, component: np.ndarray, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members x of a cell with the members y > x of other components that x has yet to be
    verified with: pairs whose first shared band is this one, and whose signatures survive."""
    for x in range(len(rows) - 1):
        y = np.flatnonzero(component[x + 1 :] != component[x]) + x + 1
        earlier = (rows[y, : ROWS * band] == rows[x, : ROWS * band]).reshape(len(y), band, ROWS)
        y = y[~earlier.all(axis=2).any(axis=1)] if band else y
        y = y[surviving(rows, rows, np.full(len(y), x), y)]
        if len(y):
            yield x, y


def _across(docs: DataFrame, cells: DataFrame, signature: DataFrame) -> DataFrame:
    """Links (a, b) between the components of a cell, as few as connect them.

    A first pass over signatures finds the members with a pair to verify; a second pass gives
    these their full sets and verifies within the cell, where links join components at once.
    """

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = _signature_rows(batch.column(6)[k].values)
                component = batch.column(5)[k].values.to_numpy()
                taken = np.zeros(len(rows), bool)
                for x, y in _open_pairs(rows, component, batch.column(1)[k].as_py()):
                    taken[x] = taken[y] = True
                if taken.any():
                    some = pa.array(taken)
                    key = [pa.array([batch.column(c)[k].as_py()] * int(taken.sum()), batch.schema.types[c]) for c in range(4)]
                    lists = [batch.column(c)[k].values.filter(some) for c in (4, 5, 6)]
                    yield pa.record_batch([*key, *lists], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rep = batch.column(4)[k].values.to_numpy()
                component = batch.column(5)[k].values.to_numpy().copy()
                rows = _signature_rows(batch.column(6)[k].values)
                sets = [x.values.to_numpy() for x in batch.column(7)[k].values]
                found = []
                for x, y in _open_pairs(rows, component.copy(), batch.column(1)[k].as_py()):
                    y = y[component[y] != component[x]]
                    for hit in y[similar(sets[x], [sets[i] for i in y])].tolist():
                        if component[hit] != component[x]:
                            component[component == component[hit]] = component[x]
                            found.append((rep[x], rep[hit]))
                a, b = (np.array([pair[c] for pair in found], np.int64) for c in (0, 1))
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    names = ["bucket", "band", "i", "j", "rep", "component", "signature"]
    key = "bucket long, band int, i long, j long"
    signed = _gathered(cells.join(signature.select("rep", "signature"), "rep"), "signature")
    left = saved(signed.mapInArrow(freeing(narrowed), f"{key}, rep long, component long, signature binary"), "cells")
    sets = full_sets(docs, left.selectExpr("rep AS node"))
    whole = left.join(sets.withColumnRenamed("node", "rep"), "rep").selectExpr(
        "bucket", "band", "struct(i, j) AS cell", "rep", "component", "signature", "shingles"
    )
    return _gathered(whole, "signature", "shingles").mapInArrow(freeing(joined), "a long, b long").where("a <> b").distinct()


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a and b of links that connect all components of the classes' smallest ids."""
    reps = saved(
        # The id is a key, so that a group's copies and their signatures do not meet in one task.
        rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2", "n_shingles"]).select(
            F.col("doc_id").alias("rep"), "bands", "signature"
        ),
        "representatives",
    )
    signature = reps.select("rep", "signature")
    bands = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last")
    members = saved(bands.join(shared.select("bucket", "pivot"), "bucket"), "members")
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    first = saved(verified(docs, saved(likely(stars, signature), "pairs")), "links")
    linked = components(first)
    return saved(first.unionAll(_across(docs, _cells(members, linked), signature)), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = saved(described(docs), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(
        full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    # Rows of one id but different texts are one document: their classes are linked too.
    same = full.join(classes, ["d1", "d2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = same.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
    twins = repeated.selectExpr("low AS a", "high AS b").unionAll(repeated.selectExpr("a", "low AS b"))
    found = components(links(docs, full, classes).unionAll(twins))
    described_ids = rows.select("doc_id", "n_shingles", "d1", "d2").join(
        classes, ["d1", "d2", "n_shingles"], "left"
    )
    return described_ids.join(found, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id.

    Rows that share an id, or have none, are documents by their text: equal texts of one id give
    one row (the smallest by all columns), different ones stand for themselves and come after all
    other ids.
    """
    shared = saved(
        docs.groupBy(F.col("doc_id").alias("shared")).count().where("count > 1 OR shared IS NULL").select("shared"),
        "shared-ids",
    )
    if shared.isEmpty():
        return docs.join(_gone(docs.select("doc_id", "text")), "doc_id", "left_anti").select(*docs.columns)
    of_shared = F.col("doc_id").eqNullSafe(F.col("shared"))
    texts = saved(
        docs.join(shared, of_shared, "left_semi")
        .groupBy("doc_id", "text")
        .agg(F.min(F.struct("*")).alias("row"))
        .select(F.col("row").alias("doc")),
        "shared-texts",
    )
    several = texts.groupBy("doc.doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared"))
    stood_for = F.lit(1 << 62) + F.shiftrightunsigned(
        F.xxhash64("doc.doc_id", F.col("doc.doc_id").isNull(), "doc.text", F.col("doc.text").isNull()), 2
    )
    named = texts.join(several, F.col("doc.doc_id").eqNullSafe(F.col("shared")), "left").select(
        "doc",
        F.when(F.col("shared").isNotNull() | F.col("doc.doc_id").isNull(), stood_for)
        .otherwise(F.col("doc.doc_id"))
        .alias("unit"),
    )
    others = docs.join(shared, of_shared, "left_anti").select(F.struct("*").alias("doc"), F.col("doc_id").alias("unit"))
    rows = others.unionByName(named)
    gone = _gone(rows.select(F.col("unit").alias("doc_id"), "doc.text")).withColumnRenamed("doc_id", "unit")
    return rows.join(gone, "unit", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _gone(docs: DataFrame) -> DataFrame:
    """The ids of documents that are not kept."""
    return saved(near_duplicates(docs).where("NOT kept").select("doc_id"), "gone")
