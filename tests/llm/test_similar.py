"""Near duplicates, line dedup, shards and top-k against brute force."""

from __future__ import annotations

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import parity  # noqa: E402
import tables  # noqa: E402

from staysearch.llm import line_dedup, near_dup, sharding, topk  # noqa: E402
from staysearch.llm.common import table  # noqa: E402
from staysearch.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(SMALL))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_components(texts):
    ids = [i for i, _ in texts if i is not None]
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_components(df, texts):
    wanted, sizes = brute_components(texts), Counter((i, len(shingles(t))) for i, t in texts)
    rows = df.collect()
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == sizes
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else wanted[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def edited(text, seed, share):
    """The text with this share of its words replaced at the end, so that shingles go with them."""
    words = text.split()
    n = round(len(words) * share)
    rng = random.Random(seed)
    return " ".join(words[: len(words) - n] + [f"w{rng.randrange(10**9)}" for _ in range(n)])


def test_near_duplicates_on_edges(spark):
    texts = tables.edge_texts()
    base = tables.sentence(500, 80)
    texts += [(200 + k, edited(base, k, share)) for k, share in enumerate([0, 0.05, 0.1, 0.13, 0.15, 0.2, 0.25, 0.3])]
    check_components(near_dup.near_duplicates(tables.documents(spark, texts)), texts)


def test_large_groups_and_chains(spark, monkeypatch):
    """Buckets of several components, cut into many blocks, lose no link."""
    monkeypatch.setattr(near_dup, "CELL", 8)
    texts = []
    for g in range(3):
        # Each text shares its start with its group; neighbours in the chain are similar.
        base = tables.sentence(900 + g, 120).split()
        for k in range(40):
            words = base[: 120 - k] + [f"g{g}x{j}" for j in range(k)]
            texts.append((1000 * g + 997 * k % 400, " ".join(words)))
    common = tables.sentence(42, 60)
    texts += [(5000 + k, common + " " + tables.sentence(5000 + k, 35)) for k in range(60)]
    check_components(near_dup.near_duplicates(tables.documents(spark, texts)), texts)


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_components(near_dup.near_duplicates(docs), texts)


def test_two_texts_of_one_id_are_one_document(spark):
    a, b = tables.sentence(1, 40), tables.sentence(2, 40)
    docs = tables.documents(spark, [(9, a), (9, b), (3, a), (4, b)])
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(9, 3), (3, 3), (4, 3)}


def test_one_of_each_keeps_whole_rows(spark):
    texts = tables.edge_texts()
    docs = tables.documents(spark, texts)
    kept = near_dup.one_of_each(docs)
    assert kept.schema == docs.schema
    wanted = brute_components(texts)
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows if r.doc_id is not None) == Counter({i for i, c in wanted.items() if i == c})
    assert sum(r.doc_id is None for r in rows) == 2
    assert near_dup.one_of_each(tables.empty(docs)).count() == 0


def test_one_of_each_keeps_every_text(spark):
    """Unrelated texts of one id all stay, and copies without an id go."""
    a, b, c, d = (tables.sentence(k, 40) for k in range(4))
    rows = [(9, a), (9, b), (9, b), (3, a), (4, d), (None, c), (None, c), (None, d), (None, None), (None, None)]
    kept = near_dup.one_of_each(tables.documents(spark, rows))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(9, b): 1, (3, a): 1, (4, d): 1, (None, c): 1, (None, None): 1}


def test_posterior_bound():
    least = near_dup.least_matches()
    assert least == sorted(least) and least[0] < 24 < least[-1]
    # Independent check of the first bound by numeric integration of the posterior.
    grid = np.linspace(0, 1, 200_001)[1:-1]
    for m, fits in ((least[0], True), (least[0] - 1, False)):
        density = grid**m * (1 - grid) ** (near_dup.BATCH - m)
        assert (density[grid >= 0.75].sum() / density.sum() >= near_dup.MISS) == fits


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    random.Random(1).shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(2, 61)} | {k: 100 for k in range(101, 140)}


# -- line dedup ------------------------------------------------------------------


def brute_lines(rows, ratio, least):
    """(doc_id, host, text) → remaining texts."""
    strip = " \t\r\x0b\x0c"
    pages = Counter(h for _, h, _ in rows)
    seen = Counter()
    for _, host, text in rows:
        seen.update({(host, x.strip(strip)) for x in (text or "").split("\n") if x.strip(strip)})
    gone = {k for k, n in seen.items() if n >= least and n / pages[k[0]] > ratio}
    out = Counter()
    for i, host, text in rows:
        if text is None:
            out[i, 0, 0, None] += 1
            continue
        lines = text.split("\n")
        left = [x for x in lines if (host, x.strip(strip)) not in gone]
        out[i, len(lines), len(lines) - len(left), "\n".join(left)] += 1
    return out


def test_site_lines(spark):
    rows = []
    for k in range(60):
        host = ["a", "b", None][k % 3]
        menu = f"Menu of {host}" if k % 2 else f"  Menu of {host}\t"
        rows.append((k, host, f"{menu}\ntext {k}\n\ntext {k % 7}\nlast"))
    rows += [(60, "a", None), (61, "a", ""), (62, "small", "last\nlast"), (0, "a", rows[0][2]), (None, "b", "last\nx")]
    schema = "doc_id long, source string, text string, host string, line string, at int, n_chars long"
    docs = spark.createDataFrame([(i, h, t, "h", "l", 1, None) for i, h, t in rows], schema)
    wanted = brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST)
    assert any(n[2] for n in wanted)
    assert Counter(map(tuple, line_dedup.line_report(docs).collect())) == wanted
    kept = line_dedup.cleaned(docs)
    assert kept.schema.names == docs.schema.names
    assert Counter(r.text for r in kept.collect()) == Counter(
        {t: n for t, n in Counter(x[3] for x, c in wanted.items() for _ in range(c)).items()}
    )
    assert line_dedup.line_report(tables.empty(docs)).count() == 0


# -- shards ----------------------------------------------------------------------


def check_shards(rows, texts, shards=24):
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == wanted
    by_shard: dict[int, list] = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by_shard.setdefault(r.shard, []).append(r)
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by_shard.get(k, [])) for k in range(shards)]
    largest = max((r["size"] for r in rows), default=0)
    total = sum(sizes)
    assert all(abs(s - total / shards) <= largest + 0.01 * total / shards for s in sizes)


def test_shards_of_edges_and_a_hot_group(spark):
    texts = tables.edge_texts() + [(1000 + k, "the same text") for k in range(900)]
    texts += [(5000 + k, tables.sentence(k, 20)) for k in range(900)]
    check_shards(sharding.shard_report(tables.documents(spark, texts)).collect(), texts)


def test_shards_do_not_depend_on_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    one, other = (sharding.shard_report(x).collect() for x in (docs, docs.repartition(7)))
    check_shards(one, texts)
    assert sorted(one) == sorted(other)


def test_empty_shards_and_arranged_rows(spark):
    docs = tables.documents(spark, tables.edge_texts())
    assert sharding.shard_report(tables.empty(docs)).count() == 0
    placed = sharding.arranged(docs, 4)
    assert placed.count() == docs.count()
    assert set(placed.columns) == set(docs.columns)
    assert {r.shard for r in placed.collect()} <= set(range(4))


# -- top-k -----------------------------------------------------------------------


def brute_top(rows, k=10):
    vectors = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for i, q in vectors:
        if i % 100 == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i and len(v) == len(q)
            )
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_top_k_with_ties_and_gaps(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(330)]
    rows += [(400 + k, [1.0, 0.5, 0.0, 0.0, -1.0, 2.0]) for k in range(120)]
    rows += [(600, None), (601, [1.0, None, 0.0]), (602, [math.nan] * 6), (603, [math.inf] * 6)]
    rows += [(700, [1.0, 2.0]), (701, [0.5, 0.5]), (None, [1.0] * 6), (800, []), (900, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<double>, shard int, score double")
    vectors = topk.integer_vectors(df)
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), shard_rows=shard_rows).collect()
    assert {tuple(r) for r in found} == brute_top(rows)
    assert len(found) == len({(r.query_id, r["rank"]) for r in found})


@pytest.mark.parametrize("name", ["op5_site_line_dedup", "op8_ball_tree_topk"])
def test_sql_twins(spark, sf_dir, name):
    problems, rows, _ = parity.compare(name, spark, parity.connect(sf_dir), sf_dir)
    assert not problems and rows


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search_report(df).count() == 0


def test_regions_bound_their_scores_and_are_dropped(spark, monkeypatch):
    """Distant clusters and one vector that half of the rows have: few shards are searched."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (16, 8))
    points = np.concatenate([np.repeat(centres, 20, axis=0) + rng.normal(0, 5, (320, 8)), np.repeat(centres[:1], 320, axis=0)])
    known = topk.Regions.of(points[::2], 16)
    region = known.place(points)
    radii = np.array([np.sqrt(((points[region == r] - c) ** 2).sum(axis=1)).max(initial=0) for r, c in enumerate(known.centres)])
    assert (points @ points.T <= known.reaches(points, radii)[:, region]).all()

    sent = []
    real = topk._elsewhere
    monkeypatch.setattr(topk, "_elsewhere", lambda *given: sent.append((real(*given), given[1])) or sent[-1][0])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points / 1024)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(df)
    asked = vectors.where("vec_id % 100 = 0")
    found = topk.top_k(vectors, asked, shard_rows=40)
    assert {tuple(r) for r in found.collect()} == brute_top(rows)
    pairs, shards = sent[0]
    parts = shards.parts[8]
    assert parts.max() >= 8
    assert 0 < pairs.count() < asked.count() * (parts.sum() - 1) / 2
