"""Toxicity, quality classifier and quality rules."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import tables  # noqa: E402

from staysearch.llm import quality_rff, quality_rules, toxicity  # noqa: E402
from staysearch.llm.common import fold, labelled, table, text_blocks  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t#%é\r", max_size=80)), min_size=1, max_size=6))
def test_measures_equal_brute_force(texts):
    found, kept = quality_rules.verdicts(quality_rules.GramModel(None), pa.array(texts, pa.string()))
    rows = list(zip(*[found[name].tolist() for name in quality_rules.MEASURES], strict=True))
    assert rows == [brute_measures(t) for t in texts]
    for row, failed, keep in zip(rows, found["base_failed"], kept, strict=True):
        assert failed == (row[0] < 10 or 100 * row[4] > 20 * row[0]) and keep == (not failed)


def accuracy(rows, labels, held):
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out == held]
    return sum(a == b for a, b in pairs) / len(pairs)


def known(spark, column):
    rows = table(spark, SF, "labels").collect()
    return {r.doc_id: r[column] for r in rows}


def check_scores(rows, n, folds, held):
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.score_report(docs, labels).collect()
    check_scores(rows, docs.count(), 5, 0)
    assert accuracy(rows, known(spark, "toxic"), True) > 0.93
    # Held-out labels are not read: turning them around changes nothing.
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(tuple, toxicity.score_report(docs, turned).collect())) == sorted(map(tuple, rows))


def test_non_negative_risk_learns_a_planted_word():
    rng = np.random.default_rng(0)
    x_p, x_u = rng.random((200, 5)) * 0.1, rng.random((2000, 5)) * 0.1
    x_p[:, 2] = 1
    x_u[:200, 2] = 1
    w, b = toxicity.train(x_p.astype(np.float32), x_u.astype(np.float32), 0.1, 1)
    scores = x_u @ w + b
    assert (scores[:200] > 0).all() and (scores[200:] < 0).all()


def one_pass(x, w, b):
    s = 1 / (1 + np.exp(-(x @ w + b)))
    return np.append(x.T @ (s * (1 - s)), (s * (1 - s)).sum()) / len(x), s.mean()


def test_slopes_over_all_texts_equal_one_pass(spark):
    texts = [t for _, t in tables.edge_texts()] * 3
    docs = tables.documents(spark, list(enumerate(texts)))
    chosen = toxicity.features(*next(text_blocks(pa.array([tables.sentence(1, 12)])))[2:])[1]
    hits = toxicity._hit_rows(docs.repartition(5), chosen, False)
    x = toxicity._matrix(toxicity._hit_rows(docs, chosen, True).toArrow(), len(chosen))
    assert len(x) == len(texts) and 0 < hits.count() < len(texts)
    rng = np.random.default_rng(5)
    members = [(rng.normal(size=len(chosen)).astype(np.float32), b) for b in (-3.0, 0.5)]
    for (slope, mean), (w, b) in zip(toxicity.whole_slopes(hits, len(texts), members), members, strict=True):
        wanted = one_pass(x.astype(float), w, b)
        np.testing.assert_allclose(slope, wanted[0], atol=1e-5)
        assert abs(mean - wanted[1]) < 1e-5
    # No text has a feature: only the bias is left.
    (slope, mean), *_ = toxicity.whole_slopes(tables.empty(hits), 7, members[:1])
    bare = 1 / (1 + np.exp(3))
    np.testing.assert_allclose([*slope, mean], [0.0] * len(chosen) + [bare * (1 - bare), bare], atol=1e-12)


@pytest.mark.parametrize("rare", [0.0, 0.05])
def test_turns_follow_all_text_where_the_sample_differs(rare):
    """The sample lacks a harmless word that half of all text and half of the positives have, or has
    little of it; the turns lower the risk over all text."""
    rng = np.random.default_rng(3)
    x_p, everything = rng.random((300, 4)) * 0.1, rng.random((20000, 4)) * 0.1
    x_p[:, 1], everything[:2000, 1] = 1, 1
    x_p[:150, 2], everything[10000:, 2] = 1, 1
    x_p, everything = x_p.astype(np.float32), everything.astype(np.float32)
    common, prior = int(1000 * rare), 0.1
    sample = np.concatenate([everything[:2000:20], everything[2000 : 2900 - common], everything[10000 : 10000 + common]])

    def measured(member):
        return toxicity.risk(x_p, member, one_pass(everything, *member)[1], prior)

    start = toxicity.train(x_p, sample, prior, 0)
    (member,) = toxicity.turned(x_p, sample, prior, [start], lambda now: [one_pass(everything, *m) for m in now])
    best = toxicity.train(x_p, everything, prior, 0)
    assert measured(best) < measured(start) - 0.005
    assert measured(member) < measured(best) + 0.4 * (measured(start) - measured(best))
    s_p, s_u = (1 / (1 + np.exp(-(x @ member[0] + member[1]))) for x in (x_p, everything))
    by_hand = prior * (1 - s_p).mean() + max(0, s_u.mean() - prior * s_p.mean())
    assert abs(measured(member) - by_hand) < 1e-5


def test_toxicity_of_edge_rows(spark):
    """Nulls, repeated rows, a hot id of many texts, empty tables."""
    rows = [(i, tables.sentence(i, 30) + (" vilest" * 3 if i % 5 == 0 else "")) for i in range(200)]
    hot = [(7, tables.sentence(1000 + k, 20)) for k in range(150)] + [(8, "the same row")] * 150
    docs = tables.documents(spark, rows + hot + tables.edge_texts())
    labels = tables.labels(spark, [(i, None, int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (3, 1, None)])
    found = toxicity.score_report(docs, labels).collect()
    check_scores([r for r in found if r.doc_id is not None], docs.where("doc_id IS NOT NULL").count(), 5, 0)
    got = {r.doc_id: r.predicted for r in found if r.doc_id is not None and r.doc_id >= 30}
    assert got == {i: int(i % 5 == 0) for i in range(30, 200)}
    assert toxicity.score_report(tables.empty(docs), labels).count() == 0
    assert {r.score < 0.01 for r in toxicity.score_report(docs, tables.empty(labels)).collect()} == {True}


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality_rff.score_report(docs, labels).collect()
    check_scores(rows, docs.count(), 3, 1)
    assert accuracy(rows, known(spark, "quality"), True) > 0.93
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(tuple, quality_rff.score_report(docs, turned).collect())) == sorted(map(tuple, rows))


def test_normal_equations_equal_one_pass(spark):
    stats = quality_rff.document_statistics(table(spark, SF, "documents")).selectExpr("*", "cast(doc_id % 2 AS int) AS y")
    kernel = quality_rff.Kernel(np.zeros(len(quality_rff.STATISTICS)), np.ones(len(quality_rff.STATISTICS)))
    gram, target = quality_rff.normal_equations(stats.repartition(5), kernel)
    pdf = stats.toPandas()
    z = kernel.features(pdf[list(quality_rff.STATISTICS)].to_numpy())
    np.testing.assert_allclose(gram, z.T @ z, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(target, z.T @ pdf["y"].to_numpy(), rtol=1e-8, atol=1e-8)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.5, (50, len(quality_rff.STATISTICS)))
    kernel = quality_rff.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = kernel.features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * quality_rff.BANDWIDTH**2))).mean() < 0.08


def test_isotonic_steps():
    centres, heights = quality_rff.isotonic([(0.0, 4, 1), (1.0, 2, 0), (2.0, 2, 1), (3.0, 2, 2)])
    assert heights.tolist() == pytest.approx([1 / 6, 0.5, 1.0])
    assert centres.tolist() == pytest.approx([1 / 3, 2.0, 3.0])


def test_rules_on_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality_rules.rule_report(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    wanted = known(spark, "quality")
    for r in rows:
        assert tuple(r[1:6]) == brute_measures(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.probability >= quality_rules.KEEP_AT)
    judged = [(r.kept, wanted[r.doc_id]) for r in rows if r.doc_id in wanted and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.95
    kept = quality_rules.passing(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_models_on_edges(spark):
    texts = tables.edge_texts()
    docs = tables.documents(spark, texts)
    odd = tables.labels(spark, [(10, 1, 1), (10, 0, 0), (11, None, None), (None, 1, 1), (12, 0, 0), (13, 1, 0), (999, 1, 1)])
    for labels in (odd, tables.empty(odd)):
        for report in (toxicity.score_report, quality_rff.score_report, quality_rules.rule_report):
            rows = report(docs, labels).collect()
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
            assert report(tables.empty(docs), labels).count() == 0
        for stage in (toxicity.clean, quality_rules.passing):
            assert stage(docs, labels).schema == docs.schema
    assert toxicity.clean(docs, tables.empty(odd)).count() == len(texts)


def test_folds_are_crc32_of_the_id(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 7, -3, None)], "doc_id long").select("doc_id", fold(__import__("pyspark").sql.functions.col("doc_id"), 5).alias("f"))
    for r in rows.collect():
        assert r.f == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5)


def test_blocks_cover_all_rows():
    rng = random.Random(2)
    texts = ["x" * rng.choice([0, 1, 700, 40]) for _ in range(5000)] + ["y" * 3_000_000, "", "z"]
    column = pa.array(["skip", *texts, None], pa.string()).slice(1)
    found = []
    for a, b, offsets, data in text_blocks(column):
        assert len(offsets) == b - a + 1 and offsets[-1] == len(data)
        found += np.diff(offsets).tolist()
    assert found == [*map(len, texts), 0]


def test_features_follow_all_unlabelled_text(spark, monkeypatch):
    """Which features are chosen does not depend on the sample that the steps learn from."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    whole = toxicity.fitted(docs, labels).buckets
    monkeypatch.setattr(toxicity, "UNLABELLED", 60)
    assert len(whole) and toxicity.fitted(docs, labels).buckets.tolist() == whole.tolist()


def test_repeated_rows_are_learned_from_once(spark):
    texts = [(1, "one"), (2, "two"), (2, "too"), (3, None)] + [(4, "four")] * 50
    rows = tables.labels(spark, [(k, 1, 1) for k in range(1, 5)])
    found = labelled(tables.documents(spark, texts), rows, "toxic", 3000, F.lit(True)).collect()
    assert sorted(r.label_id for r in found) == [1, 2, 3, 4]
    assert {(r.label_id, r.text) for r in found} <= set(texts)
