"""The corpus pipeline: stages against their operators, columns, and planted cases."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import tables  # noqa: E402

import corpus_pipeline  # noqa: E402
from staysearch.llm import packing, quality_rules, toxicity  # noqa: E402
from staysearch.llm.common import saved, table  # noqa: E402
from test_similar import brute_components, brute_lines  # noqa: E402

from staysearch.llm import line_dedup  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [saved(table(spark, SF, "documents"), "docs")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], SF), name))
    return docs


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_rules", "line_dedup", "near_dedup", "packing"
    ]


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_filters_follow_their_reports(spark, steps):
    labels = table(spark, SF, "labels")
    toxic = {r.doc_id for r in toxicity.score_report(steps[0], labels).collect() if r.predicted}
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in steps[0].collect()} - toxic
    kept = {r.doc_id for r in quality_rules.rule_report(steps[1], labels).collect() if r.kept}
    assert {r.doc_id for r in steps[2].collect()} == kept
    # Clean documents stay: labelled ones that are neither toxic nor of low quality.
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & kept) > 0.95 * len(clean)


def test_lines_and_copies_equal_brute_force(steps):
    rows = [(r.doc_id, r.source, r.text) for r in steps[2].collect()]
    wanted = {i: text for i, _, _, text in brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST)}
    found = steps[3].collect()
    assert {r.doc_id: r.text for r in found} == wanted
    assert all(r.n_chars == len(r.text) for r in found)
    groups = brute_components(list(wanted.items()))
    assert Counter(r.doc_id for r in steps[4].collect()) == Counter({i for i, c in groups.items() if i == c})


def test_packing_holds_every_remaining_document(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps[4].collect()}
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
    assert len(ends) <= 1.02 * sum(ends.values()) / packing.CAPACITY + 1


def test_run_equals_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))


def test_edges_pass_through(spark):
    docs = tables.documents(spark, tables.edge_texts())
    for start in (docs, tables.empty(docs)):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = saved(stage(spark, df, SF), name)
            if name != "packing":
                assert df.columns == docs.columns
        assert df.columns[0] == "doc_id"


def test_groups_of_copies_keep_their_text(spark):
    """A third of the rows are exact copies, a third near copies: one document of each is left."""
    body = [[tables.sentence(1000 * g + k, 12) for k in range(10)] for g in range(2)]
    rows = [(k, "\n".join(["Menu of the site", *body[0]])) for k in range(40)]
    for k in range(40):
        near = list(body[1])
        near[k % 10] += f" edited{k}"
        rows.append((100 + k, "\n".join(["Menu of the site", *near])))
    rows += [(200 + k, "\n".join(["Menu of the site", tables.sentence(9000 + k, 90)])) for k in range(40)]
    docs = tables.documents(spark, rows)
    cleaned = saved(line_dedup.cleaned(docs), "cleaned")
    texts = dict(rows)
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: t.split("\n", 1)[1] for i, t in texts.items()}
    assert {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, cleaned, SF).collect()} == {
        0, 100, *range(200, 240)
    }
