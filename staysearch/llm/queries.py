"""Registered queries: each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import public_tokenizers

from staysearch.llm import bpe, line_dedup, near_dup, packing, quality_rff, quality_rules, sharding, token_counts, topk, toxicity
from staysearch.llm import turn_repair, url_filter, whitening
from staysearch.llm.common import table


@cache
def definition(name: str) -> str:
    """A tokenizer file's text; the driver reads it, tasks get it with their code."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES = {
    "op1_nnpu_toxicity": lambda spark, d: toxicity.score_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_batched_bpe": lambda spark, d: bpe.round_trip(table(spark, d, "documents"), definition(BYTE_BPE)),
    "op4_histogram_sort": lambda spark, d: sharding.shard_report(table(spark, d, "documents")),
    "op5_site_line_dedup": lambda spark, d: line_dedup.line_report(table(spark, d, "documents")),
    "op7_exact_complement_packing": lambda spark, d: packing.pack_report(
        table(spark, d, "documents"), definition(WORD_BPE)
    ),
    "op10_length_histogram": lambda spark, d: token_counts.count_report(
        table(spark, d, "documents"), definition(BYTE_BPE)
    ),
}
QUERIES["op9_hashed_quality_rules"] = lambda spark, d: quality_rules.rule_report(
    table(spark, d, "documents"), table(spark, d, "labels")
)
QUERIES["op6_fourier_quality"] = lambda spark, d: quality_rff.score_report(
    table(spark, d, "documents"), table(spark, d, "labels")
)
QUERIES["op8_ball_tree_topk"] = lambda spark, d: topk.search_report(table(spark, d, "embeddings"))
QUERIES["op2_bayes_minhash"] = lambda spark, d: near_dup.near_duplicates(table(spark, d, "documents"))
QUERIES["op11_bloom_url_filter"] = lambda spark, d: url_filter.url_report(
    table(spark, d, "pages"), table(spark, d, "labels")
)
QUERIES["op12_lightest_repair"] = lambda spark, d: turn_repair.repair_report(table(spark, d, "conversations"))
QUERIES["op13_weighted_whitening"] = lambda spark, d: whitening.whitening_report(table(spark, d, "embeddings"))
ORACLES = {"op5_site_line_dedup": line_dedup.ORACLE, "op8_ball_tree_topk": topk.ORACLE}
ORACLES |= {"op11_bloom_url_filter": url_filter.ORACLE, "op12_lightest_repair": turn_repair.ORACLE}
