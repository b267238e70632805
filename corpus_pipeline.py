"""Corpus pipeline: toxicity, quality rules, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and gives what it reads back to the next stage. All stages but the last
return the columns of documents; the last returns one row for each packed piece. An empty
table passes through all stages; nulls are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staysearch.llm import line_dedup, near_dup, packing, quality_rules, toxicity
from staysearch.llm.common import saved, table
from staysearch.llm.queries import WORD_BPE, definition


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifiers call toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the n-gram model's threshold."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def remove_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that too many documents of a source share; the documents stay."""
    return line_dedup.cleaned(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dup.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 2048 tokens."""
    return packing.pack_report(docs, definition(WORD_BPE))


STAGES = [
    ("toxicity", remove_toxic),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", remove_site_lines),
    ("near_dedup", remove_near_duplicates),
    ("packing", pack_sequences),
]

#: The classifiers, MinHash and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
