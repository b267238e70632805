"""Small tables with the cases that operators must survive."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Extra columns whose names operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, shard int, kept boolean, y int, doc string, key string, rep long"
)
WORDS = "amber birch cedar delta ember frost grove heath inlet jetty knoll larch marsh north orchid pine".split()


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randrange(50))]) for _ in range(n))


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], source: str | None = "s") -> DataFrame:
    rows = [
        (i, t, "en", source, None if t is None else len(t), 0.5, 3, False, 9, "x", "k", 7) for i, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, equal texts, one very long text."""
    base = [(10 + k, sentence(k, 12 + k)) for k in range(20)]
    return [
        *base,
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, sentence(100, 30)),
        (None, None),
        (10, base[0][1]),
        (10, base[0][1]),
        (4, base[1][1]),
        (5, "one two"),
        (6, "ONE two"),
        (7, sentence(7, 60_000)),
        (8, "a\n\nb\na\né 日本   x"),
    ]


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(df: DataFrame) -> DataFrame:
    return df.where("false")
