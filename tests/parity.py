"""Run registered queries next to their SQL twins: ``python tests/parity.py sf0.01 [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "date": "DATE",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _text(value: object) -> str:
    if pd.isna(value):
        return "~"
    if isinstance(value, pd.Timestamp):
        return value.strftime("%Y-%m-%d")
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def _sorted(frame: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    text = pd.DataFrame({c: frame[c].astype(object).map(_text) for c in columns})
    return text.sort_values(columns).reset_index(drop=True)


def compare(name: str, spark, con, sf_dir: str) -> tuple[list[str], int, float]:
    """Problems found, number of rows and seconds taken by the query."""
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = df.select(*columns).toPandas()
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ([] if len(got) else ["no rows"]), len(got), seconds
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return [f"columns {columns} vs {sorted(relation.columns)}"], len(got), seconds
    wanted = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    problems = [
        f"type of {c}: {t} vs {wanted[c]}"
        for c, t in df.dtypes
        if TYPES.get(t, t.upper()) != wanted[c]
    ]
    left, right = _sorted(got, columns), _sorted(relation.df(), columns)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    elif not left.equals(right):
        differ = (left != right).any(axis=1)
        problems.append(f"{differ.sum()} rows differ\n{left[differ].head(3)}\n{right[differ].head(3)}")
    return problems, len(got), seconds


def main(sf: str, names: list[str]) -> int:
    from staysearch.session import local_session

    sf_dir = f"/root/testdata/{sf}"
    spark = local_session(8, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name in names or list(entry.queries()):
        try:
            problems, rows, seconds = compare(name, spark, con, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, rows, seconds = [str(error)[:600]], 0, 0.0
        bad += bool(problems)
        state = "BAD" if problems else ("ok " if name in oracles else "-- ")
        print(f"{state} {name:30s} {rows:9d} {seconds:6.2f}s", *problems, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
