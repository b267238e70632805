import time
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from staysearch.schemas import AVAILABILITY, DAY_KEY, PRICES
from staysearch.session import REMOVE_SHUFFLES
from staysearch.sources.state import VersionedTable, period_number

FIRST = date(2026, 1, 1)


def rows(spark, *entries):
    """(placement, day number, available, version)"""
    data = [(p, FIRST + timedelta(days=d), a, None, v) for p, d, a, v in entries]
    return spark.createDataFrame(data, AVAILABILITY)


def state(df):
    return {(r.placement_id, (r.date - FIRST).days): (r.available, r.version) for r in df.collect()}


@pytest.fixture(params=[("month", 1), ("year", 4), ("day", 2)])
def table(request, spark, work):
    period, buckets = request.param
    return VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY, period=period, buckets=buckets)


def test_empty_table(table):
    assert table.latest().count() == 0 and table.log().count() == 0
    table.fold()
    assert table.held().number == 0


def test_reads_do_not_depend_on_folds(spark, table):
    table.append(rows(spark, (1, 0, 1, 1), (1, 0, 0, 2), (2, 40, 1, 1)), "a")
    wanted = {(1, 0): (0, 2), (2, 40): (1, 1)}
    assert state(table.latest()) == wanted
    table.fold()
    assert table.batches() == [] and state(table.latest()) == wanted
    # An older version that comes late must not win.
    table.append(rows(spark, (1, 0, 1, 1), (3, 400, 1, 1), (2, 40, 0, 5)), "b")
    wanted |= {(3, 400): (1, 1), (2, 40): (0, 5)}
    assert state(table.latest()) == wanted
    table.fold()
    table.fold()
    assert state(table.latest()) == wanted
    assert table.log().count() == len(wanted)


def test_append_again_replaces(spark, table):
    table.append(rows(spark, (1, 0, 1, 1), (1, 1, 1, 1)), "a")
    table.append(rows(spark, (1, 0, 1, 1)), "a")
    assert table.log().count() == 1


def test_pruned_reads(spark, table):
    everything = rows(spark, *[(p, d, 1, 1) for p in range(1, 6) for d in range(0, 120, 3)])
    table.append(everything, "a")
    table.fold()
    table.append(rows(spark, (2, 30, 0, 2)), "b")
    dates = (FIRST + timedelta(days=20), FIRST + timedelta(days=70))
    got = state(table.latest(dates, placement_id=2))
    assert got == {(2, d): ((0, 2) if d == 30 else (1, 1)) for d in range(21, 71, 3)}


def test_only_touched_periods_are_rewritten(spark, work):
    table = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY)
    table.append(rows(spark, (1, 0, 1, 1), (1, 40, 1, 1)), "a")
    table.fold()
    table.append(rows(spark, (1, 41, 1, 2)), "b")
    table.fold()
    folders = table.held().folders
    assert folders[202601].startswith("rows=00000001-") and folders[202602].startswith("rows=00000002-")
    assert len(state(table.latest())) == 3
    files = table.latest((FIRST, FIRST)).inputFiles()
    assert files and all("period=202601" in f for f in files)


def test_replace_supersedes_open_changes(spark, table):
    table.append(rows(spark, (1, 0, 1, 1)), "a")
    table.replace(rows(spark, (2, 0, 1, 7)))
    assert state(table.latest()) == {(2, 0): (1, 7)}
    table.append(rows(spark, (1, 0, 1, 1)), "late")
    assert len(state(table.latest())) == 2


def test_batches_that_land_during_a_fold_stay_open(spark, work):
    table = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY)
    table.append(rows(spark, (1, 0, 1, 1)), "a")
    write = table._write

    def landing(*args):
        table.append(rows(spark, (1, 0, 0, 2), (2, 0, 1, 1)), "b")
        return write(*args)

    table._write = landing
    table.fold()
    assert table.batches() == ["b"]
    assert state(table.latest()) == {(1, 0): (0, 2), (2, 0): (1, 1)}


def test_a_fold_that_stops_before_it_drops_changes_can_run_again(spark, work):
    table = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY)
    table.append(rows(spark, (1, 0, 1, 1), (1, 40, 1, 1)), "a")
    table.fold()
    table.append(rows(spark, (1, 0, 0, 2)), "b")
    drop, table._drop = table._drop, lambda batches: None
    table.fold()
    wanted = {(1, 0): (0, 2), (1, 40): (1, 1)}
    assert table.batches() == ["b"] and state(table.latest()) == wanted
    table._drop = drop
    table.fold()
    assert table.batches() == [] and state(table.latest()) == wanted


def test_folded_changes_are_dropped(spark, work):
    table = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY)
    for n in range(3):
        table.append(rows(spark, (n, 0, 1, 1)), f"d{n}")
        table.fold()
    assert not list(Path(table.path).glob("changes/batch=*"))
    assert len(state(table.latest())) == 3


def test_unfinished_writes_are_not_read(spark, table):
    table.append(rows(spark, (1, 0, 1, 1)), "a")
    table.append(rows(spark, (1, 0, 0, 2)), "torn")
    (Path(table.path) / "changes/batch=torn" / "_SUCCESS").unlink()
    assert state(table.latest()) == {(1, 0): (1, 1)}
    table.append(rows(spark, (1, 0, 0, 2)), "torn")
    assert state(table.latest()) == {(1, 0): (0, 2)}


def test_writes_leave_no_shuffle_files(spark, table):
    """a job of several writes does not hold the shuffles of all of them on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles().mkString("\n").split("\n")
        return {name for name in found if "shuffle_" in name}

    before, setting = shuffles(), spark.conf.get(REMOVE_SHUFFLES, None)
    for n in range(3):
        table.append(spark.range(100).selectExpr("id AS placement_id", "DATE'2026-01-01' AS date", "1 AS available", "now() AS updated_at", f"{n} AS version"), f"b{n}")
    table.fold()
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(REMOVE_SHUFFLES, None) == setting
    assert table.latest().count() == 100


def test_folders_can_change(spark, work):
    old = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY, period="month", buckets=1)
    old.append(rows(spark, (1, 0, 1, 1), (2, 50, 1, 1)), "a")
    old.fold()
    new = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY, period="year", buckets=3)
    assert len(state(new.latest((FIRST, FIRST + timedelta(days=90)), 2))) == 1
    new.append(rows(spark, (3, 50, 1, 1)), "b")
    new.fold()
    assert set(new.held().folders) == {2026} and len(state(new.latest())) == 3


def test_a_hot_placement_spreads_over_files(spark, work):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY, period="year")
        hot = spark.range(100_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("placement_id"),
            F.date_add(F.lit(FIRST), (F.col("id") % 365).cast("int")).alias("date"),
            F.lit(1).alias("available"),
            F.lit(None).cast("timestamp").alias("updated_at"),
            F.col("id").alias("version"),
        )
        table.replace(hot)
        assert len(table.latest().inputFiles()) > 1
        assert table.latest().count() == 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("schema", [PRICES, AVAILABILITY])
def test_many_open_changes_are_dealt_out_before_they_are_collapsed(spark, work, monkeypatch, schema):
    """One key holds a third of the log; no task holds what its part of the scan has."""
    monkeypatch.setattr("staysearch.sources.state.TASK_BYTES", 1500, raising=False)
    table = VersionedTable(spark, f"{work}/t", schema, DAY_KEY, period="year")
    values = {"available": F.col("version") % 2, "price": F.col("version") / 4, "currency": F.concat(F.lit("c"), "version")}
    log = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).cast("bigint").alias("placement_id"),
        F.date_add(F.lit(FIRST), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 800).cast("int")).alias("date"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.pmod(F.col("id") * 7919, F.lit(6007)).alias("version"),
    ).select("*", *[v.alias(k) for k, v in values.items()])
    wanted = {}
    for r in log.collect():
        if r.version > wanted.get((r.placement_id, r.date), -1):
            wanted[r.placement_id, r.date] = r.version

    def latest(df):
        own = [f for f in ("available", "currency") if f in df.columns]
        got = df.select(*DAY_KEY, "version", *own).collect()
        assert all(r[3] in (r.version % 2, f"c{r.version}") for r in got)
        assert len(got) == len({(r.placement_id, r.date) for r in got})
        return {(r.placement_id, r.date): r.version for r in got}

    parts = [log.where(F.col("version") % 3 == n) for n in range(3)]
    table.append(parts[0], "a")
    table.append(parts[1].unionByName(parts[2]), "b")
    plan = table.latest()._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[-1]
    assert "Scan parquet" in below and "WindowGroupLimit" not in below and "Aggregate" not in below
    assert latest(table.latest()) == wanted
    year = (date(2027, 1, 1), date(2027, 12, 31))
    assert latest(table.latest(year)) == {k: v for k, v in wanted.items() if k[1].year == 2027}
    # The same beside folded rows, and folded.
    other = VersionedTable(spark, f"{work}/o", schema, DAY_KEY, period="year")
    other.append(parts[1], "a")
    other.fold()
    other.append(parts[0], "b")
    other.append(parts[2], "c")
    assert latest(other.latest()) == wanted
    for each in (table, other):
        each.fold()
        assert each.batches() == [] and latest(each.latest()) == wanted


def test_period_numbers():
    day = date(2026, 3, 9)
    assert [period_number(day, p) for p in ("year", "month", "day")] == [2026, 202603, 20260309]


def test_weighted_arrangement_evens_out_what_rows_become(spark, work, monkeypatch):
    """One placement has most days, another most weight per day: files come out alike."""
    monkeypatch.setattr("staysearch.sources.state.LEAST_ROWS", 1000)
    monkeypatch.setattr("staysearch.sources.state.FILE_ROWS", 4000)
    table = VersionedTable(spark, f"{work}/t", AVAILABILITY, DAY_KEY, period="year", buckets=2)
    days = spark.createDataFrame(
        [(p, FIRST + timedelta(days=d)) for p in range(1, 41) for d in range(700 if p == 7 else 60)],
        "placement_id bigint, date date",
    )
    weights = spark.createDataFrame([(p, 200 if p == 9 else 0 if p == 11 else 5) for p in range(1, 41)], "placement_id bigint, weight bigint")
    placed = table.arrange_weighted(days, days, weights.where("weight > 0"))
    sizes = [
        r["n"]
        for r in placed.join(weights, "placement_id").groupBy(F.spark_partition_id().alias("p"), "period", "bucket")
        .agg(F.sum("weight").alias("n")).collect()
    ]
    total = 37 * 60 * 5 + 700 * 5 + 60 * 200
    assert sum(sizes) == total and max(sizes) <= 1.6 * 4000 and len(sizes) >= total / 4000
    assert placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("period", "bucket").alias("n")).where("n > 1").count() == 0
