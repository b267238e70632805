import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from staysearch.operators import changes as ch
from staysearch.operators.joins import hot_keys, lookup_join
from staysearch.operators.latest import latest_by_key, latest_in_parts
from staysearch.operators.nest import page_of
from staysearch.operators.rekey import default_placements, first_placements

DAY = date(2026, 3, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log_rows(n=2000, keys=40, seed=7):
    rng = random.Random(seed)
    # A third of all rows has one key.
    return [(1 if rng.random() < 0.34 else rng.randrange(keys), rng.randrange(5), f"v{i}", i) for i in range(n)]


@pytest.mark.parametrize("text", [True, False])
def test_latest_matches_brute_force_in_any_order(spark, text):
    rows = log_rows()
    value = "v" if text else "n"
    wanted = {}
    for k, d, v, i in rows:
        wanted[(k, d)] = v if text else i * 3
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(k, d, v, i * 3, i) for k, d, v, i in rows], "k INT, d INT, v STRING, n INT, i BIGINT")
    got = latest_by_key(df.select("k", "d", value, "i"), ["k", "d"], "i")
    assert {(r.k, r.d): r[value] for r in got.collect()} == wanted
    again = latest_by_key(got.withColumn("i", F.lit(0)), ["k", "d"], "i")
    assert sorted(again.collect()) == sorted(got.collect())


def test_latest_reduces_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a", 2, 3)], "k INT, v STRING, n INT, i BIGINT")
    assert plan(latest_by_key(df.drop("v"), ["k"], "i")).count("HashAggregate") == 2
    ranked = plan(latest_by_key(df, ["k"], "i"))
    assert ranked.count("WindowGroupLimit") == 2
    assert "SortAggregate" not in ranked


@pytest.mark.parametrize("value", ["v", "n"])
def test_latest_in_parts_is_the_latest(spark, value):
    rows = [*log_rows(), (None, 1, "x", 1), (None, 1, None, 2), (3, None, "y", 5), (2, None, "z", None)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(k, d, v, d, i) for k, d, v, i in rows], "k INT, d INT, v STRING, n INT, i BIGINT")
    df = df.select("k", "d", value, "i")
    got = latest_in_parts(df, ["k", "d"], "i", 7)
    assert got.columns == ["k", "d", value, "i"]
    wanted = latest_by_key(df, ["k", "d"], "i", keep_version=True)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    # Nothing holds rows in the tasks of the scan.
    assert not {"WindowGroupLimit", "Aggregate", "Sort"} & set(re.findall(r"WindowGroupLimit|Aggregate|Sort", plan(got).split("Exchange")[-1]))


def test_latest_keeps_null_values_of_the_last_row(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, None, 2)], "k INT, n INT, i INT")
    assert latest_by_key(df, ["k"], "i").collect() == [(1, None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast_join(spark, how):
    facts = spark.range(500).select((F.col("id") % 3 * 50).alias("k"), "id")
    lookup = spark.range(120).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    facts = facts.unionByName(spark.range(40).select(F.col("id").alias("k"), (F.col("id") + 1000).alias("id")))
    small = lookup_join(facts, lookup, "k", ["id"], how, size=10)
    large = lookup_join(facts, lookup, "k", ["id"], how, size=1 << 40, salts=8)
    assert "Broadcast" in plan(small)
    assert "_salt" in plan(large)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


def test_only_hot_keys_are_repeated(spark):
    hot = F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500 + 2)
    facts = spark.range(10_000).select(hot.alias("k"), "id")
    assert hot_keys(facts, "k", 32) == [1]
    lookup = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = lookup_join(facts, lookup, "k", ["id"], size=1 << 40)
    assert joined.count() == 10_000
    # The repeated side is cut to the hot key; the others join without copies.
    assert plan(joined).count("explode") == 1 and "Filter (id" in plan(joined)


def test_pages_depend_on_the_caller_alone(spark):
    rows = spark.range(1000).select("id", page_of(F.col("id"), 10).alias("page"))
    sizes = [r["count"] for r in rows.groupBy("page").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000
    assert rows.select(page_of(F.col("id"), 1).alias("page")).distinct().collect() == [(0,)]


REQUEST = (
    "request_id BIGINT, kind STRING, placement_id BIGINT, date STRING, date_from STRING, date_to STRING, "
    "available STRING, price DECIMAL(12,2), currency STRING"
)


def requests(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], REQUEST)


def test_validation(spark):
    from decimal import Decimal as D

    placements = spark.createDataFrame([(1,), (2,)], "placement_id BIGINT")
    leap = (date(2026, 1, 1) + timedelta(days=365)).isoformat()
    over = (date(2026, 1, 1) + timedelta(days=366)).isoformat()
    cases = [
        (("availability", 1, "2026-03-01", None, None, "1", None, None), ""),
        (("availability", 1, None, "2026-03-01", "2026-03-10", "false", None, None), ""),
        (("availability", 1, None, "2026-01-01", leap, "0", None, None), ""),
        (("availability", 1, None, "2026-01-01", over, "0", None, None), "range_too_long"),
        (("availability", 1, None, "2026-03-10", "2026-03-01", "0", None, None), "range_reversed"),
        (("availability", 9, "2026-03-01", None, None, "1", None, None), "placement_unknown"),
        (("availability", None, "2026-03-01", None, None, "1", None, None), "placement_unknown"),
        (("availability", 1, None, "2026-03-01", None, "1", None, None), "date_required"),
        (("availability", 1, "2026-3-1", None, None, "1", None, None), "date_format"),
        (("availability", 1, "2026-03-01", None, None, "2", None, None), "available_invalid"),
        (("availability", 1, "2026-03-01", None, None, None, None, None), "available_invalid"),
        (("price", 2, "2026-03-01", None, None, None, D("10.00"), None), ""),
        (("price", 2, "2026-03-01", None, None, None, D("0.00"), "EUR"), ""),
        (("price", 2, "2026-03-01", None, None, None, D("-1.00"), None), "price_invalid"),
        (("price", 2, "2026-03-01", None, None, None, None, None), "price_invalid"),
        (("price", 2, "2026-03-01", None, None, None, D("1.00"), "RU"), "currency_invalid"),
        (("price", 9, None, None, None, None, D("-1.00"), "RU"),
         "placement_unknown,date_required,price_invalid,currency_invalid"),
    ]
    checked = ch.validate_changes(requests(spark, *[c for c, _ in cases]), placements)
    got = {r.request_id: ",".join(r.errors) for r in checked.collect()}
    assert [got[i] for i in range(len(cases))] == [errors for _, errors in cases]
    assert ch.accepted(checked).count() + ch.rejected(checked).count() == len(cases)
    counts = {r.request_id: r["count"] for r in ch.receipts(ch.accepted(checked)).collect()}
    assert counts == {0: 1, 1: 10, 2: 366, 11: 1, 12: 1}
    assert ch.expand_days(ch.accepted(checked)).count() == sum(counts.values())
    prices = {r.request_id: r.currency for r in ch.accepted(checked).where("kind = 'price'").collect()}
    assert prices == {11: "RUB", 12: "EUR"}


def test_date_wins_over_range(spark):
    placements = spark.createDataFrame([(1,)], "placement_id BIGINT")
    both = requests(spark, ("availability", 1, "2026-05-05", "2026-03-01", "2026-03-02", "1", None, None))
    days = ch.expand_days(ch.accepted(ch.validate_changes(both, placements)))
    assert [r.date for r in days.collect()] == [date(2026, 5, 5)]


def test_upsert_last_change_wins(spark):
    current = spark.createDataFrame([(1, DAY, 1), (2, DAY, 1)], "placement_id INT, date DATE, available INT")
    changes = spark.createDataFrame(
        [(1, DAY, 0, 5), (1, DAY, 1, 4), (3, DAY, 1, 1)], "placement_id INT, date DATE, available INT, request_id INT"
    )
    got = ch.upsert(current, changes, ["placement_id", "date"], "request_id")
    assert sorted((r.placement_id, r.available) for r in got.collect()) == [(1, 0), (2, 1), (3, 1)]


def test_insert_if_absent_takes_the_first(spark):
    current = spark.createDataFrame([(1, "old")], "k INT, v STRING")
    rows = spark.createDataFrame([(1, "x", 0), (2, "b", 2), (2, "a", 1)], "k INT, v STRING, i INT")
    assert ch.insert_if_absent(current, rows, ["k"], "i").select("k", "v").collect() == [(2, "a")]


def test_default_placements_are_dense_in_hotel_order(spark):
    hotels = spark.createDataFrame([(h,) for h in (1, 2, 150_000, 100_001, 7, 400_000)], "hotel_id BIGINT")
    placements = spark.createDataFrame([(10, 2, "a"), (4, 2, "b"), (20, 99, "c")], "placement_id BIGINT, hotel_id BIGINT, name STRING")
    added = default_placements(hotels, placements)
    assert sorted((r.hotel_id, r.placement_id) for r in added.collect()) == [
        (1, 21), (7, 22), (100_001, 23), (150_000, 24), (400_000, 25),
    ]
    firsts = {r.hotel_id: r.placement_id for r in first_placements(hotels, placements).collect()}
    assert firsts[2] == 4 and set(firsts) == {1, 2, 7, 100_001, 150_000, 400_000}


def test_a_hot_key_spreads_over_tasks(spark):
    """A third of the facts has one placement; no task gets anywhere near a third."""
    plain = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {key: spark.conf.get(key) for key in plain}
    for key, value in plain.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000)
        facts = spark.range(60_000).select(hot.alias("k"), (F.col("id") % 3000).alias("day"))
        lookup = spark.range(1000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
        joined = lookup_join(facts, lookup, "k", ["day"], size=1 << 40)
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).count()
        largest, total = tasks.agg(F.max("count"), F.sum("count")).first()
        assert total == 120_000 and largest / total < 0.1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
