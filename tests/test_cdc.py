import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from staysearch.schemas import RECORD
from staysearch.sources import cdc
from staysearch.sources.topics import read_topic

DAY = date(2026, 3, 1)


def records(spark, topic, *values):
    rows = [(topic, 0, i, None, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RECORD)


def wrap(payload):
    return json.dumps({"schema": None, "payload": payload})


def decoded(spark, topic, *values):
    return cdc.DECODERS[topic](cdc.unwrap(records(spark, topic, *values)))


def test_flat_nested_and_text_payloads(spark):
    rows = cdc.usable(
        decoded(
            spark,
            "availability",
            wrap({"placement_id": 1, "date": 20513, "available": 1}),
            wrap({"after": {"placement_id": 7, "date": 20513, "available": 0}}),
            wrap({"before": None, "after": {"placement_id": 8, "date": "2026-03-01", "available": True}, "op": "c"}),
            wrap(json.dumps({"placement_id": 9, "date": 20513, "available": "1"})),
        )
    )
    got = sorted((r.placement_id, r.date, r.available) for r in rows.collect())
    assert got == [(1, DAY, 1), (7, DAY, 0), (8, DAY, 1), (9, DAY, 1)]


def test_prices(spark):
    rows = cdc.usable(
        decoded(
            spark,
            "prices_by_day",
            wrap({"placement_id": 1, "date": "2026-03-01", "price": "5500.00", "currency": "RUB"}),
            wrap({"placement_id": 2, "date": 20513, "price": 5500.5}),
            wrap({"placement_id": 3, "date": 20513, "currency": ""}),
        )
    )
    got = sorted((r.placement_id, r.price, r.currency) for r in rows.collect())
    assert got == [(1, Decimal("5500.00"), "RUB"), (2, Decimal("5500.50"), "RUB"), (3, Decimal("0.00"), "RUB")]


def test_quarantine_reasons(spark):
    values = [
        wrap({"date": 20513, "available": 1}),
        wrap({"placement_id": 0, "date": 20513, "available": 1}),
        wrap({"placement_id": "abc", "date": "x", "price": "zz"}),
        wrap({"placement_id": 1, "price": "1"}),
        wrap({"placement_id": 1, "date": 20513, "price": "zz"}),
        "{bad",
        "",
        '{"other": 1}',
    ]
    rows = decoded(spark, "prices_by_day", *values).orderBy("version").collect()
    assert [r.reason for r in rows] == [
        "bad_key", "bad_key", "bad_key", "bad_date", "bad_price", "corrupt", "corrupt", "bad_key",
    ]
    log = cdc.quarantined(decoded(spark, "prices_by_day", *values))
    assert log.columns == ["source", "placement_id", "payload", "reason", "ts"]
    assert log.where("placement_id IS NULL OR payload IS NULL").count() == 0


def test_tombstones_and_deletes_are_dropped(spark):
    gone = {"before": {"placement_id": 1, "date": 20513}, "after": None, "op": "d"}
    assert decoded(spark, "availability", None, wrap(gone)).count() == 0


def test_variants_without_adults_are_left_out(spark):
    rows = decoded(
        spark,
        "placement_variants",
        wrap({"placement_id": 1, "adults": 0, "children_ages": ""}),
        wrap({"placement_id": 1, "adults": 255, "children_ages": "10, 5"}),
        wrap({"placement_id": 1, "adults": 300}),
        wrap({"placement_id": 0, "adults": 0}),
    )
    assert [(r.adults, r.children_ages) for r in cdc.usable(rows).collect()] == [(255, "5,10")]
    assert sorted(r.reason for r in cdc.quarantined(rows).collect()) == ["bad_adults", "bad_key"]


def test_every_message_is_accounted_for(spark):
    values = [wrap({"placement_id": i % 3, "date": 20513 + i, "available": 1}) for i in range(30)] + ["junk", "[1"]
    rows = decoded(spark, "availability", *values)
    assert cdc.usable(rows).count() + cdc.quarantined(rows).count() == len(values)


def parses(df):
    """Optimized plan: all parses, and those that run on every row (not within a CASE)."""
    jvm = df.sparkSession._jvm
    found, always = 0, 0

    def walk(expression, guarded):
        nonlocal found, always
        if expression.nodeName() == "JsonToStructs" or "from_json" in expression.prettyName():
            found, always = found + 1, always + (not guarded)
        inside = guarded or expression.nodeName() == "CaseWhen"
        children = expression.children()
        for i in range(children.size()):
            walk(children.apply(i), inside)

    def visit(plan):
        expressions = plan.expressions()
        for i in range(expressions.size()):
            walk(expressions.apply(i), False)
        for i in range(plan.children().size()):
            visit(plan.children().apply(i))

    assert jvm is not None
    visit(df._jdf.queryExecution().optimizedPlan())
    return found, always


def test_object_payloads_are_parsed_once(spark):
    """One parse runs on every message; the others only where that one does not fit."""
    rows = cdc.usable(cdc.decoded(records(spark, "prices_by_day", wrap({"placement_id": 1})), "prices_by_day"))
    found, always = parses(rows)
    assert always == 1 and found > 1


def test_a_topics_fields_are_enough(spark):
    """Decoding with the topic's own fields gives what decoding with all of them does."""
    values = [wrap({"placement_id": i, "date": 20513, "price": "1.5", "available": 1}) for i in range(3)]
    values += [json.dumps({"payload": json.dumps({"placement_id": 7, "date": 20513, "price": 2})}), "{bad", '{"other": 1}']
    rows = records(spark, "prices_by_day", *values)
    columns = ["placement_id", "date", "price", "currency", "reason", "payload"]
    short = cdc.decoded(rows, "prices_by_day").select(*columns)
    whole = cdc.decode_prices(cdc.unwrap(rows)).select(*columns)
    assert sorted(map(repr, short.collect())) == sorted(map(repr, whole.collect()))


def test_generations_override_offsets(spark):
    old, new = cdc.snapshot_version(0), cdc.snapshot_version(1)
    row = spark.range(1).select(
        cdc.event_version(F.lit(0), 0).alias("first"), cdc.event_version(F.lit(2**47), 0).alias("late")
    ).first()
    assert old < row.first < row.late < new


def test_read_topic_formats(spark, work):
    df = records(spark, "availability", wrap({"placement_id": 1}), "x")
    df.write.json(f"{work}/json")
    df.write.parquet(f"{work}/parquet")
    for fmt in ("json", "parquet"):
        got = read_topic(spark, "availability", f"{work}/{fmt}", fmt)
        assert got.count() == 2 and got.columns == ["topic", "partition", "offset", "timestamp", "value"]
