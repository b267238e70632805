from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from staysearch.functions import ages, wire

AGES = [
    ("10, 5", "5,10"),
    ("", ""),
    (None, ""),
    ("5,5,3", "3,5,5"),
    ("0,5", "5"),
    ("abc,4", "4"),
    (" 7 ,\t12", "7,12"),
    ("17,2,10", "2,10,17"),
]


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_ages(spark):
    assert column(spark, [raw for raw, _ in AGES], ages.normalize_ages) == [out for _, out in AGES]


@pytest.mark.parametrize("given, wanted", [("10,5", "5,10"), ([10, 5], "5,10"), (None, ""), ([0, 3], "3"), ("", ""), ("5,,3", "3,5"), ("x, 4 y", "4")])
def test_canonical_ages(given, wanted):
    assert ages.canonical_ages(given) == wanted


def test_variant_label(spark):
    df = spark.createDataFrame([(1, ""), (2, "5,10"), (3, None)], "adults INT, ages STRING")
    labels = [r.l for r in df.select(ages.variant_label(F.col("adults"), F.col("ages")).alias("l")).collect()]
    assert labels == ["1 взр.", "2 взр., дети 5, 10", "3 взр."]


def test_wire_date(spark):
    texts = ["20513", "2026-03-01", "0", "2026-3-1", "", "x", None, "-1", "99999999", "2026-02-30", "1969-12-31", "2149-06-07"]
    first = date(2026, 3, 1)
    assert column(spark, texts, wire.wire_date) == [first, first, date(1970, 1, 1)] + [None] * 9


def test_wire_price(spark):
    texts = ["5500.00", "5500.5", "", None, "zz", "99999999999.00", " 12 "]
    zero = Decimal("0.00")
    wanted = [Decimal("5500.00"), Decimal("5500.50"), zero, zero, None, None, Decimal("12.00")]
    assert column(spark, texts, wire.wire_price) == wanted


def test_wire_flag_and_currency(spark):
    flags = ["0", "1", "true", "false", "", None, "junk", "2"]
    assert column(spark, flags, wire.wire_flag) == [0, 1, 1, 0, 0, 0, 0, 1]
    assert column(spark, ["USD", "", None, " "], wire.wire_currency) == ["USD", "RUB", "RUB", "RUB"]


def test_update_version(spark):
    row = spark.sql("SELECT timestamp'2026-01-01 00:00:00.123' AS t").select(wire.update_version(F.col("t")).alias("v"))
    assert row.first().v == 1767225600123
