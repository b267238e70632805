import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from staysearch import registry
from staysearch.bindings import Inventory
from staysearch.operators import joins
from staysearch.operators.latest import latest_by_key
from staysearch.plans import hotels as hp
from staysearch.plans import jobs, reports, search, stays, totals
from staysearch.schemas import SEARCH_KEY
from staysearch.sources import state as state_module
from staysearch.sources import store as store_module
from staysearch.sources import tabular
from staysearch.sources.demo import demo_inventory
from staysearch.sources.store import Store
from staysearch.streaming import pipeline

FIRST = date(2026, 1, 1)
CONTENT = [*SEARCH_KEY, "available", "price", "currency"]


@pytest.fixture(scope="module")
def demo(spark):
    return demo_inventory(spark, hotels=3, placements_per_hotel=2, days=30)


@pytest.fixture()
def store(spark, work, demo):
    store = Store(spark, f"{work}/store")
    stamp = F.lit("2026-01-01").cast("timestamp")
    assert jobs.sync_variants(store, demo.variants.withColumn("updated_at", stamp), "v") == 120
    jobs.load_snapshot(store, "availability", demo.availability.withColumn("updated_at", stamp), "a")
    jobs.load_snapshot(store, "prices_by_day", demo.prices.withColumn("updated_at", stamp), "p")
    return store


def content(df):
    return sorted(map(tuple, df.select(*CONTENT).collect()))


def executed(df):
    """The formatted plan: a tree, then the details of every node."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_demo_sizes(demo):
    frames = (demo.hotels, demo.placements, demo.variants, demo.availability, demo.prices)
    assert [df.count() for df in frames] == [3, 6, 120, 180, 180]
    assert {r.city for r in demo_inventory(demo.hotels.sparkSession, hotels=60).hotels.collect()} == {
        "Москва", "Санкт-Петербург", "Сочи",
    }
    big = demo_inventory(demo.hotels.sparkSession, hotels=10, days=200)
    share = big.availability.agg(F.avg("available")).first()[0]
    assert 0.78 < share < 0.82
    low, high = big.prices.agg(F.min("price"), F.max("price")).first()
    assert (low, high) == (5000, 8900)


def test_refresh_counts_and_repeats(store):
    jobs.refresh_search(store)
    first = content(store.search.latest())
    assert len(first) == 3600
    jobs.refresh_search(store)
    assert content(store.search.latest()) == first
    counts = {r.entity: r.cnt for r in jobs.store_counts(store).collect()}
    assert counts == {
        "placement_variants": 120, "availability_final": 180, "prices_by_day_final": 180, "search_by_variant": 3600,
    }


def test_partial_refreshes_add_up_to_the_full_one(store):
    jobs.refresh_search(store)
    full = content(store.search.latest())
    other = Store(store.spark, f"{store.root}-parts")
    for topic in ("availability", "prices_by_day", "placement_variants"):
        other.final(topic).append(store.final(topic).log(), "copy")
    for placement in range(1, 7):
        jobs.refresh_search_part(other, placement, FIRST, FIRST + timedelta(days=29), f"p{placement}")
    assert content(other.search.latest()) == full


def test_refresh_without_broadcast_is_the_same(store, monkeypatch):
    jobs.refresh_search(store)
    wanted = content(store.search.latest())
    for module in (jobs, joins):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    jobs.refresh_search(store)
    assert content(store.search.latest()) == wanted


def test_refresh_does_not_shuffle_multiplied_rows(store):
    availability = store.availability.latest()
    days = search.day_state(availability, store.prices.latest(), "left")
    plan = store.search.multiplied(days, availability)._jdf.queryExecution().executedPlan().toString()
    top = plan.index("BroadcastHashJoin")
    assert "Exchange" not in plan[:top] and "Sort" not in plan[:top]
    assert "Exchange" in plan[top:]


def test_many_variants_are_no_reason_to_shuffle_multiplied_rows(store, monkeypatch):
    """F3 to F6: variants that are too many to be broadcast reach the days as lists."""
    jobs.refresh_search(store)
    wanted = content(store.search.latest())
    changes = search.day_state(store.availability.latest(), store.prices.latest(), "full").where("placement_id < 4")
    few = content(store.search.arranged_changes(changes))
    for module in (joins, store_module, jobs):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    availability = store.availability.latest()
    days = search.day_state(availability, store.prices.latest(), "left")
    for rows in (store.search.multiplied(days, availability, -1), store.search.arranged_changes(changes)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        top = plan.index("Generate inline(options")
        assert "Exchange" not in plan[:top] and "Sort" not in plan[:top] and "Exchange" in plan[top:]
    jobs.refresh_search(store)
    assert content(store.search.latest()) == wanted
    assert content(store.search.arranged_changes(changes)) == few and len(few) == 3 * 30 * 20


def test_many_variants_are_not_broadcast_for_their_few_bytes_on_disk(store, demo):
    """sorted keys take two or three bytes a row on disk, and the driver holds them whole."""
    many = store.spark.range(15_000).select((F.col("id") + 1).alias("placement_id"))
    many = demo_inventory(store.spark, hotels=1, placements_per_hotel=1, days=1).variants.drop("placement_id").crossJoin(many)
    rows = many.withColumns({"updated_at": F.lit("2026-01-03").cast("timestamp"), "version": F.lit(9 << 50)})
    store.variants.append(rows, "many")
    limits = joins.BROADCAST_BYTES, state_module.BROADCAST_BYTES
    assert store.variants.stored_bytes() < min(limits) and max(limits) < store.search._variants_size()

    def hints(df):
        return df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")

    assert hints(store.variants.latest()) == 0
    days = search.day_state(store.availability.latest(), store.prices.latest(), "left")
    assert hints(store.search._expanded(days)) == 0
    store.variants.fold()
    assert store.variants.latest().count() == 300_000


@pytest.mark.parametrize("word", [64, 3])
def test_many_changes_meet_the_stored_rows_as_days(store, demo, monkeypatch, word):
    """the read of a search table with many open changes shuffles no multiplied rows.

    Stored rows lack a variant that the changes have; some changes are older than the rows, some
    days are new, some placements have no change.
    """
    monkeypatch.setattr(search, "WORD", word)
    stamp = F.lit("2026-01-01").cast("timestamp")
    extra = demo.variants.where("placement_id < 3").limit(1).withColumns(
        {"adults": F.lit(9).cast("smallint"), "children_ages": F.lit(None).cast("string"), "updated_at": stamp}
    )
    jobs.refresh_search(store)
    jobs.sync_variants(store, extra, "extra")
    states = search.day_state(store.availability.latest(), store.prices.latest(), "left").where("placement_id < 5")
    old, new = F.col("date") < FIRST + timedelta(days=10), F.col("date") >= FIRST + timedelta(days=20)
    changed = states.where(old | new).withColumns(
        {"version": F.when(old, 1).otherwise(1 << 40).cast("bigint"), "price": (F.col("price") + 1).cast("decimal(12,2)")}
    )
    later = states.where(F.col("date") == FIRST).withColumn("date", F.date_add("date", 90))
    store.search.append(changed.unionByName(later), "many")
    columns = [*CONTENT, "updated_at", "version"]
    rows = lambda: sorted(map(repr, store.search.latest().select(*columns).collect()))
    wanted = rows()
    assert len(wanted) == 3600 + 4 * 20 + 10 + 10 + 1  # new days, the new variant on the changed ones
    monkeypatch.setattr(state_module, "BROADCAST_BYTES", -1)
    assert rows() == wanted
    plan = store.search.latest()._jdf.queryExecution().executedPlan().toString()
    top = plan.index("Generate inline(")
    assert "Exchange" not in plan[:top] and "Exchange" in plan[top:]
    store.search.fold()
    assert rows() == wanted
    monkeypatch.setattr(search, "MOST_KINDS", 1)
    assert rows() == wanted


def test_refresh_writes_with_many_tasks(store, monkeypatch):
    """The files follow from the multiplied rows, not from the days that are shuffled."""
    monkeypatch.setattr("staysearch.sources.state.LEAST_ROWS", 200)
    jobs.refresh_search(store)
    files = store.search.latest().inputFiles()
    assert len(files) >= store.spark.sparkContext.defaultParallelism
    assert len(content(store.search.latest())) == 3600


def test_repeated_syncs_do_not_change_the_plan(store, demo):
    stamp = F.lit("2026-01-02").cast("timestamp")
    for n in range(3):
        jobs.sync_variants(store, demo.variants.withColumn("updated_at", stamp), f"again-{n}")
    assert store.variants.log().count() == 120
    assert store.variants.stored_bytes() < joins.BROADCAST_BYTES


def test_a_batch_beside_the_rebuild_is_not_lost(store, demo):
    """The batch lands after the rebuild read the finals, and before it is published."""
    jobs.refresh_search(store)
    day = store.availability.latest(placement_id=1).where(F.col("date") == FIRST)
    change = day.withColumn("available", F.lit(5).cast("smallint")).withColumn("version", F.lit(99).cast("bigint"))
    change = store.spark.createDataFrame(change.collect(), change.schema)
    write = store.search._write

    def landing(*args):
        store.search._write = write
        write(*args)
        store.availability.append(change, "batch")
        store.prices.append(store.prices.latest().limit(0), "batch")
        pipeline.write_search(store, "batch")

    store.search._write = landing
    jobs.refresh_search(store)
    got = store.search.latest(placement_id=1).where(F.col("date") == FIRST).select("available").distinct().collect()
    assert got == [(5,)]


def test_ranges_are_merged_and_rebuilt_together(spark, store):
    def ranges(*rows):
        days = [(p, FIRST + timedelta(days=a), FIRST + timedelta(days=b)) for p, a, b in rows]
        return spark.createDataFrame(days, "placement_id bigint, date_from date, date_to date")

    wanted = ranges((1, 0, 4), (1, 3, 9), (1, 10, 12), (1, 20, 22), (2, 5, 5), (2, 5, 5), (3, 9, 2), (99, 0, 3))
    merged = sorted((r.placement_id, (r.date_from - FIRST).days, (r.date_to - FIRST).days) for r in jobs.merged_ranges(wanted).collect())
    assert merged == [(1, 0, 12), (1, 20, 22), (2, 5, 5), (99, 0, 3)]
    jobs.refresh_search_ranges(store, wanted, "ranges")
    found = store.search.latest().groupBy("placement_id").count().collect()
    assert {r.placement_id: r["count"] for r in found} == {1: 16 * 20, 2: 20}
    jobs.refresh_search_ranges(store, wanted.limit(0), "none")
    assert store.search.latest().count() == 17 * 20


def test_added_variants_equal_a_rebuild(store, demo):
    jobs.refresh_search(store)
    stamp = F.lit("2026-01-03").cast("timestamp")
    more = demo.variants.where("placement_id < 3").withColumn("adults", F.lit(7).cast("smallint")).distinct()
    everything = demo.variants.unionByName(more).withColumn("updated_at", stamp)
    jobs.add_variants(store, everything, "more")
    appended = store.spark.read.parquet(f"{store.search.path}/changes/batch=more")
    assert {r.placement_id for r in appended.select("placement_id").distinct().collect()} == {1, 2}
    found = content(store.search.latest())
    jobs.refresh_search(store)
    assert found == content(store.search.latest()) and len(found) == 3600 + 2 * 5 * 30


def test_ingest_writes_what_it_accepts(spark, store, demo):
    schema = (
        "request_id BIGINT, kind STRING, placement_id BIGINT, date STRING, date_from STRING, date_to STRING, "
        "available STRING, price DECIMAL(12,2), currency STRING"
    )
    rows = [
        (1, "availability", 1, None, "2026-01-01", "2026-01-03", "0", None, None),
        (2, "availability", 1, "2026-01-02", None, None, "1", None, None),
        (3, "price", 2, "2026-01-05", None, None, None, Decimal("7.50"), "EUR"),
        (4, "price", 99, "2026-01-05", None, None, None, Decimal("7.50"), "EUR"),
    ]
    at = datetime(2026, 2, 1)
    for _ in range(2):
        receipts, refused = jobs.ingest_changes(store, spark.createDataFrame(rows, schema), demo.placements, "in", at)
        assert {(r.request_id, r["count"]) for r in receipts.collect()} == {(1, 3), (2, 1), (3, 1)}
        assert [(r.request_id, r.errors) for r in refused.collect()] == [(4, "placement_unknown")]
        days = store.availability.latest((FIRST, FIRST + timedelta(days=2)), 1).orderBy("date").collect()
        assert [d.available for d in days] == [0, 1, 0]
        price = store.prices.latest(placement_id=2).where("date = '2026-01-05'").first()
        assert (price.price, price.currency) == (Decimal("7.50"), "EUR")
    assert store.availability.latest().count() == 180


def test_open_rows_leave_the_base_unshuffled(store):
    jobs.refresh_search(store)
    wanted = content(store.search.latest())
    jobs.refresh_search_part(store, 2, FIRST, FIRST + timedelta(days=5), "part")
    rows = store.search.latest()
    tree = executed(rows).split("\n\n")[0]
    assert "LeftAnti" in tree
    # The branch of unchanged rows has no exchange but the broadcast of the changed keys.
    rest = tree[: tree.index("LeftSemi")]
    assert "BroadcastHashJoin LeftAnti" in rest
    assert content(rows) == wanted


def test_partial_refresh_prunes_inputs(store):
    store.availability.fold()
    rows = store.availability.latest((FIRST, FIRST + timedelta(days=3)), 2)
    plan = executed(rows)
    assert "EqualTo(placement_id,2)" in plan and "GreaterThanOrEqual(date,2026-01-01)" in plan


def test_writers_agree(demo):
    stamp = F.lit("2026-01-01").cast("timestamp")
    one = F.lit(1).cast("bigint")
    some_prices = demo.prices.where("placement_id <> 2 OR day(date) < 9").withColumn("updated_at", stamp).withColumn("version", one)
    some_days = demo.availability.where("placement_id <> 3").withColumn("updated_at", stamp).withColumn("version", one)
    full = search.build_search(demo.variants, some_days, some_prices, "full")
    feeds = search.build_search_from_feeds(demo.variants, some_days, some_prices)
    assert content(full) == content(feeds)
    rebuilt = search.build_search(demo.variants, some_days, some_prices)
    assert rebuilt.count() == 5 * 30 * 20 and full.count() == 6 * 30 * 20
    only_price = full.where("placement_id = 3").agg(F.max("available"), F.min("price")).first()
    assert only_price[0] == 0 and only_price[1] > 0


def test_versions_of_a_day_only_grow(spark):
    def side(column, value, version):
        return spark.createDataFrame(
            [(1, FIRST, value, version)], f"placement_id INT, date DATE, {column}, version BIGINT"
        ).withColumn("updated_at", F.lit(None).cast("timestamp"))

    def prices(price, version):
        return side("price DOUBLE", price, version).withColumn("currency", F.lit("RUB"))

    a1, a2 = side("available INT", 1, 1), side("available INT", 0, 2)
    p0, p1 = prices(1.0, 1).limit(0), prices(5.0, 1)
    versions = [search.day_state(a, p, "full").first().version for a, p in ((a1, p0), (a1, p1), (a2, p1))]
    assert versions == [1, 2, 3]


STAY = stays.Stay(FIRST, FIRST + timedelta(days=6), adults=2, children_ages=[10, 5])


@pytest.fixture(scope="module")
def searchable(demo):
    stamp = F.lit("2026-01-01").cast("timestamp")
    finals = [df.withColumn("updated_at", stamp).withColumn("version", F.lit(1).cast("bigint")) for df in (demo.availability, demo.prices)]
    return search.build_search(demo.variants, *finals).cache()


def test_totals_follow_days(demo, searchable):
    days = stays.stay_days(searchable, STAY).collect()
    assert len(days) == 6 * 7
    totals = {r.placement_id: r for r in stays.stay_totals(searchable, STAY).collect()}
    for placement, row in totals.items():
        mine = [d for d in days if d.placement_id == placement]
        assert float(row.total_price) == sum(d.price for d in mine)
        assert row.available == all(d.available for d in mine) and row.days_found == 7
    by_hotel = stays.stay_totals_by_hotel(searchable, demo.placements, demo.hotels, STAY)
    assert tuple(stays.stay_summary(by_hotel).first()) == (3, 6)
    lost = stays.stay_totals_by_hotel(searchable, demo.placements, demo.hotels.where("hotel_id < 3"), STAY)
    assert tuple(stays.stay_summary(lost).first()) == (2, 4)


def test_nested_holds_the_same_days(demo, searchable):
    nested = stays.stay_nested(searchable, demo.placements, demo.hotels, STAY).collect()
    assert [(r.page, len(r.placements)) for r in nested] == [(0, 2)] * 3
    flat = sorted((p.placement_id, d.date, d.price) for r in nested for p in r.placements for d in p.dates)
    assert flat == sorted((r.placement_id, r.date, r.price) for r in stays.stay_days(searchable, STAY).collect())
    for r in nested:
        for p in r.placements:
            assert [d.date for d in p.dates] == sorted(d.date for d in p.dates)


def test_pages_hold_the_same_placements(demo, searchable):
    whole = stays.stay_nested(searchable, demo.placements, demo.hotels, STAY).collect()
    paged = stays.stay_nested(searchable, demo.placements, demo.hotels, STAY, pages=7).collect()
    names = lambda rows: sorted((r.hotel_id, p.placement_id, len(p.dates)) for r in rows for p in r.placements)
    assert names(paged) == names(whole) and len(paged) > len(whole)


def test_stay_arguments():
    assert STAY.children_ages == "5,10"
    default = stays.Stay()
    assert (default.date_to - default.date_from).days == 7 and default.adults == 2
    for bad in (
        {"date_from": FIRST, "date_to": FIRST - timedelta(days=1)},
        {"date_from": FIRST, "date_to": FIRST + timedelta(days=366)},
        {"adults": 0},
        {"adults": 256},
        {"children_ages": [18]},
    ):
        with pytest.raises(ValueError):
            stays.Stay(**bad)
    stays.Stay(FIRST, FIRST + timedelta(days=365))


def test_batch_requests_equal_single_searches(spark, searchable):
    schema = "request_id INT, placement_id BIGINT, date_from DATE, date_to DATE, adults INT, children_ages STRING"
    end = FIRST + timedelta(days=2)
    requests = spark.createDataFrame(
        [
            (1, 4, FIRST, end, 2, "10, 5"),
            (2, None, FIRST, end, 1, ""),
            (3, None, end, FIRST, 1, ""),
            (4, None, FIRST, end, 0, ""),
            (5, 99, FIRST, end, 1, ""),
            (6, None, FIRST, end, 1, "19"),
        ],
        schema,
    )
    checked = stays.checked_stays(requests)
    refused = {r.request_id: r.errors for r in stays.rejected_stays(checked).collect()}
    assert refused == {3: "range_reversed", 4: "adults_invalid", 6: "ages_invalid"}
    known = spark.range(1, 7).withColumnRenamed("id", "placement_id")
    refused = {r.request_id: r.errors for r in stays.rejected_stays(stays.checked_stays(requests, known)).collect()}
    assert refused == {3: "range_reversed", 4: "adults_invalid", 5: "placement_unknown", 6: "ages_invalid"}
    got = stays.stay_requests(searchable, stays.valid_stays(checked))
    counts = {r.request_id: r["count"] for r in got.groupBy("request_id").count().collect()}
    assert counts == {1: 3, 2: 18}
    single = stays.stay_days(searchable, stays.Stay(FIRST, end, 1, ""))
    assert sorted((r.placement_id, r.date) for r in got.where("request_id = 2").collect()) == sorted(
        (r.placement_id, r.date) for r in single.collect()
    )


def test_answers_to_any_placement_are_made_last(spark, searchable, monkeypatch):
    """requests of one day and occupancy are lists until the join is done; none is lost."""
    monkeypatch.setattr(stays, "LIST_ROWS", 3)
    ids = [*range(10), 4, None]
    schema = "request_id INT, placement_id BIGINT, date_from DATE, date_to DATE, adults INT, children_ages STRING"
    requests = spark.createDataFrame([(i, None, FIRST, FIRST + timedelta(days=1), 1, "") for i in ids], schema)
    lists = stays.request_lists(requests, ["date_from", "adults"]).collect()
    assert len(lists) > 1 and sorted(str(i.request_id) for row in lists for i in row.ids) == sorted(map(str, ids))
    got = stays.stay_requests(searchable, requests, shown=registry.at_edge)
    assert dict(got.dtypes) | {"date": "string", "price": "double"} == dict(got.dtypes)
    day = stays.stay_days(searchable, stays.Stay(FIRST, FIRST + timedelta(days=1), 1, "")).collect()
    found = sorted((str(r.request_id), r.placement_id, r.date) for r in got.collect())
    assert found == sorted((str(i), r.placement_id, str(r.date)) for i in ids for r in day)


def test_totals_of_any_placement_are_made_last(spark, demo):
    """the multiplied rows meet no join or shuffle, and only placements with the occupancy."""
    schema = "request_id INT, placement_id BIGINT, date_from DATE, date_to DATE, adults INT, children_ages STRING"
    requests = spark.createDataFrame([(i, None, FIRST, FIRST + timedelta(days=3), 1 + i % 2, "") for i in (1, 2, 3, 3, None) if i] + [(None, None, FIRST, FIRST, 1, "")], schema)
    stamp, one = F.lit("2026-01-01").cast("timestamp"), F.lit(1).cast("bigint")
    finals = [df.withColumn("updated_at", stamp).withColumn("version", one) for df in (demo.availability, demo.prices)]
    variants = demo.variants.where("adults = 1 OR placement_id < 3")
    batch = totals.stay_totals_requests(search.day_state(*finals, "left"), variants, requests, shown=registry.at_edge)
    got = sorted((str(r.request_id), r.placement_id, r.days_found) for r in batch.collect())
    wanted = [("1", p, 4) for p in (1, 2)] + 2 * [("3", p, 4) for p in (1, 2)]
    assert got == sorted(wanted + [("2", p, 4) for p in range(1, 7)] + [("None", p, 1) for p in range(1, 7)])
    assert dict(batch.dtypes)["total_price"] == "double"
    # The lists are taken apart above every exchange and semi join of their side.
    plan = batch._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(ids" in plan and "LeftSemi" not in plan[plan.index("inline(ids") :].split("Aggregate")[0]


def test_batch_totals_equal_single_totals(spark, demo, searchable):
    """Stays over month ends, before, within and after the calendar, with and without placement."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        start = FIRST + timedelta(days=rng.randrange(-40, 60))
        rows.append((i, rng.choice([None, 1, 2, 3, 99]), start, start + timedelta(days=rng.randrange(0, 45)), rng.choice([1, 2, 9]), rng.choice(["", "5,10"])))
    requests = spark.createDataFrame(rows, "request_id INT, placement_id BIGINT, date_from DATE, date_to DATE, adults INT, children_ages STRING")
    one = F.lit(1).cast("bigint")
    stamp = F.lit("2026-01-01").cast("timestamp")
    gaps = "NOT (placement_id = 2 AND day(date) BETWEEN 5 AND 20)"
    finals = [df.where(gaps).withColumn("updated_at", stamp).withColumn("version", one) for df in (demo.availability, demo.prices)]
    days = search.day_state(*finals, "left").withColumn("currency", F.when(F.col("date") > "2026-01-11", "EUR").otherwise("RUB"))
    table = search.fan_out(days, demo.variants).cache()
    batch = totals.stay_totals_requests(days, demo.variants, requests)
    got = sorted(tuple(r) for r in batch.collect())
    wanted = []
    for i, placement, start, end, adults, ages in rows:
        stay = stays.Stay(start, end, adults, ages, placement)
        wanted += [(i, r.placement_id, r.total_price, r.available, r.currency, r.days_found) for r in stays.stay_totals(table, stay).collect()]
    assert got == sorted(wanted) and len(got) > 15
    assert totals.stay_totals_requests(days, demo.variants, requests.limit(0)).count() == 0
    months = executed(totals.running_months(days, F.lit(FIRST), ["RUB"]))
    assert "Generate" in months and "sequence(date_from" not in executed(batch)


def test_calendar_shows_missing_prices(demo):
    prices = demo.prices.where("date > '2026-01-02'")
    rows = stays.calendar(demo.availability, prices, 1, FIRST, FIRST + timedelta(days=3)).collect()
    assert [r.price is None for r in rows] == [True, True, False, False]
    assert [r.date for r in rows] == [FIRST + timedelta(days=i) for i in range(4)]


def test_listings(spark, demo):
    hotels = demo.hotels.unionByName(demo.hotels.limit(1).withColumn("hotel_id", F.lit(9).cast("bigint")).withColumn("name", F.lit("A")))
    counts = hp.hotel_placement_counts(hotels, demo.placements).collect()
    assert [(r.name, r.placements_count) for r in counts][0] == ("A", 0) and len(counts) == 4
    variants = demo.variants.where("placement_id <> 6")
    detail = hp.hotel_detail(hotels, demo.placements, variants)
    assert detail.count() == 5 * 20 + 1 + 1
    nested = hp.placement_variants_nested(demo.placements, variants).collect()
    assert sorted((r.placement_id, len(r.variants)) for r in nested) == [(i, 20) for i in range(1, 6)] + [(6, 0)]


def test_reports(demo, searchable):
    profile = reports.variant_profile(demo.variants).first()
    assert tuple(profile) == (120, 6, 1, 6, 1, 4)
    assert reports.variant_profile(demo.variants, approximate=True).first().unique_placements == 6
    assert [tuple(r) for r in reports.variants_by_adults(demo.variants).collect()] == [(n, 30) for n in (1, 2, 3, 4)]
    diffs = reports.reconciliation({"a": demo.prices, "b": demo.hotels}, {"a": demo.prices.limit(100)})
    assert {r.entity: r["diff"] for r in diffs.collect()} == {"a": 80, "b": None}
    frames = reports.diagnose(demo.variants, demo.availability.withColumn("updated_at", F.current_timestamp()), searchable)
    assert frames["sample_days"].count() == 3
    assert "TakeOrdered" in executed(frames["sample_days"])


def test_tsv_pads_short_rows_and_cuts_long_ones(spark, work, demo):
    tabular.write_tsv(demo.prices, f"{work}/tsv")
    back = tabular.read_tsv(spark, f"{work}/tsv", demo.prices.schema)
    assert sorted(back.collect()) == sorted(demo.prices.collect())
    (spark.createDataFrame([("a\tb\tc",), ("1\tx",), ("2\ty\tz\tsurplus",)], "v STRING").coalesce(1).write.text(f"{work}/odd"))
    odd = tabular.read_tsv(spark, f"{work}/odd", "a INT, b STRING, c STRING")
    assert sorted(map(tuple, odd.collect()), key=str) == [(1, "x", None), (2, "y", "z")]


def test_searches_push_down_and_stay_in_the_jvm(spark, sf_dir):
    plan = executed(registry.QUERIES["stay_totals"](spark, sf_dir))
    assert plan.count("GreaterThanOrEqual(l_shipdate,1997-03-01T00:00)") == 2
    assert plan.count("BroadcastHashJoin") >= 1
    for name in ("search_incremental", "decode_price_events", "rejected_changes", "stay_nested", "rekey_backfill"):
        assert "Python" not in executed(registry.QUERIES[name](spark, sf_dir)), name


def test_stored_search_reads_only_the_columns_and_periods_it_needs(store):
    jobs.refresh_search(store)
    plan = executed(stays.stay_totals(store.search.latest(STAY.dates), STAY))
    assert "updated_at" not in plan.split("ReadSchema")[1].split(">")[0]
    assert "EqualTo(adults,2)" in plan and "EqualTo(children_ages,5,10)" in plan
    assert plan.split("\n\n")[0].count("Exchange") == 1


def test_logs_have_no_version_ties(spark, sf_dir):
    inv = Inventory(spark, sf_dir)
    for log in (inv.availability_log, inv.price_log):
        ties = log.groupBy("placement_id", "date", *registry.LOG_ORDER).count().where("count > 1")
        assert ties.count() == 0
    assert latest_by_key(inv.availability_log, ["placement_id", "date"], registry.LOG_ORDER).count() > 0
