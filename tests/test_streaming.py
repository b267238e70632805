import json
import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from staysearch import registry
from staysearch.bindings import Inventory
from staysearch.plans import jobs
from staysearch.plans.reports import ProgressLog, stream_progress
from staysearch.plans.search import build_search
from staysearch.schemas import RECORD, SEARCH_KEY
from staysearch.sources import cdc
from staysearch.sources.demo import demo_inventory
from staysearch.sources.store import Store
from staysearch.sources.topics import read_topic, to_records
from staysearch.streaming import pipeline
from staysearch.operators.latest import latest_by_key

TOPICS = ("availability", "prices_by_day")
DAY0 = date(2026, 1, 1)


def messages(topic, seed):
    """Changes of a few placements and days, with one hot placement and some bad events."""
    rng = random.Random(seed)
    out = []
    for offset in range(300):
        payload = {"placement_id": 1 if rng.random() < 0.4 else rng.randrange(0, 6), "date": 20454 + rng.randrange(0, 40)}
        if topic == "availability":
            payload["available"] = rng.randrange(2)
        else:
            payload |= {"price": f"{rng.randrange(10, 99)}.50", "currency": rng.choice(["", "EUR"])}
        value = "{broken" if rng.random() < 0.02 else json.dumps({"payload": payload})
        out.append((topic, 0, offset, None, value))
    return out


def feed(spark, root, order=None):
    """Four files per topic, arriving in the given order."""
    for topic in TOPICS:
        rows = messages(topic, len(topic))
        for part in order or range(4):
            piece = rows[part * 75 : part * 75 + 75]
            spark.createDataFrame(piece, RECORD).coalesce(1).write.mode("append").json(f"{root}/{topic}")


def source(spark, root, files=2):
    frames = [read_topic(spark, t, f"{root}/{t}", "json", streaming=True, maxFilesPerTrigger=str(files)) for t in TOPICS]
    return frames[0].unionByName(frames[1])


def new_store(spark, root):
    store = Store(spark, f"{root}/store")
    variants = demo_inventory(spark, hotels=1, placements_per_hotel=5, days=1).variants
    jobs.sync_variants(store, variants.withColumn("updated_at", F.lit("2026-01-01").cast("timestamp")), "v")
    return store


def run(store, root, files=2, **options):
    query = pipeline.start_search_stream(
        store, source(store.spark, root, files), f"{root}/checkpoint", "search", available_now=True, **options
    )
    query.awaitTermination()
    return query


def content(df):
    return sorted(map(tuple, df.select(*SEARCH_KEY, "available", "price", "currency").collect()))


def expected(spark, store):
    finals = {}
    for topic in TOPICS:
        rows = spark.createDataFrame(messages(topic, len(topic)), RECORD)
        usable = cdc.usable(cdc.DECODERS[topic](cdc.unwrap(rows)))
        keys = ["placement_id", "date"]
        finals[topic] = latest_by_key(usable, keys, "version", keep_version=True)
    return content(build_search(store.variants.latest(), *finals.values(), "full"))


@pytest.mark.parametrize("order, folded", [((0, 1, 2, 3), False), ((2, 0, 3, 1), True)])
def test_stream_equals_batch_in_any_file_order(spark, work, order, folded):
    feed(spark, work, order)
    store = new_store(spark, work)
    query = run(store, work, files=1)
    if folded:
        pipeline.maintain(store)
        pipeline.maintain(store)
    wanted = expected(spark, store)
    assert wanted and content(store.search.latest()) == wanted
    refused = {(r.source, r.reason) for r in store.quarantine_log().collect()}
    assert refused == {(t, r) for t in TOPICS for r in ("bad_key", "corrupt")}
    total = store.quarantine_log().count() + store.availability.log().count() + store.prices.log().count()
    assert folded or total == 600
    assert stream_progress(spark, query).agg(F.sum("input_rows")).first()[0] == 600


def test_replayed_batch_changes_nothing(spark, work):
    feed(spark, work)
    store = new_store(spark, work)
    run(store, work)
    before = content(store.search.latest()), store.quarantine_log().count()
    deltas = store.availability.batches()
    # The same batches again, as after a crash between the writes and the checkpoint.
    again = pipeline.start_search_stream(
        store, source(spark, work), f"{work}/other-checkpoint", "search", available_now=True
    )
    again.awaitTermination()
    assert (content(store.search.latest()), store.quarantine_log().count()) == before
    assert store.availability.batches() == deltas


def test_restart_goes_on_where_it_stopped(spark, work):
    feed(spark, work, order=(0, 1))
    store = new_store(spark, work)
    run(store, work)
    first = store.availability.log().count()
    feed(spark, work, order=(2, 3))
    run(store, work)
    assert store.availability.log().count() > first
    assert store.availability.log().groupBy("version").count().where("count > 1").count() == 0
    assert content(store.search.latest()) == expected(spark, store)


def test_a_new_variant_waits_for_its_backfill(spark, work):
    """Folded days do not look for new variants; adding them brings their rows."""
    feed(spark, work)
    store = new_store(spark, work)
    run(store, work)
    pipeline.maintain(store)
    rows = store.search.latest().count()
    extra = spark.createDataFrame([(1, 9, "")], "placement_id BIGINT, adults INT, children_ages STRING")
    extra = extra.withColumn("updated_at", F.lit(None).cast("timestamp"))
    jobs.sync_variants(store, extra, "extra")
    assert store.search.latest().count() == rows
    extra = extra.withColumn("adults", F.lit(8))
    jobs.add_variants(store, extra, "backfill")
    assert store.search.latest().where("adults = 8").count() == store.availability.latest(placement_id=1).count()


def test_state_stream_hands_on_the_latest(spark, work):
    feed(spark, work, (2, 0, 3, 1))
    store = Store(spark, f"{work}/store")
    records = read_topic(spark, "availability", f"{work}/availability", "json", streaming=True, maxFilesPerTrigger="1")
    log = ProgressLog(spark, f"{work}/progress")
    spark.streams.addListener(log)
    pipeline.start_state_stream(
        store, records, "availability", f"{work}/cp", "state", available_now=True
    ).awaitTermination()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(log)
    rows = spark.createDataFrame(messages("availability", len("availability")), RECORD)
    wanted = latest_by_key(cdc.usable(cdc.decoded(rows, "availability")), ["placement_id", "date"], "version")
    found = store.availability.latest()
    key = ["placement_id", "date", "available"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, wanted.select(*key).collect()))
    assert store.availability.log().count() < 300
    assert log.rows().agg(F.sum("input_rows"), F.max("state_rows")).first() == (300, wanted.count())


def test_single_topic_stream(spark, work):
    feed(spark, work)
    store = Store(spark, f"{work}/store")
    records = read_topic(spark, "availability", f"{work}/availability", "json", streaming=True)
    pipeline.start_final_stream(
        store, records, "availability", f"{work}/cp", "availability", available_now=True
    ).awaitTermination()
    assert store.availability.log().count() + store.quarantine_log().count() == 300


def test_resnapshot_overrides_the_stream(spark, work):
    feed(spark, work)
    store = new_store(spark, work)
    run(store, work)
    source_rows = store.availability.latest().drop("version").withColumn("available", F.lit(7).cast("smallint"))
    jobs.load_snapshot(store, "availability", source_rows, "again", generation=1)
    assert store.availability.latest().where("available <> 7").count() == 0


def test_feeds_are_compressed_and_read_back_as_they_were(spark, work):
    """a topic's messages as plain text took most of the disk of the queries that stream them."""
    days = spark.range(20_000).selectExpr("id % 500 AS placement_id", "date_add(DATE'2026-01-01', int(id DIV 500)) AS date", "id % 2 AS available", "id")
    records = to_records(days, "availability", ["placement_id", "date", "available"], ["id"])
    inv = Inventory(spark, work)
    registry._feed(inv, records, f"{work}/feed")
    files = list(Path(f"{work}/feed").glob("part-*"))
    text = records.agg(F.sum(F.length("value"))).first()[0]
    assert len(files) == registry.FILES and sum(f.stat().st_size for f in files) < text / 3
    query = registry._topic(inv, "availability", f"{work}/feed").writeStream.format("memory").queryName("fed").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["topic", "partition", "offset", "timestamp", "value"]
    assert sorted(map(repr, spark.table("fed").select(*columns).collect())) == sorted(map(repr, records.select(*columns).collect()))
    assert query.lastProgress is not None and len([p for p in query.recentProgress if p["numInputRows"]]) == registry.FILES // registry.FILES_A_BATCH
