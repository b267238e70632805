"""Benchmark: headline jobs and queries on the driver's tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staysearch import registry  # noqa: E402
from staysearch.bindings import Inventory  # noqa: E402
from staysearch.plans import jobs, reports, stays  # noqa: E402
from staysearch.session import local_session  # noqa: E402
from staysearch.sources.demo import demo_inventory  # noqa: E402

RUNS = 3
LOGICAL = [
    "latest_availability",
    "latest_price",
    "decode_price_events",
    "quarantine_counts",
    "search_refresh",
    "search_incremental",
    "stay_days_by_placement",
    "stay_days_all",
    "stay_totals",
    "stay_totals_by_hotel",
    "stay_nested",
    "stay_requests_batch",
    "rejected_stays",
    "calendar",
    "hotel_detail",
    "reconciliation",
    "range_upsert",
    "change_receipts",
    "rekey_backfill",
    "demo_prices",
]


def timed(step: Callable[[], object], runs: int = RUNS) -> float:
    """Median of some runs, after one run that warms the JVM up."""
    step()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        step()
        seconds.append(time.perf_counter() - start)
    return round(sorted(seconds)[len(seconds) // 2], 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stored(inv: Inventory) -> dict[str, float]:
    """Jobs and searches on stored tables, the way the engine is used."""
    store = registry._loaded(inv, "bench")
    store.availability.fold()
    store.prices.fold()
    out = {"stored_refresh": timed(lambda: jobs.refresh_search(store))}
    stay, at = registry.STAY, registry.STAY_AT
    part = (registry.PLACEMENT, registry.FROM, registry.TO)
    out["stored_stay_totals"] = timed(lambda: drain(stays.stay_totals(store.search.latest(stay.dates), stay)))
    out["stored_stay_days_by_placement"] = timed(
        lambda: drain(stays.stay_days(store.search.latest(at.dates, at.placement_id), at))
    )
    out["stored_stay_nested"] = timed(
        lambda: drain(stays.stay_nested(store.search.latest(stay.dates), inv.placements, inv.hotels, stay))
    )
    out["stored_calendar"] = timed(
        lambda: drain(
            stays.calendar(
                store.availability.latest(stay.dates, part[0]), store.prices.latest(stay.dates, part[0]), *part
            )
        )
    )
    out["stored_counts"] = timed(lambda: drain(jobs.store_counts(store)))
    out["stored_refresh_part"] = timed(lambda: jobs.refresh_search_part(store, *part, "part"))
    out["stored_stay_totals_open_delta"] = timed(
        lambda: drain(stays.stay_totals(store.search.latest(stay.dates), stay))
    )
    return out


def demo(inv: Inventory) -> dict[str, float]:
    """The full demo inventory: 730 000 days, 14.6 million search rows."""
    data = demo_inventory(inv.spark)
    store = registry._store(inv, "demo")
    jobs.sync_variants(store, data.variants.selectExpr("*", "timestamp'2026-01-01' AS updated_at"), "demo")
    jobs.load_snapshot(store, "availability", data.availability.selectExpr("*", "timestamp'2026-01-01' AS updated_at"), "demo")
    jobs.load_snapshot(store, "prices_by_day", data.prices.selectExpr("*", "timestamp'2026-01-01' AS updated_at"), "demo")
    out = {"demo_refresh_14_6m_rows": timed(lambda: jobs.refresh_search(store))}
    first = data.availability.selectExpr("min(date)").first()[0]
    stay = stays.Stay(first, adults=2, children_ages="5,10")
    out["demo_stay_totals"] = timed(lambda: drain(stays.stay_totals(store.search.latest(stay.dates), stay)))
    out["demo_variant_profile"] = timed(lambda: drain(reports.variant_profile(store.variants.latest())))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cores,
        "staysearch-bench",
        **{
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="staysearch-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    inv = Inventory(spark, sf_dir)
    queries = {
        name: timed(lambda name=name: drain(registry.QUERIES[name](spark, sf_dir))) for name in LOGICAL
    }
    queries.update(stored(inv))
    queries["stream_search"] = timed(lambda: drain(registry.QUERIES["stream_search"](spark, sf_dir)), 1)
    queries.update(demo(inv))
    total = round(sum(queries.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
