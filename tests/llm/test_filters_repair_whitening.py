"""URL filters, conversation repair and whitening against SQL and brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from staysearch.llm import turn_repair, url_filter, whitening
from tables import empty

# -- url filter ------------------------------------------------------------------

PAGES = "page_id long, url string, host string, path string, rule string, canonical string, maybe boolean, block long"
LABELS = "doc_id long, quality int, toxic int, id long"
URLS = [
    "https://a.example.net/en/7?ref=x&b=2&a=1#top",
    "HTTP://A.EXAMPLE.net:80/en/7/?a=1&utm_source=feed&b=2",
    "https://a.example.net/en/8.html",
    "https://a.example.net/en/9",
    "https://example.org/es/1",
    "https://x.example.org/en/12",
    "https://badexample.org/es/1",
    "https://org/",
    "https://org",
    "https://m.site.com/fr/5?x=http://q.net/",
    "https://site.com/de/5",
    "mailto:somebody",
    "https://",
    "://?a=b",
    "https://a.example.net",
    "",
    None,
    "https://a.example.net/en/7" + "/x" * 20_000,
    "https://é.net/en/7 8\n",
]
MARKS = [(7, 0, 0), (8, 1, 1), (9, 1, 0), (1, None, 1), (None, 0, 1), (7, 0, 0), (5, 0, None)]


def pages_of(spark, urls):
    rows = [(i, u, "h", "p", "r", "c", True, 3) for i, u in enumerate(urls)]
    return spark.createDataFrame([*rows, (None, URLS[0], *rows[0][2:]), rows[0]], PAGES)


def marks(spark):
    return spark.createDataFrame([(*m, 1) for m in MARKS], LABELS)


def sql_rows(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return con.execute(sql)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


OUT = ["page_id", "host", "path", "rule", "verdict"]


def test_urls_are_judged_as_in_sql(spark):
    pages, labels = pages_of(spark, URLS), marks(spark)
    got = rows_of(url_filter.url_report(pages, labels), *OUT)
    wanted = sql_rows(url_filter.ORACLE, pages=pages, labels=labels).fetchall()
    assert got == sorted(wanted, key=repr)
    assert {v for *_, v in got} == {"allow", "block"} and len(got) == len(URLS) + 2


def test_longest_rule_wins_and_covers_subdomains_only(spark):
    found = {r.url: (r.rule, r.verdict) for r in pages_of(spark, URLS).select(
        "url",
        url_filter.matched(url_filter.RULES, url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), "text").alias("rule"),
        url_filter.matched(url_filter.RULES, url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), "verdict").alias("verdict"),
    ).collect()}
    assert found["https://example.org/es/1"] == ("example.org/es/", "block")
    assert found["https://x.example.org/en/12"] == ("example.org/en/1", "block")
    assert found["https://badexample.org/es/1"] == ("org/", "allow")
    assert found["https://org"] == (None, None)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h.net/', id) AS canonical")
    others = spark.range(3000, 9000).selectExpr("concat('h.net/', id) AS canonical")
    blocks = math.ceil(3000 * url_filter.BITS_PER_URL / url_filter.BLOCK_BITS)
    bloom = url_filter.bloom_filter(listed, blocks)
    assert bloom.count() <= blocks
    assert url_filter.possible_hits(listed, bloom, blocks).where(~F.col("maybe")).count() == 0
    assert url_filter.possible_hits(others, bloom, blocks).where("maybe").count() < 200


@pytest.mark.parametrize("max_blocks", [1, 1 << 18])
def test_a_full_filter_only_costs_time(spark, max_blocks, monkeypatch):
    """One block passes everything; the join, salted for the hot url, removes it again."""
    monkeypatch.setattr(url_filter, "URL_BYTES", 1 << 30)  # the list is too large to be broadcast
    urls = ["https://hot.net/en/1"] * 300 + [f"https://h{i}.net/en/{i}" for i in range(400)]
    pages = pages_of(spark, urls)
    listed = spark.createDataFrame([("hot.net/en/1",), *[(f"h{i}.net/en/{i}",) for i in range(0, 400, 2)]], "canonical string")
    got = url_filter.judged(pages, (), listed, max_blocks)
    known = {r.canonical for r in listed.collect()}
    for r in got.collect():
        assert r.verdict == ("block" if r.host + r.path in known else "allow")
    assert got.count() == len(urls) + 2


def test_url_filter_of_empty_tables(spark):
    pages, labels = pages_of(spark, URLS), marks(spark)
    assert url_filter.url_report(empty(pages), labels).count() == 0
    unlisted = url_filter.url_report(pages, empty(labels))
    assert unlisted.where("rule IS NULL AND verdict = 'block'").count() == 0 and unlisted.count() == len(URLS) + 2


# -- conversation repair -----------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, live boolean, fault string, number int, copy int, damage int"
WELL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) over all edits, tried one by one, with their turns."""
    best, options = None, []
    for role, text, state in rows:
        mine = [(4, "D", [])]
        if state != turn_repair.GONE:
            extra = 3 if state == turn_repair.CUT_OFF else 0
            mine.append((extra, "K", [(role, text)]))
            mine += [(3 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(mine)
    # More than two inserts in one place never pay.
    inserts = [(3 * k, "I" * k, [(r, "") for r in rs]) for k in range(3) for rs in itertools.product(("user", "assistant"), repeat=k)]
    steps = [inserts]
    for mine in options:
        steps += [mine, inserts]
    for path in itertools.product(*steps):
        turns = [t for _, _, part in path for t in part]
        if WELL.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
            value = (sum(c for c, _, _ in path), "".join(a for _, a, _ in path), turns)
            best = value if best is None or value[:2] < best[:2] else best
    return best


def test_repairs_are_the_cheapest_of_all_edits():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", " "]
    for _ in range(60):
        rows = [(rng.choice(roles), f"t{i}.", rng.choice([0, 1, 1, 1, 2])) for i in range(rng.randrange(4))]
        assert turn_repair.edits(rows) == cheapest(rows), rows


def test_segments_do_not_change_repairs(monkeypatch):
    rng = random.Random(6)
    cases = []
    for _ in range(200):
        kind = rng.choice([["user", "assistant"], ["system", "user", "assistant", "x"], ["x"], ["user"]])
        cases.append([(rng.choice(kind), f"t{i}.", rng.choice([0, 1, 1, 1, 1, 2])) for i in range(rng.randrange(60))])
    whole = [turn_repair.edits(rows) for rows in cases]
    for size in (1, 2, 7):
        monkeypatch.setattr(turn_repair, "SEGMENT", size)
        assert [turn_repair.edits(rows) for rows in cases] == whole


def test_decided_rows_are_let_go():
    work, kept = turn_repair.Repair(), 0
    for i in range(5000):
        list(work.add(turn_repair.Row(("user", "assistant")[i % 2], "x" * 100, turn_repair.SOUND)))
        kept = max(kept, len(work.waiting) + len(work.undecided))
    assert kept <= 2 * turn_repair.SEGMENT
    assert list(work.finish()) is not None and work.cost == 0 and "".join(work.audit) == "K" * 5000


def conversations_of(spark):
    rng = random.Random(7)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]),
         rng.choice(["Yes.", "No", "What? ", "", " \n\t", None, "a.b!c", f"t{t}."]))
        for c in range(120) for t in range(rng.randrange(7))
    ]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, None, "user", "Hi."), (500, None, "user", "only.")]
    rows += [(501, 3, "user", "same."), (501, 3, "user", "same."), (501, 3, "assistant", "same."), (502, 10**12, "user", "y.")]
    rows += [(503, t, ("user", "assistant")[t % 2], f"turn {t}." + "z" * (200_000 if t == 5 else 0)) for t in range(900)]
    return spark.createDataFrame([(*r, False, "blank", 2, 1, 3) for r in rows], TURNS)


def test_conversations_are_repaired_as_in_sql(spark):
    data = conversations_of(spark).where("conv_id IS NULL OR conv_id <> 503")
    columns = [f.split(" ")[0] for f in turn_repair.REPORT.split(", ")]
    got = rows_of(turn_repair.repair_report(data.repartition(5)), *columns)
    wanted = sql_rows(turn_repair.ORACLE, conversations=data).fetchall()
    assert got == sorted(wanted, key=repr)


def test_repaired_turns_fit_their_report(spark):
    data = conversations_of(spark)
    rows = turn_repair.damaged(data)
    report = {r.conv_id: r for r in turn_repair.reported(rows).collect()}
    assert set(report) == {r.conv_id for r in data.select("conv_id").distinct().collect()}
    found = {c: [] for c in report}
    for r in turn_repair.repaired(rows).orderBy("conv_id", "turn").collect():
        assert r.turn == len(found[r.conv_id])
        found[r.conv_id].append((r.role, r.text))
    for conv_id, turns in found.items():
        assert WELL.fullmatch("".join(r[:1] for r, _ in turns))
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        assert hashlib.sha256(text.encode()).hexdigest() == report[conv_id].repaired_sha256
    sound = [(1, "user", "Hi."), (2, "assistant", "Hello!")]
    plain = spark.createDataFrame([(1, *r) for r in sound], "conv_id long, turn long, role string, text string")
    assert [tuple(r)[6:8] for r in turn_repair.reported(turn_repair.turns(plain)).collect()] == [(0, "KK")]


def test_repair_of_an_empty_table(spark):
    assert turn_repair.repair_report(empty(conversations_of(spark))).count() == 0


# -- whitening -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x array<long>, white double, weight long, dim int"


def vectors_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, [1], 0.5, 2, 9) for i, v in vectors], VECTORS)


def sample(n=400, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(n, dim)) @ np.diag(np.linspace(1, 0.1, dim)) * 0.2
    spread[: n // 3] = spread[0]  # a hot group of copies
    return spread.astype(np.float32)


def expected(data, weights=None):
    x = np.floor(data.astype(np.float64) * 1024).astype(np.int64) + 100_000
    distinct = x if weights is None else np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    c = (distinct * n - total) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    return x, n, total, e, axes, np.trace(c.T @ c / n)


@pytest.mark.parametrize("weighted", [True, False])
def test_whitening_is_that_of_numpy(spark, weighted):
    data = sample()
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = vectors_of(spark, [*rows, *bad]).repartition(7)
    x, n, total, e, axes, trace = expected(data, None if weighted else 1)
    z = ((x * n - total) / n) @ axes / np.sqrt(e)
    got = whitening.white_rows(whitening.integer_vectors(df), weighted).collect()
    assert len(got) == 8 * len(data)
    found = np.zeros((len(data), 8))
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((x[r.vec_id] * n - total) ** 2).sum())
        assert abs(r.explained * trace / e[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    signs = np.sign((found * z).sum(axis=0))
    assert np.allclose(found, z * signs, rtol=1e-9, atol=1e-9)


def test_components_end_where_the_spread_does(spark):
    flat = [(i, [0.5, float(i % 4), 0.25]) for i in range(40)]
    got = whitening.whitening_report(vectors_of(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 40
    same = vectors_of(spark, [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.5, 0.5])])
    assert whitening.whitening_report(same).count() == 0
    assert whitening.whitening_report(empty(same)).count() == 0


def test_lengths_are_fitted_apart_and_repeated_ids_stay(spark):
    mixed = [(1, [0.1, 0.9]), (1, [0.4, 0.2]), (None, [0.3, 0.8]), (2, [0.5]), (3, [0.25]), (4, [0.7, 0.1])]
    got = whitening.whitening_report(vectors_of(spark, mixed)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == sorted(
        [(1, 1, 4), (1, 2, 4), (1, 1, 4), (1, 2, 4), (0, 1, 4), (0, 2, 4), (4, 1, 4), (4, 2, 4), (2, 1, 2), (3, 1, 2)]
    )


def test_large_entries_neither_fail_nor_wrap():
    x = np.array([[1 << 40, 5], [-(1 << 40), 7]])
    total = x.sum(axis=0)
    assert whitening.deviations(x, 1 << 30, total)[0] is None
    assert whitening.deviations(x[:, 1:], 2, total[1:]) == [4, 4]
    assert np.allclose(whitening.centred(x, 1 << 30, total)[:, 0], x[:, 0])
