"""Running state with one key that holds nearly all events, in small slices, against plain loops; and nulls in dedup."""

from __future__ import annotations

import random

import pytest
from gleanframe.operators import admission, dedup, pacing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def events(spark):
    chance = random.Random(4)
    now, rows = 0.0, []
    for seq in range(600):
        now += chance.random() * 30
        rows.append(("hot" if chance.random() < 0.9 else "cold", seq, now, chance.choice([0.5, 2.0, 60.0]), chance.choice(["ok", "bad", "bad", "maybe", "other"])))
    return rows, spark.createDataFrame(rows, "domain string, seq long, at double, delay double, kind string")


def by_domain(rows):
    return [[r for r in rows if r[0] == d] for d in ("hot", "cold")]


def test_tickets(events):
    rows, table = events
    expected = {}
    for own in by_domain(rows):
        free = 0.0
        for _, seq, at, delay, _ in own:
            expected[seq] = max(at, free)
            free = expected[seq] + delay
    found = {r.seq: r.start for r in pacing.tickets(table, width=7).collect()}
    assert found == pytest.approx(expected)


def test_breaker(events):
    rows, table = events
    expected = {}
    for own in by_domain(rows):
        n = 0
        for _, seq, _, _, kind in own:
            n = 0 if kind == "ok" else n + (kind == "bad")
            expected[seq] = (n, kind == "bad" and n % 3 == 0)
    found = pacing.breaker(table, F.col("kind") == "ok", F.col("kind") == "bad", 3, width=7).collect()
    assert {r.seq: (r.failures, r.trip) for r in found} == expected


def slow_bans(own, failed, most=100.0, base=10.0):
    n, last = 0, None
    for (_, seq, at, _, kind), bad in zip(own, failed, strict=True):
        if kind == "ok" or (bad and last is not None and at - last > most):
            n = 0
        if bad:
            n, last = n + 1, at
        yield seq, min(most, base * 2.0 ** (n - 1)) if bad else None


@pytest.mark.parametrize("width", [5, 64, 4096])
def test_bans(events, width):
    rows, table = events
    kind = F.col("kind")
    expected = {k: v for own in by_domain(rows) for k, v in slow_bans(own, [r[4] == "bad" for r in own])}
    assert {r.seq: r.ban for r in pacing.bans(table, kind == "bad", kind == "ok", 10.0, 100.0, key="domain", width=width).collect()} == expected
    expected = {}
    for own in by_domain(rows):
        n, last, failed = 0, None, []
        for _, _, at, _, what in own:
            if what == "ok" or (what == "maybe" and last is not None and at - last > 100.0):
                n = 0
            if what == "maybe":
                n, last = n + 1, at
            failed.append(what == "bad" or (what == "maybe" and n % 3 == 0))
        expected.update(slow_bans(own, failed))
    found = pacing.attributed_bans(table, kind == "bad", kind == "maybe", kind == "ok", 3, 10.0, 100.0, key="domain", width=width)
    assert found.columns == [*table.columns, "ban"]
    assert {r.seq: r.ban for r in found.collect()} == expected


def test_admit_loses_no_null(spark):
    rows = spark.createDataFrame([(0, None, True), (1, "a", True), (2, "a", True), (3, None, False), (4, "a", False), (5, None, None), (6, "b", None)], "seq int, fp string, filter_repeat boolean")
    assert sorted(r.seq for r in dedup.admit(rows).collect()) == [0, 1, 3, 4, 5, 6]
    assert sorted(r.seq for r in dedup.admit(rows, rows.where("fp = 'a'").select("fp")).collect()) == [0, 3, 4, 5, 6]
    assert sorted(r.seq for r in dedup.first_wins(rows, "fp", "seq").collect()) == [0, 1, 6]


def test_bloom_filters_of_unseen_keys(spark):
    inside, outside = (spark.range(10_000).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("k")) for p in ("in-", "out-"))
    size, small = dedup.bloom_size(10_000, 1e-3), dedup.bloom_size(1000, 1e-3)
    built = dedup.bloom_build(inside, "k", size)
    assert dedup.bloom_probe(inside, "k", built, size).where("not maybe").isEmpty()
    assert dedup.bloom_probe(outside, "k", built, size).where("maybe").count() < 20
    flat = dedup.bloom_build(inside, "k", small)  # ten times over its capacity
    assert dedup.bloom_probe(outside, "k", flat, small).where("maybe").count() > 5000
    layered = dedup.layered_build(inside, "k", 1000, 1e-3)
    assert dedup.layered_probe(inside, "k", layered).where("not maybe").isEmpty()
    assert dedup.layered_probe(outside, "k", layered).where("maybe").count() < 100


def test_robots_rules(spark):
    text = "User-agent: *\nDisallow: /all\n\nUser-agent: bot\nAllow: /x/open\nDisallow: /x\nCrawl-delay: 2"
    robots = spark.createDataFrame([("a", text, 200), ("b", text, 404), ("c", None, 200), ("d", "garbage", 200)], "domain string, text string, status int")
    asked = [("http://a/x/y", "a"), ("http://a/x/open/1", "a"), ("http://a/all", "a"), ("http://b/x", "b"), ("http://c/x", "c"), ("http://d/x", "d"), ("http://e/x", "e"), ("http://a/%78/z", "a")]
    found = {r.url: (r.allowed, r.crawl_delay) for r in admission.robots_allowed(spark.createDataFrame(asked, "url string, domain string"), robots, "bot").collect()}
    assert found == {"http://a/x/y": (False, 2.0), "http://a/x/open/1": (True, 2.0), "http://a/all": (True, 2.0), "http://b/x": (True, None), "http://c/x": (True, None), "http://d/x": (True, None), "http://e/x": (True, None), "http://a/%78/z": (False, 2.0)}


def test_backoff_with_chance(spark):
    row = spark.range(1).select(admission.retry_delay(F.lit(None).cast("double"), F.lit(3), 0.0, 1.0, 60.0, F.lit(0.0)).alias("low"), admission.retry_delay(F.lit(None).cast("double"), F.lit(3), 0.0, 1.0, 60.0, F.lit(1.0)).alias("high")).first()
    assert (row.low, row.high) == (2.0, 4.0)
