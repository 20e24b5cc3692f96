"""Pacing, admission, table and task policies against plain loops on small inputs."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import admission, dedup, pacing, tables, tasks
from gleanframe.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare


def test_tickets_equal_a_loop(spark):
    chance = random.Random(1)
    rows, expected = [], {}
    for domain in "abc":
        free, now = 0.0, 0.0
        for seq in range(100):
            now += chance.random() * 3
            delay = chance.choice([0.5, 1.0, 10.0])
            start = max(now, free)
            free = start + delay
            rows.append((domain, seq, now, delay))
            expected[domain, seq] = start
    found = pacing.tickets(spark.createDataFrame(rows, "domain string, seq int, at double, delay double")).collect()
    assert all(abs(r.start - expected[r.domain, r.seq]) < 1e-6 for r in found)
    assert len(found) == len(expected)


def test_concurrency_equals_a_loop(spark):
    chance = random.Random(2)
    rows = [(d, i, float(i) + chance.random(), chance.random() * 9) for d in "ab" for i in range(60)]
    expected = {}
    for d in "ab":
        ends: list[float] = []
        for _, i, at, took in (r for r in rows if r[0] == d):
            start = at if len(ends) < 3 else max(at, heapq.heappop(ends))
            heapq.heappush(ends, start + took)
            expected[d, i] = start
    found = pacing.concurrency(spark.createDataFrame(rows, "domain string, seq int, at double, took double"), 3).collect()
    assert {(r.domain, r.seq): r.start for r in found} == expected


def test_breaker_counts_by_domain_and_clears_after_a_trip(spark):
    kinds = ["bad", "bad", "ok", "bad", "neutral", "bad", "bad", "bad"]
    rows = spark.createDataFrame([("d", i, k) for i, k in enumerate(kinds)] + [("e", 0, "bad")], "domain string, seq int, kind string")
    found = pacing.breaker(rows, F.col("kind") == "ok", F.col("kind") == "bad", 3).where("trip").select("domain", "seq").collect()
    assert [tuple(r) for r in found] == [("d", 6)]
    assert pacing.breaker(rows, F.col("kind") == "ok", F.col("kind") == "bad", 0).where("trip").isEmpty()


def test_suspects_are_banned_after_some_in_a_row(spark):
    kinds = ["suspect", "suspect", "suspect", "ok", "suspect", "fault", "suspect"]
    rows = spark.createDataFrame([("p", i, float(i), k) for i, k in enumerate(kinds)], "proxy string, seq int, at double, kind string")
    found = pacing.attributed_bans(rows, F.col("kind") == "fault", F.col("kind") == "suspect", F.col("kind") == "ok", 3, 10.0, 100.0).orderBy("seq").collect()
    assert [r.ban for r in found] == [None, None, 10.0, None, None, 10.0, None]


def test_pool_is_served_in_turn(spark):
    asks = spark.createDataFrame([(i, i) for i in range(7)], "seq int, url int")
    pool = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "proxy string")
    found = pacing.round_robin(asks, pool).orderBy("seq").collect()
    assert [r.proxy for r in found] == ["p0", "p1", "p2", "p0", "p1", "p2", "p0"]
    assert [r.proxy for r in pacing.round_robin(asks, pool, most_uses=2).orderBy("seq").collect()] == ["p0", "p1", "p2", "p0", "p1", "p2", None]


def test_stalls_are_gaps_between_successes(spark):
    log = spark.createDataFrame([(0, 0.0, "ok"), (1, 5.0, "failed"), (2, 40.0, "ok"), (3, 41.0, "failed"), (4, 90.0, "failed")], "seq int, at double, outcome string")
    assert [(r.seq, r.key) for r in tasks.stalls(log, 30.0).orderBy("seq").collect()] == [(2, "stall"), (4, "stall")]


def test_challenge_pages(spark):
    cases = [
        (403, {"cf-mitigated": "challenge"}, "", "cloudflare"), (503, {}, "<script>window.__CF_chl_opt</script>", "cloudflare"), (200, {}, "<p>__cf_chl_</p>", None), (503, {}, "é" * 1020 + "__cf_chl_", None),
        (503, {}, "<title>Just a moment...</title>", None), (200, {}, "<h3>text</h3><script>location = '/x'</script>", None), (200, {}, "<meta http-equiv=refresh content=0>", "js_redirect"),
        (403, {}, "bm-verify", "akamai"), (200, {}, "<script>location.href='/x'</script>", "js_redirect"), (200, {}, "<p>text</p><script>location.href='/x'</script>", None),
        (404, {}, "not here", None), (200, {}, "", None),
    ]
    rows = spark.createDataFrame([(i, s, h, b) for i, (s, h, b, _) in enumerate(cases)], "i int, status int, headers map<string,string>, body string")
    found = rows.select("i", admission.challenge_kind(F.col("status"), F.col("headers"), F.col("body")).alias("k")).orderBy("i").collect()
    assert [r.k for r in found] == [k for *_, k in cases]


def test_crawl_delay():
    text = "User-agent: a\nUser-agent: b\nCrawl-delay: 2.5\n\nUser-agent: *\nDisallow: /x\nCrawl-delay: 1"
    assert [admission.crawl_delay(text, agent) for agent in ("A", "b", "c")] == [2.5, 2.5, 1.0]
    assert admission.crawl_delay("User-agent: *\nCrawl-delay: soon", "a") is None


def test_layers_double_and_errors_halve():
    found = dedup.layers(10, 1e-3, 3)
    assert [n for n, _ in found] == [10, 20, 40]
    assert sum(p for _, p in found) < 2e-3


def test_refused_groups_become_dead_letters(spark):
    items = spark.createDataFrame([("news", False, 1), ("news", True, 2), ("price", False, 3)], "table string, is_update boolean, n int")
    dead = tables.write_groups(items, {"sink": lambda table, update, rows: table != "price"})
    assert [(r["table"], r.n) for r in dead.collect()] == [("price", 3)]


def test_insert_policy_error_refuses_known_keys(spark):
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(2, "b", 1)], "id int, v string, seq int")
    assert tables.insert(base, new, ["id"], "seq", "error").count() == 2
    try:
        tables.insert(base, spark.createDataFrame([(1, "b", 1)], "id int, v string, seq int"), ["id"], "seq", "error")
    except ValueError:
        return
    raise AssertionError("a known key went through")


def test_routes_stop_at_the_first_refusal_and_can_be_written_again(spark):
    kinds = "a int, b string"
    news = tables.normalise(spark.createDataFrame([(1, " x "), (1, "x"), (2, None)], kinds), "news", ["b"], pipelines=["one", "two"], clean={"b": F.trim("b")})
    assert [r.data for r in news.orderBy("data").collect()] == ['{"a":1,"b":"x"}', '{"a":1,"b":"x"}', '{"a":2,"b":null}']
    assert news.select("fp").distinct().count() == 2
    prices = tables.normalise(spark.createDataFrame([(3, "y")], kinds), "price", update_keys=["a"])
    calls = []

    def sink(name, refuses=(), breaks=()):
        def write(table, update, rows):
            calls.append((name, table, update, rows.count()))
            if table in breaks:
                raise RuntimeError("down")
            return table not in refuses

        return write

    dead = tables.write_groups(news.unionByName(prices), {"one": sink("one", breaks=["news"]), "two": sink("two"), "three": sink("three", refuses=["price"])}, default=["three"])
    assert sorted(calls) == [("one", "news", False, 3), ("three", "price", True, 1)]
    assert sorted(r["table"] for r in dead.collect()) == ["news", "news", "news", "price"]
    left = tables.write_again(dead, {"one": sink("one"), "two": sink("two"), "three": sink("three", refuses=["price"])}, default=["three"])
    assert [(r["table"], r["update_keys"]) for r in left.collect()] == [("price", ["a"])] and left.columns == dead.columns
    assert tables.write_groups(news, {}).count() == 3  # no such sink


def test_replay_tells_groups_apart(spark):
    dead = spark.createDataFrame([("t", None, None, 1), ("t", ["a"], None, 2), ("t", ["a"], ["p"], 3), ("u", [], None, 4)], "table string, update_keys array<string>, pipelines array<string>, n int")
    went = spark.createDataFrame([("t", [], None), ("t", ["a"], ["p"])], "table string, update_keys array<string>, pipelines array<string>")
    assert sorted(r.n for r in tables.replay(dead, went).collect()) == [2, 4]


def test_updates_of_nothing_are_passed_over(spark):
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    after, missed = tables.keyed_update(base, spark.createDataFrame([(1, 0), (9, 1)], "id int, seq int"), ["id"], "seq")
    assert after.collect() == base.collect() and missed.isEmpty()


def test_batches_follow_one_another(spark):
    at = lambda day: F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
    work = spark.createDataFrame([(1, 1), (2, -1)], "id int, batch_status int").withColumn("update_time", at(1))
    none = spark.createDataFrame([], "id long, total long, done long, failed long, is_done boolean, create_time timestamp")
    batches, open_tasks, opened = tasks.open_batch(none, work, at(1), 86400)
    assert opened and {r.batch_status for r in open_tasks.collect()} == {0}
    assert not tasks.open_batch(batches, work, at(9), 86400)[2]  # not done
    assert not tasks.open_batch(batches, work, at(9), 86400, force=True)[2]
    after, row, taken = tasks.tick(work, at(1), 60, 5)
    assert taken.isEmpty() and row.first().is_done
    batches = tasks.record(batches, 1, row)
    assert [tuple(r)[:5] for r in batches.collect()] == [(1, 2, 1, 1, True)]
    assert not tasks.open_batch(batches, work, F.lit("2024-01-01 23:00:00").cast("timestamp"), 86400)[2]  # too early
    assert tasks.open_batch(batches, work, F.lit("2024-01-01 23:00:00").cast("timestamp"), 86400, force=True)[2]
    later, _, opened = tasks.open_batch(batches, work, at(2), 86400)
    assert opened and sorted(r.id for r in later.collect()) == [1, 2]
    marked = tasks.mark(open_tasks, spark.createDataFrame([(1, 0, 2), (1, 1, -1), (7, 2, 1)], "id int, seq int, batch_status int"), at(3))
    assert sorted((r.id, r.batch_status) for r in marked.collect()) == [(1, -1), (2, 0)]


def test_summary_of_nothing(spark):
    row = tasks.summary(spark.createDataFrame([], "counter string, ts timestamp")).first()
    assert len(row) == 15 and row.schema == 1 and set(row[1:]) == {0}


def test_suppression_equals_a_loop(spark):
    chance = random.Random(3)
    rows, at = [], 0.0
    for seq in range(400):
        at += chance.choice([0.0, 0.0, 0.3, 2.0])
        rows.append((seq, at, chance.choice("ab")))
    last, expected = {}, []
    for seq, t, key in rows:
        if key not in last or t - last[key] >= 5.0:
            last[key] = t
            expected.append(seq)
    found = spark.createDataFrame(rows, "seq int, at double, key string")
    assert sorted(r.seq for r in tasks.suppress(found, 5.0).collect()) == expected
    assert tasks.suppress(found, 0).count() == 400


def test_alerts_follow_the_order_and_not_the_clock(spark):
    log = spark.createDataFrame([(1, 100.0), (2, 5000.0), (3, 90.0), (4, 80.0)], "seq long, at double").withColumn("outcome", F.lit("failed"))
    assert sorted(r.seq for r in tasks.alerts(log, 100, 0.5, 3).collect()) == [3, 4]
    assert tasks.alerts(log, 100, 0.5, 0).isEmpty()
    assert sorted((r.seq, r.key) for r in tasks.alerts(log, 4, 1.0, 0, held="seq", capacity=4, full=0.75).collect()) == [(3, "dedup_fill"), (4, "dedup_fill"), (4, "failed_rate")]


def test_failed_requests_pass_dedup_again(spark):
    from gleanframe.sources import tables as sources

    lines = spark.createDataFrame([('{"url": "http://a", "seq": 1, "filter_repeat": true, "cb_kwargs": {"n": "2"}}',), ("{broken",), (" ",), ('{"seq": 3}',), (None,)], "value string")
    again, bad = sources.failed_requests(lines)
    assert [(r.url, r.seq, r.filter_repeat, r.cb_kwargs) for r in again.collect()] == [("http://a", 1, False, {"n": "2"})]
    assert {r.value for r in bad.collect()} == {"{broken", '{"seq": 3}'}
    assert dedup.admit(again, again.select("url"), fp="url").count() == 1


def test_delays_are_the_longer_of_two_and_spread(spark):
    rows = spark.createDataFrame([(None, 0.0), (3.0, 1.0), (0.5, 0.5)], "own double, chance double").coalesce(1)
    assert [tuple(r) for r in rows.select(pacing.delay(1.0, F.col("own")), pacing.delay(1.0, F.col("own"), F.col("chance"))).collect()] == [(1.0, 0.5), (3.0, 4.5), (1.0, 1.0)]


def test_polite_delays_of_repeated_urls_equal_sql(spark, tmp_path):
    """Two pages of one URL are two requests with a delay each, not four."""
    urls = ["http://a.com/1", "http://a.com/1", "http://b.org/1", "http://b.org/1", None, None]
    spark.createDataFrame(list(enumerate(urls, 5)), "page_id long, url string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(spark, str(tmp_path), "polite_delay", QUERIES["polite_delay"], ORACLE_SQL["polite_delay"])


def test_seeds_come_in_the_order_of_their_table(spark):
    from gleanframe.operators import frontier
    from gleanframe.sources import tables as sources

    table = spark.createDataFrame([(f"http://h/{i * 7 % 10}", i) for i in range(10)] + [(None, 10)], "url string, n int").repartition(4)
    taken = frontier.top(sources.seeds(table, order="n"), 10).collect()
    assert [r.url for r in taken] == [f"http://h/{i * 7 % 10}" for i in range(10)]


def test_schemas_hold_the_fields_of_all_items(spark):
    from gleanframe.sources import tables as sources

    lines = spark.createDataFrame([('{"a": 1}',), ('{"b": "x", "a": 2.5}',), (None,)], "data string")
    shown = sources.item_schema(spark, lines)
    assert [tuple(r.v) for r in lines.where("data is not null").select(F.from_json("data", shown).alias("v")).orderBy("v.a").collect()] == [(1.0, None), (2.5, "x")]


@pytest.mark.parametrize(("interval", "width"), [(10.0, 4), (10.0, 1024), (0.5, 8), (1000.0, 2)])
def test_suppression_over_many_stretches_equals_a_loop(spark, interval, width):
    """Dense and sparse alerts of a hot key, alone in their slices or many in one, with gaps of many slices."""
    rng = random.Random(7)
    rows, now = [], 0.0
    for i in range(3000):
        now += rng.choice([0, 1, 1, 2, 9, 10, 11, 25]) if rng.random() < 0.99 else 700.0
        rows.append(("hot" if rng.random() < 0.9 else rng.choice("ab"), i, now))
    last, want = {}, set()
    for key, i, at in rows:
        if key not in last or at - last[key] >= interval:
            last[key] = at
            want.add(i)
    table = spark.createDataFrame(rows, "key string, seq long, at double")
    assert {r.seq for r in tasks.suppress(table, interval, width=width).collect()} == want
    assert tasks.suppress(table.limit(0), interval, width=width).count() == 0
