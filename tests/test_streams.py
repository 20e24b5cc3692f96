"""Streams over folders of files: enqueue with dedup, durable micro-batches, windows, dead letters."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from gleanframe.functions import identity
from gleanframe.operators import dedup, frontier
from gleanframe.sources import tables as sources
from gleanframe.streaming import streams
from pyspark.sql import functions as F


def _lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_enqueue_keeps_each_fingerprint_once(spark, tmp_path):
    urls = ["http://a.b/?y=2&x=1", "http://a.b/?x=1&y=2", "http://a.b/?x=1&y=2#top", "http://a.b/other"]
    _lines(tmp_path / "in", "one.json", [{"url": u} for u in urls[:2]])
    _lines(tmp_path / "in", "two.json", [{"url": u} for u in urls[2:]])
    stream = streams.enqueue(sources.task_stream(spark, str(tmp_path / "in"), "url string", files=1))
    _drain(stream, "enqueued")
    found = spark.table("enqueued")
    assert found.count() == 2
    assert found.select("fp").distinct().count() == 2


def test_durable_acknowledges_after_the_write(spark, tmp_path):
    _lines(tmp_path / "in", "one.json", [{"n": i} for i in range(5)])
    rows = sources.task_stream(spark, str(tmp_path / "in"), "n int")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def fails(batch, number):
        raise RuntimeError("sink is down")

    broken = streams.durable(rows, fails, checkpoint)
    with pytest.raises(Exception, match="sink is down"):
        broken.awaitTermination(120)

    def writes(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    streams.durable(rows, writes, checkpoint).awaitTermination(120)  # the failed batch comes again
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    _lines(tmp_path / "in", "two.json", [{"n": 9}])
    streams.durable(rows, writes, checkpoint).awaitTermination(120)  # only what is new
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 9]


def test_outcomes_by_window(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [{"ts": (start + timedelta(minutes=m)).isoformat(), "domain": "d", "outcome": o} for m, o in ((0, "ok"), (5, "ok"), (10, "failed"), (70, "ok"))]
    _lines(tmp_path / "in", "one.json", events)
    log = sources.task_stream(spark, str(tmp_path / "in"), "ts timestamp, domain string, outcome string")
    _drain(streams.outcomes_by_window(log), "windows", "complete")
    found = {(r.window.start.hour, r.outcome): r["count"] for r in spark.table("windows").collect()}
    assert found == {(0, "ok"): 2, (0, "failed"): 1, (1, "ok"): 1}


def test_dead_letters_are_told_from_broken_lines(spark, tmp_path):
    (tmp_path / "dead.jsonl").write_text('{"table": "news", "data": "{}", "update_keys": ["url"]}\n\n{broken\n{"table": "price", "data": "{}"}\n')
    good, bad = sources.dead_letters(spark, str(tmp_path / "dead.jsonl"))
    assert sorted(r["table"] for r in good.collect()) == ["news", "price"]
    assert [r.value for r in bad.collect()] == ["{broken"]


def test_seeding_twice_adds_nothing(spark):
    table = spark.createDataFrame([("http://a.b/1",), (None,), ("http://a.b/2",)], "url string")
    seeds = sources.seeds(table).withColumn("fp", identity.request_fingerprint(F.col("method"), F.col("url")))
    assert seeds.count() == 2
    assert sources.seed_once(seeds, seeds.select("fp")).count() == 0


def test_stale_seeds(spark):
    cases = [(61, 0, 0, 0, True), (60, 0, 0, 0, False), (61, 1, 0, 0, False), (61, 0, 1, 0, False), (61, 0, 0, 1, False)]
    rows = spark.createDataFrame(cases, "age int, q int, f int, live int, want boolean")
    assert all(r.want == r.got for r in rows.withColumn("got", sources.stale_seed(F.col("age"), 60, F.col("q"), F.col("f"), F.col("live"))).collect())


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_appending_by_table(spark, tmp_path, fmt):
    items = spark.createDataFrame([("news", 1, "a"), ("price", 2, "b")], "table string, n int, v string")
    for _ in range(2):
        sources.append(items, str(tmp_path / "out"), fmt)
    found = spark.read.option("header", True).format(fmt).load(str(tmp_path / "out"))
    assert sorted((r["table"], int(r.n), r.v) for r in found.collect()) == [("news", 1, "a")] * 2 + [("price", 2, "b")] * 2


def test_jdbc_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id int, v string")
    rows.write.jdbc(url, "items", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    found = sources.jdbc(spark, url, "items", partitionColumn="id", lowerBound="0", upperBound="50", numPartitions="4", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_polling_goes_on(spark, tmp_path):
    _lines(tmp_path / "in", "one.json", [{"n": 1}])
    rows = sources.task_stream(spark, str(tmp_path / "in"), "n int")
    query = streams.durable(rows, lambda batch, number: batch.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint"), every="200 milliseconds")
    try:
        query.processAllAvailable()
        _lines(tmp_path / "in", "two.json", [{"n": 2}])
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_cached_responses_come_whole(spark):
    at = lambda day: datetime(2024, 1, day)
    cache = spark.createDataFrame([("a", at(1), "old"), ("a", at(3), "new"), ("b", at(1), "stale"), ("c", at(3), "posted")], "fp string, fetched_at timestamp, text string")
    asked = spark.createDataFrame([("a", "GET"), ("b", "GET"), ("c", "POST"), ("d", "GET")], "fp string, method string")
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")
    found = {r.fp: (r.hit, r.response and r.response.text) for r in frontier.cache_lookup(asked, cache, now, 2 * 86400).collect()}
    assert found == {"a": (True, "new"), "b": (False, None), "c": (False, None), "d": (False, None)}
    assert {r.fp for r in frontier.cache_lookup(asked, cache, now, 0).where("hit").collect()} == {"a", "b"}


def test_scopes():
    assert [dedup.scope(*x) for x in (("auto", "j", "r"), ("auto", "j", None), ("run", "j", "r"), ("run", "j", None), ("spider", "j", "r"))] == ["j:run:r", "j", "j:run:r", "j", "j"]
    with pytest.raises(ValueError):
        dedup.scope("forever", "j", "r")
