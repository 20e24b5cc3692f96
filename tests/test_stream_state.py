"""Operators with state on streams: they equal the batch operators over the whole log, whatever its cut into micro-batches, and restarts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import frontier, pacing
from gleanframe.streaming import state

LOG = "task_uid string, kind string, ts timestamp"


def write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{name}")


def drain(stream, folder, name):
    """What is there, taken up to the end into a Parquet folder, from the checkpoint on."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/{name}")
    assert query.awaitTermination(120) and query.exception() is None


def source(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).json(folder)


def test_leases_end_once_and_equal_reclaim(spark, tmp_path):
    """Claims, renewals and ends over several batches and a restart; the tasks given back are those that batch reclaim finds."""
    rng = random.Random(5)
    log = []
    for i in range(40):
        start = 1000.0 + rng.randrange(0, 60)
        log.append((f"t{i}", "claim", start))
        for b in range(rng.randrange(3)):
            log.append((f"t{i}", "beat", start + 7.0 * (b + 1)))
        if rng.random() < 0.4:
            log.append((f"t{i}", "ack", start + 5.0))
    log.sort(key=lambda r: r[2])
    log.append(("end", "claim", 5000.0))
    rows = [(u, k, t) for u, k, t in log]
    spark_rows = lambda part: [(u, k, __import__("datetime").datetime.fromtimestamp(t, __import__("datetime").timezone.utc)) for u, k, t in part]
    folder = str(tmp_path)
    (tmp_path / "in").mkdir()
    cut_at = len(rows) // 2
    for part, name in ((rows[: cut_at // 2], "a"), (rows[cut_at // 2 : cut_at], "b")):
        write(spark, spark_rows(part), LOG, f"{folder}/in", name)
    drain(state.leases(source(spark, f"{folder}/in", LOG), 10.0, late="0 seconds"), folder, "out")
    early = spark.read.schema("task_uid string, lease_until timestamp, priority int").parquet(f"{folder}/out").count()
    write(spark, spark_rows(rows[cut_at:]), LOG, f"{folder}/in", "c")  # a restart goes on from the checkpoint
    drain(state.leases(source(spark, f"{folder}/in", LOG), 10.0, late="0 seconds"), folder, "out")
    found = sorted((r.task_uid, r.lease_until.timestamp(), r.priority) for r in spark.read.parquet(f"{folder}/out").collect())
    table = spark.createDataFrame(spark_rows(rows), LOG).where("task_uid <> 'end'")
    claims = table.where("kind = 'claim'").select("task_uid", (F.col("ts") + F.expr("INTERVAL 10 SECONDS")).alias("lease_until"), F.lit(300).alias("priority"))
    inflight = frontier.ack(frontier.renew(claims, table.where("kind = 'beat'"), 10.0), table.where("kind = 'ack'"))
    want = frontier.reclaim(inflight, F.lit("1970-01-01 01:00:00").cast("timestamp"))
    assert found == sorted((r.task_uid, r.lease_until.timestamp(), r.priority) for r in want.collect())
    assert 0 < early < len(found) < 40


def test_beats_after_the_end_and_repeated_claims(spark, tmp_path):
    rows = [("late", "claim", 100), ("late", "beat", 111), ("again", "claim", 100), ("again", "claim", 108), ("kept", "claim", 100), ("kept", "beat", 109), ("kept", "beat", 102), ("gone", "ack", 101), ("gone", "beat", 102), ("end", "claim", 900)]
    write(spark, [(u, k, t) for u, k, t in rows], "task_uid string, kind string, ts long", str(tmp_path), "in")
    stream = source(spark, f"{tmp_path}/in", "task_uid string, kind string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    drain(state.leases(stream, 10.0, late="0 seconds"), str(tmp_path), "out")
    found = {r.task_uid: r.lease_until.timestamp() for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {"late": 110.0, "again": 118.0, "kept": 119.0}


def test_leases_by_the_clock(spark, tmp_path):
    """With the machines' clock, a lease of a second ends while the stream polls, though nothing more comes."""
    import time

    write(spark, [("a", "claim", 0), ("b", "claim", 0), ("b", "ack", 0)], "task_uid string, kind string, ts long", str(tmp_path), "in")
    stream = source(spark, f"{tmp_path}/in", "task_uid string, kind string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    query = state.leases(stream, 1.0).writeStream.format("memory").queryName("by_clock").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("by_clock").count():
            time.sleep(0.5)
        assert [r.task_uid for r in spark.table("by_clock").collect()] == ["a"]
    finally:
        query.stop()


EVENTS = "domain string, seq long, at double, delay double, kind string"


def outcomes(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("abcd"), i, float(i * 3 + rng.randrange(3)), float(rng.choice([0, 5, 20])), rng.choice(["ok", "bad", "bad", "none"])) for i in range(n)]


def batch_truth(table, threshold, base, most):
    failed, ok = F.col("kind") == "bad", F.col("kind") == "ok"
    tickets = pacing.tickets(table)
    streaks = pacing.breaker(table, ok, failed, threshold)
    bans = pacing.bans(table, failed, ok, base, most, key="domain")
    whole = tickets.join(streaks.select("seq", "failures", "trip"), "seq").join(bans.select("seq", "ban"), "seq")
    return tickets, streaks, bans, whole


@pytest.mark.parametrize("handed", [False, True])
def test_pace_equals_batch(spark, tmp_path, handed):
    """Batches of a stream, alone or after a state handed over by batch tables, equal the batch operators on their union."""
    failed, ok = F.col("kind") == "bad", F.col("kind") == "ok"
    rows = outcomes(400, 3)
    table = spark.createDataFrame(rows, EVENTS)
    want = {r.seq: (r.domain, r.start, r.failures, r.trip, r.ban) for r in batch_truth(table, 3, 10.0, 160.0)[3].collect()}
    first, initial = (0, None) if not handed else (150, None)
    if handed:
        tickets, streaks, bans, _ = batch_truth(table.where("seq < 150"), 3, 10.0, 160.0)
        initial = state.pace_state(tickets, streaks, bans, ok, 10.0)
        initial = spark.createDataFrame(initial.collect(), initial.schema)
    for i, at in enumerate(range(first, 400, 100)):
        write(spark, rows[at : at + 100], EVENTS, f"{tmp_path}/in", f"part{i}")
    stream = state.paced(source(spark, f"{tmp_path}/in", EVENTS), failed, ok, 3, 10.0, 160.0, initial=initial)
    drain(stream, str(tmp_path), "out")
    found = {r.seq: (r.domain, r.start, r.failures, r.trip, r.ban) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {s: v for s, v in want.items() if s >= first} and len(found) == 400 - first


KEYS = "fp string, seq long"


def test_shared_bloom_over_batches_and_a_restart(spark, tmp_path):
    """Nothing new is fresh twice, also after a restart; few new keys are held back at eight times the first layers' capacity."""
    rows = [(f"http://site/{i}", i) for i in range(8000)]
    for i in range(4):
        write(spark, rows[i * 1000 : i * 1000 + 1200], KEYS, f"{tmp_path}/in", f"a{i}")  # neighbours overlap
    stream = lambda: state.seen_by_bloom(source(spark, f"{tmp_path}/in", KEYS), 8000, 0.01, buckets=4)
    drain(stream(), str(tmp_path), "out")
    for i in range(4, 8):
        write(spark, rows[i * 1000 : i * 1000 + 1000] + rows[:50], KEYS, f"{tmp_path}/in", f"b{i}")
    drain(stream(), str(tmp_path), "out")
    found = spark.read.parquet(f"{tmp_path}/out")
    times = found.groupBy("key").agg(F.count_if("fresh").alias("n"))
    assert times.where("n > 1").isEmpty() and times.count() == 8000
    assert times.where("n = 0").count() < 0.02 * 8000
    assert found.where("full").isEmpty()


def test_full_bloom_says_so(spark, tmp_path):
    write(spark, [(f"k{i}", i) for i in range(500)] + [(None, 500)], KEYS, f"{tmp_path}/in", "a")
    drain(state.seen_by_bloom(source(spark, f"{tmp_path}/in", KEYS), 40, 0.01, buckets=1, most=2), str(tmp_path), "out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 500 and not found.where("full").isEmpty()


def test_bloom_state_does_not_grow_with_the_stream(spark, tmp_path):
    sizes = []
    processor = state._Bloom(100, 0.01, 2)
    for i in range(3):
        write(spark, [(f"k{i}-{j}", j) for j in range(400)], KEYS, f"{tmp_path}/in", f"a{i}")
    bits = sum(-(-b // 8) for _, _, b in processor.layers)
    query = state.seen_by_bloom(source(spark, f"{tmp_path}/in", KEYS), 300, 0.01, buckets=1, most=2).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    sizes = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in map(lambda p: __import__("json").loads(p.json), query.recentProgress)]
    assert sizes and max(sizes) <= 1 and bits < 1000
