"""Callbacks by name and their outcomes, sinks that take each batch once, sessions of heartbeats, and counts from sketches."""

from __future__ import annotations

import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import callbacks, dedup, tables, tasks
from gleanframe.plans import registry
from gleanframe.streaming import streams

PAGES = "url string, body string, callback string, cb_kwargs map<string,string>, retry_times int"


def listing(page, tag="none"):
    yield callbacks.Ask(page["url"] + "/1", "detail", {"tag": tag, "n": 1}, 5)
    yield {"name": page["body"]}


def detail(page, tag, n):
    yield {"name": tag, "size": int(n)}
    if page["body"] == "bad":
        raise ValueError("broken")
    if page["body"] == "gone":
        raise callbacks.NotRetry("not there")
    if page["body"] == "odd":
        yield {"colour": "red"}


def test_outcomes_of_callbacks(spark):
    kw = {"tag": "t", "n": "7"}
    rows = [
        ("u1", "x", None, None, 0), ("u2", "x", "listing", {"tag": "y"}, None), ("u3", "good", "detail", kw, 2), ("u4", "bad", "detail", kw, 2), ("u5", "bad", "detail", kw, 3), ("u6", "gone", "detail", kw, 1),
        ("u7", "x", "unknown", kw, 0), ("u8", "x", "detail", {"tag": "t"}, 0), ("u9", "odd", "detail", kw, 0), ("u10", "x", "nothing", {}, 0),
    ]
    found = callbacks.dispatch(spark.createDataFrame(rows, PAGES), {"listing": listing, "detail": detail, "nothing": lambda page: None}, "name string, size int", default="listing").collect()
    got = Counter((r.source, r.kind, r.url, r.callback, tuple(sorted((r.cb_kwargs or {}).items())), r.priority, r.retry_times, r.item and (r.item.name, r.item.size)) for r in found)
    sent = (("n", "7"), ("tag", "t"))
    want = [("u1", "request", "u1/1", "detail", (("n", "1"), ("tag", "none")), 5, 0, None), ("u1", "item", "u1", None, (), None, 0, ("x", None)), ("u1", "ok", "u1", None, (), None, 0, None)]
    want += [("u2", "request", "u2/1", "detail", (("n", "1"), ("tag", "y")), 5, 0, None), ("u2", "item", "u2", "listing", (("tag", "y"),), None, 0, ("x", None)), ("u2", "ok", "u2", "listing", (("tag", "y"),), None, 0, None)]
    want += [(u, "item", u, "detail", sent, None, t, ("t", 7)) for u, t in (("u3", 2), ("u4", 2), ("u5", 3), ("u6", 1), ("u9", 0))]
    want += [(u, kind, u, "detail", sent, None, t, None) for u, kind, t in (("u3", "ok", 2), ("u4", "retry", 3), ("u5", "fail", 3), ("u6", "drop", 1), ("u9", "retry", 1))]
    want += [("u7", "fail", "u7", "unknown", sent, None, 0, None), ("u8", "retry", "u8", "detail", (("tag", "t"),), None, 1, None), ("u10", "ok", "u10", "nothing", (), None, 0, None)]
    assert got == Counter(want)
    reasons = {r.source: r.reason for r in found if r.reason}
    assert reasons["u4"] == "ValueError: broken" and "colour" in reasons["u9"] and "unknown" in reasons["u7"] and reasons["u6"] == "not there"


def test_pages_without_request_columns_and_none_at_all(spark):
    pages = spark.createDataFrame([("u", "b")], "url string, body string")
    found = callbacks.dispatch(pages, {"parse": listing}, "name string")
    assert Counter(r.kind for r in found.collect()) == {"request": 1, "item": 1, "ok": 1}
    assert callbacks.dispatch(pages.limit(0), {"parse": listing}, "name string").count() == 0


def test_all_outcomes_are_in_the_query(spark, sf01):
    assert {r.kind for r in registry.QUERIES["callback_dispatch"](spark, sf01).select("kind").distinct().collect()} == {"request", "item", "ok", "retry", "fail", "drop"}


# --- ledger


class Crash(BaseException):
    """What ends a process, and no sink's refusal."""


ITEMS = "table string, is_update boolean, update_keys array<string>, pipelines array<string>, id long"


def items(spark):
    return spark.createDataFrame([("a", False, None, None, i) for i in range(5)] + [("b", False, None, ["lake"], i) for i in range(3)], ITEMS)


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    """The second sink crashes after the first took a group; the batch comes again, and no row is twice in any sink."""
    written, crash = [], [True]

    def sink(name):
        def write(table, update, rows):
            ids = sorted(r.id for r in rows.collect())
            if name == "index" and crash[0]:
                raise Crash
            written.extend((name, table, i) for i in ids)
            return True

        return write

    sinks = {"lake": sink("lake"), "index": sink("index")}
    ledger = tables.Ledger(str(tmp_path / "ledger"), 7)
    with pytest.raises(Crash):
        tables.write_groups(items(spark), sinks, ledger=ledger)
    assert {w[0] for w in written} == {"lake"}
    crash[0] = False
    assert tables.write_groups(items(spark), sinks, ledger=ledger).isEmpty()
    want = [(s, "a", i) for s in sinks for i in range(5)] + [("lake", "b", i) for i in range(3)]
    assert Counter(written) == Counter(want)
    assert tables.write_groups(items(spark), sinks, ledger=ledger).isEmpty() and len(written) == len(want)
    tables.write_groups(items(spark), sinks, ledger=ledger._replace(epoch=8))  # another batch is written
    assert Counter(written) == Counter(want * 2)


def test_refused_groups_are_not_noted(spark, tmp_path):
    taken = []
    sinks = {"one": lambda table, update, rows: taken.append(table) or True, "two": lambda table, update, rows: table == "b"}
    ledger = tables.Ledger(str(tmp_path / "ledger"), 0)
    rows = items(spark).withColumn("pipelines", F.array(F.lit("one"), F.lit("two")))
    assert {r.table for r in tables.write_groups(rows, sinks, ledger=ledger).collect()} == {"a"}
    assert {r.table for r in tables.write_groups(rows, sinks, ledger=ledger).collect()} == {"a"}  # asked again, the first sink is not
    assert sorted(taken) == ["a", "b"]


def test_routed_stream_goes_on_after_a_crash(spark, tmp_path):
    """A stream whose second sink fails for all of a micro-batch that comes again: rows are in each sink once, refused ones in the dead letters."""
    folder = tmp_path / "in"
    for i in range(2):
        items(spark).withColumn("id", F.col("id") + 100 * i).coalesce(1).write.mode("append").json(str(folder))
    schema = items(spark).schema

    def sinks(epoch):
        def write(name):
            def one(table, update, rows):
                rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}/table={table}/epoch={epoch}")
                return name != "index" or epoch > 0

            return one

        return {"lake": write("lake"), "index": write("index")}

    def dead(rows, epoch):
        rows.write.mode("overwrite").json(f"{tmp_path}/dead/epoch={epoch}")

    for _ in range(2):  # the second run finds nothing left
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        query = streams.routed(stream, sinks, dead, f"{tmp_path}/ledger", f"{tmp_path}/checkpoint")
        assert query.awaitTermination(120) and query.exception() is None
    lake = spark.read.option("basePath", f"{tmp_path}/lake").parquet(f"{tmp_path}/lake/table=*/epoch=*")
    assert lake.count() == lake.select("table", "id").distinct().count() == 16
    refused = spark.read.json(f"{tmp_path}/dead")
    assert refused.count() == 5 and {r.table for r in refused.select("table").collect()} == {"a"}


# --- sessions


def test_sessions_on_a_stream_equal_batch(spark, tmp_path):
    """Heartbeats out of order, over several files; a late one joins two stretches."""
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    beats = [(f"n{rng.randrange(4)}", start + datetime.timedelta(seconds=t)) for t in range(0, 3000, 7) if not 600 < t % 1000 < 800]
    beats += [("late", start + datetime.timedelta(seconds=s)) for s in (0, 100, 50)] + [("end", start + datetime.timedelta(days=2))]
    table = spark.createDataFrame(beats, "node string, ts timestamp")
    want = sorted(map(tuple, tasks.node_sessions(table, "60 seconds").where("node <> 'end'").collect()))
    assert ("late", 3) in {(w[0], w[3]) for w in want}
    parts = [beats[i::3] for i in range(3)]
    for i, part in enumerate(parts):
        spark.createDataFrame([p for p in part if p[0] != "end"], table.schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    for last in (False, True):
        if last:
            spark.createDataFrame([("end", beats[-1][1])], table.schema).coalesce(1).write.json(f"{tmp_path}/in/9")
        query = tasks.node_sessions(stream(), "60 seconds", late="2 hours").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120) and query.exception() is None
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    now = F.lit("2024-01-01 00:01:30").cast("timestamp")
    assert "late" in {r.node for r in tasks.alive(tasks.node_sessions(table, "60 seconds"), now).collect()}


def test_fill_from_sketches_of_runs(spark):
    keys = spark.range(60_000).select((F.col("id") % 50_000).alias("k"))
    runs = [dedup.key_sketch(keys.where(F.col("k") % 3 != i), "k", f"r{i}") for i in range(3)]
    stored = runs[0].unionByName(runs[1]).unionByName(runs[2])
    row = dedup.fill_from_sketches(stored, 60_000).first()
    assert abs(row.n - 50_000) < 0.05 * 50_000 and row.nearly_full
    assert not dedup.fill_from_sketches(stored, 100_000).first().nearly_full
    assert dedup.fill_from_sketches(stored.limit(0), 10).first().n == 0
    assert json.dumps([r.run for r in stored.select("run").orderBy("run").collect()]) == '["r0", "r1", "r2"]'
