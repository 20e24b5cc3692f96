"""Task tables, batches, run summaries, termination and alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.functions.lineage import cut
from gleanframe.operators.tables import keyed_update

TODO, DONE, DOING, FAILED = 0, 1, 2, -1
#: Numbers of the order in a slice, which one task sees at a time.
SLICE = 4096

#: The counters of a run, in the order of its summary.
COUNTERS = (
    "request_ok", "request_failed", "retry", "dropped", "robots_dropped", "content_type_dropped", "dedup_dropped",
    "parse_error", "items", "item_dedup_dropped", "item_failed", "dedup_degraded",
)


def counts(tasks: DataFrame, state: str = "batch_status") -> DataFrame:
    """One row: total and the tasks in each state; unknown states count toward the total only."""
    of = lambda v: F.count_if(F.col(state) == v)
    return tasks.agg(F.count("*").alias("total"), of(TODO).alias("todo"), of(DOING).alias("doing"), of(DONE).alias("done"), of(FAILED).alias("failed"))


def next_open(tasks: DataFrame, n: int, key: str = "id", state: str = "batch_status") -> DataFrame:
    """The first ``n`` open tasks by id, at least one."""
    return tasks.where(F.col(state) == TODO).orderBy(key).limit(max(1, n))


def claim(tasks: DataFrame, n: int, now: Column, key: str = "id", state: str = "batch_status") -> DataFrame:
    """The table after the first ``n`` open tasks, by id, are taken."""
    taken = next_open(tasks, n, key, state).select(key).withColumn("_taken", F.lit(True))
    joined = tasks.join(taken, key, "left")
    return joined.select(
        *(F.when(F.col("_taken"), {state: F.lit(DOING), "update_time": now}[c]).otherwise(F.col(c)).alias(c) if c in (state, "update_time") else F.col(c) for c in tasks.columns)
    )


def reset_lost(tasks: DataFrame, now: Column, stale: float, state: str = "batch_status") -> DataFrame:
    """Tasks in work for ``stale`` seconds or more are open again."""
    lost = (F.col(state) == DOING) & (F.unix_timestamp(now) - F.unix_timestamp("update_time") >= stale)
    return tasks.withColumn("_lost", lost).withColumn(state, F.when(F.col("_lost"), TODO).otherwise(F.col(state))).withColumn("update_time", F.when(F.col("_lost"), now).otherwise(F.col("update_time"))).drop("_lost")


def mark(tasks: DataFrame, marks: DataFrame, now: Column, key: str = "id", state: str = "batch_status", seq: str = "seq") -> DataFrame:
    """The table after ``marks`` (key, state, seq): the last state of each task holds, unknown tasks are passed over."""
    return keyed_update(tasks, marks.select(key, seq, state, now.alias("update_time")), [key], seq)[0]


def reset_all(tasks: DataFrame, state: str = "batch_status") -> DataFrame:
    """All tasks open again, for a new batch."""
    return tasks.withColumn(state, F.lit(TODO))


def open_batch(batches: DataFrame, tasks: DataFrame, now: Column, interval: float, force: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """The batches and tasks to go on with, and whether a new batch was opened, which opens all tasks again.

    ``batches`` has ``id, total, done, failed, is_done, create_time``. A batch follows when there is none yet, or when
    the last one is done and at least ``interval`` seconds old; with ``force``, of any age. One row reaches the driver.
    """
    age = (F.unix_timestamp(now) - F.unix_timestamp("create_time")).alias("age")
    last = batches.agg(F.max_by(F.struct("id", "is_done", age), "id").alias("b")).first()["b"]
    if last is not None and not (last["is_done"] and (force or last["age"] >= interval)):
        return batches, tasks, False
    number = 1 if last is None else last["id"] + 1
    zero = F.lit(0).cast("long")
    row = counts(tasks).select(F.lit(number).cast("long").alias("id"), "total", zero.alias("done"), zero.alias("failed"), F.lit(False).alias("is_done"), now.alias("create_time"))
    return batches.unionByName(row), reset_all(tasks), True


def record(batches: DataFrame, number: int, row: DataFrame) -> DataFrame:
    """The batches after one of them takes the counts and the end that ``tick`` found."""
    return keyed_update(batches, row.select(F.lit(number).cast("long").alias("id"), F.lit(0).alias("seq"), "total", "done", "failed", "is_done"), ["id"], "seq")[0]


def tick(tasks: DataFrame, now: Column, stale: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One turn of the batch's monitor: the next task table, the batch's row with ``is_done``, and the tasks taken."""
    ready = reset_lost(tasks, now, stale)
    after = claim(ready, n, now)
    row = counts(after)
    done = (F.col("total") == 0) | (F.col("done") + F.col("failed") >= F.col("total"))
    return after, row.withColumn("is_done", done), next_open(ready, n)


def summary(log: DataFrame, counter: str = "counter", at: str = "ts", n: str | None = None) -> DataFrame:
    """One row of 15 columns: ``schema``, ``elapsed`` seconds, the total of each counter, and ``rate``, successes a second.

    A row of ``log`` counts once, or ``n`` times. Other counters are passed over; without rows or time the rate is 0.
    """
    times = F.lit(1) if n is None else F.col(n)
    totals = [F.coalesce(F.sum(F.when(F.col(counter) == c, times)), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    row = log.agg(((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6).alias("took"), *totals)
    rate = F.when(F.col("took") > 0, F.round(F.col("request_ok") / F.col("took"), 3)).otherwise(0.0)
    return row.select(F.lit(1).alias("schema"), F.coalesce(F.round("took", 3), F.lit(0.0)).alias("elapsed"), *COUNTERS, rate.alias("rate"))


def rates(log: DataFrame, every: str, counter: str = "counter", at: str = "ts") -> DataFrame:
    """``(tick, request_ok, per_second)`` of each stretch of time that has rows."""
    ticks = log.groupBy(F.window(at, every).alias("w")).agg(F.count_if(F.col(counter) == "request_ok").alias("request_ok"))
    width = F.unix_timestamp(F.col("w")["end"]) - F.unix_timestamp(F.col("w")["start"])
    return ticks.select(F.col("w")["start"].alias("tick"), "request_ok", F.round(F.col("request_ok") / width, 3).alias("per_second"))


def all_idle(beats: DataFrame, now: Column, stale: float, queued: Column, inflight: Column, started: Column, grace: float) -> DataFrame:
    """One row ``done``: no live node with work, nothing queued or in flight, and the start long enough ago."""
    last = beats.groupBy("node").agg(F.max_by("pending", "ts").alias("pending"), F.max("ts").alias("ts"))
    busy = F.count_if((F.unix_timestamp(now) - F.unix_timestamp("ts") <= stale) & (F.col("pending") > 0))
    return last.agg(busy.alias("busy")).select(((F.col("busy") == 0) & (queued == 0) & (inflight == 0) & (F.unix_timestamp(now) - F.unix_timestamp(started) > grace)).alias("done"))


def node_sessions(beats: DataFrame, gap: str, node: str = "node", at: str = "ts", late: str | None = None) -> DataFrame:
    """``(node, started, ended, beats)``: stretches in which a node was alive, ``gap`` after its last heartbeat being their end.

    A heartbeat that comes late joins the stretches it lies between. On a stream, ``late`` is how long these are waited for, and a
    stretch is reported once it can no longer grow. Heartbeats are merged before and after the exchange, so a busy node
    sends few rows.
    """
    rows = beats if late is None else beats.withWatermark(at, late)
    found = rows.groupBy(F.session_window(at, gap).alias("_w"), node).agg(F.count("*").alias("beats"))
    return found.select(node, F.col("_w")["start"].alias("started"), F.col("_w")["end"].alias("ended"), "beats")


def alive(sessions: DataFrame, now: Column, node: str = "node") -> DataFrame:
    """The nodes in whose stretch ``now`` lies."""
    return sessions.where((F.col("started") <= now) & (now < F.col("ended"))).select(node)


def alerts(log: DataFrame, least: int, part: float, most_failed: int, order: str = "seq", at: str = "at", held: str | None = None, capacity: int = 0, full: float = 0.8) -> DataFrame:
    """``(seq, at, key)``: the conditions met after each event of a run: ``failed_rate`` and ``failed_count``, at the limit or above (0 failed: no limit).

    ``held``, if given, is how many keys a dedup filter of that ``capacity`` holds by then; ``dedup_fill`` tells that it is nearly full.

    ``order`` is a whole number, ``at`` is in seconds and need not grow with it. Running sums go over the totals of slices of
    the order first (a window over one row for each slice), then inside a slice.
    """
    log = log.withColumn("_held", F.lit(None).cast("long") if held is None else F.col(held))
    sliced = log.withColumn("_slice", F.floor(F.col(order) / SLICE))
    sums = sliced.groupBy("_slice").agg(F.count("*").alias("_n"), F.count_if(F.col("outcome") == "failed").alias("_f"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_slice", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_f")))
    inside = W.partitionBy("_slice").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = sliced.select("_slice", order, at, "_held", F.count("*").over(inside).alias("_n"), F.sum((F.col("outcome") == "failed").cast("int")).over(inside).alias("_f")).join(starts, "_slice")
    n, failed = F.col("_n") + F.col("_n0"), F.col("_f") + F.col("_f0")
    nearly = F.lit(capacity > 0) & (F.col("_held") >= capacity * full)
    conditions = {"failed_rate": (n >= least) & (failed / n >= part), "failed_count": F.lit(most_failed > 0) & (failed >= most_failed), "dedup_fill": nearly}
    keys = F.array_compact(F.array(*(F.when(met, key) for key, met in conditions.items())))
    return running.select(order, at, F.explode(keys).alias("key"))


def stalls(log: DataFrame, most: float, order: str = "seq", at: str = "at") -> DataFrame:
    """``(seq, at, key)``: the events that come over ``most`` seconds after the last success before them.

    The last success is carried over the ends of slices of the order, then inside a slice.
    """
    sliced = log.withColumn("_slice", F.floor(F.col(order) / SLICE)).withColumn("_ok_at", F.when(F.col("outcome") == "ok", F.col(at)))
    ends = sliced.groupBy("_slice").agg(F.max("_ok_at").alias("_ok"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select("_slice", F.max("_ok").over(before).alias("_ok0"))
    inside = W.partitionBy("_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = sliced.withColumn("_last", F.max("_ok_at").over(inside)).join(starts, "_slice").withColumn("_last", F.coalesce("_last", "_ok0"))
    return last.where(F.col(at) - F.col("_last") > most).select(order, at, F.lit("stall").alias("key"))


def suppress(found: DataFrame, interval: float, order: str = "seq", at: str = "at", width: int = 1024) -> DataFrame:
    """Of each key's alerts, by time ``at``, one per ``interval`` seconds; the first always. Without an interval all are sent.

    Of alerts with one key and time only the first in ``order`` can be sent. Each other alert has a successor, the first at least
    ``interval`` later, and what is sent is the chain of successors from a key's first alert. Time is cut into slices of the
    interval, so a successor lies in the next slice or begins a later one; and ``width`` slices make a stretch, inside of
    which a task follows chains. Chains over stretches are followed by doubling. So a key with very many alerts is
    spread over as many tasks as it has stretches.
    """
    if interval <= 0:
        return found
    t, own = F.col("_t"), ["key", "_stretch"]
    firsts = found.groupBy("key", F.col(at).cast("double").alias("_t")).agg(F.min_by(F.struct(*found.columns), order).alias("_first"))
    firsts = cut(firsts.withColumn("_slice", F.floor(t / interval)).withColumn("_stretch", F.floor(F.col("_slice") / width)))
    nodes = cut(_successors(firsts.select("key", "_t", "_slice", "_stretch"), interval))

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        """Where the chain from each alert enters another stretch."""
        rows = rows.sort_values("_t", ignore_index=True)
        place, out = {x: i for i, x in enumerate(rows["_t"])}, [None] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            to = rows["_next"][i]
            out[i] = None if pd.isna(to) else out[place[to]] if to in place else to
        return pd.DataFrame({"key": rows["key"], "_t": rows["_t"], "_enters": pd.array(out, "Float64")})

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        """The chain from the stretch's entry."""
        to, now, sent = dict(zip(rows["_t"], rows["_next"], strict=True)), rows["_entry"].iloc[0], []
        while now in to:
            sent.append(now)
            now = to[now]
        return pd.DataFrame({"key": rows["key"].iloc[: len(sent)].to_numpy(), "_t": sent})

    kind = found.schema["key"].dataType.simpleString()
    jumps = nodes.groupBy(*own).applyInPandas(leave, f"key {kind}, _t double, _enters double").where("_enters is not null")
    entries = nodes.groupBy("key").agg(F.min("_t").alias("_t"))
    targets = jumps.select("key", F.col("_enters").alias("_t")).distinct().unionByName(entries)
    jumps = cut(jumps.join(targets.distinct(), ["key", "_t"], "left_semi"))
    levels = []
    while not jumps.isEmpty():
        levels.append(jumps)
        further = jumps.select("key", F.col("_t").alias("_enters"), F.col("_enters").alias("_on"))
        jumps = cut(jumps.join(further, ["key", "_enters"]).select("key", "_t", F.col("_on").alias("_enters")))
    for level in reversed(levels):
        entries = cut(entries.unionByName(entries.join(level, ["key", "_t"]).select("key", F.col("_enters").alias("_t"))))
    entries = entries.join(nodes, ["key", "_t"]).groupBy(*own).agg(F.min("_t").alias("_entry"))
    sent = nodes.join(entries, own).groupBy(*own).applyInPandas(follow, f"key {kind}, _t double")
    return firsts.join(sent, ["key", "_t"], "left_semi").select("_first.*")


def _successors(alerts: DataFrame, interval: float) -> DataFrame:
    """``alerts`` (by key, time, slice and stretch) with ``_next``, the time of the first one at least ``interval`` later."""
    slices = alerts.groupBy("key", "_stretch", "_slice").agg(F.min("_t").alias("_low"))
    stretches = slices.groupBy("key", "_stretch").agg(F.min("_low").alias("_low"))
    after = stretches.select("key", "_stretch", F.lead("_low").over(W.partitionBy("key").orderBy("_stretch")).alias("_after"))
    later = F.coalesce(F.lead("_low").over(W.partitionBy("key", "_stretch").orderBy("_slice")), F.col("_after"))
    follows = slices.join(after, ["key", "_stretch"]).select("key", "_slice", later.alias("_later"))
    # the alerts of a slice beside those of the slice before that ask for the first one from their time plus the interval on
    here = alerts.select("key", "_slice", F.col("_t").alias("_at"), F.lit(0).alias("_asks"), F.lit(None).cast("double").alias("_t"), F.lit(None).cast("long").alias("_stretch"))
    asking = alerts.select("key", (F.col("_slice") + 1).alias("_slice"), (F.col("_t") + interval).alias("_at"), F.lit(1).alias("_asks"), "_t", "_stretch")
    upwards = W.partitionBy("key", "_slice").orderBy(F.desc("_at"), "_asks").rowsBetween(W.unboundedPreceding, 0)
    near = here.unionByName(asking).withColumn("_near", F.min(F.when(F.col("_asks") == 0, F.col("_at"))).over(upwards)).where("_asks = 1")
    next_slice = follows.select("key", "_slice", F.col("_later").alias("_past_next"), F.lit(True).alias("_is_there"))
    own_slice = follows.select("key", (F.col("_slice") + 1).alias("_slice"), F.col("_later").alias("_past_own"))
    met = near.join(next_slice, ["key", "_slice"], "left").join(own_slice, ["key", "_slice"], "left")
    return met.select("key", "_t", "_stretch", F.coalesce("_near", F.when(F.col("_is_there"), F.col("_past_next")).otherwise(F.col("_past_own"))).alias("_next"))
