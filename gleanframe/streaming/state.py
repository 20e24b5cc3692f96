"""Operators with state of their own on streams: leases with timers, running state by domain, a shared layered Bloom filter.

Each is one processor whose state Spark keeps by key, checkpoints with the stream's offsets and moves with the key's partition, so
a restart goes on where the last finished micro-batch left off. What a key holds is bounded and does not grow with
the stream. Rows of a micro-batch are taken in their order inside a key. State needs the RocksDB provider (:func:`stateful`).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanframe.operators.dedup import layers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stateful(spark: SparkSession) -> SparkSession:
    """The session with a state store that the operators here can use, unless it names another one itself."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch in order; how many these are is bounded by the source's rate limit."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


# --- leases


class _Leases(StatefulProcessor):
    """State of a task: when its lease ends. A timer stands at that time."""

    def __init__(self, key: str, lease: float, event_time: bool) -> None:
        self.key, self.lease, self.event_time = key, round(lease * 1000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def _move(self, until: int | None) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        if until is None:
            self.until.clear()
        else:
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        until = self.until.get()[0] if self.until.exists() else None
        for kind, ms in _in_order(rows, "ms", "place")[["kind", "ms"]].itertuples(index=False):
            at = int(ms) if self.event_time else max(now, int(ms))
            if kind == "claim":
                until = at + self.lease
            elif kind == "beat" and until is not None and until > at:
                until = max(until, at + self.lease)
            elif kind == "ack":
                until = None
        self._move(until)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] <= ended:
            self.until.clear()
            yield pd.DataFrame({self.key: [key[0]], "lease_until": [pd.Timestamp(ended, unit="ms", tz="UTC")], "priority": [0]})


def leases(log: DataFrame, lease: float, key: str = "task_uid", kind: str = "kind", at: str = "ts", late: str | None = None) -> DataFrame:
    """``(key, lease_until, priority)`` of the tasks whose lease has run out, once each, to be queued again before all others.

    ``log`` tells what happens to tasks: ``claim`` starts a lease, ``beat`` extends one that has not ended (never shortens it),
    ``ack`` ends the task. By default leases end by the clock of the machines; with ``late``, by ``at``, once rows are
    that far past it, so that the outcome does not depend on when the stream runs.
    """
    rows = log if late is None else log.withWatermark(at, late)
    place = F.array_position(F.array(*map(F.lit, ("claim", "beat", "ack"))), F.col(kind)).alias("place")  # in this order at one time
    slim = rows.select(F.col(key), F.col(kind).alias("kind"), F.unix_millis(F.col(at)).alias("ms"), place, *([F.col(at).alias("at")] if late else []))
    kind_of = log.schema[key].dataType.simpleString()
    out = f"{key} {kind_of}, lease_until timestamp, priority int"
    mode = "ProcessingTime" if late is None else "EventTime"
    stateful(log.sparkSession)
    return slim.groupBy(key).transformWithStateInPandas(_Leases(key, lease, late is not None), out, "Append", mode)


# --- running state by domain

PACED = "start double, failures long, trip boolean, ban double"
#: What a domain's state holds, and what a first batch can hand over.
PACE_STATE = "next double, failures long, nth long, failed_at double"


class _Pace(StatefulProcessor):
    """State of a domain: the next free ticket, the running streak, and the streak and time of the last failures that ban."""

    def __init__(self, key: str, names: list[str], threshold: int, base: float, most: float) -> None:
        self.key, self.names, self.threshold, self.base, self.most = key, names, threshold, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pace", PACE_STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        given = lambda name, kind: None if pd.isna(row[name]) else kind(row[name])
        self.state.update((given("next", float), given("failures", int) or 0, given("nth", int) or 0, given("failed_at", float)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        free, failures, nth, failed_at = self.state.get() if self.state.exists() else (None, 0, 0, None)
        batch, out = _in_order(rows, "seq"), []
        for at, delay, failed, ok in batch[["at", "delay", "failed", "ok"]].itertuples(index=False):
            start = at if free is None else max(at, free)
            free = start + delay
            failures = 0 if ok else failures
            quiet = failed and failed_at is not None and at - failed_at > self.most
            nth = 0 if ok or quiet else nth
            if failed:
                failures, nth, failed_at = failures + 1, nth + 1, at
            trip = bool(failed and self.threshold > 0 and failures % self.threshold == 0)
            out.append((start, failures, trip, min(self.most, self.base * 2.0 ** (nth - 1)) if failed else None))
        self.state.update((free, failures, nth, failed_at))
        found = pd.DataFrame(out, columns=["start", "failures", "trip", "ban"])
        found["ban"] = found["ban"].astype("float64")
        yield pd.concat([batch[self.names], found], axis=1)


def paced(
    events: DataFrame, failed: Column, ok: Column, threshold: int, base: float, most: float, key: str = "domain", order: str = "seq", at: str = "at", delay: str = "delay", initial: DataFrame | None = None
) -> DataFrame:
    """Each event with its ticket's ``start``, the ``failures`` in the streak, whether the breaker ``trip``s, and ``ban`` seconds.

    What :mod:`operators.pacing` finds for a whole log (``tickets``, ``breaker``, ``bans``), this finds as the log comes. ``initial`` is
    the state to begin with (:func:`pace_state` makes it from a log), so a stream takes over where a batch ended.
    """
    slim = events.select(F.col(key), F.col(order).alias("seq"), F.col(at).cast("double").alias("at"), F.col(delay).cast("double").alias("delay"), failed.alias("failed"), ok.alias("ok"))
    names = [key, "seq", "at"]
    out = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names) + ", " + PACED
    stateful(events.sparkSession)
    first = None if initial is None else initial.groupBy(key)
    return slim.groupBy(key).transformWithStateInPandas(_Pace(key, names, threshold, base, most), out, "Append", "None", initialState=first)


def pace_state(tickets: DataFrame, streaks: DataFrame, bans: DataFrame, ok: Column, base: float, key: str = "domain", order: str = "seq", at: str = "at", delay: str = "delay") -> DataFrame:
    """The state at the end of a log, by domain, from what ``pacing.tickets``, ``breaker`` and ``bans`` found for it.

    The number of the last failure in its streak comes back from its ban, so it is known up to the number at which bans stop to grow,
    which is all that later bans depend on; a success since then begins anew.
    """
    ends = tickets.groupBy(key).agg(F.max_by(F.col("start") + F.col(delay), order).alias("next"))
    runs = streaks.groupBy(key).agg(F.max_by("failures", order).alias("failures"))
    ban = bans.groupBy(key).agg(
        F.max_by(F.struct(F.col(at).alias("at"), F.col("ban").alias("ban"), F.col(order).alias("seq")), F.when(F.col("ban").isNotNull(), F.col(order))).alias("f"),
        F.max(F.when(ok, F.col(order))).alias("ok"),
    )
    nth = F.when(F.col("ok") > F.col("f.seq"), 0).otherwise(F.round(F.log2(F.col("f.ban") / base)) + 1)
    ban = ban.select(key, F.coalesce(nth, F.lit(0)).cast("long").alias("nth"), F.col("f.at").cast("double").alias("failed_at"))
    return ends.join(runs, key).join(ban, key).select(key, F.col("next").cast("double"), F.col("failures").cast("long"), "nth", "failed_at")


# --- a layered Bloom filter that all nodes share


class _Bloom(StatefulProcessor):
    """State of a bucket of keys: layers of bits, opened one after the other, and how many keys each has taken."""

    def __init__(self, capacity: int, error: float, most: int) -> None:
        self.layers = [(n, max(1, math.ceil(-math.log2(p))), max(64, math.ceil(n * -math.log(p) / math.log(2) ** 2))) for n, p in layers(capacity, error, most)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bloom", "counts array<long>, bits array<binary>")

    @staticmethod
    def _places(key: np.uint64, hashes: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = np.uint64(key) + np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts, held = self.state.get() if self.state.exists() else ([0], [bytes(-(-self.layers[0][2] // 8))])
        counts, held = list(counts), [np.frombuffer(h, np.uint8).copy() for h in held]
        batch = _in_order(rows, "seq")
        fresh = []
        for h in batch["hash"].to_numpy(np.int64).view(np.uint64):
            known = False
            for (_, hashes, bits), block in zip(self.layers, held, strict=False):
                at = self._places(h, hashes, bits)
                if (block[at >> 3] >> (at & 7).astype(np.uint8) & 1).all():
                    known = True
                    break
            fresh.append(not known)
            if not known:
                if counts[-1] >= self.layers[len(counts) - 1][0] and len(counts) < len(self.layers):
                    counts.append(0)
                    held.append(np.zeros(-(-self.layers[len(counts) - 1][2] // 8), np.uint8))
                _, hashes, bits = self.layers[len(counts) - 1]
                at = self._places(h, hashes, bits)
                np.bitwise_or.at(held[-1], at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
                counts[-1] += 1
        full = len(counts) == len(self.layers) and counts[-1] > self.layers[-1][0]
        if full:
            logging.getLogger(__name__).warning("bucket %s of the filter holds %d keys over its capacity: its error grows", key[0], counts[-1] - self.layers[-1][0])
        self.state.update((counts, [h.tobytes() for h in held]))
        yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "fresh": fresh, "full": full})


def seen_by_bloom(requests: DataFrame, capacity: int, error: float, key: str = "fp", order: str = "seq", buckets: int = 64, most: int = 4) -> DataFrame:
    """``(key, seq, fresh, full)`` of each request with a key: whether the filter lacked it, and whether its bucket is over capacity.

    Keys are dealt by hash into ``buckets``, each with a filter of its own whose layers open as its count grows, so the state is
    as large as the capacity asks for and no larger, whatever comes. No key is ever fresh twice; a new one is taken for known with less
    than twice ``error``, until a bucket is full. Keys that are repeated more often than others only cost their rows.
    """
    hashed = F.xxhash64(F.col(key).cast("string"))
    slim = requests.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(1)), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), hashed.alias("hash"))
    stateful(requests.sparkSession)
    each = max(1, math.ceil(1.1 * capacity / buckets / (2**most - 1)))
    return slim.groupBy("bucket").transformWithStateInPandas(_Bloom(each, error, most), "key string, seq long, fresh boolean, full boolean", "Append", "None")
