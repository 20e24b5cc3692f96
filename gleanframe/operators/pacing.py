"""Ordered running state by domain: throttling, penalties, concurrency, circuit breakers, bans.

The state of throttles, breakers and bans can be carried over: a key's events are cut into slices of the order
(``SLICE`` numbers each), each slice is summed up, windows over the few sums give what comes before each slice, and only
then are the rows of a slice seen in order. So no task holds all events of a hot domain. ``order`` is a whole number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLICE = 4096


def _sliced(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(order) / width))


def _inside(key: str, order: str, last: int):
    return W.partitionBy(key, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, last)


def _before(key: str):
    return W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def tickets(arrivals: DataFrame, key: str = "domain", order: str = "seq", at: str = "at", delay: str = "delay", width: int = SLICE) -> DataFrame:
    """``start`` of each request: not before it arrives, and each ``delay`` after its predecessor's start.

    With ``c`` the sum of the delays before, ``start = c + max(at - c)`` over all up to the row. A penalty is
    a row whose delay is the penalty.
    """
    summed = _sliced(arrivals, order, width).withColumn("_c", F.coalesce(F.sum(delay).over(_inside(key, order, -1)), F.lit(0.0)))
    totals = summed.groupBy(key, "_slice").agg(F.sum(delay).alias("_delay"), F.max(F.col(at) - F.col("_c")).alias("_late"))
    starts = totals.withColumn("_c0", F.coalesce(F.sum("_delay").over(_before(key)), F.lit(0.0)))
    starts = starts.select(F.col(key), "_slice", "_c0", F.max(F.col("_late") - F.col("_c0")).over(_before(key)).alias("_late0"))
    latest = F.max(F.col(at) - F.col("_c")).over(_inside(key, order, 0))
    met = summed.withColumn("_latest", latest).join(starts, [key, "_slice"])
    found = F.col("_c0") + F.col("_c") + F.greatest(F.col("_late0"), F.col("_latest") - F.col("_c0"))
    return met.withColumn("start", found).select(*arrivals.columns, "start")


def delay(usual: float, crawl_delay: Column, chance: Column | None = None) -> Column:
    """Seconds between two requests to a domain: the usual ones, or its own crawl delay if that is longer.

    ``chance`` (0 to 1, of each request) makes it half to one and a half of that, since an even pace gives a robot away.
    """
    longer = F.greatest(F.lit(float(usual)), F.coalesce(crawl_delay, F.lit(0.0)))
    return longer if chance is None else longer * (0.5 + chance)


def _last_before(rows: DataFrame, value: Column, name: str, key: str, order: str, width: int) -> DataFrame:
    """``rows`` with the last value that is not null of the key's rows before."""
    some = _sliced(rows, order, width).withColumn("_value", value)
    ends = some.groupBy(key, "_slice").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    ends = ends.select(key, "_slice", F.last("_end", ignorenulls=True).over(_before(key)).alias("_carried"))
    near = some.withColumn("_near", F.last("_value", ignorenulls=True).over(_inside(key, order, -1)))
    return near.join(ends, [key, "_slice"]).withColumn(name, F.coalesce("_near", "_carried")).select(*rows.columns, name)


def _streak(rows: DataFrame, fresh: Column, counted: Column, name: str, key: str, order: str, width: int) -> DataFrame:
    """``rows`` with how many were counted since the last fresh one, both ends included."""
    marked = _sliced(rows, order, width).withColumn("_fresh", fresh.cast("int")).withColumn("_counted", counted.cast("int"))
    marked = marked.withColumn("_part", F.coalesce(F.sum("_fresh").over(_inside(key, order, 0)), F.lit(0)))
    parts = marked.groupBy(key, "_slice", "_part").agg(F.sum("_counted").alias("_n"))
    ends = parts.groupBy(key, "_slice").agg(F.max_by("_n", "_part").alias("_tail"), (F.max("_part") > 0).alias("_cut"))
    line = W.partitionBy(key).orderBy("_slice")
    ends = ends.withColumn("_run", F.sum(F.col("_cut").cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("_sum", F.sum("_tail").over(W.partitionBy(key, "_run").orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.select(key, "_slice", F.coalesce(F.lag("_sum").over(line), F.lit(0)).alias("_carried"))
    own = F.sum("_counted").over(W.partitionBy(key, "_slice", "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    met = marked.withColumn("_own", own).join(ends, [key, "_slice"])
    return met.withColumn(name, F.col("_own") + F.when(F.col("_part") == 0, F.col("_carried")).otherwise(0)).select(*rows.columns, name)


def breaker(events: DataFrame, healthy: Column, unhealthy: Column, threshold: int, key: str = "domain", order: str = "seq", width: int = SLICE) -> DataFrame:
    """``failures`` in the running streak and ``trip`` at every ``threshold``-th; a success begins a new streak."""
    trip = unhealthy & (F.col("failures") % threshold == 0) if threshold > 0 else F.lit(False)
    return _streak(events, healthy, unhealthy, "failures", key, order, width).withColumn("trip", trip)


def bans(events: DataFrame, failed: Column, ok: Column, base: float, most: float, key: str = "proxy", order: str = "seq", at: str = "at", width: int = SLICE) -> DataFrame:
    """``ban`` seconds of each failure: ``base`` doubling with each in a row up to ``most``; a success or a quiet time over ``most`` starts anew."""
    known = _last_before(events, F.when(failed, F.col(at)), "_failed_at", key, order, width)
    fresh = ok | (failed & F.coalesce(F.col(at) - F.col("_failed_at") > most, F.lit(False)))
    ban = F.when(failed, F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.col("_nth") - 1)))
    return _streak(known, fresh, failed, "_nth", key, order, width).withColumn("ban", ban).select(*events.columns, "ban")


def attributed_bans(
    events: DataFrame, fault: Column, suspect: Column, ok: Column, suspects: int, base: float, most: float, key: str = "proxy", order: str = "seq", at: str = "at", width: int = SLICE
) -> DataFrame:
    """:func:`bans` where a fault counts at once and a suspect failure only as every ``suspects``-th of its streak.

    A success, or a quiet time over ``most`` between two suspect failures, begins a new streak.
    """
    known = _last_before(events, F.when(suspect, F.col(at)), "_suspect_at", key, order, width)
    fresh = ok | (suspect & F.coalesce(F.col(at) - F.col("_suspect_at") > most, F.lit(False)))
    counted = _streak(known, fresh, suspect, "_nth_suspect", key, order, width)
    failed = counted.withColumn("_failed", fault | (suspect & (F.col("_nth_suspect") % max(suspects, 1) == 0)))
    return bans(failed, F.col("_failed"), ok, base, most, key, order, at, width).select(*events.columns, "ban")


def round_robin(requests: DataFrame, pool: DataFrame, most_uses: int = 0, name: str = "proxy", order: str = "seq", at_least: int = 4096) -> DataFrame:
    """Requests, in order, served by the pool's members in turn; beyond ``most_uses`` of each (0: no limit) ``name`` is null.

    Requests are numbered inside ranges of the order, so no task sees all of them; the pool's members are few
    beside the requests, and Spark picks the join by their size.
    """
    members = pool.select(name).distinct().withColumn("_place", F.row_number().over(W.orderBy(name)) - 1)
    size = members.agg(F.count("*").alias("_size"))
    sliced = requests.withColumn("_slice", F.floor(F.col(order) / at_least))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sliced.groupBy("_slice").agg(F.count("*").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = sliced.join(starts, "_slice").withColumn("_n", F.col("_start") + F.row_number().over(W.partitionBy("_slice").orderBy(order)) - 1)
    dealt = numbered.join(F.broadcast(size)).withColumn("_place", F.when(F.col("_size") > 0, F.col("_n") % F.col("_size")))  # one row
    if most_uses > 0:
        dealt = dealt.withColumn("_place", F.when(F.col("_n") < F.col("_size") * most_uses, F.col("_place")))
    return dealt.join(members, "_place", "left").select(*requests.columns, name)


def account_ready(events: DataFrame, blocked: Column, login_failed: Column, block: float = 1800.0, retry: float = 300.0, key: str = "account", at: str = "at") -> DataFrame:
    """``(account, ready_at)``: when each account may be used again; a block costs ``block`` seconds, a failed login ``retry``."""
    until = F.when(blocked, F.col(at) + block).when(login_failed, F.col(at) + retry).otherwise(F.col(at))
    return events.groupBy(key).agg(F.max(until).alias("ready_at"))


def concurrency(arrivals: DataFrame, slots: int, key: str = "domain", order: str = "seq", at: str = "at", took: str = "took") -> DataFrame:
    """``(key, seq, start)``: greedy start times with ``slots`` places for each key (0: no limit).

    A domain's schedule is sequential; its rows stream through one task in order, which holds ``slots`` end times.
    """
    if slots <= 0:
        return arrivals.select(key, order, F.col(at).cast("double").alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, ends = None, []
        for b in batches:
            starts = []
            for k, t, d in zip(b[key], b[at], b[took], strict=True):
                if k != who:
                    who, ends = k, []
                start = t if len(ends) < slots else max(t, heapq.heappop(ends))
                heapq.heappush(ends, start + d)
                starts.append(start)
            yield pd.DataFrame({key: b[key], order: b[order], "start": starts})

    rows = arrivals.select(key, order, F.col(at).cast("double").alias(at), F.col(took).cast("double").alias(took)).repartition(key).sortWithinPartitions(key, order)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, start double")


def proxy_fault(kind: Column, code: Column) -> Column:
    """``proxy`` for failures to connect (or codes 5, 7, 97), ``suspect`` for other ones, null without a failure."""
    return F.when(kind.isNull(), None).when(kind.startswith("connect") | F.coalesce(code.isin(5, 7, 97), F.lit(False)), "proxy").otherwise("suspect")
