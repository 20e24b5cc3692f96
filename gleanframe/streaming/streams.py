"""The same semantics on streams: enqueue with dedup, and durable writes before a batch is acknowledged."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanframe.functions.identity import request_fingerprint
from gleanframe.operators import tables


def enqueue(requests: DataFrame, at: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream of requests with each fingerprint once; with ``at``, fingerprints are forgotten after the time ``late``."""
    rows = requests.withColumn("fp", request_fingerprint(F.lit("GET"), F.col("url")))
    return rows.dropDuplicates(["fp"]) if at is None else rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["fp"])


def durable(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Micro-batches given to ``write``; a batch is acknowledged (checkpointed) only when it has returned.

    The query ends when what is there is drained; with ``every`` (such as ``10 seconds``) it stays and polls for more.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def routed(
    items: DataFrame, sinks: Callable[[int], Mapping[str, Callable[[str, bool, DataFrame], bool]]], dead: Callable[[DataFrame, int], None], ledger: str, checkpoint: str,
    default: Sequence[str] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Items written by their groups (:func:`tables.write_groups`), each micro-batch once to each sink, also when it comes again.

    ``sinks(epoch)`` gives the sinks for a micro-batch, which may write under its number; refused items go to ``dead(rows, epoch)``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        left = tables.write_groups(batch, sinks(epoch), default, tables.Ledger(ledger, epoch))
        if not left.isEmpty():
            dead(left, epoch)

    return durable(items, write, checkpoint, every)


def outcomes_by_window(log: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcomes counted by domain in windows of event time."""
    return log.withWatermark(at, late).groupBy(F.window(at, width), "domain", "outcome").count()
