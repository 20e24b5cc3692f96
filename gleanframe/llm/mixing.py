"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document is shuffled inside its source by a hash and may be served several times (epochs). A
copy's virtual finish time is the source's words served up to and including it, divided by the
source's target. All copies in the order of that time, cut where the running total would pass the
budget, are the mix: at any moment each source has been served in proportion to its target, to
within one document.

No step puts a source into one task. A source's shuffled order is dealt into buckets by the top bits
of the hash; the buckets' totals give each one the words before it; only inside a bucket is there a
running sum. The cut is found alike from totals by slices of virtual time.

Edge cases: null text has size 0; null source is a source of its own, last in order; documents of size
0 are never taken; rows with the same id and text share one place in the order and are taken together; an
empty table gives an empty result; further columns of the input are ignored by ``schedule`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm.common import cut, free, n_words, small

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that a bucket of a source's order holds on average.
BUCKET = 2048


def shuffle_key(id_col: Column, text: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), id_col, text)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from ``(source, source_size, n_docs)``, one row per source.

    Sources in order of code points, null last, have the ``weights`` in turn. Each target is its
    weight's part of ``share`` times all words, but at most ``most`` times the source's words; what is
    above goes to the others by weight, again and again: the water level that solves this is read off
    the sources sorted by capacity for each unit of weight.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("room", most * F.col("source_size"))
    by_room = W.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(0, W.unboundedFollowing)
    budget = share * F.sum("source_size").over(W.partitionBy())
    level = (budget - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    full = F.col("room") < F.col("weight") * F.col("level")
    stop = F.min(F.when(~full, F.struct("rank", "level"))).over(W.partitionBy())
    ranked = weighed.withColumn("rank", F.row_number().over(by_room)).withColumn("level", level).withColumn("stop", stop)
    met = F.col("stop").isNotNull() & (F.col("rank") >= F.col("stop.rank"))
    return ranked.select("source", "source_size", "n_docs", F.when(met, F.col("weight") * F.col("stop.level")).otherwise(F.col("room")).alias("target"))


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = 1.0, most: int = 3, seed: int = 0, bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: ``doc_id, source, key, size, source_size, target, first, every, copies``.

    ``first`` is the first copy's virtual finish time, ``every`` the time between two copies, and
    ``copies`` how many of them the mix takes, at most ``most``.
    """
    light = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), shuffle_key(F.col(id_col), F.col(text_col), seed).alias("key"), n_words(F.col(text_col)).alias("size")
    )
    light = cut(light)
    goal = targets(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, float(most))
    goal = cut(goal.withColumn("bits", F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / bucket)))).cast("int")))

    # the words of a source before each of its buckets
    known = small(goal.select(F.col("source").alias("_s"), "source_size", "target", "bits"))
    top_bits = F.expr("shiftrightunsigned(shiftrightunsigned(key ^ shiftleft(1L, 63), 1), 63 - bits)")
    dealt = light.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("bucket", top_bits)
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("start"))
    starts = small(cut(starts))
    order = W.partitionBy("source", "bucket").orderBy(F.col("key")).rangeBetween(W.unboundedPreceding, W.currentRow)
    served = dealt.withColumn("inside", F.sum("size").over(order)).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    first, every = (F.col("start") + F.col("inside")) / F.col("target"), F.col("source_size") / F.col("target")
    timed = cut(served.select("doc_id", "source", "key", "size", "source_size", "target", F.when(F.col("size") > 0, first).alias("first"), F.when(F.col("size") > 0, every).alias("every")))

    # where in virtual time the running total passes the budget
    last = _cut_time(timed, share, most, bucket)
    epochs = F.sequence(F.lit(0), F.lit(most - 1))
    copies = F.size(F.filter(F.transform(epochs, lambda e: F.col("first") + e * F.col("every")), lambda t: t <= last))
    return timed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))


def _cut_time(timed: DataFrame, share: float, most: int, bucket: int) -> float:
    """The last virtual time up to which all copies fit the budget."""
    copies = timed.where("size > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("first") + e * F.col("every"))).alias("time"), "size")
    whole = timed.agg(F.sum("size").alias("words"), F.count("*").alias("n")).first()
    budget, slices = share * (whole["words"] or 0), max(16, (whole["n"] or 0) // bucket)
    slice_ = F.least(F.floor(F.col("time") * slices), F.lit(1 << 40)).cast("long")
    totals = copies.groupBy(slice_.alias("slice")).agg(F.sum("size").alias("words"), F.max("time").alias("last"))
    up_to = W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = totals.select("slice", "last", F.sum("words").over(up_to).alias("total"))
    edge = cut(sums).agg(
        F.max(F.when(F.col("total") <= budget, F.struct("slice", "total", "last"))).alias("whole"), F.min(F.when(F.col("total") > budget, F.col("slice"))).alias("next")
    ).first()
    base, done = (edge["whole"]["total"], edge["whole"]["last"]) if edge["whole"] else (0, -1.0)
    if edge["next"] is None:
        return float(done)
    inside = copies.where(slice_ == edge["next"]).groupBy("time").agg(F.sum("size").alias("words"))
    fits = inside.select("time", (F.lit(base) + F.sum("words").over(W.orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow))).alias("total"))
    return float(fits.where(F.col("total") <= budget).agg(F.coalesce(F.max("time"), F.lit(float(done)))).first()[0])


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = 1.0, most: int = 3, seed: int = 0, ordered: bool = False,
) -> DataFrame:
    """The mix's rows with the columns of ``docs``, a document as often as it is taken.

    A source's documents up to some place in its shuffled order are taken once more than the rest,
    so one row per source tells what to take, and texts need no shuffle. ``ordered`` adds the column
    ``virtual_time`` and range-sorts the rows by it.
    """
    plan = schedule(docs, id_col, text_col, source_col, weights, share, most, seed)
    own = {c: free(c, docs.columns) for c in ("id", "key", "first", "every", "copies", "source", "low", "high", "last", "taken", "copy")}
    key = shuffle_key(docs[id_col], docs[text_col], seed)
    if ordered:
        plan = plan.where("copies > 0").select(F.col("doc_id").alias(own["id"]), *(F.col(c).alias(own[c]) for c in ("key", "first", "every", "copies"))).dropDuplicates([own["id"], own["key"]])
        rows = docs.join(plan, docs[id_col].eqNullSafe(F.col(own["id"])) & (key == F.col(own["key"])))
        times = F.transform(F.sequence(F.lit(0), F.col(own["copies"]) - 1), lambda e: F.col(own["first"]) + e * F.col(own["every"]))
        return rows.select(*(docs[c] for c in docs.columns), F.explode(times).alias("virtual_time")).orderBy("virtual_time")
    sized = plan.where("size > 0")
    high = sized.groupBy(F.col("source").alias(own["source"])).agg(F.max(F.struct("copies", "key")).alias("top"), F.min("copies").alias(own["low"]))
    high = small(cut(high.select(own["source"], own["low"], F.col("top.copies").alias(own["high"]), F.col("top.key").alias(own["last"]))))
    has_words = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    taken = F.when(~has_words, 0).when(key <= F.col(own["last"]), F.col(own["high"])).otherwise(F.col(own["low"]))
    rows = docs.join(high, docs[source_col].eqNullSafe(F.col(own["source"]))).withColumn(own["taken"], taken).where(F.col(own["taken"]) > 0)
    return rows.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(own["taken"]))).alias(own["copy"])).drop(own["copy"])
