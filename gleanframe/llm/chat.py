"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Each turn gets a rolling hash of all turns up to
it (a running sum of hashes of place, role and text). A conversation whose last hash is another one's
hash at the same place, with more turns to come, is a snapshot and goes in an anti-join; of equal
conversations the one with the smallest id stays. Those left are rendered turn by turn with a template.

A long conversation is never gathered into one task: turns are numbered inside slices of the turn
number, and a rendered conversation comes in parts of at most ``PART`` turns.

Edge cases: null role or text counts as empty; roles are trimmed and lower-cased, texts trimmed; turns come in
the order of turn (null last), role, text; a repeated row counts once; rows with a null conversation id are left out;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm.common import cut

#: Turns that one row of a rendered conversation holds at most.
PART = 1024
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def rolling(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """``(conv_id, place, n_turns, role, text, high, low, chars)``: each turn's place and the hash of the turns up to it."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.lower(clean(role_col)).alias("role"), clean(text_col).alias("text")
    )
    rows = rows.distinct().withColumn("slice", F.coalesce(F.floor(F.col("turn") / part), F.lit((1 << 62) - 1)))
    inside = W.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.withColumn("in_slice", F.row_number().over(inside))
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = cut(rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n")))
    slices = slices.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n_turns", F.sum("n").over(W.partitionBy("conv_id"))).drop("n")
    placed = placed.join(slices, ["conv_id", "slice"]).withColumn("place", F.col("start") + F.col("in_slice"))
    hashed = placed.withColumn("hash", F.xxhash64("place", "role", "text"))
    marks = {"high": F.shiftright("hash", 32), "low": F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)), "chars": F.length("role") + F.length("text")}
    hashed = hashed.select("conv_id", "slice", "place", "n_turns", "role", "text", *(c.cast("long").alias(k) for k, c in marks.items()))
    sums = hashed.groupBy("conv_id", "slice").agg(*(F.sum(k).alias(f"_{k}") for k in marks))
    sums = sums.select("conv_id", "slice", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in marks))
    upto = W.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = hashed.select("conv_id", "slice", "place", "n_turns", "role", "text", *(F.sum(k).over(upto).alias(k) for k in marks)).join(sums, ["conv_id", "slice"])
    return running.select("conv_id", "place", "n_turns", "role", "text", *((F.col(k) + F.col(f"_{k}")).alias(k) for k in marks))


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations that no other one continues, one of each set of equal ones."""
    mark = ["place", "high", "low", "chars"]
    whole = rolled.where("place = n_turns").groupBy(*mark).agg(F.min("conv_id").alias("conv_id"))
    begun = rolled.where("place < n_turns").select(*mark).distinct()
    return whole.join(begun, mark, "left_anti").select("conv_id")


def render(turns: DataFrame, template: str = TEMPLATE, part: int = PART, **columns: str) -> DataFrame:
    """``(conv_id, part, n_turns, rendered)``: the maximal conversations, as text in parts of ``part`` turns."""
    rolled = cut(rolling(turns, part=part, **columns))
    kept = rolled.join(maximal(rolled), "conv_id", "left_semi")
    head, middle, tail = template.replace("{text}", "{role}").split("{role}")
    segment = F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(tail))
    cells = kept.groupBy("conv_id", F.floor((F.col("place") - 1) / part).alias("part"), "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", segment.alias("segment")))).alias("cells"))
    return cells.select("conv_id", "part", "n_turns", F.array_join(F.transform("cells", lambda c: c["segment"]), "").alias("rendered"))
