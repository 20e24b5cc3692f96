"""Exact and Bloom deduplication, and its scopes."""

from __future__ import annotations

import logging
import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, null being a key too. A hot key costs no more than a minimum: no key's rows meet before it."""
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return rows.join(first, rows[key].eqNullSafe(F.col("_key")) & (rows[order] == F.col("_first")), "left_semi")


def admit(requests: DataFrame, seen: DataFrame | None = None, fp: str = "fp", order: str = "seq", bypass: str = "filter_repeat") -> DataFrame:
    """Requests to enqueue: new fingerprints, first wins.

    A request with ``filter_repeat`` false passes and is not recorded; null counts as true. A null fingerprint can't be
    compared, so such requests all pass: nothing is lost.
    """
    checked = F.coalesce(F.col(bypass), F.lit(True)) & F.col(fp).isNotNull()
    fresh = first_wins(requests.where(checked), fp, order)
    if seen is not None:
        fresh = fresh.join(seen.select(fp), fp, "left_anti").select(*requests.columns)
    return fresh.unionByName(requests.where(~checked))


def persist_new(items: DataFrame, written: DataFrame, fp: str = "fp", order: str = "seq") -> DataFrame:
    """Items to write: those with a null fingerprint, and the first of each that ``written`` lacks."""
    some = items.where(F.col(fp).isNotNull())
    return first_wins(some, fp, order).join(written.select(fp), fp, "left_anti").select(*items.columns).unionByName(items.where(F.col(fp).isNull()))


def scope(policy: str, job: str, run_id: str | None) -> str:
    """The namespace of seen fingerprints: ``auto`` is the run if there is one, else the job; so is ``run``, with a warning."""
    if policy not in ("auto", "run", "spider"):
        raise ValueError(f"unknown dedup scope {policy!r}")
    if policy == "run" and not run_id:
        logging.getLogger(__name__).warning("no run id: %s keeps its fingerprints from run to run", job)
    return f"{job}:run:{run_id}" if policy != "spider" and run_id else job


def fill_alert(count: Column, capacity: Column, part: float = 0.8) -> Column:
    """Whether a filter is nearly full; exact ones have a null capacity and never are."""
    return F.coalesce(count >= capacity * part, F.lit(False))


def key_sketch(keys: DataFrame, key: str, run: Column | str, size: int = 12) -> DataFrame:
    """``(run, sketch)``: how many distinct keys each run has, as HyperLogLog sketches of 2 ** ``size`` registers, which can be stored."""
    named = F.lit(run) if isinstance(run, str) else run
    return keys.where(F.col(key).isNotNull()).groupBy(named.alias("run")).agg(F.hll_sketch_agg(F.col(key).cast("string"), F.lit(size)).alias("sketch"))


def fill_from_sketches(sketches: DataFrame, capacity: int, part: float = 0.8) -> DataFrame:
    """One row ``(n, nearly_full)``: distinct keys of all runs together, within 2 % or so at the usual size, without counting any key again."""
    n = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")
    return sketches.agg(F.coalesce(n, F.lit(0)).alias("n")).withColumn("nearly_full", fill_alert(F.col("n"), F.lit(capacity), part))


# --- Bloom filters
#
# All bits of a key lie in one block of ``WORDS`` words of 64 bits, so a probe is one row that meets one row. A filter is a table
# ``(block, words)``, which can be stored, read again, and united with others of the same size.

WORDS = 64
_BLOCK = 64 * WORDS


class Bloom(NamedTuple):
    """A filter's size: ``blocks`` of ``WORDS`` words, and ``hashes`` bits a key."""

    blocks: int
    hashes: int


def bloom_size(capacity: int, error: float) -> Bloom:
    """Each hash halves the error, and half of the bits are set when the filter is full; a fifth more room, as blocks fill unevenly."""
    hashes = max(1, math.ceil(-math.log2(error)))
    return Bloom(max(1, math.ceil(1.2 * max(capacity, 1) * hashes / math.log(2) / _BLOCK)), hashes)


def layers(capacity: int, error: float, most: int = 4) -> list[tuple[int, float]]:
    """Capacity and error of each layer: capacities double, errors halve, so the whole stays under twice the error."""
    return [(capacity * 2**i, error * 0.5 ** (i + 1)) for i in range(most)]


def _block(key: Column, size: Bloom) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(size.blocks))


def _places(key: Column, size: Bloom) -> Column:
    """A key's bits in its block: five places of twelve bits from each 64-bit hash, told apart by a salt."""
    hashes = [F.xxhash64(key, F.lit(salt)) for salt in range(-(-size.hashes // 5))]
    return F.array(*(F.shiftrightunsigned(hashes[i // 5], 12 * (i % 5)).bitwiseAND(_BLOCK - 1).cast("int") for i in range(size.hashes)))


def bloom_build(keys: DataFrame, key: str, size: Bloom) -> DataFrame:
    """``(block, words)``: the filter of the keys; null ones are left out.

    Keys are dealt by block once, a number each; their bits are only spread out behind that exchange, which serves both
    aggregations. A block holds a bounded part of the keys, so a common key costs no more than another.
    """
    text = F.col(key).cast("string")
    dealt = keys.where(F.col(key).isNotNull()).select(_block(text, size).alias("block"), text.alias("key")).distinct().repartition("block")
    bits = dealt.select("block", F.explode(_places(F.col("key"), size)).alias("at"))
    mask = F.expr("shiftleft(1L, at % 64)")
    words = bits.groupBy("block", F.shiftright("at", 6).alias("word")).agg(F.bit_or(mask).alias("bits"))
    return words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_m")).select("block", _dense("_m"))


def _dense(found: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.element_at(F.col(found), i), F.lit(0).cast("long"))).alias("words")


def bloom_union(*filters: DataFrame) -> DataFrame:
    """One filter of all keys of filters of one size: their blocks' bits united, word by word."""
    every = reduce(DataFrame.unionByName, filters)
    return every.groupBy("block").agg(*(F.bit_or(F.col("words")[i]).alias(f"_{i}") for i in range(WORDS))).select("block", F.array(*(f"_{i}" for i in range(WORDS))).alias("words"))


def bloom_hit(key: Column, words: Column, size: Bloom) -> Column:
    """Whether all bits of a key are set in its block; a missing block has none."""
    bit = lambda at: F.call_function("shiftright", F.get(words, F.shiftright(at, 6)), at % 64).bitwiseAND(F.lit(1).cast("long"))
    return F.coalesce(F.forall(_places(key, size), lambda at: bit(at) == 1), F.lit(False))


def bloom_probe(keys: DataFrame, key: str, blocks: DataFrame, size: Bloom) -> DataFrame:
    """``(key, maybe)``: whether each distinct key may be in the filter."""
    asked = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    met = asked.withColumn("block", _block(F.col("key"), size)).join(blocks, "block", "left")
    return met.select("key", bloom_hit(F.col("key"), F.col("words"), size).alias("maybe"))


def bloom_add(rows: DataFrame, key: str, order: str, blocks: DataFrame, size: Bloom) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``fresh``, and the filter that holds their keys too.

    Fresh is the first row of each key that the filter before them lacked; the others are repetitions, inside the batch or
    of what was added before. Rows with a null key are fresh, as nothing can tell them apart.
    """
    firsts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(order).alias("_first"))
    probed = firsts.join(bloom_probe(firsts, "key", blocks, size), "key").where("not maybe").select(F.col("key").alias("_key"), "_first")
    met = rows.join(probed, (rows[key].cast("string") == F.col("_key")) & (rows[order] == F.col("_first")), "left")
    fresh = met.withColumn("fresh", F.col(key).isNull() | F.col("_key").isNotNull()).select(*rows.columns, "fresh")
    return fresh, bloom_union(blocks, bloom_build(rows, key, size))


def admit_by_bloom(requests: DataFrame, blocks: DataFrame, size: Bloom, fp: str = "fp", order: str = "seq", bypass: str = "filter_repeat") -> tuple[DataFrame, DataFrame]:
    """:func:`admit` against a filter in place of a table, and the filter after it. A request may be held back wrongly, with the filter's error."""
    checked = F.coalesce(F.col(bypass), F.lit(True)) & F.col(fp).isNotNull()
    fresh, after = bloom_add(requests.where(checked), fp, order, blocks, size)
    return fresh.where("fresh").drop("fresh").unionByName(requests.where(~checked)), after


class Layer(NamedTuple):
    capacity: int
    size: Bloom
    blocks: DataFrame


def layered_build(keys: DataFrame, key: str, capacity: int, error: float, most: int = 4) -> list[Layer]:
    """A layered filter: the j-th new key goes to the layer that the running count falls into; the last takes the rest.

    Keys are numbered by their hash, in slices of it, so no task sees all of them. More keys than all layers hold raise the
    error of the last one, which is told by a warning.
    """
    distinct = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct().withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(1024)))
    sizes = distinct.groupBy("slice").count()
    before = sizes.select("slice", F.coalesce(F.sum("count").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = distinct.join(before, "slice").withColumn("n", F.col("before") + F.row_number().over(W.partitionBy("slice").orderBy("key")))
    out, start, specs = [], 0, layers(capacity, error, most)
    total, room = sizes.agg(F.sum("count")).first()[0] or 0, sum(n for n, _ in specs)
    if total > room:
        logging.getLogger(__name__).warning("%d keys in a filter for %d: its error is above %g", total, room, 2 * error)
    for i, (n, p) in enumerate(specs):
        part = numbered.where((F.col("n") > start) & (F.lit(True) if i == len(specs) - 1 else F.col("n") <= start + n))
        out.append(Layer(n, bloom_size(n, p), bloom_build(part, "key", bloom_size(n, p))))
        start += n
    return out


def layered_probe(keys: DataFrame, key: str, built: list[Layer]) -> DataFrame:
    """``(key, maybe)``: whether any layer may hold the key. A key meets its block of each layer; one pass over the keys."""
    met = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    for i, layer in enumerate(built):
        blocks = layer.blocks.select(F.col("block").alias(f"_b{i}"), F.col("words").alias(f"_w{i}"))
        met = met.join(blocks, _block(F.col("key"), layer.size) == F.col(f"_b{i}"), "left").withColumn(f"_hit{i}", bloom_hit(F.col("key"), F.col(f"_w{i}"), layer.size)).drop(f"_b{i}", f"_w{i}")
    hit = reduce(lambda a, b: a | b, (F.col(f"_hit{i}") for i in range(len(built))))
    return met.select("key", hit.alias("maybe"))
