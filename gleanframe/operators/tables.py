"""Sinks as table versions: conflict policies, keyed updates, upserts, routing, dead letters, replay."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.identity import item_fingerprint
from gleanframe.operators.dedup import first_wins

#: What tells groups of items apart, as far as a table has it.
GROUP = ("table", "is_update", "update_keys", "pipelines")


def _last(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in others))


def insert(base: DataFrame, delta: DataFrame, keys: Sequence[str], seq: str, policy: str = "nothing") -> DataFrame:
    """The table after inserting ``delta`` (with an order ``seq``): ``nothing`` keeps what is there, ``update`` overwrites, ``error`` refuses."""
    keys = list(keys)
    if policy == "error":
        if not delta.join(base, keys, "left_semi").isEmpty() or not delta.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key is there already")
        return base.unionByName(delta.drop(seq))
    if policy == "nothing":
        first = delta.withColumn("_k", F.struct(*keys))
        fresh = first_wins(first, "_k", seq).drop("_k").join(base, keys, "left_anti")
        return base.unionByName(fresh.select(*base.columns))
    if policy == "update":
        return base.join(delta, keys, "left_anti").select(*base.columns).unionByName(_last(delta, keys, seq).select(*base.columns))
    raise ValueError(f"unknown conflict policy {policy!r}")


def keyed_update(base: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """The table after changes to rows that are there, explicit nulls included, and the changes that matched none."""
    keys = list(keys)
    cells = [c for c in changes.columns if c not in (*keys, seq)]
    if not cells:  # keys only: nothing to set, so nothing is missed
        return base, changes.where(F.lit(False))
    last = _last(changes, keys, seq).select(*keys, *(F.col(c).alias(f"_new_{c}") for c in cells), F.lit(True).alias("_hit"))
    joined = base.join(last, keys, "left")
    out = joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cells else F.col(c) for c in base.columns))
    return out, changes.join(base, keys, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Update of the delta's columns where the key is there, new rows elsewhere; rows with a null key are refused."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    updated, new = keyed_update(base, delta.where(known), keys, seq)
    return updated.unionByName(_last(new, list(keys), seq).drop(seq), allowMissingColumns=True)


def normalise(items: DataFrame, table: str, key: Sequence[str] = (), update_keys: Sequence[str] = (), pipelines: Sequence[str] | None = None, clean: Mapping[str, Column] | None = None) -> DataFrame:
    """Items of one table as rows ``(table, is_update, update_keys, pipelines, fp, data)``, ready to be routed with others.

    ``clean`` gives columns to set first, so that fingerprints tell cleaned items apart; ``data`` is the item as JSON,
    with its nulls. Items with ``update_keys`` are updates. Without ``pipelines`` they go to the default ones.
    """
    ready = items.withColumns(dict(clean or {}))
    names = lambda x: F.lit(None).cast("array<string>") if x is None else F.array(*map(F.lit, x)).cast("array<string>")
    return ready.select(
        F.lit(table).alias("table"), F.lit(bool(update_keys)).alias("is_update"), names(update_keys or None).alias("update_keys"), names(pipelines).alias("pipelines"),
        item_fingerprint(table, ready.columns, key, bool(update_keys)).alias("fp"), F.to_json(F.struct(*ready.columns), {"ignoreNullFields": "false"}).alias("data"),
    )


def _group(rows: DataFrame) -> list[str]:
    return [c for c in GROUP if c in rows.columns]


def route_counts(items: DataFrame) -> DataFrame:
    """How many items each group has."""
    return items.groupBy(*_group(items)).agg(F.count("*").alias("n"))


class Ledger(NamedTuple):
    """Where it is written down which sinks took which groups of a batch, told by its number."""

    folder: str
    epoch: int

    def entries(self, spark: SparkSession) -> set[tuple[str, str]]:
        """The ``(group, sink)`` of this batch: as many rows as groups and sinks, however many items they took."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epoch={self.epoch}")
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return set()
        rows = spark.read.schema("group string, sink string").parquet(f"{self.folder}/epoch={self.epoch}")
        return {(r["group"], r["sink"]) for r in rows.collect()}

    def add(self, spark: SparkSession, group: str, sink: str) -> None:
        spark.createDataFrame([(group, sink)], "group string, sink string").coalesce(1).write.mode("append").parquet(f"{self.folder}/epoch={self.epoch}")


def write_groups(items: DataFrame, sinks: Mapping[str, Callable[[str, bool, DataFrame], bool]], default: Sequence[str] | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Each group goes to its ``pipelines``, or to the default ones (all), until one refuses it; refused rows come back.

    A group is told apart by what it has of ``table``, ``is_update``, ``update_keys`` and ``pipelines``. A sink refuses
    by a false result or an exception, and an unknown one refuses too. Earlier sinks of a refused group keep its rows.
    There are few groups, as of tables, so the driver lists them; the items are kept meanwhile, not computed for each.

    With a ``ledger``, what a sink took is written down after it, and when the batch comes again, as after a failure, sinks that
    took a group are passed over. Only a sink that failed between its write and the entry sees rows twice; one that
    overwrites what it wrote under the batch's number does not mind.
    """
    spark, group = items.sparkSession, _group(items)
    took = ledger.entries(spark) if ledger else set()
    known = F.to_json(F.struct(*group))
    kept = items.persist()
    try:
        groups = [r.asDict() for r in kept.select(*group, known.alias("_known")).distinct().collect()]
        refused = []
        for g in groups:
            rows = kept.where(known == g["_known"])
            for name in g.get("pipelines") or default or sinks:
                if (g["_known"], name) in took:
                    continue
                try:
                    went = sinks[name](g["table"], g.get("is_update", False), rows)
                except Exception:  # noqa: BLE001
                    logging.getLogger(__name__).exception("sink %s failed on %s", name, g["table"])
                    went = False
                if not went:
                    refused.append(g["_known"])
                    break
                if ledger:
                    ledger.add(spark, g["_known"], name)
    finally:
        kept.unpersist()
    return items.where(known.isin(refused) if refused else F.lit(False)).withColumn("reason", F.lit("sink refused"))


def write_again(dead: DataFrame, sinks: Mapping[str, Callable[[str, bool, DataFrame], bool]], default: Sequence[str] | None = None) -> DataFrame:
    """Dead letters written by their groups, updates as updates; those refused again come back."""
    update = F.size(F.coalesce("update_keys", F.array().cast("array<string>"))) > 0
    return write_groups(dead.drop("reason").withColumn("is_update", update), sinks, default).select(*dead.columns)


def replay(dead: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Dead letters left after some groups went through, told apart by table, update keys and pipelines; none is like empty."""
    names = [c for c in ("table", "update_keys", "pipelines") if c in dead.columns and c in succeeded.columns]
    plain = lambda c: F.col(c) if c == "table" else F.coalesce(F.col(c), F.array().cast("array<string>"))
    group = F.to_json(F.struct(*(plain(c).alias(c) for c in names)))
    done = succeeded.select(group.alias("_replayed")).distinct()
    return dead.withColumn("_replayed", group).join(done, "_replayed", "left_anti").drop("_replayed")
