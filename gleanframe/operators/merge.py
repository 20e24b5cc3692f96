"""Tables in buckets of their key, merged bucket by bucket: a delta rewrites only the buckets it touches.

A table is a Parquet folder with a subfolder for each bucket of its key's hash. A merge reads the buckets that the delta has
keys in, applies one of the policies of :mod:`operators.tables` to these, and overwrites just them. The new rows are computed
and kept before anything is overwritten, so a job that fails on the way leaves the table as it was; a failure while
files are moved can leave some buckets new and others old, and merging the same delta again mends that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.lineage import cut
from gleanframe.operators import tables

BUCKET = "_bucket"


class Bucketed(NamedTuple):
    """A table's place, its key, and its number of buckets, which stays as it is."""

    folder: str
    keys: tuple[str, ...]
    buckets: int


def _bucket(at: Bucketed) -> Column:
    return F.pmod(F.xxhash64(*at.keys), F.lit(at.buckets)).cast("int")


def create(rows: DataFrame, at: Bucketed) -> None:
    """The table's first rows, of any number; the folder must not exist yet. Each bucket is one file."""
    rows.withColumn(BUCKET, _bucket(at)).repartition(at.buckets, BUCKET).write.partitionBy(BUCKET).parquet(at.folder)


def read(spark: SparkSession, at: Bucketed) -> DataFrame:
    return spark.read.parquet(at.folder).drop(BUCKET)


def merge(delta: DataFrame, at: Bucketed, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """``change(base, delta)`` on the buckets that the delta has keys in, which are overwritten and whose numbers come back."""
    spark = delta.sparkSession
    whole = spark.read.parquet(at.folder)
    kinds = {f.name: f.dataType for f in whole.schema.fields}
    # a hash tells types apart, so keys take the table's
    delta = delta.withColumns({k: F.col(k).cast(kinds[k]) for k in at.keys})
    touched = sorted(r[0] for r in delta.select(_bucket(at)).distinct().collect())  # at most as many as there are buckets
    if touched:
        after = change(whole.where(F.col(BUCKET).isin(touched)).drop(BUCKET), delta)
        kept = cut(after.withColumn(BUCKET, _bucket(at)).repartition(BUCKET))
        kept.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(at.folder)
    return touched


def insert(delta: DataFrame, at: Bucketed, seq: str, policy: str = "nothing") -> list[int]:
    return merge(delta, at, lambda base, new: tables.insert(base, new, at.keys, seq, policy))


def update(delta: DataFrame, at: Bucketed, seq: str) -> list[int]:
    return merge(delta, at, lambda base, new: tables.keyed_update(base, new, at.keys, seq)[0])


def upsert(delta: DataFrame, at: Bucketed, seq: str) -> list[int]:
    """Rows with a null key are refused, as in :func:`tables.upsert`."""
    keys: Sequence[str] = at.keys
    return merge(delta.dropna(subset=list(keys)), at, lambda base, new: tables.upsert(base, new, keys, seq))
