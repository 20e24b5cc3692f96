"""Short lineages for iterated plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Only where everything runs on this machine may a temporary folder take its place.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("spark.checkpoint.dir is not set")
            folder = tempfile.mkdtemp(prefix="lineage-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> str:
    """The name of a table in the shared folder that holds ``df`` in buckets of ``key``, or, if named, has it appended.

    Joins on the key with rows that are dealt into as many partitions move none of the table's rows.
    """
    table = name or f"kept_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    if name is None:
        writer = writer.option("path", f"{shared_folder(df)}/{table}")
    writer.mode("append").saveAsTable(table)
    return table
