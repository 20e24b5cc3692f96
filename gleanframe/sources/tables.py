"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.lineage import shared_folder

#: Core columns of the tables that the operators take.
REQUESTS = "seq long, url string, method string, callback string, priority int, retry_times int, filter_repeat boolean, cb_kwargs map<string,string>, requests_kwargs map<string,string>, custom map<string,string>"
RESPONSES = "url string, status_code int, headers map<string,string>, cookies map<string,string>, content binary, encoding string, elapsed double, history array<string>, fetched_at timestamp"
DEAD_LETTER = "table string, data string, update_keys array<string>, pipelines array<string>, reason string"


def seeds(table: DataFrame, url: str = "url", priority: int = 300, order: str | None = None) -> DataFrame:
    """Requests of a seed table; rows without a URL are refused.

    ``seq`` is the whole number ``order`` of the table, so that seeds of one priority are taken first come, first served, in
    every run. A table without such a column has no order; ``seq`` is then the URL's hash, which reruns at least agree on.
    """
    rows = table.where(F.col(url).isNotNull())
    arrival = F.xxhash64(F.col(url)) if order is None else F.col(order).cast("long")
    return rows.select(arrival.alias("seq"), F.col(url).alias("url"), F.lit("GET").alias("method"), F.lit(priority).alias("priority"), F.lit(0).alias("retry_times"), F.lit(True).alias("filter_repeat"))


def seed_once(fresh: DataFrame, frontier: DataFrame, key: str = "fp") -> DataFrame:
    """Seeds that the frontier of the same run lacks, so that seeding twice adds nothing."""
    return fresh.join(frontier.select(key), key, "left_anti")


def stale_seed(age: Column, grace: float, queued: Column, inflight: Column, live: Column) -> Column:
    """Whether a seed lock belongs to a completed job: older than the grace time with nothing queued, in flight or alive."""
    return (age > grace) & (queued == 0) & (inflight == 0) & (live == 0)


def task_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Tasks as a stream of JSON files; with ``Trigger.AvailableNow`` it drains what is there and stops."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; ``partitionColumn`` and its bounds among the options read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def dead_letters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readable dead letters, and the lines that are not."""
    rows = spark.read.schema(DEAD_LETTER + ", _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("table").isNotNull()).drop("_corrupt_record")
    lines = spark.read.text(folder).where(F.trim("value") != "")
    bad = lines.where(F.from_json("value", "table string", {"mode": "PERMISSIVE"})["table"].isNull())
    return good, bad


def failed_requests(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Requests to try again, from a column of JSON objects as failed requests are kept, and the lines that hold none.

    Their fingerprints were recorded when they were first enqueued, so dedup is told to let them pass.
    """
    read = lines.where(F.trim(column) != "").withColumn("_r", F.from_json(column, REQUESTS, {"mode": "PERMISSIVE"}))
    known = F.coalesce(F.col("_r.url").isNotNull(), F.lit(False))
    return read.where(known).select("_r.*").withColumn("filter_repeat", F.lit(False)), read.where(~known).drop("_r")


def append(items: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Rows added to a folder by table: Parquet, JSON or CSV with the declared header."""
    writer = items.write.mode("append").partitionBy("table")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(folder)


def item_schema(spark: SparkSession, lines: DataFrame, column: str = "data") -> str:
    """The schema of a column of JSON objects: the fields that any of them has, in types that hold all their values.

    The objects are kept as text in the shared folder, for Spark's reader to infer it from all of them.
    """
    folder = f"{shared_folder(lines)}/lines-{uuid.uuid4().hex}"
    lines.select(F.col(column).alias("value")).where("value is not null").write.text(folder)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.json(folder).schema.fields)
