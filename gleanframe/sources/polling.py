"""Tasks polled from a database table, as a streaming source with offsets and commits, and runs that end when nothing more comes.

The table has a whole-number key that grows with every task. An offset is the last key taken; tasks read ranges of keys on the
executors, which connect themselves, so no task passes through the driver. A micro-batch that is committed may be marked in the
table, whose rows stay there. After a restart the stream goes on behind the last offset that its checkpoint holds.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType


@dataclass
class Range(InputPartition):
    """Keys above ``low`` up to ``high``."""

    low: int
    high: int


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.options = schema.names, options
        self.table, self.key = options["table"], options.get("key", "id")
        self.rows = int(options.get("rows_per_task", 10_000))
        self.seen = int(options.get("after", 0))

    def _connect(self) -> Any:
        return importlib.import_module(self.options["module"]).connect(**json.loads(self.options["connect"]))

    def _run(self, sql: str, *values: int) -> list[tuple]:
        db = self._connect()
        try:
            cursor = db.cursor()
            cursor.execute(sql.replace("?", self.options.get("mark", "?")), values)
            found = cursor.fetchall() if cursor.description else []
            db.commit()
            return found
        finally:
            db.close()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"key": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = max(self.seen, self._run(f"SELECT coalesce(max({self.key}), 0) FROM {self.table}")[0][0])
        return {"key": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(low, min(low + self.rows, end["key"])) for low in range(start["key"], end["key"], self.rows)]

    def read(self, partition: Range) -> Iterator[tuple]:
        columns = ", ".join(self.names)
        yield from self._run(f"SELECT {columns} FROM {self.table} WHERE {self.key} > ? AND {self.key} <= ? ORDER BY {self.key}", partition.low, partition.high)

    def commit(self, end: dict) -> None:
        if "on_commit" in self.options:
            self._run(self.options["on_commit"], end["key"])


class TaskTable(DataSource):
    """Options: ``module`` (a DB-API module) and ``connect`` (its arguments as JSON), ``table``, ``key``; ``after`` (a key to begin behind),
    ``rows_per_task``, ``mark`` (how the module writes a value's place), ``on_commit`` (a statement that gets the last key)."""

    @classmethod
    def name(cls) -> str:
        return "task_table"

    def schema(self) -> str:
        raise ValueError("name the columns to read with .schema(...)")

    def streamReader(self, schema: StructType) -> _Reader:  # noqa: N802
        return _Reader(schema, dict(self.options))


def task_table(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """A stream of a task table's rows."""
    spark.dataSource.register(TaskTable)
    return spark.readStream.format("task_table").schema(schema).options(**options).load()


def run_until_exhausted(writer: DataStreamWriter, every: float, empty_polls: int = 3) -> StreamingQuery:
    """The query, polling ``every`` seconds; it ends after so many polls in a row that found nothing (0: never, it is the caller's to stop).

    A poll counts as empty once the trigger is over and no micro-batch came of it, so slow batches are waited for.
    """
    query = writer.trigger(processingTime=f"{round(every * 1000)} milliseconds").start()
    if empty_polls <= 0:
        return query
    empty, last = 0, None
    while query.isActive and empty < empty_polls:
        time.sleep(every)
        progress, status = query.lastProgress, query.status
        done = progress.batchId if progress is not None and progress.numInputRows else last
        waits = status["isTriggerActive"] or status["isDataAvailable"] or status["message"].startswith("Initializing")
        empty = 0 if done != last or waits else empty + 1
        last = done
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return query
