"""A task table polled by a stream: drained to its end, kept alive, and taken up again."""

from __future__ import annotations

import json
import sqlite3
import threading
import time

import pytest

from gleanframe.sources import polling


@pytest.fixture
def tasks(tmp_path):
    place = str(tmp_path / "tasks.db")
    with sqlite3.connect(place) as db:
        db.execute("CREATE TABLE tasks (id INTEGER PRIMARY KEY AUTOINCREMENT, url TEXT, taken INTEGER DEFAULT 0)")
    return place


def put(place, *urls):
    with sqlite3.connect(place) as db:
        db.executemany("INSERT INTO tasks (url) VALUES (?)", [(u,) for u in urls])


def stream(spark, place, **more):
    return polling.task_table(spark, "id long, url string", module="sqlite3", connect=json.dumps({"database": place}), table="tasks", on_commit="UPDATE tasks SET taken = 1 WHERE id <= ?", rows_per_task="3", **more)


def writer(rows, tmp_path):
    return rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")


def got(spark, tmp_path):
    return sorted(r.url for r in spark.read.schema("id long, url string").parquet(f"{tmp_path}/out").collect())


def test_drains_ends_and_goes_on_behind_the_last_task(spark, tasks, tmp_path):
    put(tasks, *(f"u{i}" for i in range(10)))
    first = polling.run_until_exhausted(writer(stream(spark, tasks), tmp_path), 0.5)
    assert not first.isActive and got(spark, tmp_path) == sorted(f"u{i}" for i in range(10))
    put(tasks, "late1", "late2")
    polling.run_until_exhausted(writer(stream(spark, tasks), tmp_path), 0.5)
    assert got(spark, tmp_path) == sorted([*(f"u{i}" for i in range(10)), "late1", "late2"])
    with sqlite3.connect(tasks) as db:
        assert db.execute("SELECT count(*) FROM tasks WHERE taken = 1 AND id <= 10").fetchone() == (10,)


def test_tasks_that_come_while_polling_keep_it_alive(spark, tasks, tmp_path):
    put(tasks, "a")

    def later():
        for u in "bcd":
            time.sleep(1.5)
            put(tasks, u)

    feeder = threading.Thread(target=later)
    feeder.start()
    polling.run_until_exhausted(writer(stream(spark, tasks), tmp_path), 0.5, empty_polls=8)
    feeder.join()
    assert got(spark, tmp_path) == list("abcd")


def test_without_a_number_of_polls_it_stays(spark, tasks, tmp_path):
    query = polling.run_until_exhausted(writer(stream(spark, tasks, after="1"), tmp_path), 0.3, empty_polls=0)
    try:
        time.sleep(3)
        assert query.isActive
        put(tasks, "a", "b")
        query.processAllAvailable()
        until = time.time() + 30
        while time.time() < until and got(spark, tmp_path) != ["b"]:
            time.sleep(0.5)
        assert got(spark, tmp_path) == ["b"]
    finally:
        query.stop()
