"""Vectors packed into blocks: rows that hold many vectors as bytes, for array arithmetic in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import drawn

BLOCK_SCHEMA = "key long, first long, low double, high double, ids binary, data binary"


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    n = len(column)
    return np.asarray(column.flatten()).astype(dtype, copy=False).reshape(n, -1) if n else np.empty((0, 0), dtype)


def unpack(ids: bytes, data: bytes, dtype: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    where = np.frombuffer(ids, "<i8")
    return where, np.frombuffer(data, dtype).reshape(len(where), -1)


def pack(vectors: DataFrame, rows: int, dtype: str = "<f8") -> DataFrame:
    """Blocks of at most ``rows`` vectors from ``(key, at, vec_id, x)``.

    The vectors are range-sorted by key, ``at`` and id, so that a block has one key and a range of ``at``, and
    a key that holds many rows is dealt to many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, at, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            cells = [[int(key[0])], [int(ids[0])], [float(at.min())], [float(at.max())], [ids.astype("<i8").tobytes()], [x.astype(dtype).tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["key", "first", "low", "high", "ids", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, at, ids = (np.asarray(batch.column(i)) for i in range(3))
            x = matrix(batch.column(3))
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() + [len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[0][0][0] != key[a]:
                    yield flush()
                while a < b:
                    take = min(b, a + rows - sum(len(h[0]) for h in held))
                    held.append((key[a:take], at[a:take], ids[a:take], x[a:take]))
                    a = take
                    if sum(len(h[0]) for h in held) >= rows:
                        yield flush()
        if held:
            yield flush()

    ordered = vectors.select("key", "at", "vec_id", "x").repartitionByRange("key", "at", "vec_id").sortWithinPartitions("key", "at", "vec_id")
    return ordered.mapInArrow(run, BLOCK_SCHEMA)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores, highest first, ties to the smaller id."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def sample(vectors: DataFrame, rows: int, n: int) -> np.ndarray:
    """About ``rows`` vectors of the ``n``, those with the smallest hashes of their ids, so that reruns agree; none only of none."""
    place = F.xxhash64("vec_id", F.lit(7))
    chosen = vectors.where(drawn(place, 2 * rows, n)).orderBy(place, "vec_id").limit(rows).toArrow()
    if n and not chosen.num_rows:
        raise RuntimeError(f"a sample of {n} vectors is empty")
    order = np.argsort(np.asarray(chosen.column("vec_id")))
    return matrix(chosen.column("x").combine_chunks())[order] if chosen.num_rows else np.empty((0, 0))
