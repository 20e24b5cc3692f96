"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one text that a task handles at a time in Python.
CHUNK_BYTES = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: short lineage, survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``. A temporary one is made only where none is set and
    everything runs on this machine; on a cluster, whose executors could not see it, that is refused.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as it takes to clash with none of ``taken``."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def drawn(hashed: Column, rows: int, of: int) -> Column:
    """Whether a row's 64-bit hash falls into the part that holds about ``rows`` of ``of`` rows, however many these are."""
    return F.lit(True) if of <= rows else hashed < F.lit(((rows << 64) // of) - (1 << 63)).cast("long")


def small(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``, which :func:`cut` has made, marked for broadcast if its values take ``most`` bytes or fewer."""
    wide = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, *more = df.agg(F.count("*"), *wide).first()
    return F.broadcast(df) if 16 * rows * len(df.columns) + sum(x or 0 for x in more) <= most else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, then ``forget``, and what was freed goes back to the system.

    Spark keeps a task's process for later ones, and for a while beside stages that need no Python; what its
    allocators hold back meanwhile would count against the executor.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return whole


def give_back() -> None:
    """Hands freed memory to the system: Arrow's, and the C library's where it can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def word_chunks(text: bytes, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists made from about ``size`` bytes each, so a huge text needs little memory."""
    if len(text) <= size:
        yield text.split()
        return
    start = 0
    while start < len(text):
        found = _SPACE.search(text, min(start + size, len(text)))
        end = found.start() if found else len(text)
        yield text[start:end].split()
        start = end


def finite_vectors(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool, dim: int | None = None) -> DataFrame:
    """``(vec_id, x array<double>)``: one row per id whose vector is usable.

    Null ids, null vectors, and vectors with null or non-finite components (or, with ``drop_zero``,
    only zeros) are left out. Vectors of another length than ``dim`` are too; by default ``dim`` is
    the commonest length, ties to the larger. Of repeated ids the smallest vector stays.
    """
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    if drop_zero:
        rows = rows.where(F.exists(x, lambda v: v != 0.0))
    if dim is None:
        first = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = first["n"] if first else 0
    return rows.where(F.size(x) == dim).groupBy("vec_id").agg(F.min("x").alias("x"))
