"""Vector codes: product quantisation in whole numbers, with grid cells that remember which codewords can be nearest.

A vector's components become whole numbers, and the vector is cut into equal parts. Each part position has a codebook
that starts as the parts of the first vectors and is moved a fixed number of rounds. A round is one pass over all
vectors: tasks assign parts to codewords and sum them up, Spark adds the sums, and only those of the codebooks' size
(parts times codewords) reach the driver.

The nearest codeword is found through a grid. A part's coarse cell is hashed; for each cell seen, a task keeps the
codewords that are not dominated across the cell's box, that is, whose least distance to the box is not above the least of
all greatest distances. Only these are evaluated exactly. A cell whose hash another one has is told apart by its
coordinates and evaluated in full, so the grid never changes a result.

Edge cases: null vectors, those with null or non-finite components and empty ones are left out; so are vectors of
another length than most have (ties to the longer). Null ids are kept, and come last where ids are ordered; repeated rows get a row
each. Fewer vectors than codewords make smaller codebooks; an empty table gives an empty result. Components so
large that squared distances leave 64 bits, and lengths that do not divide into the parts, are errors; a label's sum of errors that
leaves 64 bits is null. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.blocks import matrix
from gleanframe.llm.common import cut, drawn, small, tidy

#: Cells that a task remembers for a part position before it starts anew, and vectors from which the cells' widths are picked.
MEMO_CELLS, TRIAL = 1 << 16, 1024
#: Vectors that a task handles at a time.
ROWS = 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grid:
    """The codewords that can be nearest, by cell of ``1 << shift`` a side; without a ``shift``, one is picked from the first parts seen."""

    def __init__(self, book: np.ndarray, shift: int | None = None, most: int = MEMO_CELLS) -> None:
        self.book, self.shift, self.most, self.evaluated = book, shift, most, 0
        self._forget()

    def _forget(self) -> None:
        self.keys, self.cells, self.sets = np.empty(0, np.uint64), np.empty((0, self.book.shape[1]), np.int64), np.empty((0, len(self.book)), bool)

    def undominated(self, cells: np.ndarray, shift: int) -> np.ndarray:
        """``[cell, codeword]``: whether the codeword can be nearest to some point of the cell's box."""
        low = (cells << shift)[:, None, :]
        high = low + ((1 << shift) - 1)
        least = (np.maximum(np.maximum(low - self.book, self.book - high), 0) ** 2).sum(2)
        most = (np.maximum(self.book - low, high - self.book) ** 2).sum(2)
        return least <= most.min(1)[:, None]

    def pick(self, parts: np.ndarray) -> int:
        """The width with the least work on these parts: codewords evaluated, and twice all of them for each cell."""
        top = int(np.abs(parts).max(initial=0)).bit_length() + 1

        def cost(shift: int) -> int:
            cells = parts >> shift
            _, first, n = np.unique(self._hash(cells), return_index=True, return_counts=True)
            if 2 * len(first) > len(parts) and shift < top:  # most parts are alone in their cells
                return 3 * len(self.book) * len(parts)
            return int(self.undominated(cells[first], shift).sum(1) @ n) + 2 * len(self.book) * len(first)

        return min(range(top, -1, -1), key=cost)

    def _hash(self, cells: np.ndarray) -> np.ndarray:
        h = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            h = (h ^ column.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """``[part, codeword]``: the remembered set of each part's cell."""
        if self.shift is None:
            self.shift = self.pick(parts[:TRIAL])
        cells = parts >> self.shift
        seen, first, back = np.unique(self._hash(cells), return_index=True, return_inverse=True)
        new = ~np.isin(seen, self.keys, assume_unique=True)
        if len(self.keys) + new.sum() > self.most:
            self._forget()
            new[:] = True
        if new.any():
            fresh = cells[first[new]]
            keys = np.concatenate([self.keys, seen[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.cells = np.concatenate([self.cells, fresh])[order]
            self.sets = np.concatenate([self.sets, self.undominated(fresh, self.shift)])[order]
        at = np.searchsorted(self.keys, seen)[back]
        return self.sets[at] | (self.cells[at] != cells).any(1)[:, None]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest codeword, ties to the lower index."""
        may = self.candidates(parts)
        self.evaluated += int(may.sum())
        best, at = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
        for j, word in enumerate(self.book):
            rows = np.flatnonzero(may[:, j])
            d = ((parts[rows] - word) ** 2).sum(1)
            closer = d < best[rows]
            rows, d = rows[closer], d[closer]
            best[rows], at[rows] = d, j
        return at, best


def _chunks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``ROWS`` rows and their vectors as ``[row, part, component]``; the vector is the last column."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            yield batch, matrix(batch.column(batch.num_columns - 1), np.int64).reshape(batch.num_rows, parts, -1)


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """``(vec_id, label, x array<int>)`` of the usable vectors, ``x`` being ``floor(scale * component)``; null where that is no int."""
    x = F.col("x")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("x"))
    usable = rows.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return usable.withColumn("x", F.transform(x, lambda v: F.floor(v * float(scale)).try_cast("int")))


def trial(rows: DataFrame, parts: int, of: int) -> np.ndarray:
    """At most ``TRIAL`` of the vectors, as ``[row, part, component]``: those with the smallest hashes of their ids."""
    place = F.xxhash64("vec_id", F.lit(9))
    some = rows.where(drawn(place, 2 * TRIAL, of)).orderBy(place, "vec_id", "x").select("x").limit(TRIAL).toArrow()
    return matrix(some.column("x").combine_chunks(), np.int64).reshape(some.num_rows, parts, -1)


def widths(books: np.ndarray, some: np.ndarray) -> list[int]:
    """The cells' width for each part position, picked once for all tasks; it only decides how much is evaluated."""
    return [Grid(b).pick(some[:, p]) for p, b in enumerate(books)]


def _train(rows: DataFrame, books: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The codebooks ``[part, codeword, component]`` after one round; codewords that no part is nearest to stay."""
    parts, words, width = books.shape
    shifts = widths(books, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, s) for b, s in zip(books, shifts, strict=True)]
        sums, n = np.zeros(books.shape, np.int64), np.zeros((parts, words), np.int64)
        for _, x in _chunks(batches, parts):
            for p, grid in enumerate(grids):
                at, _ = grid.nearest(x[:, p])
                np.add.at(sums[p], at, x[:, p])
                n[p] += np.bincount(at, minlength=words)
        if n.any():
            cells = [np.repeat(np.arange(parts * words), width), np.tile(np.arange(width), parts * words), np.repeat(n.ravel(), width), sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["word", "place", "n", "total"])

    summed = rows.select("x").mapInArrow(tidy(run), "word long, place long, n long, total long").groupBy("word", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = books.copy().reshape(-1, width)
    for r in summed.collect():  # as many rows as the codebooks have numbers
        if r["n"]:
            moved[r["word"], r["place"]] = r["total"] // r["n"]
    return moved.reshape(books.shape)


def learn(rows: DataFrame, some: np.ndarray, parts: int = 8, words: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks of :func:`whole_vectors`, which all have one length: first vectors' parts, moved ``rounds`` times; ``some`` are for :func:`widths`."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(words).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _train(rows, books, some)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, some: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)``: a byte for each part's codeword, and the squared distances summed over the parts."""
    parts, shifts = len(books), widths(books, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, s) for b, s in zip(books, shifts, strict=True)]
        for batch, x in _chunks(batches, parts):
            found = [grid.nearest(x[:, p]) for p, grid in enumerate(grids)]
            code = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"vec_id long, label {label}, code binary, error long")


def decode(coded: DataFrame, books: np.ndarray, scale: int = 4096, code_col: str = "code") -> DataFrame:
    """``coded`` with ``x``, the vector that the code stands for: the middles of the whole numbers' steps."""
    table = F.array(*(F.array(*(F.array(*(F.lit((int(v) + 0.5) / scale) for v in word)) for word in book)) for book in books))
    places = F.sequence(F.lit(0), F.lit(len(books) - 1))
    byte = lambda i: F.conv(F.hex(F.substring(F.col(code_col), i + 1, F.lit(1))), 16, 10).cast("int")
    return coded.withColumn("x", F.flatten(F.transform(places, lambda i: F.get(F.get(table, i), byte(i)))))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, words: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error, label_error)`` of each usable vector, and the codebooks.

    ``label_error`` is the error summed over all vectors with an equal label, nulls together. It is summed before it is joined
    back, so a label that very many vectors have costs no more than others.
    """
    if not 1 <= words <= 256:
        raise ValueError("a code has one byte for each part")
    usable = cut(whole_vectors(vectors, id_col, vec_col, label_col, scale))
    x = F.col("x")
    lengths = usable.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(x)).alias("high"), F.min(F.array_min(x)).alias("low"), F.bool_or(F.exists(x, lambda v: v.isNull())).alias("odd"))
    most = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if most is None:
        nothing = usable.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return nothing, np.empty((parts, 0, 0), np.int64)
    if most["n"] % parts:
        raise ValueError(f"vectors of {most['n']} components cannot be cut into {parts} equal parts")
    if most["odd"] or most["n"] * (2 * max(most["high"], -most["low"]) + 2) ** 2 >= 1 << 63:
        raise ValueError("components are too large for squared distances of 64 bits")
    rows = usable.where(F.size(x) == most["n"])
    some = trial(rows, parts, most["rows"])
    books = learn(rows, some, parts, words, rounds)
    coded = cut(encode(rows, books, some))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(small(cut(by_label)), coded["label"].eqNullSafe(F.col("of")), "left").drop("of"), books
