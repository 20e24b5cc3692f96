"""Approximate nearest neighbours with score-aware (anisotropic) product quantisation.

Vectors are centred and cut into pairs of components; each pair has 16 codewords, so a code takes four bits. Codewords
and codes minimise a loss in which the residual's part parallel to the vector weighs more than the
rest, since that part changes large inner products most. A query turns the codewords into tables of inner
products; scanning a block adds table entries (two codes in a byte, so 256 entries a step) and the exact norms
make the sums squared distances. The ``rerank`` best of each block are measured exactly on the original vectors.

Vectors are dealt to cells by nearest centre and packed into blocks of one cell. Each block has codewords of its own, so
a group of near copies is told apart as finely as any other, and a query scans every block. Centres are fitted
on a bounded sample (about ``SAMPLE`` vectors), codewords on at most ``FIT`` vectors of the block; every vector is indexed.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and null ids, take no part,
neither do vectors of another length than the commonest; of repeated ids the smallest vector stays; equal
distances go to the smaller id; a query with fewer candidates gets all; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm.blocks import best, matrix, pack, sample, unpack
from gleanframe.llm.common import cut, finite_vectors, small

SAMPLE = 16_384
BLOCK, QUERY_BLOCK, CELL, FIT = 8192, 256, 2048, 2048
#: The cosine from which scores matter most; it sets how much more the parallel residual weighs.
THRESHOLD = 0.2


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, up to a constant of each row of ``x``."""
    return (y**2).sum(1) - 2 * x @ y.T


def choose_centres(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    centres = x[np.random.default_rng(0).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = apart(x, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(0)
    return centres


class Quantizer:
    """A mean and the codewords of a block's vectors."""

    def __init__(self, mean: np.ndarray, words: np.ndarray, threshold: float = THRESHOLD) -> None:
        self.mean, self.words = mean, words  # words: parts, 16, 2
        self.dim, self.parts = len(mean), len(words)
        self.weight = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2)) - 1

    @classmethod
    def fitted(cls, x: np.ndarray, rounds: int = 6, rows: int = FIT) -> Quantizer:
        random = np.random.default_rng(0)
        if len(x) > rows:
            x = x[random.choice(len(x), rows, replace=False)]
        parts = -(-x.shape[1] // 2)
        parts += parts % 2
        coder = cls(x.mean(0), np.zeros((parts, 16, 2)))
        x = coder.padded(x)
        pairs = x.reshape(len(x), parts, 2)
        coder.words = pairs[random.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
        codes = coder._nearest(x)
        for _ in range(rounds):
            coder._refit(x, codes)
            codes = coder._improve(x, codes)
        return coder

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Centred, with components of zero up to four bits times an even number of parts."""
        return np.pad(x - self.mean, ((0, 0), (0, 2 * self.parts - self.dim)))

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([apart(x[:, 2 * m : 2 * m + 2], self.words[m]).argmin(1) for m in range(self.parts)], 1)

    def _improve(self, x: np.ndarray, codes: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes of less loss, part after part with the others held."""
        norm = np.maximum((x**2).sum(1), 1e-12)
        rows = np.arange(len(x))
        along = [x[:, 2 * m : 2 * m + 2] @ self.words[m].T for m in range(self.parts)]
        lost = norm - sum(along[m][rows, codes[:, m]] for m in range(self.parts))  # the residual's product with x
        for _ in range(passes):
            for m in range(self.parts):
                part = x[:, 2 * m : 2 * m + 2]
                others = lost + along[m][rows, codes[:, m]]
                loss = apart(part, self.words[m]) + self.weight * (others[:, None] - along[m]) ** 2 / norm[:, None]
                codes[:, m] = loss.argmin(1)
                lost = others - along[m][rows, codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords of least loss for the codes, part after part."""
        norm = np.maximum((x**2).sum(1), 1e-12)
        rows = np.arange(len(x))
        lost = norm - sum((x[:, 2 * m : 2 * m + 2] * self.words[m][codes[:, m]]).sum(1) for m in range(self.parts))
        for m in range(self.parts):
            part = x[:, 2 * m : 2 * m + 2]
            others = lost + (part * self.words[m][codes[:, m]]).sum(1)
            weight = self.weight / norm
            for c in np.unique(codes[:, m]):
                i = rows[codes[:, m] == c]
                left = len(i) * np.eye(2) + (part[i] * weight[i, None]).T @ part[i]
                right = (part[i] * (1 + weight[i] * others[i])[:, None]).sum(0)
                self.words[m, c] = np.linalg.solve(left, right)
            lost = others - (part * self.words[m][codes[:, m]]).sum(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes, and the exact squared norms of the centred vectors."""
        x = self.padded(x)
        codes = self._improve(x, self._nearest(x)).astype(np.uint8)
        return codes[:, ::2] << 4 | codes[:, 1::2], (x**2).sum(1)

    def scan(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Minus the approximate squared distance to ``q``, which is centred and padded."""
        table = (q.reshape(self.parts, 1, 2) * self.words).sum(2)
        pairs = (table[::2, :, None] + table[1::2, None, :]).reshape(self.parts // 2, 256)
        total = np.zeros(len(codes))
        for j in range(self.parts // 2):
            total += pairs[j][codes[:, j]]
        return 2 * total - norms - (q**2).sum()


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = 128, rows: int = SAMPLE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, its ``k`` nearest others found.

    ``score`` is the exact Euclidean distance.
    """
    spark = vectors.sparkSession
    whole = cut(finite_vectors(vectors, id_col, vec_col, drop_zero=True))
    n = whole.count()
    learned = sample(whole, rows, n)
    if not len(learned):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = choose_centres(learned, min(1024, max(1, n // CELL)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = apart(matrix(b.column(1)), centres).argmin(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(cell))), b.column(0), b.column(1)], ["key", "at", "vec_id", "x"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, x = unpack(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                coder = Quantizer.fitted(x)
                codes, norms = coder.encode(x)
                made = [pa.array([a.tobytes()]) for a in (codes, norms.astype("<f8"), coder.mean.astype("<f8"), coder.words.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in range(3)), *made], ["block", "ids", "data", "codes", "norms", "mean", "words"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cells = [c[i].as_py() for c in b.columns]
                ids, x = unpack(cells[0], cells[1])
                codes = np.frombuffer(cells[2], "u1").reshape(len(ids), -1)
                norms, mean, words = (np.frombuffer(c, "<f8") for c in cells[3:6])
                coder = Quantizer(mean, words.reshape(-1, 16, 2))
                who, q = unpack(cells[6], cells[7])
                out = []
                for one, row, centred in zip(who.tolist(), q, coder.padded(q), strict=True):
                    score = coder.scan(centred, codes, norms)
                    score[ids == one] = -np.inf
                    near = best(score, ids, rerank)
                    near = near[ids[near] != one]
                    exact = np.sqrt(((x[near] - row) ** 2).sum(1))
                    top = best(-exact, ids[near], k)
                    out.append((np.full(len(top), one), ids[near][top], exact[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    blocks = pack(whole.mapInArrow(placed, "key long, at double, vec_id long, x array<double>"), BLOCK).select(F.col("first").alias("block"), "ids", "data")
    index = cut(blocks.mapInArrow(coded, "block long, ids binary, data binary, codes binary, norms binary, mean binary, words binary"))
    queries = whole.where(F.col("vec_id") % every == 0).select(F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("at"), "vec_id", "x")
    asking = pack(queries, QUERY_BLOCK).select(F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    pairs = asking.crossJoin(small(index.select("block")))  # a stated query set against all blocks; only their numbers travel
    both = pairs.join(index, "block").select("ids", "data", "codes", "norms", "mean", "words", "query_ids", "query_data")
    found = both.mapInArrow(scanned, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
