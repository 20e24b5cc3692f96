"""Exact top-k inner products with a pivot-distance index.

One more component makes all vectors equally long, ``sqrt(M - |x|^2)`` with M the greatest squared length, so the
highest inner products are the smallest distances. Vectors are keyed by their nearest pivot and the distance to it,
sorted, and packed into blocks; a block is a run of annuli, ranges of that distance around one pivot. Each annulus knows
the least and greatest distance of its vectors to every pivot, and their greatest length. A query first scans
the block that is nearest by these bounds; the k-th score found bounds its radius. After that a query is sent
only to blocks with an annulus that the triangle inequality (around any pivot) and the lengths do not put beyond
its radius, and in a block it takes the annuli from near to far, its radius shrinking, and stops at the first
bound that is beyond it. Each query has its own list of blocks: queries travel together, but only those that need a block.

Pivots are chosen on a bounded sample; every vector is indexed, and results are exact whatever the pivots. Products
are taken in doubles where these are exact, else in 64-bit integers, else in unbounded ones; a score that does not
fit a long is an error.

Edge cases: components become ``floor(1024 * x)``; vectors that are null or hold null or non-finite components, and
null ids, take no part, neither do vectors of another length than the commonest; of repeated ids the smallest
vector stays; ties go to the smaller id; a query with fewer candidates gets all; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm.blocks import matrix, pack, sample
from gleanframe.llm.common import cut, finite_vectors

SAMPLE, PIVOTS = 8192, 32
#: Vectors of a block and of an annulus, queries that travel together, and blocks whose bounds do.
BLOCK, ANNULUS, QUERY_BLOCK, BOUNDS = 4096, 128, 2048, 256
#: Part of the greatest length that covers the rounding of distances.
SLACK = 1e-7


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x`` far from each other: each next one is farthest from those chosen."""
    chosen = [0]
    apart = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class Space:
    """Distances between lengthened vectors and pivots."""

    def __init__(self, pivots: np.ndarray, greatest: float) -> None:
        self.greatest = greatest
        self.pivots = self.lengthened(pivots)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.greatest - (x**2).sum(1)))[:, None]], 1)

    def to_pivots(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        long = np.concatenate([x, np.zeros((len(x), 1))], 1) if query else self.lengthened(x)
        square = (long**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * long @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square))

    def beyond(self, apart: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least possible distance of each query (its distances to the pivots) to each annulus (its bounds by pivot)."""
        out = np.zeros((len(apart), len(low)))
        for p in range(apart.shape[1]):
            own = apart[:, p : p + 1]
            np.maximum(out, np.maximum(low[:, p] - own, own - high[:, p]), out=out)
        return out

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a score lies, for queries of a squared length, and what rounding may add."""
        return np.sqrt(np.maximum(0.0, square + self.greatest - 2.0 * score)) + SLACK * np.sqrt(square + self.greatest)


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, x)``: usable vectors as whole numbers, kept as doubles, which hold them exactly."""
    some = finite_vectors(vectors, id_col, vec_col, drop_zero=False)
    # from 2^52 on every double is whole
    floor = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale)
    return some.select("vec_id", F.transform("x", floor).alias("x"))


def product(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers."""
    most = largest**2 * x.shape[1]
    if most < 2.0**52:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    found = whole(q) @ whole(x).T
    if found.size and max(abs(v) for v in found.ravel()) >= 1 << 63:
        raise ValueError("a score does not fit a 64-bit integer")
    return found.astype(np.int64)


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS,
    block: int = BLOCK, annulus: int = ANNULUS, queries: int = QUERY_BLOCK, counted: bool = False,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, the ``k`` others of highest integer inner product.

    ``counted`` adds ``scanned``, the number of vectors that the query was multiplied with.
    """
    spark = vectors.sparkSession
    whole = cut(integers(vectors, id_col, vec_col))
    length = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
    facts = whole.agg(F.count("*").alias("n"), F.max(length).alias("greatest"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long" + (", scanned long" if counted else ""))
    learned = sample(whole, SAMPLE, facts["n"])
    space, largest = Space(choose_pivots(learned, pivots), facts["greatest"]), facts["largest"]
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8"

    def unpacked(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        where = np.frombuffer(ids, "<i8")
        return where, np.frombuffer(data, kind).reshape(len(where), -1).astype(np.float64)

    def keyed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    apart = space.to_pivots(matrix(b.column(1)), query)
                    near = apart.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), pa.array(apart[np.arange(len(near)), near]), b.column(0), b.column(1)], ["key", "at", "vec_id", "x"])

        return run

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the bounds of their annuli: for each the least and greatest distance by pivot, then the greatest length."""
        for b in batches:
            for i in range(b.num_rows):
                _, x = unpacked(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                apart, norms = space.to_pivots(x), np.sqrt((x**2).sum(1))
                cuts = np.arange(0, len(x), annulus)
                low, high = np.minimum.reduceat(apart, cuts), np.maximum.reduceat(apart, cuts)
                bounds = np.concatenate([low, high, np.maximum.reduceat(norms, cuts)[:, None]], 1)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in range(3)), pa.array([bounds.astype("<f8").tobytes()], pa.binary())], ["first", "ids", "data", "bounds"])

    def split(bounds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells = np.frombuffer(bounds, "<f8").reshape(-1, 2 * len(space.pivots) + 1)
        n = len(space.pivots)
        return cells[:, :n], cells[:, n : 2 * n], cells[:, -1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query its nearest block by the bounds, of those whose bounds came along."""
        for b in batches:
            for i in range(b.num_rows):
                who, q = unpacked(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                apart = space.to_pivots(q, query=True)
                firsts, best = [], []
                for one in b.column(3)[i].as_py():
                    low, high, _ = split(one["bounds"])
                    middle = np.abs(apart[:, None, :] - (low + high)[None] / 2).mean(2) if len(low) * apart.size < 1 << 24 else np.zeros((len(q), len(low)))
                    firsts.append(one["first"])
                    best.append((space.beyond(apart, low, high) + 1e-3 * middle).min(1))
                best, firsts = np.array(best), np.array(firsts)
                at = best.argmin(0)
                columns = [np.full(len(who), b.column(0)[i].as_py()), who, best[at, np.arange(len(who))], firsts[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["together", "query_id", "bound", "first"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the queries that must look at it: ids, vectors and least scores so far."""
        for b in batches:
            for i in range(b.num_rows):
                who, q = unpacked(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                known = {r["query_id"]: r for r in b.column(4)[i].as_py() or ()}
                seen = np.array([known[w]["first"] if w in known else -1 for w in who.tolist()])
                begun = np.array([w in known for w in who.tolist()])
                least = np.array([known[w]["least"] if w in known and known[w]["least"] is not None else -np.inf for w in who.tolist()], np.float64)
                apart, square = space.to_pivots(q, query=True), (q**2).sum(1)
                radius = space.radius(square, least)
                for one in b.column(3)[i].as_py():
                    low, high, norm = split(one["bounds"])
                    wanted = ~(space.beyond(apart, low, high) > radius[:, None]) & ~(np.sqrt(square)[:, None] * norm * (1 + SLACK) < least[:, None])
                    some = wanted.any(1) & ~(begun & (seen == one["first"]))
                    if some.any():
                        cells = [who[some].astype("<i8").tobytes(), q[some].astype(kind).tobytes(), least[some].astype("<f8").tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([one["first"]], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], ["first", "query_ids", "query_data", "least"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The annuli of a block from near to far, each by the queries whose radius reaches it."""
        for b in batches:
            for i in range(b.num_rows):
                cells = [c[i].as_py() for c in b.columns]
                ids, x = unpacked(cells[0], cells[1])
                who, q = unpacked(cells[3], cells[4])
                low, high, norm = split(cells[2])
                least, square = np.frombuffer(cells[5], "<f8").copy(), (q**2).sum(1)
                beyond = space.beyond(space.to_pivots(q, query=True), low, high)
                most = np.sqrt(square)[:, None] * norm * (1 + SLACK)
                seen, tops = np.zeros(len(who), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(who)
                for s in np.argsort(beyond.mean(0), kind="stable").tolist():
                    some = np.flatnonzero(~(beyond[:, s] > space.radius(square, least)) & ~(most[:, s] < least))
                    if not len(some):
                        continue
                    a, e = s * annulus, min((s + 1) * annulus, len(ids))
                    scores = product(q[some], x[a:e], largest)
                    seen[some] += e - a
                    part = np.arange(len(some))
                    enough = scores.max(1) >= least[some]
                    for j in part[enough].tolist():
                        one = int(some[j])
                        good = np.flatnonzero(scores[j] >= least[one])
                        good = good[ids[a:e][good] != who[one]]
                        where, value = np.concatenate([tops[one][0], ids[a:e][good]]), np.concatenate([tops[one][1], scores[j][good]])
                        order = np.lexsort((where, -value))[:k]
                        tops[one] = where[order], value[order]
                        if len(order) == k:
                            least[one] = max(least[one], float(value[order[-1]]))
                n = [len(t[0]) for t in tops]
                # rows that are no neighbours tell how many vectors were scanned
                looked = np.flatnonzero(seen)
                none = np.zeros(len(looked), np.int64)
                columns = [np.concatenate(c) for c in ([np.repeat(who, n), who[looked]], [*(t[0] for t in tops), none], [*(t[1] for t in tops), none], [np.zeros(sum(n), np.int64), seen[looked]])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "scanned"])

    blocks = pack(whole.mapInArrow(keyed(False), "key long, at double, vec_id long, x array<double>"), block, kind)
    index = cut(blocks.select("first", "ids", "data").mapInArrow(bounded, "first long, ids binary, data binary, bounds binary"))
    some = max(1, -(-facts["n"] // (block * BOUNDS)))
    bounds = index.groupBy(F.pmod(F.xxhash64("first"), F.lit(some)).alias("pack")).agg(F.collect_list(F.struct("first", "bounds")).alias("bounds"))
    near = whole.where(F.col("vec_id") % every == 0).mapInArrow(keyed(True), "key long, at double, vec_id long, x array<double>")
    # queries with one nearest pivot travel together
    asking = cut(pack(near, queries, kind).select(F.col("first").alias("together"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data")))
    # the stated queries meet all bounds, which are far fewer than the vectors
    met = cut(asking.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(some - 1).cast("long"))).alias("pack")).join(bounds, "pack").select("together", "query_ids", "query_data", "bounds"))
    first = met.mapInArrow(nearest, "together long, query_id long, bound double, first long").groupBy("together", "query_id").agg(F.min(F.struct("bound", "first")).alias("b"))
    seeds = cut(first.select("together", "query_id", "b.first"))

    def scanned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(index, "first").select("ids", "data", "bounds", "query_ids", "query_data", "least")
        return cut(both.mapInArrow(scan, "query_id long, vec_id long, score long, scanned long"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                who, q = unpacked(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                to = {r["query_id"]: r["first"] for r in b.column(2)[i].as_py()}
                at = np.array([to[w] for w in who.tolist()])
                for one in np.unique(at).tolist():
                    rows = at == one
                    cells = [who[rows].astype("<i8").tobytes(), q[rows].astype(kind).tobytes(), np.full(rows.sum(), -np.inf, "<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], ["first", "query_ids", "query_data", "least"])

    pairs = "first long, query_ids binary, query_data binary, least binary"
    goals = seeds.groupBy("together").agg(F.collect_list(F.struct("query_id", "first")).alias("goals"))
    found = scanned(asking.join(goals, "together").select("query_ids", "query_data", "goals").mapInArrow(dealt, pairs))
    kth = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    real = found.where("scanned = 0")
    least = real.withColumn("place", F.row_number().over(kth)).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    known = seeds.join(least, "query_id", "left").groupBy("together").agg(F.collect_list(F.struct("query_id", "first", "least")).alias("known"))
    more = scanned(met.join(known, "together").select("together", "query_ids", "query_data", "bounds", "known").mapInArrow(needed, pairs))
    every_one = found.unionByName(more)
    rank = F.row_number().over(kth).cast("int")
    top = every_one.where("scanned = 0").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if not counted:
        return top
    return top.join(every_one.groupBy("query_id").agg(F.sum("scanned").alias("scanned")), "query_id")
