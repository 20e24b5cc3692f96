"""SimHash near-duplicates through a binary trie self-join.

A text's fingerprint has one bit per majority vote over the hashes of its word shingles. The distinct fingerprints
form a binary trie; pairs of its nodes are walked together from the root. A pair carries the differing bits so
far and goes once these exceed the budget. Spark holds the frontier of node pairs as a table and takes ``STEP``
bits a round; a pair whose two nodes hold few fingerprints (a leaf) is walked on inside one task down to the last bit,
with the same sums and the same pruning. Only nodes with too many fingerprints go deeper on Spark's side, so a
dense region (a large group of near copies) is split further, and no task holds more than two leaves. A task
reports a spanning forest of the links it found, never all pairs, and the components are contracted with joins
and aggregations.

There are two ways to use it. :func:`near_duplicates` links texts whose 64-bit fingerprints differ by few bits.
:func:`similar` finds texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: fingerprints over
all shingles of such texts differ in about 15 % of their bits, too many for a trie, and fingerprints short enough to agree
would bring unrelated texts together, the more the larger the corpus. So each of ``TREES`` tries holds the SimHash of a small
sample of a text's shingles, drawn by least hashes, which similar texts share as a whole with good chance and unrelated ones
don't, however many there are. The tries are walked in one pass, and each pair that any of them finds is then checked
exactly. What the tries miss is found by the prefixes of sets in one order, rare shingles first: two sets that are similar enough share one of
their first shingles. Such pairs of different components are checked too, so no link is lost.

Edge cases: a null or empty text, or one without words, has the fingerprint zero and links like any
other; fewer words than a shingle count as one shingle; repeated rows (same id and text) count as
copies of each other; null ids get a component like any row but never name one unless nothing else is in
it; an empty table gives an empty result; further columns of the input, whatever their names, are ignored by all but
:func:`keep_one`, which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import cut, free, small, tidy, word_chunks

#: Bits that a round of the walk takes, on Spark's side and inside a leaf.
STEP, INNER = 6, 4
#: Fingerprints in a node that one task walks on alone.
LEAF = 4096
#: Node pairs that a task holds at a time.
WIDTH = 1 << 19

# :func:`similar`
#: Tries, shingles in the sample that each of them takes of a text, bits of its fingerprint, and the bits by which two may
#: differ. A pair of similarity s has one sample with probability s ** 5, so at 0.8 any of twelve with 0.991 and at 0.85
#: with 0.999; unrelated texts meet with probability 12 * 57 / 2 ** 56, so fewer than one in a hundred of 10 ** 12 texts does.
TREES, SAMPLE, BITS, BUDGET = 12, 5, 56, 1
#: Words of 64 bits that are compared before the exact check, and the bits by which they may differ: at similarity
#: 0.8 the mean is 19 and the deviation 4 (24 and 4 for very short texts), for unrelated texts 64 and 6.
WORDS, FAR = 2, 44
#: Spanning forests of its candidates that a task reports, each made of what the ones before left: where no more than so many
#: candidates join two groups, all of them are checked.
FORESTS = 2
NEAR_LEAF = 8192
#: Bits of the places that count how common shingles are (it only orders them), and bits of a set's map for each shingle, at least.
PLACES, MAP = 18, 4
MEMO_WORDS = 100_000


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text: bit b is set if it is in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    ones, n, tail = np.zeros(64, np.int64), 0, []
    short: list[bytes] = []
    for words in word_chunks((text or b"").lower()):
        words = tail + words
        if len(words) < shingle:
            tail = short = words
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        k = len(words) - shingle + 1
        bits = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), "<u8", k)
        ones += _ones(bits)
        n += k
        tail = words[len(words) - shingle + 1 :]
    if not n:
        if not short:
            return 0
        n, ones = 1, _ones(np.array([xxh64_intdigest(b" ".join(short), 42)], "<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight counters of a byte in each integer; 255 rows fill none of them
        ones += np.add.reduceat(part, np.arange(0, len(part), 255)).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return _plain(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, text_hash long, fp long")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].cast("binary").alias("text"))


# --- the walk


def walk(a: np.ndarray, b: np.ndarray, same: bool, budget: int, depth: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within ``budget`` bits of two leaves at ``depth``, or of one (``same``), some at a time.

    ``a`` and ``b`` are ascending, so a node of the trie is a slice of them.
    """
    one = np.zeros(1, np.int64)
    d = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(bits - depth))) if 0 < depth else 0
    held = [(depth, one, one + len(a), one, one + len(b), one + d)]
    while held:
        depth, la, ha, lb, hb, d = held.pop()
        if depth == bits:
            yield from _singles(la, ha, lb, hb, same)
            continue
        new = min(depth + INNER, bits)
        shift, mask = np.uint64(bits - new), np.uint64((1 << (new - depth)) - 1)
        starts_a, starts_b = (np.flatnonzero(np.append(True, (x[1:] >> shift) != (x[:-1] >> shift))) for x in (a, b))
        ends_a, ends_b = np.append(starts_a[1:], len(a)), np.append(starts_b[1:], len(b))
        first_a, first_b = np.searchsorted(starts_a, la), np.searchsorted(starts_b, lb)
        wide = np.searchsorted(starts_b, hb) - first_b
        made = (np.searchsorted(starts_a, ha) - first_a) * wide
        total = np.cumsum(made)
        i = 0
        while i < len(made):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + WIDTH, "right")))
            n = made[i:j]
            pair = np.repeat(np.arange(i, j), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            x, y = first_a[pair] + at // wide[pair], first_b[pair] + at % wide[pair]
            sum_ = d[pair] + np.bitwise_count(((a[starts_a[x]] ^ b[starts_b[y]]) >> shift) & mask)
            kept = (sum_ <= budget) & ((x <= y) if same else True)
            x, y = x[kept], y[kept]
            if len(x):
                held.append((new, starts_a[x], ends_a[x], starts_b[y], ends_b[y], sum_[kept]))
            i = j


def _singles(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of slices that share their bits; a fingerprint that many have makes them many."""
    wide = hb - lb
    made = (ha - la) * wide
    total, i = np.cumsum(made), 0
    while i < len(made):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + WIDTH, "right")))
        for low in range(0, int(total[j - 1] - done), WIDTH):
            at = np.arange(low, min(low + WIDTH, int(total[j - 1] - done))) + done
            pair = np.searchsorted(total, at, "right")
            at = at - (total[pair] - made[pair])
            x, y = la[pair] + at // wide[pair], lb[pair] + at % wide[pair]
            yield (x[x < y], y[x < y]) if same else (x, y)
        i = j


def spanning(left: np.ndarray, right: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """Which edges make a minimum spanning forest of ``n`` nodes: every component takes its cheapest way out, again and again."""
    order = np.argsort(cost, kind="stable")
    left, right = left[order], right[order]
    root, alive, chosen = np.arange(n), np.arange(len(order)), []
    while True:
        a, b = root[left[alive]], root[right[alive]]
        alive, a, b = alive[a != b], a[a != b], b[a != b]
        if not len(alive):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        first = np.full(n, -1)
        first[np.concatenate([a[::-1], b[::-1]])] = np.concatenate([alive[::-1], alive[::-1]])
        both = np.full(n, -1)  # the cheaper of the two ends' first edges
        both[a[::-1]] = alive[::-1]
        first = np.where((both >= 0) & ((first < 0) | (both < first)), both, first)
        taken = np.unique(first[first >= 0])
        chosen.append(taken)
        u, v = root[left[taken]], root[right[taken]]
        label = np.arange(n)
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        root = label[root]


class Links:
    """Links between numbered nodes, thinned as they come to ``forests`` spanning forests, each a minimum one of what is left."""

    def __init__(self, n: int, forests: int = 1) -> None:
        self.n, self.forests, self.held = n, forests, []

    def add(self, left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> None:
        self.held.append((left, right, cost))
        if sum(len(h[0]) for h in self.held) > max(WIDTH, 4 * self.forests * self.n):
            self.held = [self.thinned()]

    def thinned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right, cost = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64),) * 3
        rest, chosen = np.arange(len(left)), []
        for _ in range(self.forests):
            some = spanning(left[rest], right[rest], cost[rest], self.n)
            chosen.append(rest[some])
            rest = np.delete(rest, some)
        some = np.concatenate(chosen)
        return left[some], right[some], cost[some]


def trie_links(fps: DataFrame, budget: int = 2, bits: int = 64, step: int = STEP, leaf: int = LEAF, words: int = 0, far: int = 64, forests: int = 1) -> DataFrame:
    """``(u, v)``: links that connect the same nodes as all pairs within ``budget`` bits do.

    ``fps`` has ``fp`` (``bits`` bits; what stands above them is the trie's number, and only fingerprints
    of one trie are compared) and ``id``. With ``words``, the links are between ids whose ``sketch``, so many
    64-bit words, differs by ``far`` bits or fewer, and of those that connect two ids the nearest ones are reported, in ``forests``
    forests from each task.
    """
    kind = np.dtype([("fp", "<u8" if bits > 32 else "<u4")] + ([("id", "<u8"), *((f"w{i}", "<u8") for i in range(words))] if words else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's entries as bytes, ascending, a row for each chunk that is to meet it."""
        for batch in batches:
            for i in range(batch.num_rows):
                fields = [np.asarray(f).view(np.uint64) for f in batch.column(0)[i].values.flatten()]
                cells = np.empty(len(fields[0]), kind)
                for name, f in zip(kind.names, fields, strict=True):
                    cells[name] = f.astype(kind[name])
                partners = batch.column(1)[i].values
                n = len(partners)
                data = pa.array([np.sort(cells, order=kind.names).tobytes()], pa.binary())
                places = [batch.column(c).slice(i, 1) for c in (2, 3)]
                yield pa.RecordBatch.from_arrays([*partners.flatten(), *(pa.array(np.repeat(np.asarray(p), n)) for p in places), pa.array([data[0].as_py()] * n, pa.binary())], ["a", "ca", "asked", "b", "cb", "cells"])

    def unpack(cells: bytes) -> list[np.ndarray]:
        rows = np.frombuffer(cells, kind)
        columns = [rows[name].astype(np.uint64) for name in kind.names]
        return columns if words else columns * 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                same, asked, depth, cells = (batch.column(k)[i].as_py() for k in (1, 2, 3, 4))
                other = unpack(cells)
                if same:
                    own = other
                if not asked:
                    continue
                n = len(own[0])
                found = Links(n if same else n + len(other[0]), forests)
                for x, y in walk(own[0], other[0], same, budget, depth, bits):
                    if words:
                        apart = sum(np.bitwise_count(p[x] ^ q[y]).astype(np.int64) for p, q in zip(own[2:], other[2:], strict=True))
                        near = (apart <= far) & (own[1][x] != other[1][y])
                        x, y, apart = x[near], y[near], apart[near]
                    else:
                        apart = np.zeros(len(x), np.int64)
                    if len(x):
                        found.add(x, y if same else y + n, apart)
                x, y, _ = found.thinned()
                ids = own[1] if same else np.concatenate([own[1], other[1]])
                us.append(ids[x]), vs.append(ids[y])
            out = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["u", "v"])

    def prefix(depth: int):
        return F.lit(0).cast("long") if depth == 0 and bits == 64 else F.shiftrightunsigned(F.col("fp"), bits - depth)

    # a row for each trie, written out, as literals would be folded out of the joins' keys and leave a Cartesian product
    pairs = cut(fps.select(prefix(0).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("d")))
    active, links = fps, []
    for depth in range(step, bits + step, step):
        up, depth = depth - step, min(depth, bits)
        child = cut(active.groupBy(prefix(up).alias("up"), prefix(depth).alias("node")).agg(F.count("*").alias("n")))
        one = child.select(F.col("up").alias("a"), F.col("node").alias("na"), F.col("n").alias("n_a"))
        two = child.select(F.col("up").alias("b2"), F.col("node").alias("nb"), F.col("n").alias("n_b"))
        differ = (F.col("d") + F.bit_count(F.expr(f"(na ^ nb) & {(1 << (depth - up)) - 1}"))).cast("int")
        within = (F.col("b") == F.col("b2")) & (differ <= budget) & ((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb")))
        walked = pairs.join(one, "a").join(two, within)
        end = F.lit(depth == bits)
        walked = cut(walked.select(F.col("na").alias("a"), F.col("nb").alias("b"), differ.alias("d"), "n_a", "n_b", ((F.greatest("n_a", "n_b") <= leaf) | end).alias("small")))
        # a leaf is one chunk; only a fingerprint that more than a leaf share at the last bit is dealt to several
        chunks = lambda n: F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / leaf))
        near = walked.where("small").select("a", "b", F.explode(chunks("n_a")).alias("ca"), "n_b").select("a", "b", "ca", F.explode(chunks("n_b")).alias("cb")).where("a < b or ca <= cb")
        # a node meets its partners one after the other, its own row first
        own = near.select("a", "ca", F.col("a").alias("b"), F.col("ca").alias("cb"), F.lit(False).alias("asked"))
        met = near.withColumn("asked", F.lit(True)).unionByName(own).groupBy("a", "ca", "b", "cb").agg(F.max("asked").alias("asked"))
        sized = child.where((F.col("n") <= leaf) | end).select("node", F.floor((F.col("n") - 1) / leaf + 1).alias("of"))
        cells = F.collect_list(F.struct("fp", *(["id"] if words else []), *(F.col("sketch")[i].alias(f"w{i}") for i in range(words))))
        dealt = active.withColumn("node", prefix(depth)).join(sized, "node").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("of")))
        packed = dealt.groupBy(F.col("node").alias("b"), F.col("chunk").alias("cb")).agg(cells.alias("cells"))
        partners = met.groupBy("b", "cb").agg(F.collect_list(F.struct("a", "ca", "asked")).alias("partners"))
        sent = packed.join(partners, ["b", "cb"]).select("cells", "partners", "b", "cb").mapInArrow(tidy(pack), "a long, ca long, asked boolean, b long, cb long, cells binary")
        same = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
        rows = sent.select(F.struct("a", "ca").alias("whose"), same.alias("same"), "asked", F.lit(depth).alias("depth"), "cells", "b", "cb")
        rows = rows.repartition("whose").sortWithinPartitions("whose", ~F.col("same"), "b", "cb").drop("b", "cb")
        links.append(cut(rows.mapInArrow(tidy(compare), "u long, v long").distinct()))
        pairs = walked.where(~F.col("small")).select("a", "b", "d")
        if depth == bits or pairs.isEmpty():
            break
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        active = cut(active.withColumn("node", prefix(depth)).join(wanted, "node", "left_semi").drop("node"))
    return reduce(DataFrame.unionByName, links)


def fresh(df: DataFrame) -> DataFrame:
    """``df`` after :func:`cut`, with no estimate of its size: a checkpoint keeps its plan's, and what is joined round after round multiplies them to numbers that fill the driver."""
    df, session = cut(df), df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link: ``root`` is its component's smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling,
    and contracts the links; the nodes left shrink to half or fewer each time.
    """
    edges = fresh(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))
        low = fresh(low)
        while True:
            jump = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
            low = fresh(low.select("node", "root").join(jump, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            if low.where("moved").isEmpty():
                break
        to = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if roots is None:
            roots = low.select("node", "root")
        else:
            roots = fresh(roots.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        moved = edges.join(low.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(low.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        edges = fresh(moved.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    return links.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def _best():
    return F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("best")


def _grouped(by_node: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``(node, best)``: for each node the smallest ``best`` of its component."""
    rooted = cut(by_node.join(components(links).withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)))
    by_root = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select(node, "root").join(by_root, "root").select(node, "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, best)``: one row per row of ``docs``.

    ``component_id`` is the smallest id that links of at most ``budget`` differing bits reach, the row's own
    included. ``best`` is the ``(id missing, id, text_hash)`` of the row that stands for the component.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    by_fp = cut(marked.groupBy("fp").agg(_best()))
    links = trie_links(by_fp.select("fp", F.col("fp").alias("id")), budget)
    return marked.join(_grouped(by_fp, links, "fp"), "fp").select("doc_id", "text_hash", "fp", F.col("best.doc_id").alias("component_id"), "best")


# --- similarity of sets of shingles


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO_WORDS:
            self.clear()
        found = xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = found
        return found


def shingles(text: bytes | None, size: int, memo: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's shingles of ``size`` words, ascending; fewer words are one shingle, none make none."""
    parts, tail, short = [], np.empty(0, np.uint64), np.empty(0, np.uint64)
    for words in word_chunks((text or b"").lower()):
        w = np.concatenate([tail, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))])
        if len(w) < size:
            tail = short = w
            continue
        n = len(w) - size + 1
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
        parts.append(np.unique(h))
        tail = w[n:]
    if not parts and len(short):
        h = np.full(1, len(short), np.uint64)
        for x in short:
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
        parts.append(h)
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def sketch(s: np.ndarray, words: int) -> np.ndarray:
    """``64 * words`` bits, each a majority vote over the set's hashes."""
    ones = [_ones(_mixed(s + np.uint64((i + 1) * 0xD1B54A32D192ED03 % (1 << 64)))) for i in range(words)]
    return np.concatenate(ones) * 2 > len(s)


def sampled(s: np.ndarray, odd: np.ndarray, bits: int) -> np.ndarray:
    """The SimHash of each sample of the set: ``odd`` is ``[trie, draw]``, and a draw takes the shingle with the least hash by its multiplier."""
    if not len(s):
        return np.zeros(len(odd), np.int64)
    least = np.full(odd.size, np.iinfo(np.uint64).max, np.uint64)
    mixed = s ^ (s >> np.uint64(32))
    for i in range(0, len(s), 4096):
        np.minimum(least, np.multiply.outer(odd.ravel(), mixed[i : i + 4096]).min(1), out=least)
    votes = np.unpackbits(_mixed(least).astype("<u8").view(np.uint8), bitorder="little").reshape(*odd.shape, 64).sum(1, dtype=np.int64)
    return (2 * votes[:, :bits] > odd.shape[1]) @ (np.int64(1) << np.arange(bits))


def multipliers(trees: int, sample: int) -> np.ndarray:
    return (_mixed(np.arange(1, trees * sample + 1, dtype=np.uint64)) | np.uint64(1)).reshape(trees, sample)


def commonness(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """How many shingles of all texts fall into each of ``2 ** PLACES`` places by their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, n = _Words(), np.zeros(1 << PLACES, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, shingles(t.as_py(), shingle, memo) >> np.uint64(64 - PLACES), 1)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], ["place", "n"])

    found = np.zeros(1 << PLACES, np.int64)
    rows = docs.select(docs[text_col].cast("binary")).mapInArrow(tidy(count), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    found[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return found


def prefix(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in one order of all, rare places first: sets of that similarity or more have one of them in common."""
    if not len(s):
        return s
    shared = int(np.ceil(similarity * len(s) - 1e-9))  # with any set that is similar enough, at least
    return s[np.lexsort((s, common[s >> np.uint64(64 - PLACES)]))[: len(s) - shared + 1]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle by its hash, in a power of two of words: two sets differ in as many shingles as their maps do in bits, at least."""
    words = 1 << max(0, (MAP * len(s) - 1).bit_length() - 6)
    bits = np.zeros(64 * words, np.uint8)
    bits[s % np.uint64(64 * words)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two maps differ, the longer one folded to the other's length."""
    words = min(len(a), len(b))
    one, two = (np.bitwise_or.reduce(x.reshape(-1, words)) for x in (a, b))
    return int(np.bitwise_count((one ^ two).view(np.uint64)).sum())


def marks(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, trees: int, sample: int, bits: int, similarity: float = 0.8, common: np.ndarray | None = None
) -> DataFrame:
    """``(row, doc_id, text_hash, class, fps, sketch)``: a hash of the set of shingles, a fingerprint for each trie, and the sketch.

    ``row`` is a number of each row's own, which stays once the rows are written. With ``common`` also ``(n, prefix, map)``: the size
    of the set, its :func:`prefix` and its :func:`bitmap`.
    """
    odd = multipliers(trees, sample)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for b in batches:
            classes, fps, near, n, first, maps = [], [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), shingle, memo)
                with np.errstate(over="ignore"):
                    classes.append(int(_mixed(np.array([_mixed(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]))
                fps.append(sampled(s, odd, bits) + (np.arange(trees) << bits))
                near.append(np.packbits(sketch(s, WORDS), bitorder="little").view(np.int64))
                if common is not None:
                    n.append(len(s))
                    first.append(prefix(s, common, similarity).view(np.int64))
                    maps.append(bitmap(s))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())) for x in (fps, near, first, maps)]
            more = [] if common is None else [pa.array(n, pa.int64()), *lists[2:]]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), pa.array(classes, pa.int64()), *lists[:2], *more], ["row", "doc_id", "text_hash", "class", "fps", "sketch", "n", "prefix", "map"][: 6 + len(more)])

    kinds = "row long, doc_id long, text_hash long, class long, fps array<long>, sketch array<long>" + ("" if common is None else ", n long, prefix array<long>, map array<long>")
    return _plain(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(mark), kinds)


def missed(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``: all pairs of classes of different components of ``links`` that may be similar enough, from one row ``(class, n, prefix)`` for each class.

    Two sets that are similar enough have their first common shingle where both have enough left for all that they must share.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that share a shingle, which comes with all its classes in a row, those of a component together."""

        def pairs(shingle: np.ndarray, root: np.ndarray, classes: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.append(True, shingle[1:] != shingle[:-1])
            run = np.flatnonzero(new | np.append(True, root[1:] != root[:-1]))
            ends = [np.repeat(np.append(x[1:], len(shingle)), np.diff(np.append(x, len(shingle)))) for x in (np.flatnonzero(new), run)]
            a = np.arange(len(shingle))
            b, us, vs, total = ends[1], [], [], 0
            while len(a := (a[inside := b < ends[0][a]])):
                b = b[inside]
                shared = np.ceil(similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9)
                near = (at[a] <= n[a] - shared) & (at[b] <= n[b] - shared)
                us.append(np.minimum(classes[a[near]], classes[b[near]])), vs.append(np.maximum(classes[a[near]], classes[b[near]]))
                total += len(us[-1])
                if total > WIDTH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                    us, vs, total = [], [], 0
                b = b + 1
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        held = [np.empty(0, np.int64)] * 5
        for b in batches:
            held = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, b.columns, strict=True)]
            ended = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(ended):
                yield from pairs(*(h[: ended[-1] + 1] for h in held))
                held = [h[ended[-1] + 1 :] for h in held]
        if len(held[0]):
            yield from pairs(*held)

    roots = small(cut(components(links).select(F.col("node").alias("class"), "root")))
    entries = sets.join(roots, "class", "left").select(F.posexplode("prefix").alias("at", "shingle"), "class", F.coalesce("root", "class").alias("root"), "n").repartition("shingle")
    mixed = entries.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    met = entries.join(mixed, "shingle").select("shingle", "root", "class", "n", "at").repartition("shingle").sortWithinPartitions("shingle", "root")
    return met.mapInArrow(tidy(meet), "u long, v long").distinct()


def near(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose maps don't show that they are too different, from one row ``(class, n, map)`` for each class."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 - similarity) / (1 + similarity)
        for b in batches:
            n = np.asarray(b.column(2)) + np.asarray(b.column(3))
            kept = [apart(*(np.asarray(b.column(c)[i].values) for c in (4, 5))) <= most * n[i] + 1e-6 for i in range(b.num_rows)]
            yield b.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    links = cut(links)
    wanted = small(cut(links.select(F.explode(F.array("u", "v")).alias("class")).distinct()))
    maps = cut(sets.join(wanted, "class").select("class", "n", "map"))
    for c in "vu":
        links = links.join(maps.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}")), c)
    return links.select("u", "v", "n_u", "n_v", "map_u", "map_v").mapInArrow(tidy(compare), "u long, v long")


def candidates(by_class: DataFrame, bits: int = BITS, budget: int = BUDGET, leaf: int = NEAR_LEAF, far: int = FAR, forests: int = FORESTS) -> DataFrame:
    """``(u, v)``: pairs of classes to check, from ``(class, fps, sketch)``."""
    nodes = by_class.select(F.explode("fps").alias("fp"), F.col("class").alias("id"), "sketch")
    return trie_links(nodes, budget, bits, leaf=leaf, words=WORDS, far=far, forests=forests).distinct()


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, trees: int = TREES, sample: int = SAMPLE, bits: int = BITS, budget: int = BUDGET, leaf: int = NEAR_LEAF
) -> DataFrame:
    """``(doc_id, text_hash, component_id, best)``: one row per row of ``docs``, as :func:`near_duplicates` has them.

    Two texts are linked if their sets of shingles (of lower-cased words) have a Jaccard similarity of ``similarity``
    or more. Texts with the same set are one class from the start. Of the other pairs, those that a trie of
    sampled fingerprints brings together and whose sketches are not far apart are candidates; each task keeps some minimum
    spanning forests of its candidates by sketch distance; and every candidate kept whose :func:`bitmap` leaves it open is checked on the whole texts. Then
    all pairs that :func:`missed` finds between the components made so far are checked as well. Texts without a word are one class.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, left = _Words(), None, None
        for b in batches:
            kept = []
            for i in range(b.num_rows):
                u = b.column(0)[i].as_py()
                if u != last:
                    last, left = u, shingles(b.column(2)[i].as_py(), shingle, memo)
                right = shingles(b.column(3)[i].as_py(), shingle, memo)
                both = len(np.intersect1d(left, right, assume_unique=True))
                kept.append(both >= similarity * (len(left) + len(right) - both))
            yield b.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    plain = _plain(docs, id_col, text_col)
    marked = cut(marks(docs, id_col, text_col, shingle, trees, sample, bits, similarity, commonness(docs, text_col, shingle)))
    by_class = cut(marked.groupBy("class").agg(_best(), F.min("row").alias("row"), *(F.any_value(c).alias(c) for c in ("fps", "sketch"))))
    # prefixes and maps take the most room: they stay where they are, and the rows that stand for no class are anti-joined
    copies = small(cut(marked.select("row").join(by_class.select("row"), "row", "left_anti")))
    sets = marked.join(copies, "row", "left_anti").select("class", "n", "prefix", "map")

    def linked(links: DataFrame) -> DataFrame:
        """Those of the pairs that are similar enough, by their maps and then by their whole texts."""
        links = cut(near(links, sets, similarity))
        if links.isEmpty():
            return links
        wanted = links.select(F.explode(F.array("u", "v")).alias("class")).distinct().join(by_class.select("class", "best"), "class")
        wanted = wanted.select("class", F.col("best.doc_id").alias("of"), F.col("best.text_hash").alias("hash"))
        wanted = small(cut(wanted))
        one = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["of"]) & (plain["text_hash"] == wanted["hash"]))
        texts = cut(one.groupBy("class").agg(F.any_value("text").alias("text")))
        sides = [texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv"]
        both = links.join(sides[1], "v").join(sides[0], "u").select("u", "v", "text_u", "text_v")
        return fresh(both.mapInArrow(tidy(check), "u long, v long"))

    checked = linked(candidates(by_class, bits, budget, leaf))
    checked = checked.unionByName(linked(missed(sets, checked, similarity)))
    return marked.join(_grouped(by_class.select("class", "best"), checked, "class"), "class").select("doc_id", "text_hash", F.col("best.doc_id").alias("component_id"), "best")


def keep_one(docs: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each component of ``found`` (:func:`similar`, if not given). All columns stay.

    That is the one with the smallest id, null last; of several with that id, the one with the smallest hash of its
    text, then of all its columns. The rows that go are anti-joined, so that few of them move no text.
    """
    found = similar(docs, id_col, text_col) if found is None else found
    row = free("whole_row", docs.columns)
    stands = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash") == F.col("best")
    keys = cut(found.groupBy("doc_id", "text_hash").agg(F.max(stands).alias("stands"), F.count("*").alias("n")))
    names = {c: free(c, docs.columns) for c in ("gone_id", "gone_hash")}
    keyed = lambda rows: rows.select(F.col("doc_id").alias(names["gone_id"]), F.col("text_hash").alias(names["gone_hash"]))
    same = docs[id_col].cast("long").eqNullSafe(F.col(names["gone_id"])) & (F.xxhash64(docs[text_col]) == F.col(names["gone_hash"]))
    out = docs.join(small(cut(keyed(keys.where("not stands or n > 1")))), same, "left_anti")
    again = keys.where("stands and n > 1")
    if again.isEmpty():
        return out
    some = docs.join(keyed(again), same, "left_semi").select(F.struct(*(docs[c] for c in docs.columns)).alias(row))
    by = [F.col(row)[id_col].cast("long"), F.xxhash64(F.col(row)[text_col])]
    one = some.groupBy(*by).agg(F.min_by(row, F.xxhash64(row)).alias(row))
    return out.unionByName(one.select(f"{row}.*"))
