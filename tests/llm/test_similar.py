"""Similarity of word shingles: the trie walk and the exact check against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import simhash
from tests.llm.test_operators import DOCS, LONG, pandas


def sets(texts, size=5):
    out = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        out.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else []))
    return out


def slow_similar(ids, texts, least=0.8):
    found, root = sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            both, either = len(found[i] & found[j]), len(found[i] | found[j])
            if both >= least * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)


def found(rows):
    return Counter((r.doc_id, r.component_id) for r in rows.collect())


def test_similar_equals_brute_force(spark, sf01):
    docs = pandas(spark, sf01, "documents")
    got = simhash.similar(spark.read.parquet(f"{sf01}/documents.parquet"))
    assert found(got) == slow_similar(docs.doc_id.tolist(), docs.text.tolist())


def edited(rng, words, share):
    """A copy with single words replaced until about that part of the shingles is shared."""
    out, whole = list(words), set(zip(*(words[i:] for i in range(5)), strict=False))
    while True:
        at = rng.randrange(len(out))
        old, out[at] = out[at], f"new{rng.randrange(10**9)}"
        own = set(zip(*(out[i:] for i in range(5)), strict=False))
        if len(own & whole) / len(own | whole) < share:
            out[at] = old
            return out


def test_copies_from_080_to_095_are_found_and_clean_texts_stay(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for k in range(300):
        words = rng.choices(vocabulary, k=rng.choice((60, 150, 400)))
        copy = edited(rng, words, 0.8 + 0.15 * (k % 4) / 3)
        pairs.append((len(rows), len(rows) + 1))
        rows += [" ".join(words), " ".join(copy).upper()]
    line = "this very line stands in many documents again and again"
    clean = range(len(rows), len(rows) + 40)
    rows += [(line + "\n") * 30 + " ".join(rng.choices(vocabulary, k=30)) for _ in clean]  # repeats do not make copies
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    caught = np.mean([got[a] == got[b] for a, b in pairs])
    print(f"recall {caught:.3f}")
    assert caught >= 0.95
    assert all(got[c] == c for c in clean)
    assert {d for d in got if got[d] == d and d % 2 == 0} >= {a for a, _ in pairs}


def test_a_large_group_of_near_copies(spark):
    """Thousands of texts one word apart share short fingerprints; nodes of them are dealt to several chunks."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"y{i}_{j}" for j in range(50))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, leaf=64).collect()}
    assert {got[i] for i in range(1500)} == {0} and all(got[2000 + i] == 2000 + i for i in range(50))


def test_similar_odd(spark):
    texts = [None, "", "  \n", "one two", "one two", "ONE  two", LONG, LONG + "end", "é one", "one"]
    rows = [(i, t, "en", "s", None, "a", "b", "c") for i, t in enumerate(texts)] + [(3, "one two", "en", "s", None, "a", "b", "c"), (None, "one two", "en", "s", None, "a", "b", "c"), (None, "alone", "en", "s", None, "a", "b", "c")]
    odd = spark.createDataFrame(rows, DOCS)
    ids, whole = [r[0] for r in rows], [r[1] for r in rows]
    assert found(simhash.similar(odd)) == slow_similar(ids, whole)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({0: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1})  # one more shingle makes the long text 2/3 alike
    assert simhash.similar(odd.limit(0)).count() == simhash.keep_one(odd.limit(0)).count() == 0


def test_keep_one_takes_the_same_row_of_repeated_ones(spark):
    rows = [(1, "a b c d e f", f"s{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    first = simhash.keep_one(docs).collect()
    assert len(first) == 1 and first == simhash.keep_one(docs.repartition(3, "gone_id")).collect()


@pytest.mark.parametrize("same", [True, False])
def test_walk_equals_all_pairs(same):
    rng = np.random.default_rng(3)
    draw = lambda n: np.sort(rng.integers(0, 1 << 12, n, dtype=np.uint64))
    a = draw(300)
    b = a if same else draw(200)
    pairs = [p for x, y in simhash.walk(a, b, same, 2, 0, 12) for p in zip(x.tolist(), y.tolist(), strict=True)]
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (i < j or not same) and int(a[i] ^ b[j]).bit_count() <= 2]
    assert sorted(pairs) == sorted(want)


def test_minimum_spanning_forest():
    rng = random.Random(2)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(20)) for _ in range(150)]
    left, right, cost = (np.array(x) for x in zip(*edges, strict=True))
    some = simhash.spanning(left, right, cost, n)
    root, total, count = list(range(n)), 0, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, c in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, count = total + c, count + 1
    assert (cost[some].sum(), len(some)) == (total, count)


def test_groups_around_the_threshold_keep_their_links(spark):
    """120 groups of eight edited copies, whose similarities lie on both sides of 0.8: links are held against all pairs."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(120):
        base = rng.choices(vocabulary, k=rng.choice((80, 150, 300)))
        rows += [" ".join(edited(rng, base, rng.uniform(0.86, 0.93))) for _ in range(8)]
    found_, pairs = sets(rows), []
    for g in range(0, len(rows), 8):
        pairs += [(i, j) for i in range(g, g + 8) for j in range(i) if len(found_[i] & found_[j]) >= 0.8 * len(found_[i] | found_[j])]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    lost = sum(got[i] != got[j] for i, j in pairs)
    want = {d: c for d, c in slow_similar(range(960), rows)}
    print(f"{lost} of {len(pairs)} links lost, {sum(got[d] != want[d] for d in got)} of 960 texts elsewhere")
    assert lost <= 0.01 * len(pairs) and sum(got[d] != want[d] for d in got) <= 0.01 * 960


def test_links_that_the_tries_miss_are_found(spark):
    """With one trie, which finds a third of the links at 0.8, and a passage that all texts share: the components are those of brute force."""
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage, rows = rng.choices(vocabulary, k=20), []
    for _ in range(60):
        base = [*rng.choices(vocabulary, k=rng.choice((12, 40, 80, 150))), *passage]
        rows += [" ".join(edited(rng, base, rng.uniform(0.9, 0.99))) for _ in range(5)]
    got = simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), trees=1)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == set(slow_similar(range(300), rows))


def test_candidates_of_unrelated_texts_stay_few(spark):
    """Candidates for each text do not grow with the corpus: nothing is held back by sketches here, and 16 forests are kept."""
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(2000)]
    each = []
    for n in (2000, 8000, 32000):
        docs = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(n)], "doc_id long, text string").repartition(8)
        marked = simhash.marks(docs, "doc_id", "text", 5, simhash.TREES, simhash.SAMPLE, simhash.BITS)
        each.append(simhash.candidates(marked.select("class", "fps", "sketch"), far=128, forests=16).count() / n)
    print("candidates a text:", each)
    assert max(each) < 0.001


def test_candidates_of_documents_stay_flat(spark):
    """Distinct texts of the test documents, which share passages and lines; near copies are a part of them at all sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").dropDuplicates(["text"])
    each = []
    for n in (2000, 8000):
        marked = simhash.marks(docs.orderBy(F.xxhash64("text")).limit(n), "doc_id", "text", 5, simhash.TREES, simhash.SAMPLE, simhash.BITS)
        one = marked.dropDuplicates(["class"])
        each.append((simhash.candidates(one, far=128, forests=16).count() + 1) / n)
    print("candidates a text:", each)
    assert max(each) < 0.5


def test_forests_keep_all_links_of_thin_cuts():
    rng = random.Random(4)
    for _ in range(30):
        n = 12
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(30)})
        left, right = (np.array(x) for x in zip(*edges, strict=True))
        links = simhash.Links(n, 2)
        for i in range(0, len(edges), 7):
            links.add(left[i : i + 7], right[i : i + 7], np.array([rng.randrange(9) for _ in edges[i : i + 7]]))
        x, y, _ = links.thinned()
        kept = set(zip(x.tolist(), y.tolist(), strict=True))
        assert kept <= set(edges)
        for bits in range(1, 1 << (n - 1)):  # all cuts of the nodes into two
            across = lambda e, bits=bits: (bits >> e[0] & 1) != (bits >> e[1] & 1)
            cut_, held = sum(map(across, edges)), sum(map(across, kept))
            assert held >= min(2, cut_)


def test_maps_show_that_long_sets_differ(spark):
    """Long texts that share a passage meet by it, but no whole text is fetched for them; pairs similar enough, of equal size or not, stay."""
    rng = np.random.default_rng(15)
    draw = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    passage = draw(200)
    sets = [np.union1d(draw(5000), passage) for _ in range(30)]
    for n in (3, 30, 300, 8100, 20000):  # four fifths of the first one's shingles and more, without others and with some
        one = draw(n)
        sets += [one, np.delete(one, rng.choice(len(one), n // 5, replace=False)), np.union1d(np.delete(one, rng.choice(len(one), n // 10, replace=False)), draw(n // 10))]
    common = np.zeros(1 << simhash.PLACES, np.int64)
    rows = [(i, len(s), simhash.prefix(s, common, 0.8).view(np.int64).tolist(), simhash.bitmap(s).tolist()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "class long, n long, prefix array<long>, map array<long>").cache()
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    met = simhash.missed(table, spark.createDataFrame([], "u long, v long"), 0.8)
    assert len(want) >= 10 and want | {(i, j) for j in range(30) for i in range(j)} <= {(r.u, r.v) for r in met.collect()}
    left = {(r.u, r.v) for r in simhash.near(met, table, 0.8).collect()}
    assert want <= left and min(i for i, _ in left) >= 30


def test_estimates_of_size_stay_small_over_rounds(spark):
    """A long path takes many rounds of joins; the planner's estimates of the sizes don't multiply from one to the next."""
    links = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    for _ in range(2):
        roots = simhash.components(links)
        assert roots.count() == 3001 and roots.where("root <> 0").isEmpty()
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        assert roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
