"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import ann, byte_bpe, chat, langid, mixing, quality, registry, simhash, token_cache, topk

LONG = "word salad " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and columns with clashing names."""
    texts = [None, "", "   \n\t", "one", "one two", "one two three", LONG, LONG, "Ünï cödé 中文 字 😀", "a b", 'the token = "0123456789abcdef0123456789abcdef01234567" is it']
    rows = [(i, t, ("en", None)[i % 2], ("s1", None, "s2")[i % 3], None, "x", None, "y") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "one two three", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pandas(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet").toPandas()


# --- 1


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return Counter((doc, min((d for d in g if d is not None), default=None)) for g in groups.values() for doc in g)


def test_simhash_equals_brute_force(spark, sf001):
    docs = pandas(spark, sf001, "documents")
    rows = [(d, slow_fingerprint(t)) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    found = registry.op1_simhash(spark, sf001).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == dict(rows)
    assert Counter((r.doc_id, r.component_id) for r in found) == slow_components(rows)


def test_simhash_odd(spark, odd, none):
    found = simhash.near_duplicates(odd).collect()
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in odd.collect()]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in found) == Counter(rows)
    assert Counter((r.doc_id, r.component_id) for r in found) == slow_components(rows)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd, simhash.near_duplicates(odd))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert simhash.keep_one(none, simhash.near_duplicates(none)).count() == 0


def test_trie_links_in_dense_regions(spark):
    """Many fingerprints around a few centres, so nodes must be split deep into the trie."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(250)} | {rng.getrandbits(64) for _ in range(200)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.trie_links(spark.createDataFrame([(f, f) for f in fps], "fp long, id long"), leaf=16)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want = slow_components([(f, f % (1 << 64)) for f in fps])
    assert Counter((f, roots.get(f, f)) for f in fps) == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# --- 2 and 8


def vectors(spark, folder):
    v = pandas(spark, folder, "embeddings")
    return v.vec_id.to_numpy(), np.stack(v.embedding.to_numpy()).astype(np.float64)


def test_ann_recall(spark):
    from tests.conftest import DATA

    ids, x = vectors(spark, f"{DATA}/sf0.1")
    found = registry.op2_ann(spark, f"{DATA}/sf0.1").collect()
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append(r)
    hits = 0
    for q in ids[ids % 100 == 0]:
        apart = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        apart[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, apart))[:10]])
        rows = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert np.allclose([r.score for r in rows], [apart[ids == r.vec_id][0] for r in rows], rtol=1e-12)
        hits += len(want & {r.vec_id for r in rows})
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()


def recall(x, found, every=100, k=10):
    """The part of the true nearest in ``found``, for vectors numbered from 0."""
    ids, by = np.arange(len(x)), defaultdict(set)
    for r in found:
        by[r.query_id].add(r.vec_id)
    hits = []
    for q in ids[::every]:
        apart = ((x - x[q]) ** 2).sum(1)
        apart[q] = np.inf
        hits.append(len(by[q] & set(ids[np.lexsort((ids, apart))[:k]].tolist())) / k)
    return np.mean(hits)


def test_ann_recall_of_many_cells_and_jittered_copies(spark):
    rng = np.random.default_rng(4)
    spread = (rng.normal(size=(300, 1, 64)) * 0.5 + rng.normal(size=(300, 40, 64))).reshape(-1, 64)
    copies = spread[0] + 0.01 * rng.normal(size=(6000, 64))
    x = np.concatenate([spread, copies])[rng.permutation(18_000)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = recall(x, ann.search(v).collect())
    print(f"recall {found:.3f}")
    assert found >= 0.95


def test_topk_is_exact(spark, sf01):
    ids, x = vectors(spark, sf01)
    whole = np.floor(1024 * x).astype(np.int64)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in registry.op8_topk(spark, sf01).collect()}
    for q in ids[ids % 100 == 0]:
        score = whole @ whole[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        assert [found[q, k + 1] for k in range(10)] == [(ids[i], score[i]) for i in order]


def check_topk(x, found):
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    whole = np.array([[math.floor(1024 * c) for c in row] for row in x.tolist()], object)
    for q in range(0, len(x), 100):
        score = [int(s) for s in whole @ whole[q]]
        order = [i for i in sorted(range(len(x)), key=lambda i: (-score[i], i)) if i != q][:10]
        assert [found.get((q, k + 1)) for k in range(len(order))] == [(i, score[i]) for i in order]


def vector_table(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def test_topk_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 1, 8)) * 3 + rng.normal(size=(12, 150, 8)) * 0.05).reshape(-1, 8)
    x[:400] = x[0]  # many copies
    rows = topk.search(vector_table(spark, x), block=64, annulus=16, queries=5, pivots=8, counted=True).collect()
    check_topk(x, rows)
    share = np.mean([r.scanned for r in rows]) / len(x)
    print(f"scanned {share:.2f}")
    assert share < 0.5


@pytest.mark.parametrize("size", [1e2, 1e5, 1e6])
def test_topk_of_large_components(spark, size):
    """Products beyond what doubles and 64-bit integers hold on the way; no finite vector is left out."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(230, 3))
    x[::7] *= size
    x[5] = [70000.0, 1.0, 0.0]
    check_topk(x, topk.search(vector_table(spark, x), block=32, annulus=8, pivots=4).collect())


def test_topk_says_so_if_a_score_does_not_fit(spark):
    v = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        topk.search(v).collect()


@pytest.mark.parametrize("search", [ann.search, topk.search])
def test_vectors_odd(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, None, "b"), (2, [nan, 1.0], "c"), (3, [inf, 1.0], "d"), (4, [1.0, None], "e"), (5, [0.5, 0.5], "f"), (100, [0.5, 0.5], "g"), (None, [1.0, 1.0], "h"), (7, [1.0, 2.0, 3.0], "i"), (5, [0.5, 0.5], "f")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in search(v).collect())
    if search is ann.search:
        assert found == [(0, 1, 5), (0, 2, 100), (100, 1, 5), (100, 2, 0)]
    else:
        assert found == [(0, 1, 5), (0, 2, 100), (100, 1, 0), (100, 2, 5)]
    assert search(v.where("vec_id < 0")).count() == 0


# --- 3


@pytest.fixture(scope="module")
def tiktoken():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def test_byte_bpe_query(spark, sf001, tiktoken):
    docs = pandas(spark, sf001, "documents")
    want = {d: tiktoken[1].encode_ordinary(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in registry.op3_byte_bpe(spark, sf001).collect():
        ids = np.array(want[r.doc_id], "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_byte_bpe_boundaries_of_random_strings(tiktoken):
    path, library = tiktoken
    rng = random.Random(1)
    letters = [*"ab's'stmdrevl  \n\t\r é中1２½_-!", "　", "’", "\U0001d4b3", "\U0001f600"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["x" * 5000, "ab" * 3000, " " * 9000 + "a", ""]
    ids, starts, counts = byte_bpe.encode_texts(texts, path)
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)] == [library.encode_ordinary(t) for t in texts]
    assert byte_bpe.decode_tokens(ids, starts, counts, path) == [t.encode() for t in texts]


def test_byte_bpe_odd(spark, odd, none, tiktoken):
    path, library = tiktoken
    tokens = byte_bpe.encode(odd, path)
    assert tokens.columns == [*odd.columns, "token_ids", "token_starts"]
    for r in byte_bpe.decode(tokens, path).collect():
        assert r.token_ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(none, path), path).count() == 0


# --- 4


def token_cache_key(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "").strip(" ")


def test_token_counts_with_one_text_in_most_rows(spark):
    path = registry.tokenizer("word_bpe_49k.json")
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("the hot text").alias("text"))
    found = token_cache.count_tokens(rows, path).toPandas()
    assert len(found) == 3000 and found[found.doc_id % 10 != 0].n_tokens.nunique() == 1


def test_token_counts(spark, sf001, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = pandas(spark, sf001, "documents")
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    want = {d: (len(t.encode()), count(t), count(t) > 2048) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op4_token_counts(spark, sf001).collect()}
    assert found == want
    cache = str(tmp_path / "cache")
    strange = odd.unionByName(odd.limit(1).withColumn("text", F.lit("x<|endoftext|>y  <|STARTOFTEXT|> Σ'S ΑΣ İ é   don't 123")).withColumn("doc_id", F.lit(99).cast("long")))
    for _ in range(2):
        found = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_cache.count_tokens(strange, path, cache).collect())
        assert found == Counter((r.doc_id, len((r.text or "").encode()), count(r.text)) for r in strange.collect())
    stored = token_cache.read_cache(odd, cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second run added nothing
    assert token_cache.fill(strange, path, cache) == 0
    half = str(tmp_path / "half")
    assert token_cache.fill(strange.where("doc_id > 5"), path, half) > 0
    changed = token_cache.read_cache(odd, half).withColumn("n_tokens", F.col("n_tokens") + 1000)
    changed.write.parquet(str(tmp_path / "other"))
    found = {(r.doc_id, r.n_tokens) for r in token_cache.count_tokens(strange, path, str(tmp_path / "other")).collect()}
    assert found == {(r.doc_id, count(r.text) + 1000 * any(token_cache_key(r.text) == token_cache_key(o.text) for o in strange.where("doc_id > 5").collect())) for r in strange.collect()}  # stored counts are used, only the rest is encoded
    assert token_cache.count_tokens(none, path).count() == 0


# --- 5


def test_chat(spark):
    a, b, c = ("system", "be good"), ("user", "hi"), ("Assistant ", " hello ")
    convs = {1: [a, b], 2: [a, b, c], 3: [a, b, c], 4: [b], 5: [b, a], 6: [(None, None)]}
    rows = [(k, i, role, text, "z") for k, turns in convs.items() for i, (role, text) in enumerate(turns)] + [(None, 0, "user", "x", "z"), (2, 0, *a, "z"), (7, None, "user", "last", "z"), (7, 5, "user", "first", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    found = {(r.conv_id, r.part): r.rendered for r in chat.render(turns, template="{role}:{text};").collect()}
    assert found == {(2, 0): "system:be good;user:hi;assistant:hello;", (5, 0): "user:hi;system:be good;", (6, 0): ":;", (7, 0): "user:first;user:last;"}
    parts = {(r.conv_id, r.part): r.rendered for r in chat.render(turns, template="{role}:{text};", part=2).collect()}
    assert parts[2, 0] + parts[2, 1] == found[2, 0]
    assert chat.render(turns.where("conv_id < 0")).count() == 0


# --- 6


def test_quality_on_documents_not_learned_from(spark):
    """A half that no choice has seen: sizes are chosen inside the half that is learned from."""
    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2))
    model = quality.learn(docs, labels.where(half == 0), F.col("quality") + 1 - F.col("toxic"), 3)
    scored = quality.grade_documents(docs, model).join(labels.where(half == 1), "doc_id").toPandas()
    clean = (scored.quality == 1) & (scored.toxic == 0)
    print(f"right {(scored.keep == clean).mean():.3f}, clean kept {scored.keep[clean].mean():.3f}, toxic kept {scored.keep[scored.toxic == 1].mean():.3f}, low kept {scored.keep[scored.quality == 0].mean():.3f}")
    assert (scored.keep == clean).mean() > 0.94
    assert scored.keep[clean].mean() > 0.98
    assert scored.keep[scored.toxic == 1].mean() < 0.35  # a fifth of them hold no word that clean ones lack
    assert scored.expected_grade.between(0, 2).all()


def test_quality_fit_equals_a_plain_optimiser():
    """The penalised likelihood that is reached, against gradient descent with numeric slopes on dense rows."""
    rng = np.random.default_rng(6)
    x = rng.random((120, 4)) < 0.5
    grades = np.clip((x @ np.array([2.0, -2.0, 1.0, 0.0]) + rng.normal(size=120)).round().astype(int) + 1, 0, 2)
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    model = quality.fit(rows, grades, 3, rounds=1500, ridge=1e-2, step=0.3, low=0.0)
    dense = np.zeros((120, 4))
    for i, r in enumerate(rows):
        at, size = quality.vector(r, model.rarity, model.marks)
        dense[i, at[at < 4]] = size[at < 4]

    def objective(p):
        tail = 1 / (1 + np.exp(-((dense @ p[:4])[:, None] - p[4:])))
        edges = np.concatenate([np.ones((120, 1)), tail, np.zeros((120, 1))], 1)
        likely = edges[np.arange(120), grades] - edges[np.arange(120), grades + 1]
        return -np.log(np.maximum(likely, 1e-12)).mean() + 0.5e-2 * (p[:4] ** 2).sum()

    p = np.array([0.0, 0.0, 0.0, 0.0, -1.0, 1.0])
    for _ in range(4000):
        slope = np.array([(objective(p + e) - objective(p - e)) / 2e-5 for e in 1e-5 * np.eye(6)])
        p -= 1.0 * slope
    reached = objective(np.concatenate([model.weights[:4], model.thresholds]))
    assert reached == pytest.approx(objective(p), abs=2e-3)
    assert np.allclose(model.thresholds, p[4:], atol=0.15)
    assert quality.loss(model, rows, grades) == pytest.approx(reached - 0.5e-2 * (model.weights[:4] ** 2).sum(), abs=1e-6)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (6, 1), (3, 1)], "doc_id long, grade int")
    model = quality.learn(odd, labels, F.col("grade"), 2)
    assert quality.grade_documents(odd, model).count() == odd.count()
    blank = quality.learn(odd, labels.limit(0), F.col("grade"), 2)
    assert {r.tail_probability for r in quality.grade_documents(odd, blank).collect()} == {0.5}
    assert quality.grade_documents(none, blank).count() == 0


# --- 7


# --- 9


def test_language(spark, sf01, odd, none):
    docs = pandas(spark, sf01, "documents").set_index("doc_id")
    found = registry.op9_language(spark, sf01).toPandas().set_index("doc_id")
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.index]).all()
    held = found[found.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.98
    assert found.score.between(0, 1).all()
    profiles = langid.learn(odd)
    rows = {(r.doc_id, r.text): (s.lang_pred, s.score) for r, s in zip(odd.collect(), langid.predict(odd, profiles).collect(), strict=True)}
    assert rows[0, None] == rows[1, ""] == rows[2, "   \n\t"] == ("und", 0.0)
    assert rows[6, LONG][0] == "en"
    assert langid.predict(none, profiles).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.learn(none)).collect()} == {"und"}
    kept = langid.keep_known(odd, profiles)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 10, None}


def test_language_ranks_equal_a_plain_count():
    text = "La casa, la Casa y el 4x4 niño"
    plain = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        plain.update([w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if not (n == 1 and w[i] == " ")])
    grams, times = langid.gram_counts(text)
    assert sorted(times.tolist()) == sorted(plain.values())


# --- 10


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def check_mix(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, most = Counter(), Counter(), Counter()
    for d in docs:
        sizes[d.source] += size(d.text)
        most[d.source] = max(most[d.source], size(d.text))
    want = slow_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d.doc_id, size(d.text)) for d in docs)
    for r in rows:
        assert r.copies <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    assert sum(taken.values()) <= sum(sizes.values())
    return taken


def test_mixing(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    plan = mixing.schedule(docs, bucket=64)
    taken = check_mix(docs.collect(), plan.collect())
    again = {(r.doc_id, r.copies) for r in mixing.schedule(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in plan.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in again if n})
    assert {r.source: r.words for r in mixed.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("words")).collect()} == dict(taken)
    ordered = mixing.mix(docs, ordered=True).collect()
    assert len(ordered) == mixed.count() and [r.virtual_time for r in ordered] == sorted(r.virtual_time for r in ordered)


def test_mixing_odd(spark, odd, none):
    check_mix(odd.collect(), mixing.schedule(odd, bucket=2).collect())
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.schedule(none).count() == mixing.mix(none).count() == 0
    blank = odd.withColumn("text", F.lit(" "))
    assert mixing.mix(blank).count() == 0 and {r.copies for r in mixing.schedule(blank).collect()} == {0}
