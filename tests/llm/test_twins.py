"""Plain versions of what operators decide, in Python without Spark or arrays."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from gleanframe.llm import langid, mixing, quality, registry
from gleanframe.llm.common import drawn
from tests.llm.test_operators import pandas, slow_targets

# --- language


def slow_grams(text):
    found = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f" {w} "
        found.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return found


def slow_rank(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: langid.PROFILE]]


def slow_profiles(docs):
    """From ``(doc_id, text, lang)``, all of them used."""
    total = {}
    for doc_id, text, lang in docs:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            total.setdefault(lang, Counter()).update(slow_grams(text))
    return {lang: {g: i for i, g in enumerate(slow_rank(c))} for lang, c in total.items()}


def slow_language(profiles, text):
    own = slow_rank(slow_grams(text))
    if not own or not profiles:
        return "und", 0.0
    apart = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (langid.PROFILE * len(own))


def test_language_equals_plain_profiles(spark, sf001):
    docs = pandas(spark, sf001, "documents")
    profiles = slow_profiles(zip(docs.doc_id.tolist(), docs.text, docs.lang, strict=True))
    found = {r.doc_id: (r.lang_pred, r.score) for r in registry.op9_language(spark, sf001).collect()}
    for d, t in zip(docs.doc_id.tolist(), docs.text, strict=True):
        lang, score = slow_language(profiles, t)
        assert found[d] == (lang, pytest.approx(score, abs=1e-9))


# --- mixing


def slow_mix(docs):
    """Fair queueing one copy at a time: ``{(doc_id, key): copies}`` from ``(doc_id, source, key, size)``."""
    sizes = Counter()
    for _, source, _, size in docs:
        sizes[source] += size
    target, queue = slow_targets(sizes), []
    for source in sizes:
        own = sorted((d for d in docs if d[1] == source), key=lambda d: d[2])
        served = 0
        for i, (doc_id, _, key, size) in enumerate(own):
            served += size
            if size:
                assert i == 0 or own[i - 1][2] != key
                queue += [(served / target[source] + e * (sizes[source] / target[source]), size, (doc_id, key)) for e in range(3)]
    taken, total, budget = Counter(), 0, sum(sizes.values())
    for _, size, who in sorted(queue, key=lambda x: x[0]):
        if total + size > budget:
            break
        total += size
        taken[who] += 1
    return taken


@pytest.mark.parametrize("bucket", [16, mixing.BUCKET])
def test_mixing_equals_plain_queueing(spark, sf01, bucket):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    key = mixing.shuffle_key(F.col("doc_id"), F.col("text"))
    rows = [(r.doc_id, r.source, r.key, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "source", "text", key.alias("key")).collect()]
    want = slow_mix(rows)
    assert {(r.doc_id, r.key): r.copies for r in mixing.schedule(docs, bucket=bucket).collect() if r.copies} == dict(want)
    if bucket == mixing.BUCKET:
        sizes = {r[0]: r[3] for r in rows}
        assert {r.doc_id: r.taken for r in registry.op10_mixing(spark, sf01).collect() if r.taken} == {d: n * sizes[d] for (d, _), n in want.items()}


# --- quality


def slow_quality_features(text):
    """The distinct buckets of words, endings and shapes, and of how much a text repeats itself."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if not words:
        return set()
    bucket = lambda f: xxhash.xxh32_intdigest(f) % quality.BUCKETS
    lower = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    out = set()
    for w in set(words):
        shape = re.sub(rb"[0-9]+", b"9", re.sub(rb"[a-z\x80-\xff]+", b"x", re.sub(rb"[A-Z]+", b"X", w)))
        out |= {bucket(b"w" + lower(w).strip(b".,;:!?\"'()")), bucket(b"e" + lower(w)[-3:]), bucket(b"s" + shape)}
    again = b"\x00repeats%d" % int(math.log2(len(words) / len(set(words))) * 2)
    return out | {bucket(b"w" + again)}


def test_grades_equal_plain_ones(spark, sf001):
    """A fitted model's scores from features found one by one, and grades from the thresholds one after the other."""
    docs, labels = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, F.col("quality") + 1 - F.col("toxic"), 3)
    got = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    texts = pandas(spark, sf001, "documents")
    for doc_id, text in zip(texts.doc_id, texts.text, strict=True):
        found = slow_quality_features(text)
        size = math.sqrt(sum(float(model.rarity[f]) ** 2 for f in found)) or 1.0
        score = sum(float(model.weights[f]) * float(model.rarity[f]) / size + float(model.weights[f + quality.BUCKETS]) * float(model.marks[f]) for f in found)
        tails = [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]
        assert got[doc_id].expected_grade == pytest.approx(sum(tails), abs=1e-4)
        assert got[doc_id].tail_probability == pytest.approx(tails[-1], abs=1e-4)


def test_rated_ids_that_repeat_count_once(spark):
    rows = [(i, f"word{i % 5} good text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows + [rows[0]] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int")
    once, often = (quality.learn(d, labels, F.col("grade"), 2) for d in (docs.dropDuplicates(), docs))
    assert (once.weights == often.weights).all() and (once.thresholds == often.thresholds).all()


# --- samples


@pytest.mark.parametrize("of", [10**7, 10**10, 10**15, 10**18])
def test_samples_are_as_large_at_any_size(spark, of):
    """The part of the hashes that is drawn, against a sixteen-millionth or less of them; none is empty because the table is large."""
    rows = max(1, of // 500_000)  # of two million hashes, four are to be expected
    n = spark.range(2_000_000).where(drawn(F.xxhash64("id"), rows, of)).count()
    assert 0 < n < 20
    assert spark.range(5).where(drawn(F.xxhash64("id"), 10, 5)).count() == 5
    last = drawn(F.lit(-(1 << 63)).cast("long"), 1, of)
    assert spark.range(1).where(last).count() == 1
