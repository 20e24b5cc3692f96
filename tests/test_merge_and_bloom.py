"""Merges into buckets, Bloom filters that are united and added to, crawls to their end, robots paths, and queries whose results hold both outcomes."""

from __future__ import annotations

import logging
import os
import random
from urllib.parse import quote, unquote, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import admission, dedup, frontier, merge
from gleanframe.plans import registry

ROW = "id long, name string, value double"


def stamps(folder):
    """Each bucket's files with their times."""
    return {b: {f: os.stat(f"{folder}/{b}/{f}").st_mtime_ns for f in os.listdir(f"{folder}/{b}") if f.endswith(".parquet")} for b in os.listdir(folder) if b.startswith("_bucket=")}


def plain_merge(base, delta, policy):
    """A loop over the changes in order."""
    table = {r[0]: r for r in base}
    for i, name, value, _ in sorted(delta, key=lambda r: r[3]):
        if policy == "nothing":
            table.setdefault(i, (i, name, value))
        elif policy == "update" and i in table or policy in ("upsert", "overwrite"):
            table[i] = (i, name, value)
    return sorted(table.values())


@pytest.mark.parametrize("policy", ["nothing", "overwrite", "update", "upsert"])
def test_merge_rewrites_only_touched_buckets(spark, tmp_path, policy):
    rng = random.Random(4)
    base = [(i, f"n{i}", float(i)) for i in range(400)]
    at = merge.Bucketed(f"{tmp_path}/table", ("id",), 32)
    merge.create(spark.createDataFrame(base, ROW), at)
    assert len(stamps(at.folder)) == 32 and all(len(f) == 1 for f in stamps(at.folder).values())
    delta = [(rng.choice([3, 77, 390, 1000, 1001]), f"d{k}", k + 0.5, k) for k in range(12)]
    changes = spark.createDataFrame(delta, ROW.replace("id long", "id int") + ", seq long")  # another type of key
    before = stamps(at.folder)
    run = {"nothing": lambda: merge.insert(changes, at, "seq"), "overwrite": lambda: merge.insert(changes, at, "seq", "update"), "update": lambda: merge.update(changes, at, "seq"), "upsert": lambda: merge.upsert(changes, at, "seq")}[policy]
    touched = run()
    after = stamps(at.folder)
    assert 1 <= len(touched) <= 5
    for bucket, files in before.items():
        assert (after[bucket] == files) == (int(bucket.split("=")[1]) not in touched), bucket
    assert sorted(map(tuple, merge.read(spark, at).select("id", "name", "value").collect())) == plain_merge(base, delta, policy)


def test_merge_that_fails_or_changes_nothing(spark, tmp_path):
    at = merge.Bucketed(f"{tmp_path}/table", ("id",), 4)
    merge.create(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], ROW), at)
    before = stamps(at.folder)
    with pytest.raises(ValueError):
        merge.insert(spark.createDataFrame([(1, "c", 3.0, 1)], ROW + ", seq long"), at, "seq", "error")
    assert merge.upsert(spark.createDataFrame([], ROW + ", seq long"), at, "seq") == []
    assert merge.upsert(spark.createDataFrame([(None, "c", 3.0, 1)], ROW + ", seq long"), at, "seq") == []
    assert stamps(at.folder) == before


def test_filters_unite(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    size = dedup.bloom_size(3000, 1e-4)
    whole = dedup.bloom_build(keys, "k", size)
    parts = [dedup.bloom_build(keys.where(F.pmod(F.xxhash64("k"), F.lit(3)) == i), "k", size) for i in range(3)]
    assert sorted(map(str, dedup.bloom_union(*parts).collect())) == sorted(map(str, whole.collect()))
    plan = dedup.bloom_probe(keys, "k", spark.createDataFrame(whole.collect(), whole.schema), size)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # distinct keys, and the two sides of the join


def test_adding_tells_what_is_new(spark):
    """First rows of keys that are new are fresh; repetitions inside a batch and of earlier batches are not."""
    size = dedup.bloom_size(2000, 1e-6)
    held, known = dedup.bloom_build(spark.createDataFrame([], "fp string"), "fp", size), set()
    rng = random.Random(6)
    for batch in range(3):
        rows = [(f"f{rng.randrange(700)}" if rng.random() < 0.95 else None, batch * 1000 + i) for i in range(400)]
        found, held = dedup.bloom_add(spark.createDataFrame(rows, "fp string, seq long"), "fp", "seq", held, size)
        held = spark.createDataFrame(held.collect(), held.schema)
        want = {}
        for fp, seq in rows:
            want[seq] = fp is None or fp not in known
            known |= {fp} - {None}
        assert {r.seq: r.fresh for r in found.collect()} == want


def test_overfull_layers_are_told(spark, caplog):
    keys = spark.range(200).select(F.col("id").alias("k"))
    with caplog.at_level(logging.WARNING):
        dedup.layered_build(keys, "k", 10, 1e-3, most=2)
    assert "200 keys" in caplog.text


def test_crawl_of_a_chain_and_a_cycle(spark):
    """A chain of twenty pages that leads back, and pages that nothing leads to."""
    pages = [(f"http://h/{i}", f'<a href="/{(i + 1) % 21}">x</a><a href="/{max(i - 3, 0)}">y</a><a href="mailto:z">z</a>') for i in range(21)] + [("http://h/alone", '<a href="/0">x</a>')]
    table = spark.createDataFrame(pages, "url string, html string")
    seed = table.where("url = 'http://h/0'").select("url")
    assert {r.url: r.depth for r in frontier.crawl(seed, table, buckets=2).collect()} == {f"http://h/{i}": i for i in range(21)}
    assert frontier.crawl(seed, table, 3, buckets=2).count() == 4
    assert frontier.crawl(seed.limit(0), table, buckets=2).count() == 0


URLS = ["http://h/a b?x=1&y=*~", "http://h", "http://h/%7Efoo/", "http://h/p?", "http://h/ü#f", "http://h/p#", "HTTPS://u:p@h:8/a+b;c?d=e/f", "//h/x", "http://h/100%zz", "/only/path", "http://h/%E4%B8%AD"]


def test_robots_paths_equal_the_standard_library(spark):
    got = [r[0] for r in spark.createDataFrame([(u,) for u in URLS], "u string").coalesce(1).select(admission.robots_path(F.col("u"))).collect()]
    assert got == [quote(urlunparse(("", "", *urlparse(unquote(u))[2:]))) or "/" for u in URLS]


def test_delays_of_groups_as_given_last():
    text = "User-agent: a\nUser-agent: b\nFoo: bar\nUser-agent: c\nCrawl-delay: 1\nCrawl-delay: 2.5\nUser-agent: *\nCrawl-delay: 7\n# x\nUser-agent: a\nDisallow: /\nCrawl-delay: 9"
    assert [admission.crawl_delay(text, x) for x in "abcd"] == [9.0, 2.5, 2.5, 7.0]
    assert admission.crawl_delay("User-agent: a\nCrawl-delay: 3\nCrawl-delay: soon", "a") == 3.0


def test_waits_in_all_ways_of_writing_numbers(spark):
    rows = spark.createDataFrame([(".5",), ("+5",), ("1e3",), ("-2",), ("5.",), ("soon",), ("",), ("0x1",)], "h string").coalesce(1)
    found = [r[0] for r in rows.select(admission.retry_after(F.lit(429), F.col("h"), F.lit("2024-01-01").cast("timestamp"), 60.0)).collect()]
    assert found == [0.5, 5.0, 1000.0, 0.0, 5.0, None, None, None]


def test_backoff_without_a_cap(spark):
    row = spark.range(1).select(*(admission.retry_delay(F.lit(None).cast("double"), F.lit(n), 1.0, 0.5, most).alias(f"c{n}{int(most)}") for n in (1, 9) for most in (0.0, 60.0))).first()
    assert tuple(row) == (0.5, 0.5, 128.0, 60.0)


def test_results_hold_both_outcomes(spark, sf01):
    """Queries that could pass without doing anything."""
    docs, pages = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "pages"))
    of = lambda name: registry.QUERIES[name](spark, sf01)
    assert {r.allowed for r in of("robots_allowed").collect()} == {True, False}
    assert {r.done for r in of("all_idle").collect()} == {True, False}
    others = docs.where("source <> 'src1'")
    fresh = others.where("source <> 'src0'").select(F.md5("text")).distinct().count() + others.where("source = 'src0'").count()
    assert 0 < of("item_dedup").count() < fresh
    assert 0 < of("dead_letter_replay").count() < docs.where("lang = 'en'").count()
    assert 0 < of("seed_once").count() < pages.count()
    assert of("unseen_frontier").count() < frontier.discover(registry._linked(spark, sf01)).select("fp").distinct().count()
    assert of("frontier_fixpoint").agg(F.max("depth")).first()[0] > 5
    assert {r.maybe for r in of("bloom_membership").collect()} == {True, False}
