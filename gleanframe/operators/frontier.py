"""The frontier of requests: order, claims, leases, and expansion by links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.identity import canonical_url, join_url, links, request_fingerprint
from gleanframe.functions.lineage import bucketed, cut


def top(queue: DataFrame, n: int, *order: str) -> DataFrame:
    """The next ``n`` requests: smaller priority first, then in order of arrival."""
    return queue.orderBy(*(order or ("priority", "seq"))).limit(n)


def collapse(queue: DataFrame, payload: str = "payload", priority: str = "priority", seq: str = "seq") -> DataFrame:
    """One entry for each payload, with the priority it was given last."""
    return queue.groupBy(payload).agg(F.max_by(priority, seq).alias(priority))


def claim(queue: DataFrame, n: int, now: Column, lease: float, *order: str) -> DataFrame:
    """The next ``n`` requests with ``lease_until``; no lease (zero or less) leaves it null."""
    until = now + F.make_dt_interval(secs=F.lit(float(lease))) if lease > 0 else F.lit(None).cast("timestamp")
    return top(queue, n, *order).withColumn("lease_until", until)


def ack(inflight: DataFrame, done: DataFrame, key: str = "task_uid") -> DataFrame:
    """What is still in flight after some tasks, named by their unchanging id, are done."""
    return inflight.join(done.select(key), key, "left_anti")


def renew(inflight: DataFrame, beats: DataFrame, lease: float, key: str = "task_uid") -> DataFrame:
    """Leases extended to the last heartbeat plus ``lease``, for tasks still in flight only; never shortened."""
    last = beats.groupBy(key).agg(F.max("ts").alias("_beat"))
    longer = F.greatest("lease_until", F.col("_beat") + F.make_dt_interval(secs=F.lit(float(lease))))
    return inflight.join(last, key, "left").withColumn("lease_until", longer).drop("_beat")


def reclaim(inflight: DataFrame, now: Column, limit: int = 500, key: str = "task_uid") -> DataFrame:
    """The tasks whose lease has run out, oldest first, to be queued again before all others."""
    return inflight.where(F.col("lease_until") <= now).orderBy("lease_until", key).limit(limit).withColumn("priority", F.lit(0))


def discover(pages: DataFrame, depth: Column | int = 0, url: str = "url", html: str = "html") -> DataFrame:
    """``(parent, url, fp, depth)`` of the links on pages; links that aren't http(s) are left out."""
    found = pages.select(F.col(url).alias("parent"), (F.lit(depth) + 1 if isinstance(depth, int) else depth + 1).alias("depth"), F.explode(links(F.col(html))).alias("link"))
    found = found.select("parent", "depth", canonical_url(join_url(F.col("parent"), F.col("link"))).alias("url")).where(F.col("url").rlike("^https?:"))
    return found.withColumn("fp", request_fingerprint(F.lit("GET"), F.col("url")))


def crawl(seeds: DataFrame, pages: DataFrame, rounds: int | None = None, buckets: int | None = None) -> DataFrame:
    """``(fp, url, depth)`` reached from ``seeds(url)`` over stored ``pages(url, html)``: until nothing is new, or for ``rounds`` rounds.

    Pages are parsed once, into links kept in buckets of their page's fingerprint; what was reached is kept in such buckets
    too. So a round shuffles only the newest URLs and what they lead to, and neither links nor what was reached before.
    There are as many buckets as shuffles have partitions, unless told otherwise.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = request_fingerprint(F.lit("GET"), F.col("url"))
    page = pages.select(of.alias("of"), F.col("url").alias("page"))
    links_ = discover(pages).join(page, F.col("parent") == F.col("page")).groupBy("of", "fp").agg(F.min("url").alias("url"))
    links_ = spark.table(bucketed(links_, "of", buckets))
    newest = cut(seeds.select(of.alias("fp"), canonical_url(F.col("url")).alias("url")).groupBy("fp").agg(F.min("url").alias("url")).withColumn("depth", F.lit(0)))
    reached = bucketed(newest, "fp", buckets)
    depth = 0
    while (rounds is None or depth < rounds) and not newest.isEmpty():
        depth += 1
        asked = newest.select(F.col("fp").alias("of")).repartition(buckets, "of")
        found = links_.join(asked, "of").groupBy("fp").agg(F.min("url").alias("url")).repartition(buckets, "fp")
        newest = cut(found.join(spark.table(reached).select("fp"), "fp", "left_anti").withColumn("depth", F.lit(depth)))
        bucketed(newest, "fp", buckets, reached)
    return spark.table(reached)


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, expire: float) -> DataFrame:
    """Requests with the newest cached response, if it is there and fresh (``expire`` 0: always), and ``hit``.

    ``response`` is a struct of the cache's columns but ``fp``; null without a hit. Only GET is answered from the cache.
    """
    fresh = cache if expire == 0 else cache.where(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(float(expire))))
    kept = F.struct(*(c for c in cache.columns if c != "fp"))
    one = fresh.groupBy("fp").agg(F.max_by(kept, "fetched_at").alias("response"))
    met = requests.join(one, "fp", "left").withColumn("hit", F.col("response").isNotNull() & (F.col("method") == "GET"))
    return met.withColumn("response", F.when(F.col("hit"), F.col("response")))
