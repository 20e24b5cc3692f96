"""Token counts behind a digest cache.

A text's key is the SHA-256 of its normalised content together with a digest of the tokenizer's file. Keys
that the cache table has need no tokenizer; of the others one text each is encoded, and the new counts are
appended to the cache. Counts are then joined to the rows by key.

Normalising collapses runs of ASCII white space to one space and trims them, which this tokenizer drops
anyway. Its pieces never hold white space, so a text's count is the sum over its white-space
separated parts; a task encodes each distinct part once with the library and keeps its count in a bounded memo.

Edge cases: a null text counts as empty (no bytes, no tokens); texts are never truncated; copies are encoded
once; repeated rows get a row each; null ids get a row like others; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import cut, small, word_chunks

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Distinct parts whose counts a task keeps before it starts anew.
MEMO_PARTS = 200_000


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


class _Counter(dict):
    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, text: bytes) -> int:
        total = 0
        for parts in word_chunks(text):
            new = [p for p in set(parts) if p not in self]
            if len(self) + len(new) > MEMO_PARTS:
                self.clear()
                new = list(set(parts))
            if new:
                found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
                self.update(zip(new, map(len, found), strict=True))
            total += sum(map(self.__getitem__, parts))
        return total


@lru_cache(1)
def _counter(path: str) -> _Counter:
    return _Counter(path)


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """``(digest, n_tokens)`` from ``(digest, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", F.col("text").cast("binary")).mapInArrow(run, "digest binary, n_tokens long")


def new_cache(docs: DataFrame) -> str:
    """A place for a cache of this session's own, in the shared checkpoint folder."""
    cut(docs.sparkSession.range(1))
    return f"{docs.sparkSession.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"


def read_cache(docs: DataFrame, cache: str) -> DataFrame:
    """The cache table at a path, empty if nothing is there yet."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def _described(docs: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_bytes, digest, text)``, the text normalised."""
    text = normalised(docs[text_col])
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.lit(label), text), 256))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest"), text.alias("text"))


def stored(docs: DataFrame, cache: str, label: str) -> DataFrame:
    """``(digest, n_tokens)`` that the cache holds for a tokenizer's version; if runs at once have added a digest twice, it counts once."""
    return cut(read_cache(docs, cache).where(F.col("version") == label).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def fill(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", rows: DataFrame | None = None) -> int:
    """Encodes one text for each digest that the cache lacks, appends the counts, and returns how many digests were added.

    ``rows`` are the documents' ``(doc_id, digest)``, if they are known. Of the rows to encode and the rows to leave out the
    fewer ones are joined to the texts, so that whole texts are shuffled only where both are many.
    """
    label = version(path)
    if rows is None:
        rows = cut(_described(docs, label, id_col, text_col).select("doc_id", "digest"))
    missing = rows.groupBy("digest").agg(F.min("doc_id").alias("one"), F.count("*").alias("n")).join(stored(docs, cache, label), "digest", "left_anti")
    short = lambda digest: F.xxhash64(digest).alias("short")
    wanted = cut(missing.select("digest", "one"))
    n, whole = wanted.count(), rows.count()
    if not n:
        return 0
    texts = _described(docs, label, id_col, text_col)
    keyed = texts["doc_id"].eqNullSafe(F.col("id")) & (F.xxhash64(texts["digest"]) == F.col("short"))
    if 2 * n <= whole:
        some = texts.join(small(cut(wanted.select(F.col("one").alias("id"), short("digest")))), keyed, "left_semi")
    else:
        is_one = rows.join(wanted.select("digest", F.col("one"), F.lit(True).alias("is_missing")), "digest", "left")
        rest = is_one.where(~F.coalesce(F.col("is_missing") & F.col("doc_id").eqNullSafe(F.col("one")), F.lit(False)))
        some = texts.join(small(cut(rest.select(F.col("doc_id").alias("id"), short("digest")).distinct())), keyed, "left_anti")
    found = encode_counts(some, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found.select("digest", F.lit(label).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    return n


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``; ``cache`` is a Parquet folder to use and extend.

    The cache is filled with what it lacks; then every row's count is the stored one.
    """
    cache, label = cache or new_cache(docs), version(path)
    rows = cut(_described(docs, label, id_col, text_col).drop("text"))
    fill(docs, path, cache, id_col, text_col, rows)
    # both sides are tables, so Spark can split a digest that many rows have
    return rows.join(stored(docs, cache, label), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
