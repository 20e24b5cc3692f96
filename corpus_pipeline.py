"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read by the next.

language        drops documents whose language is not recognised (no letters, or like no learned profile)
near_duplicates keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more)
secrets         masks secrets inside the texts
mixture         repeats or drops documents so that sources reach their target weights
tokens          encodes the texts and decodes them again; a text that does not come back whole ends the job

In all stages further columns of the documents pass through, whatever their names; an empty table stays empty; texts are
taken whole, however long. Reruns find the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import byte_bpe, langid, mixing, secrets, simhash
from gleanframe.llm.common import cut
from gleanframe.llm.registry import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a learned language; ``lang`` is the predicted one from here on.

    Null and empty texts, those without a letter, and those that score too low go. A null ``lang`` teaches nothing;
    ties between languages go to the first in order; repeated rows are judged alike. Without any label all rows go.
    Profiles and the least score come from all labelled rows that are not held out.
    """
    chosen = langid.labelled(docs, per_language=None)
    profiles = langid.learn(docs, chosen=chosen)
    return langid.keep_known(docs, profiles, least=langid.least_score(chosen, profiles), lang_col="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity connect: that with the smallest id, null last.

    Texts without a word (null ones too) are copies of each other; repeated rows are one; of several texts with one
    id that stand for a group, the one with the smallest hash stays.
    """
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret in the text replaced by a mask, and ``n_chars`` counted anew (null for a null text)."""
    masked = secrets.redact(docs, secrets.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Texts without a word (null ones too) are never taken; a null source is a source of its own; repeated rows share
    one place in the order and are taken together.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids_sha256, decoded_sha256, token_ids, token_starts``, one row per row.

    A null text has no tokens, like an empty one. A text that its tokens do not decode to is an error.
    """
    return byte_bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), keep=["doc_id", "source"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mixture", mixture), ("tokens", tokens)]

#: Hashes, learned profiles and a random forest decide here, which SQL cannot express; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what lies between them is kept in the shared checkpoint folder, until the next is written."""
    cut(spark.range(1))  # makes sure of that folder
    folder, last = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
