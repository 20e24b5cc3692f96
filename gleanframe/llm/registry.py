"""The operators' queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import alignment, ann, byte_bpe, chat, codes, langid, mixing, packing, quality, secrets, simhash, token_cache, topk


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_table(spark, folder, "embeddings"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"], tokens=False)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_cache.count_tokens(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(_table(spark, folder, "conversations"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality.learn(docs, labels, F.col("quality") + 1 - F.col("toxic"), 3)
    return quality.grade_documents(docs, model)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(_table(spark, folder, "embeddings"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return langid.predict(docs, langid.learn(docs))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.schedule(_table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, folder, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_ann, op3_byte_bpe, op4_token_counts, op5_chat, op6_quality, op7_secrets, op8_topk, op9_language, op10_mixing, op11_alignment, op12_packing, op13_codes,
    )
}


def _codes_sql(parts: int = 8, words: int = 16, rounds: int = 6) -> str:
    """The rounds of :func:`codes.compress` written out, for vectors of one length with distinct ids."""
    steps = [f"""
        k AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x, CAST(len(embedding) / {parts} AS BIGINT) AS w FROM embeddings
            WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ),
        p AS MATERIALIZED (SELECT vec_id, part, list_slice(x, part * w + 1, part * w + w) AS y FROM k, (SELECT unnest(range({parts})) AS part)),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {words}),
        b0 AS MATERIALIZED (SELECT part, e, y AS c FROM p JOIN s USING (vec_id))"""]  # fmt: skip
    for n in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"""
        a{n} AS MATERIALIZED (
            SELECT vec_id, part, any_value(y) AS y, arg_min(e, d * {words} + e) AS e, min(d) AS d
            FROM (SELECT vec_id, p.part, y, e, CAST({apart} AS BIGINT) AS d FROM p JOIN b{n} AS b ON p.part = b.part) GROUP BY vec_id, part
        )""")
        if n < rounds:
            steps.append(f"""
        u{n} AS (
            SELECT part, e, list(CAST((t - ((t % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c
            FROM (SELECT part, e, i, sum(v) AS t, count(*) AS n FROM (SELECT part, e, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM a{n}) GROUP BY part, e, i) GROUP BY part, e
        ),
        b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(u.c, b.c) AS c FROM b{n} AS b LEFT JOIN u{n} AS u ON u.part = b.part AND u.e = b.e)""")
    return f"""
        WITH {",".join(steps)},
        r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k ON r.vec_id = k.vec_id, h
    """


ORACLE_SQL = {
    "op5_chat": r"""
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, lower(trim(coalesce(role, ''))) AS r, trim(coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL
        ), whole AS (
            SELECT conv_id, list(r || chr(31) || x ORDER BY turn, r, x) AS l,
                   string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10), '' ORDER BY turn, r, x) AS rendered
            FROM turns GROUP BY conv_id
        ), one AS (
            SELECT min(conv_id) AS conv_id, l, min(rendered) AS rendered FROM whole GROUP BY l
        ), begun AS (
            SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM one)
        )
        SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(len(l) AS BIGINT) AS n_turns, rendered FROM one WHERE l NOT IN (SELECT l FROM begun)
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "op13_codes": _codes_sql(),
}
