"""Secrets: extraction, the forest against a plain version of its votes, masks and offsets."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import registry, secrets
from tests.llm.test_operators import DOCS, LONG, pandas

HEX = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture(scope="module")
def learned(spark, sf01):
    return secrets.learn(spark.read.parquet(f"{sf01}/documents.parquet"))


def described(findings, forest):
    return findings.select("label", F.struct(*secrets.features(F.col("before"), F.col("candidate"), F.col("after"), forest.known)).alias("r"))


def test_votes_equal_a_plain_walk_of_the_trees(spark, sf01, learned):
    """On findings from other documents and other values than those learned from."""
    rows = described(secrets.labelled_findings(spark.read.parquet(f"{sf01}/documents.parquet"), n=2000, seed=7), learned)
    rows = rows.select("label", "r", F.expr(learned.vote("r")).alias("vote")).collect()

    def walk(node, row):
        while not isinstance(node, float):
            feature, threshold, left, right = node
            node = left if row[feature] <= threshold else right
        return node

    for r in rows:
        assert r.vote == pytest.approx(sum(walk(t, r.r) for t in learned.trees) / len(learned.trees))
    right = [(r.vote >= 0.5) == (r.label == 1) for r in rows]
    assert sum(right) / len(right) > 0.98
    assert {r.label for r in rows} == {0, 1}


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        (f'the token = "{HEX}" is it', HEX),
        ("API_KEY=0123456789abcdef0123456789abcdef", "0123456789abcdef0123456789abcdef"),
        ("export password: hunter2!Secret", "hunter2!Secret"),
        ('AWS_SECRET_ACCESS_KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEY"', "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEY"),
        ("https://x.com/a?api_key=9f8e7d6c5b4a39281706f5e4d3c2b1a0&b=1", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"),
        ('password = "Tr0ub4dor&3xyz"', "Tr0ub4dor&3xyz"),
        ("postgres://bob:s3cr3tPa55@db.host/x", "s3cr3tPa55"),
        ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8", None),
        ("see org.apache.spark.sql.functions", None),
        ('password = os.environ["X"]', None),
        ("file /usr/local/lib/python/site-packages/numpy", None),
        ('sha256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"', None),
        ("550e8400-e29b-41d4-a716-446655440000", None),
    ],
)
def test_shapes(spark, learned, text, secret):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = secrets.scan(docs, learned).collect()
    assert [text[r.start : r.start + r.length] for r in rows] == ([secret] if secret else [])
    masked = secrets.redact(docs, learned).first().text
    assert masked == (text.replace(secret, secrets.MASK) if secret else text)


def test_planted(spark, sf01):
    docs = pandas(spark, sf01, "documents")
    planted = {(d, m.start(1), m.end(1) - m.start(1)) for d, t in zip(docs.doc_id, docs.text, strict=True) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert {(r.doc_id, r.start, r.length) for r in registry.op7_secrets(spark, sf01).collect()} == planted


def test_offsets_in_a_text_with_many_candidates(spark, learned):
    parts = [f'é name{i} {"long" * 5}.{i} secret = "{HEX}" ' if i % 3 else f"commit {HEX} " for i in range(900)]
    text = "".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = secrets.scan(docs, learned).collect()
    want = [m.start(1) for m in re.finditer(f'secret = "({HEX})"', text)]
    assert sorted(r.start for r in rows) == want
    assert {(r.length, text[r.start : r.start + r.length]) for r in rows} == {(40, HEX)}


def test_all_documents_teach(spark):
    """A word counts in each of many documents, a line stands in each, and each one's candidates are look-alikes."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("see wordy org.apache.spark.n"), F.col("id").cast("string"), F.when(F.col("id") % 1000 == 0, " seldomly").otherwise("")).alias("text"))
    known = secrets.language(docs)
    assert {"wordy", "seldomly"} <= set(known.words)
    found = secrets.labelled_findings(docs, n=1000)
    own = found.where("candidate like 'org.apache.spark.n%'")
    assert own.select("candidate").distinct().count() == 5000
    total = {r.label: (r.n, r.weight) for r in found.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    assert total[1][0] > 1000 and total[1][1] == pytest.approx(total[1][0] / 5)  # 5,000 lines that weigh 1,000


def test_odd(spark, learned):
    texts = [None, "", "  ", LONG, f'the token = "{HEX}" is it']
    rows = [(i, t, None, None, None, "x", None, "y") for i, t in enumerate(texts)] + [(4, texts[4], None, None, None, "x", None, "y"), (None, texts[4], None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, DOCS)
    assert Counter((r.doc_id, r.start, r.length) for r in secrets.scan(odd, learned).collect()) == Counter({(4, 13, 40): 2, (None, 13, 40): 1})
    masked = secrets.redact(odd, learned)
    assert masked.columns == odd.columns
    assert Counter(r.text for r in masked.collect()) == Counter([*texts[:4], *['the token = "[SECRET]" is it'] * 3])
    none = odd.limit(0)
    assert secrets.scan(none, learned).count() == secrets.redact(none, learned).count() == 0
    alone = secrets.learn(none)  # from generated lines only
    assert secrets.scan(odd, alone).count() == 3


def test_the_same_forest_however_the_rows_are_dealt(spark, sf01, learned):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    again = secrets.learn(docs.orderBy(F.xxhash64("doc_id")).repartition(5))
    assert again.known.words == learned.known.words
    assert again.known.pairs == learned.known.pairs
    assert again.trees == learned.trees


def slow_features(before, candidate, after, known):
    """The features one by one, as plain Python has them."""
    left, low, n = before.lower(), candidate.lower(), len(candidate)
    count = lambda pattern: len(re.findall(pattern, candidate)) / n
    spaced = re.sub("(?<=[a-z])(?=[A-Z])", " ", candidate).lower()
    place = [secrets._CHARS.find(c) + 1 for c in low]
    likely = sum(known.pairs[a * 37 + b] for a, b in zip(place, place[1:], strict=False)) / max(n - 1, 1)
    return {
        "length": math.log2(n), "digits": count("[0-9]"), "uppers": count("[A-Z]"), "switches": count("[a-z](?=[0-9A-Z])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9])"), "repeats": count(r"(.)(?=\1)"),
        "distinct": len(set(low)) / min(n, 36), "hex_only": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", candidate))), "numeric": float(bool(re.fullmatch(r"[0-9.\-]+", candidate))), "symbols": count("[^A-Za-z0-9+/_.=-]"),
        "likely": likely, "covered": sum(len(w) for w in re.findall("[a-z]{4,}", spaced) if w in set(known.words)) / n, "stop": float(any(w in low for w in secrets.STOPS)),
        "slashes": low.count("/") / n, "dots": low.count(".") / n, "dashes": (low.count("_") + low.count("-")) / n, "assigned": float(bool(re.search(r"[=:]\s*[\"'`]?$", left))), "quoted": float(left[-1:] in tuple("\"'`")),
        "secret_before": float(any(w in left for w in secrets.SECRET_WORDS)), "other_before": float(any(w in left for w in secrets.OTHER_WORDS)), "url_before": float(bool(re.search(r"://[^\s]*$", left))), "at_after": float(after.startswith("@")),
        "known_form": float(bool(re.match(r"(AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[baprs]-|[sr]k_(live|test)_|glpat-|AIza|eyJ[A-Za-z0-9_-]+\.)", candidate))),
    }


def test_features_equal_plain_ones(spark, sf01, learned):
    """On the findings of generated lines and of documents."""
    found = secrets.labelled_findings(spark.read.parquet(f"{sf01}/documents.parquet"), n=1500, seed=3)
    rows = found.select("before", "candidate", "after", F.struct(*secrets.features(F.col("before"), F.col("candidate"), F.col("after"), learned.known)).alias("r")).collect()
    assert len(rows) > 1000
    for r in rows:
        want = slow_features(r.before, r.candidate, r.after, learned.known)
        got = r.r.asDict()
        assert set(want) == set(got) == set(secrets.FEATURES)
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}, (r.before, r.candidate)
