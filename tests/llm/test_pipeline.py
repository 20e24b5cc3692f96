"""The pipeline against plain versions of its decisions, and every stage on odd tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import byte_bpe, mixing
from gleanframe.llm.registry import tokenizer
from gleanframe.llm.secrets import MASK
from tests.llm.test_operators import DOCS, LONG, pandas
from tests.llm.test_similar import slow_similar
from tests.llm.test_twins import slow_language, slow_mix, slow_profiles


def test_run(spark, sf01):
    import public_tokenizers
    import tiktoken

    docs = pandas(spark, sf01, "documents").astype({"doc_id": object})
    profiles = slow_profiles(zip(docs.doc_id, docs.text, docs.lang, strict=True))
    docs = docs[[slow_language(profiles, t)[0] != "und" for t in docs.text]]
    stands = {c for _, c in slow_similar(docs.doc_id.tolist(), docs.text.tolist())}
    docs = docs[docs.doc_id.isin(stands)]
    text = {d: re.sub(r'(?i)(token = ")[0-9a-f]{40}(?=")', rf"\g<1>{MASK}", t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert any(MASK in t for t in text.values())
    keyed = spark.createDataFrame(list(text.items()), "doc_id long, text string").select("doc_id", mixing.shuffle_key(F.col("doc_id"), F.col("text")).alias("key"))
    key = {r.doc_id: r.key for r in keyed.collect()}
    taken = slow_mix([(d, s, key[d], len(re.findall(r"[^\x20\x09-\x0D]+", text[d]))) for d, s in zip(docs.doc_id, docs.source, strict=True)])
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    found = corpus_pipeline.run(spark, sf01).collect()
    assert Counter(r.doc_id for r in found) == Counter({d: n for (d, _), n in taken.items()})
    words = {i: t for t, i in byte_bpe.load_ranks(path).items()}
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    for r in found:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.source, r.n_tokens, r.token_ids) == (source[r.doc_id], len(ids), ids)
        assert r.token_starts == np.cumsum([0, *(len(words[i]) for i in ids)])[:-1].tolist()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_unlearned_languages_go(spark, sf001):
    import base64
    import random

    rng = random.Random(3)
    learned = spark.read.parquet(f"{sf001}/documents.parquet")
    clean = ["hello", "the house is red", "la casa es roja", "le chat est noir", "der Hund und die Katze"]
    strange = ["Это совершенно другой язык и другое письмо", "这是一种完全不同的语言", "これは日本語です", "Ελληνικά γράμματα εδώ", "1 2 3"]
    strange += [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 400, 3000)]
    strange += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)) for n in (30, 300)]
    columns = ["doc_id", "text"]
    more = spark.createDataFrame(list(enumerate(clean + strange, 1_000_000)), "doc_id long, text string")
    docs = learned.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf001).select(*columns).collect()}
    assert {r.doc_id for r in learned.collect()} <= kept
    assert {d for d in kept if d >= 1_000_000} == set(range(1_000_000, 1_000_000 + len(clean)))


CLASHING = """whole_text ids starts found gaps kept lengths runs gone_id gone_hash whole_row class best fp fps sketch text_hash id key first every copies low high last taken copy
    size _s _taken _copy _keep_id _keep_hash _found _gaps _whole_text part score lang_pred _low _high _last""".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(0, None), (1, ""), (2, "one two three"), (2, "one two three"), (3, LONG), (4, LONG), (None, "neither null nor void"), (None, None), (5, 'token = "0123456789abcdef0123456789abcdef01234567"')]
    names = CLASHING  # further columns that are named as operators name their own
    odd = spark.createDataFrame([(i, t, "en", ("a", None)[n % 2], None, *["x"] * len(names)) for n, (i, t) in enumerate(rows)], f"{DOCS.split(', fp')[0]}, {', '.join(f'`{c}` string' for c in names)}")
    out = stage(spark, odd, "")
    assert name == "tokens" or out.columns == odd.columns
    held = [r.asDict() for r in out.collect()]
    ids = Counter(r["doc_id"] for r in held)
    texts = Counter((r.doc_id, r.text) for r in odd.collect())
    if name == "tokens":
        path = tokenizer("byte_bpe_multi_50k.tiktoken")
        known = byte_bpe.load_ranks(path)
        import public_tokenizers
        import tiktoken

        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        want = Counter()
        for (i, t), n in texts.items():
            encoded = library.encode_ordinary(t or "")
            want[i, len(encoded), hashlib.sha256(np.array(encoded, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += n
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in held) == want
    else:
        assert all(r[c] == "x" for r in held for c in names)  # further columns as they were
    if name == "language":  # no letter, no language; all others are in the one that is learned, repeated rows alike
        assert ids.keys() <= {2, 3, 4, 5, None} and ids[2] in (0, 2) and ids[3] == ids[4] == 1
        assert {r["lang"] for r in held} == {"en"}
    if name == "near_duplicates":  # null and empty texts are one class, so are the long ones and the repeated ones
        assert Counter((r["doc_id"], r["text"]) for r in held) == Counter([(0, None), (2, "one two three"), (3, LONG), (None, "neither null nor void"), rows[-1]])
    if name == "secrets":
        assert Counter((r["doc_id"], r["text"]) for r in held) == Counter({(i, t.replace("0123456789abcdef0123456789abcdef01234567", MASK) if i == 5 else t): n for (i, t), n in texts.items()})
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in held)
    if name == "mixture":  # texts without a word are never taken, no document more than three times, repeated rows together
        assert ids.keys() <= {2, 3, 4, 5, None} and all(n <= 3 * texts[i, t] for (i, t), n in Counter((r["doc_id"], r["text"]) for r in held).items()) and ids[2] % 2 == 0
        assert all((r["doc_id"], r["text"]) in texts and r["text"] for r in held)
    none = stage(spark, odd.limit(0), "")
    assert none.count() == 0 and none.columns == out.columns
