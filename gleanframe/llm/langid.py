"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (one to three characters of words,
padded with a blank) in order of frequency. A document's own list is compared with each profile: every
n-gram adds how many places it is out of place, or the greatest distance if the profile lacks it. The
language with the smallest sum is predicted; the score is one minus that sum's part of its maximum.

Profiles are learned from a bounded sample of the labelled rows: at most about ``per_language`` documents for
each language, chosen by a hash of the id. Predictions cover every whole text.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing could be
learned; ties go to the language first in order; rows with a null label or id teach nothing; repeated rows
get a row each; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm.common import cut, tidy

PROFILE = 300
#: Documents for each language from which profiles are learned, about, and languages (those with most documents) that are.
PER_LANGUAGE, LANGUAGES = 2000, 1000
#: A text is like no learned profile if its score is below ``MARGIN`` times the ``LOWEST`` quantile of learned texts' scores.
LOWEST, MARGIN = 0.01, 0.65
#: Words whose n-grams a task keeps before it starts anew.
MEMO_WORDS = 150_000
_WORD, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"\s")
_CHUNK = 1 << 22


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _words(text: str) -> Counter:
    found: Counter = Counter()
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + _CHUNK) if start + _CHUNK < len(text) else None
        end = gap.start() if gap else len(text)
        found.update(_WORD.findall(text[start:end].lower()))
        start = end
    return found


def _grams(word: str) -> bytes:
    """The 1- to 3-grams of a padded word; each is its code points, 21 bits each, in one integer."""
    c = np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    return np.concatenate([c[1:-1], two, (two[:-1] << 21) | c[2:]]).tobytes()


class _Memo(dict):
    """The n-grams of words met so far; a task lets them go when it ends."""

    def __missing__(self, word: str) -> bytes:
        grams = _grams(word)
        if len(word) <= 40:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = grams
        return grams


_memo = _Memo()


def forget() -> None:
    _memo.clear()


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """A text's distinct n-grams, ascending, and how often each occurs. None without a letter."""
    words = _words(text or "")
    if not any(any(map(str.isalpha, w)) for w in words):
        return None
    packed = list(map(_memo.__getitem__, words))
    grams = np.frombuffer(b"".join(packed), np.int64)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, packed), np.int64, len(words)) // 8)
    order = np.argsort(grams)
    grams, times = grams[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[new], np.add.reduceat(times, new)


def ranked(text: str | None, size: int = PROFILE) -> np.ndarray | None:
    """A text's most frequent n-grams, most frequent first, ties by code points."""
    found = gram_counts(text)
    return None if found is None else found[0][np.argsort(-found[1], kind="stable")[:size]]


class Profiles:
    """Ranks of n-grams in each language's profile."""

    def __init__(self, lists: dict[str, list[int]], size: int = PROFILE) -> None:
        self.languages, self.size = sorted(lists), size
        self.grams = np.unique(np.array([g for grams in lists.values() for g in grams], np.int64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), size, np.int64)
        for i, language in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.grams, lists[language])] = np.arange(len(lists[language]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.size) if self.languages else None
        if own is None:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        places = self.ranks[:, at]
        apart = np.where(places < self.size, np.abs(places - np.arange(len(own))), self.size).sum(1)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(own)))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = PER_LANGUAGE) -> DataFrame | None:
    """``(lang, text)`` of a bounded sample of the rows that are not held out, or of all these rows if ``per_language`` is None. None without such rows."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    # hashes up to a language's last one are drawn; all, for a language with fewer rows than ``per_language``
    last = {r["lang"]: (1 << 63) - 1 if per_language is None or r["count"] <= per_language else (per_language << 64) // r["count"] - (1 << 63) for r in most.collect()}
    if not last:
        return None
    up_to = F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("lang")]
    chosen = rows.where(F.xxhash64("doc_id") <= up_to).select("lang", "text")
    return chosen if per_language is None else cut(chosen)


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE, chosen: DataFrame | None = None
) -> Profiles:
    """Profiles of the languages in the rows that are not held out; ``chosen`` is their :func:`labelled` sample, if there is one already."""
    chosen = labelled(docs, id_col, text_col, lang_col, per_language) if chosen is None else chosen
    if chosen is None:
        return Profiles({}, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (found := gram_counts(text.as_py())) is not None:
                    total.setdefault(lang, Counter()).update(dict(zip(found[0].tolist(), found[1].tolist(), strict=True)))
            flat = [(k, g, n) for k, c in total.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=False)], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(tidy(run, forget), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    lists: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists, size)


def least_score(chosen: DataFrame | None, profiles: Profiles) -> float:
    """The score below which a text is like no learned profile, from all chosen texts that were labelled rightly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(1)]
            right = [score for (lang, score), label in zip(found, batch.column(0).to_pylist(), strict=True) if lang == label]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.float64())], ["score"])

    low = None if chosen is None else chosen.select("lang", "text").mapInArrow(tidy(run, forget), "score double").agg(F.percentile_approx("score", LOWEST, 10_000)).first()[0]
    return MARGIN * (low or 0.0)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(2)]
            lang, score = (pa.array([x[i] for x in found], t) for i, t in ((0, pa.string()), (1, pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, score], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidy(run, forget), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = 0.0, lang_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with a score of ``least`` or more.

    All columns stay; ``lang_col``, if given, holds the predicted language from here on.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(at)]
            if lang_col is not None:
                columns = [pa.array([lang for lang, _ in found], pa.string()) if n == lang_col else c for n, c in zip(names, batch.columns, strict=True)]
                batch = pa.RecordBatch.from_arrays(columns, names)
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run, forget), docs.schema)
