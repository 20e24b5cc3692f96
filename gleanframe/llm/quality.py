"""Quality grades by ordinal cumulative-link regression on hashed text.

Ratings are graded; one weight for each hashed feature is shared by all grades, and ordered thresholds cut the
score into grades: ``P(grade > j) = sigmoid(score - threshold_j)``. From these follow the expected grade and the
tail probability by which documents are selected.

Features of a text are hashes of its distinct lower-cased words, their endings and shapes, and how much it repeats
itself. Features that fewer than ``MIN_DOCS`` rated documents have are ignored, others weigh by how rare they are, in a
text's vector of length one. Long texts dilute what only a few words tell; so a feature whose documents' mean
grade is ``MARK`` standard errors or more from that of all counts a second time, undiluted, with a weight of its own. How
large it counts is chosen by likelihood: a quarter of the rated sample is held back from fits with each of ``SIZES``,
the size under which it is likeliest wins, and the model is then fitted to the whole sample.

The model is fitted on the driver from a bounded sample of rated documents (at most ``SAMPLE``, chosen by a hash of
the id); every whole text is scored.

Edge cases: a null or empty text has no words and gets the grade of a text without features; rows with a null id
or rating teach nothing; without any rating all documents get the middle of the grades; repeated rows get a
row each; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import cut, drawn, word_chunks

BUCKETS = 1 << 18
SAMPLE, MIN_DOCS, ROUNDS = 6000, 8, 120
#: Standard errors that make a feature a mark, the sizes tried for marks of low grades, and those of high grades beside them.
MARK, SIZES, HIGH = 5.0, (0.0, 0.5, 1.0, 2.0), 0.1
MEMO_WORDS = 60_000
_SHAPES = [(re.compile(p), r) for p, r in ((rb"[A-Z]+", b"X"), (rb"[a-z\x80-\xff]+", b"x"), (rb"[0-9]+", b"9"))]


class _Memo(dict):
    """A word's feature buckets, packed."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh32_intdigest

        shape = word
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        lower = word.lower()
        found = np.array([xxh32_intdigest(f) % BUCKETS for f in (b"w" + lower.strip(b".,;:!?\"'()"), b"e" + lower[-3:], b"s" + shape)], np.int32).tobytes()
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found


_memo = _Memo()


def forget() -> None:
    _memo.clear()


def features(text: bytes | None) -> np.ndarray:
    """The distinct buckets of a text's features, ascending."""
    distinct: set[bytes] = set()
    total = 0
    parts = []
    for words in word_chunks(text or b""):
        total += len(words)
        distinct.update(words)
        if len(distinct) > MEMO_WORDS:
            parts.append(_buckets(distinct))
            distinct.clear()
    if not total:
        return np.empty(0, np.int32)
    few = sum(len(p) for p in parts) + len(distinct)
    parts += [_buckets(distinct), np.array([_memo[b"\x00repeats%d" % int(np.log2(total / few) * 2)]]).view(np.int32)[:1] if few else np.empty(0, np.int32)]
    return np.unique(np.concatenate(parts))


def _buckets(words: set[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(map(_memo.__getitem__, words)), np.int32))


class Model:
    """Weights (of features, then of marks), rarities, marks' sizes, and thresholds."""

    def __init__(self, weights: np.ndarray, rarity: np.ndarray, marks: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.rarity, self.marks, self.thresholds = weights, rarity, marks, thresholds

    def score(self, text: bytes | None) -> float:
        at, x = vector(features(text), self.rarity, self.marks)
        return float((self.weights[at] * x).sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > j)``, a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))


def vector(f: np.ndarray, rarity: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of a text's features, scaled to length one, and of its marks (``BUCKETS`` places on)."""
    known, marked = f[rarity[f] > 0], f[marks[f] > 0]
    x = rarity[known]
    norm = np.sqrt((x**2).sum())
    return np.concatenate([known, marked + BUCKETS]).astype(np.int64), np.concatenate([x / norm if norm else x, marks[marked]])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, ridge: float = 1e-4, step: float = 1.0, low: float = 1.0) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows."""
    if not len(rows):
        return Model(np.zeros(2 * BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(n_grades - 1))
    n = np.array([len(r) for r in rows])
    bucket = np.concatenate(rows).astype(np.int64)
    seen = np.bincount(bucket, minlength=BUCKETS)
    rarity = np.where(seen >= MIN_DOCS, np.log(1 + len(rows) / np.maximum(seen, 1)), 0.0)
    apart = np.bincount(bucket, np.repeat(grades - grades.mean(), n), BUCKETS) / (max(grades.std(), 1e-9) * np.sqrt(np.maximum(seen, 1)))
    marks = np.where(seen < MIN_DOCS, 0.0, np.where(apart < -MARK, low, np.where(apart > MARK, HIGH * low, 0.0)))
    places, sizes = zip(*(vector(r, rarity, marks) for r in rows), strict=True)
    bucket, x = np.concatenate(places), np.concatenate(sizes)
    row = np.repeat(np.arange(len(rows)), [len(p) for p in places])
    known, bucket = np.unique(bucket, return_inverse=True)  # only what these rows have
    size = len(known)
    above = grades[:, None] > np.arange(n_grades - 1)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    thresholds = np.log(1 / share - 1)
    params = np.concatenate([np.zeros(size), thresholds])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, cuts = params[:size], params[size:]
        score = np.bincount(row, w[bucket] * x, len(rows))
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -50, 50)))
        # P(grade) is a difference of neighbouring tails; the derivatives follow from it
        edges = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], 1)
        slope = edges * (1 - edges)
        i = np.arange(len(rows))
        p = np.maximum(edges[i, grades] - edges[i, grades + 1], 1e-9)
        upper, lower = slope[i, grades] / p, slope[i, grades + 1] / p
        by_score = -(upper - lower) / len(rows)
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, upper / len(rows))
        np.add.at(by_cut, grades + 1, -lower / len(rows))
        slope_w = np.bincount(bucket, by_score[row] * x, size) + ridge * w
        g = np.concatenate([slope_w, by_cut[1:-1]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        change = (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        change[size:] *= 0.1
        params = params - step * change * (1 - t / (rounds + 1))
        params[size:] = np.maximum.accumulate(params[size:])
    weights = np.zeros(2 * BUCKETS, np.float32)
    weights[known] = params[:size]
    return Model(weights, rarity.astype(np.float32), marks.astype(np.float32), params[size:])


def loss(model: Model, rows: list[np.ndarray], grades: np.ndarray) -> float:
    """Mean negative log-likelihood of the grades."""
    places = [vector(r, model.rarity, model.marks) for r in rows]
    tails = model.tails(np.array([float((model.weights[at] * x).sum()) for at, x in places]))
    edges = np.concatenate([np.ones((len(rows), 1)), tails, np.zeros((len(rows), 1))], 1)
    i = np.arange(len(rows))
    return float(-np.log(np.maximum(edges[i, grades] - edges[i, grades + 1], 1e-9)).mean())


def fit_chosen(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Model:
    """:func:`fit` with the size of marks under which every fourth row, held back from the others, is likeliest."""
    held = np.arange(len(rows)) % 4 == 3
    if held.sum() < 50:
        return fit(rows, grades, n_grades)
    some, rest = [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]
    best = min(SIZES, key=lambda size: loss(fit(some, grades[~held], n_grades, low=size), rest, grades[held]))
    return fit(rows, grades, n_grades, low=best)


def learn(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Model:
    """A model from the rated documents: ``ratings`` has ``id_col`` and the columns of ``grade`` (0 to n_grades - 1)."""
    rated = ratings.select(F.col(id_col).cast("long").alias("_id"), grade.cast("int").alias("_grade")).where(F.col("_id").isNotNull() & F.col("_grade").between(0, n_grades - 1))
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    n = rated.count()
    place = F.xxhash64("_id", F.lit(3))
    some = cut(rated.where(drawn(place, 2 * rows, n)).orderBy(place, "_id").limit(rows))
    if n and some.isEmpty():
        raise RuntimeError(f"a sample of {n} ratings is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).astype("<i4").tobytes() for t in b.column(2)], pa.binary())], ["id", "grade", "features"])

    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("binary").alias("_text"))
    # at most ``rows`` small rows, so the texts need no shuffle; of repeated ids one text counts, so no more come back
    met = texts.join(F.broadcast(some), "_id").select("_id", "_grade", "_text").mapInArrow(run, "id long, grade int, features binary")
    found = met.groupBy("id").agg(F.min("grade").alias("grade"), F.min("features").alias("features")).orderBy("id").toArrow().to_pylist()
    return fit_chosen([np.frombuffer(r["features"], "<i4") for r in found], np.array([r["grade"] for r in found], np.int64), n_grades)


def grade_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, keep)``: the tail is that of the top grade, ``keep`` if it is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = model.tails(np.array([model.score(t.as_py()) for t in b.column(1)], np.float64))
            columns = [b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_probability", "keep"])
        forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")
