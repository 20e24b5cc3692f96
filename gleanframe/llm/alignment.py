"""Alignment of two tokenizers' tokens over the same texts, and how often their tokens meet in the corpus.

Equal texts are brought together by a shuffle on the whole text. Each distinct text is tokenised and aligned once, its
links count as often as the text occurs, and what was measured is joined back to all documents that hold it.

Tokens end at byte offsets. The offsets at which either side ends a token cut a text into pieces, each of which lies in one token
of either side: these are the links. Where both sides end one, a group ends. So all tokens of many texts are aligned by array
arithmetic over their ends. A huge text is handled in slices: it may be parted before a space that follows something that is
neither white space nor U+2581, where both tokenizers end a token (the byte-level one splits words there, and no piece of
the other holds a space after something else).

How often an id pair is linked is counted in the whole corpus. Texts are dealt with in blocks of about ``BLOCK`` bytes: a block
reports each of its pairs once, with its sum, so what is shuffled is far less than one row a link. The corpus-wide counts
come back by block, and each text's few numbers are found from the counts of its block's pairs. Nothing is broadcast, and no
group is larger than a block or a single text.

Edge cases: null and empty texts, and those that the tokens of one side do not give back (such as texts that hold U+2581), have no
tokens: zeros and ''. Repeated rows get a row each and count each; null ids are kept; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm import merges
from gleanframe.llm.common import cut, tidy

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
#: Where a text may be parted; the space belongs to what follows.
GAP = re.compile(r"(?<=[^\s▁]) (?!\Z)")
#: Characters of texts that are aligned at a time, and bytes of texts in a block.
CHUNK_CHARS, BLOCK = 1 << 19, 4 << 20
#: Texts that are measured before their pairs go into blocks.
ROWS = 256
#: A pair of ids as one number: the first id above, the second in so many bits below.
LOW = 20


class First:
    """A ``tokenizers`` file with a byte-level vocabulary; special strings in texts are ordinary text."""

    def __init__(self, path: str, fast: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        of = merges.byte_level()
        self.bytes = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in self.tokenizer.get_vocab().items()}
        self.fast = None
        if fast:
            rank, ids = merges.ranks(path, held=True)
            self.fast, self.ids = merges.encoding(path, rank), np.array([ids[r] for r in range(len(ids))], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is not None:
            return [self.ids[self.fast.encode_to_numpy(" " + t)] for t in texts]
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Second:
    """A ``sentencepiece`` model, which puts the space before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        #: Whether texts may be parted at :data:`GAP`: no piece holds a space after something else.
        self.parts = not any(re.search("[^▁]▁", p) for _, p in pieces)
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class _Side:
    """What a vocabulary's ids stand for, by id: their bytes, how many, and their decimal digits in cells of one width."""

    def __init__(self, of: dict[int, bytes]) -> None:
        top = max(of) + 1
        self.bytes = [of.get(i, b"") for i in range(top)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        width = len(str(top))
        self.digits = np.array([list(str(i).encode().rjust(width, b"\0")) for i in range(top)], np.uint8)
        self.written = (self.digits > 0).sum(1)

    def whole(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == text


class Aligner:
    def __init__(self, path_a: str, path_b: str, fast: bool) -> None:
        self.a, self.b = First(path_a, fast), Second(path_b)
        self.parts = fast and self.b.parts
        self.side_a, self.side_b = _Side(self.a.bytes), _Side(self.b.bytes)

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, bytes, np.ndarray, np.ndarray] | None]:
        """For each text its ``MEASURES``, its groups as text, its distinct pairs ascending and how often it has each; None if it does not come back whole."""
        out: list = [None] * len(texts)
        kept = []
        for i, (text, a, b) in enumerate(zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True)):
            whole = (" " + text).encode()
            if self.side_a.whole(a, whole) and self.side_b.whole(b, whole):
                kept.append((i, a, b, len(whole)))
        if not kept:
            return out
        a, b = (np.concatenate([k[j] for k in kept]) for j in (1, 2))
        edge = np.cumsum([k[3] for k in kept])  # where texts end
        ends_a, ends_b = np.cumsum(self.side_a.size[a]) - 1, np.cumsum(self.side_b.size[b]) - 1  # last bytes of tokens
        last_a, last_b = np.zeros(edge[-1], bool), np.zeros(edge[-1], bool)
        last_a[ends_a], last_b[ends_b] = True, True
        common = last_a & last_b
        cuts = np.flatnonzero(last_a | last_b)
        token_a, token_b = (np.cumsum(x)[cuts] - x[cuts] for x in (last_a, last_b))  # tokens that ended before
        pairs = a[token_a] << LOW | b[token_b]
        inner = edge - 1
        n_a, n_b, n_links = (np.diff(np.searchsorted(x, inner, "right"), prepend=0) for x in (ends_a, ends_b, cuts))
        n_groups = np.diff(np.cumsum(common)[inner], prepend=0)
        written, starts = self._written(a, b, ends_a, ends_b, common, np.cumsum(n_a), np.cumsum(n_b))
        begin, first = 0, 0
        for (i, *_), end, links, *numbers in zip(kept, starts.tolist(), n_links.tolist(), n_a, n_b, n_groups, n_links, strict=True):
            keys, times = np.unique(pairs[first : first + links], return_counts=True)
            out[i] = np.array(numbers), written[begin : end - 1], keys, times
            begin, first = end, first + links
        return out

    def _written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, each closed by a semicolon, and where each text's end in that.

        A token's place is its number on its own side and the number of tokens of the other side that come before it.
        """
        closed = np.cumsum(common)
        group_a, group_b = (closed[e] - common[e] for e in (ends_a, ends_b))
        of_a, of_b = (np.bincount(g, minlength=closed[-1]) for g in (group_a, group_b))
        place_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
        width = max(self.side_a.digits.shape[1], self.side_b.digits.shape[1])
        cells, sizes = np.zeros((len(a) + len(b), width + 1), np.uint8), np.empty(len(a) + len(b), np.int64)
        for side, ids, ends, place, closing in ((self.side_a, a, ends_a, place_a, b"|"), (self.side_b, b, ends_b, place_b, b";")):
            cells[place, width - side.digits.shape[1] : width] = side.digits[ids]
            cells[place, width] = np.where(common[ends], closing[0], ord(","))
            sizes[place] = side.written[ids] + 1
        return cells[cells > 0].tobytes(), np.cumsum(sizes)[to_a + to_b - 1]


def slices(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A text in slices of about ``size`` characters, parted at :data:`GAP`; the space between two is left out."""
    start = 0
    while len(text) - start > size:
        m = GAP.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def measured(texts: list[str], aligner: Aligner, size: int = CHUNK_CHARS) -> list[tuple[list[int], str, np.ndarray, np.ndarray] | None]:
    """Each text's numbers, the digest of its groups, and its distinct pairs with their numbers; None if it does not come back whole.

    That is so if a slice does not: no token stands for more bytes than its text, so no slice could make up for those that another lacks.
    """
    out: list = []
    short: list[int] = []

    def one(parts: Iterator[tuple | None]) -> tuple | None:
        numbers, digest, keys, times = np.zeros(4, np.int64), hashlib.sha256(), np.empty(0, np.int64), np.empty(0, np.int64)
        for k, part in enumerate(parts):
            if part is None:
                return None
            numbers += part[0]
            digest.update((b";" if k else b"") + part[1])
            keys, times = (part[2], part[3]) if not k else _sum(np.concatenate([keys, part[2]]), np.concatenate([times, part[3]]))
        return numbers.tolist(), digest.hexdigest(), keys, times

    def flush() -> None:
        for i, part in zip(short, aligner.align([texts[i] for i in short]), strict=True):
            out[i] = one(iter([part]))
        short.clear()

    held = 0
    for i, text in enumerate(texts):
        out.append(None)
        if len(text) > size and aligner.parts:
            out[i] = one(aligner.align([s])[0] for s in slices(text, size))
            continue
        short.append(i)
        held += len(text)
        if held >= size:
            flush()
            held = 0
    if short:
        flush()
    return out


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its numbers."""
    some, back = np.unique(keys, return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, back, n)
    return some, total


@lru_cache(1)
def _aligner(path_a: str, path_b: str, fast: bool) -> Aligner:
    return Aligner(path_a, path_b, fast)


ALIGNED = "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block binary, pairs binary, keys array<long>, totals array<long>"


def aligned(texts: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Rows of texts, with their pairs, and of blocks, with all pairs of their texts; from ``(text, digest, times)``.

    A text's ``pairs`` are places in its block's ascending ``keys`` and how often it has them. ``totals`` count each text ``times``.
    """
    fast = merges.same(path_a)
    kinds = pa.schema([(c, pa.binary() if c in ("digest", "block", "pairs") else pa.string() if c == "groups_sha256" else pa.list_(pa.int64()) if c in ("keys", "totals") else pa.int64()) for c in [f.split()[0] for f in ALIGNED.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = _aligner(path_a, path_b, fast), [], 0

        def flush() -> pa.RecordBatch:
            keys = np.unique(np.concatenate([m[2] for _, _, m in held]))
            totals, name, rows = np.zeros(len(keys), np.int64), held[0][0], []
            for digest, times, (numbers, groups, own, n) in held:
                at = np.searchsorted(keys, own)
                totals[at] += n * times
                packed = zlib.compress(np.diff(at, prepend=0).astype("<i8").tobytes() + n.astype("<i8").tobytes(), 1)
                rows.append((digest, *numbers, groups, name, packed, None, None))
            rows.append((None, None, None, None, None, None, name, None, keys, totals))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                texts = part.column(0).to_pylist()
                for text, digest, times, found in zip(texts, part.column(1), part.column(2), measured(texts, aligner), strict=True):
                    if found is None:
                        continue
                    held.append((digest.as_py(), times.as_py(), found))
                    size += len(text)
                    if size >= block:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return texts.select("text", "digest", "times").mapInArrow(tidy(run), ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, a, b, count, is_best)`` of the whole corpus from :func:`aligned`; ``is_best``: no pair of this ``b`` is linked more often.

    The window over a ``b`` has at most as many rows as the first vocabulary has ids.
    """
    blocks = rows.where(F.col("digest").isNull()).select(F.explode(F.arrays_zip("keys", "totals")).alias("p"))
    counts = blocks.groupBy(F.col("p.keys").alias("pair")).agg(F.sum("p.totals").alias("count"))
    named = counts.select("pair", F.shiftright("pair", LOW).alias("a"), F.col("pair").bitwiseAND((1 << LOW) - 1).alias("b"), "count")
    return named.withColumn("is_best", F.col("count") == F.max("count").over(W.partitionBy("b")))


def _scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Texts of one block beside the block's pairs: links whose pair is its ``b``'s best, and counts summed over links."""
    keys = np.asarray(right.column("pair"))
    order = np.argsort(keys)
    count, best = (np.asarray(right.column(c)).astype(np.int64)[order] for c in ("count", "is_best"))
    n_best, sums = [], []
    for packed in left.column("pairs"):
        numbers = np.frombuffer(zlib.decompress(packed.as_py()), "<i8").reshape(2, -1)
        at, n = np.cumsum(numbers[0]), numbers[1]
        n_best.append(int(best[at] @ n))
        sums.append(int(count[at] @ n))
    return left.select(["digest", *MEASURES, "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``."""
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), F.when(docs[text_col] != "", docs[text_col]).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    distinct = plain.where("text is not null").groupBy("text").agg(F.count("*").alias("times")).select("text", digest, "times")
    rows = cut(aligned(distinct, path_a, path_b, block))
    counts = cut(pair_counts(rows))
    asked = rows.where(F.col("digest").isNull()).select("block", F.explode("keys").alias("pair"))
    known = asked.join(counts.select("pair", "count", "is_best"), "pair")
    texts = rows.where(F.col("digest").isNotNull()).select("digest", *MEASURES, "groups_sha256", F.col("block").alias("of"), "pairs")
    kind = "digest binary, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string, n_best long, count_sum long"
    scored = cut(texts.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(_scores, kind))
    named = cut(plain.select("doc_id", digest))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return named.join(scored, "digest", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
