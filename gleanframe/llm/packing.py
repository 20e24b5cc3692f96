"""Packing of documents into sequences of a fixed number of tokens: best-fit decreasing over remaining capacities.

Each document's tokens, with an end token, are cut into pieces of at most ``capacity`` tokens (only a longer document is
cut). Pieces go by decreasing length into the open sequence that they fill most tightly, or into a new one. The tightest
is found by a segment tree over remaining capacities, in a number of steps that is the logarithm of ``capacity``.

What decides is only how many pieces there are of each length, and pieces of one length are interchangeable. So the
counts by length (at most ``capacity`` rows, however many documents there are) are packed at once, for all the corpus:
sequences that are alike are one entry of the tree with their number, and a run of equal pieces is put into a run of such sequences in
one step, with exactly the outcome of piece after piece. Tasks then look up each piece's place by its length and its number among
the pieces of that length. The numbers come from slices of a hash, so no task numbers all pieces of a common length.

Edge cases: a null text counts as empty, so it is its end token alone; nothing is dropped or truncated; repeated rows are packed
each; null ids are packed like others; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleanframe.llm import merges
from gleanframe.llm.common import cut, tidy, word_chunks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct parts of texts whose ids a task keeps before it starts anew.
MEMO_PARTS = 500_000
#: Slices of a hash in which pieces of one length are numbered, at least, and pieces for each slice beyond that.
SLICES, SLICE_ROWS = 1024, 1 << 16


class _Ids(dict):
    """Ids (little-endian, four bytes each) of the white-space separated parts of texts, as the tokenizer gives them.

    Its pieces never hold white space, so a text's ids are those of its parts, one after the other. Parts of plain letters
    (ASCII and the Latin letters up to U+00FF, which its normaliser only lower-cases) are split into words here and merged by
    ranks, if the file allows that (:mod:`merges`); the library encodes all others.
    """

    #: Words of plain parts, as the file's pattern takes them, and what a part must be made of to be plain.
    WORDS = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str, fast: bool) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = None
        if fast:
            rank, ids = merges.ranks(path, held=True)
            self.packed = [ids.get(r, 0).to_bytes(4, "little") for r in range(len(rank))]
            self.merge = merges.encoding(path, rank)._encode_single_piece

    def _learn(self, parts: list[bytes]) -> None:
        rest, merge, packed = [], self.merge, self.packed.__getitem__ if self.merge else None
        for p in parts:
            if merge is not None and p.isalpha():  # one word of ASCII letters
                self[p] = b"".join(map(packed, merge(p.lower() + merges.END)))
                continue
            text = p.decode()
            if merge is None or not self.PLAIN.fullmatch(text) or ("<" in text and any(s in text for s in self.special)):
                rest.append((p, text))
                continue
            found: list[int] = []
            for word in self.WORDS.findall(text.lower()):
                found += merge(word.encode() + merges.END)
            self[p] = b"".join(map(packed, found))
        if rest:
            found = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
            self.update((p, np.array(e.ids, "<u4").tobytes()) for (p, _), e in zip(rest, found, strict=True))

    def chunks(self, text: bytes) -> Iterator[bytes]:
        for parts in word_chunks(text):
            new = [p for p in set(parts) if p not in self]
            if len(self) + len(new) > MEMO_PARTS:
                self.clear()
                new = list(set(parts))
            if new:
                self._learn(new)
            yield b"".join(map(self.__getitem__, parts))


@lru_cache(1)
def _ids(path: str, fast: bool) -> _Ids:
    return _Ids(path, fast)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's pieces, and their ``ids`` if asked for."""
    fast = merges.same_words(path)
    last, size = np.array([end], "<u4").tobytes(), 4 * capacity

    def parted(text: bytes) -> Iterator[bytes]:
        held = b""
        for chunk in _ids(path, fast).chunks(text):
            held += chunk
            full = len(held) // size * size
            yield from (held[i : i + size] for i in range(0, full, size))
            held = held[full:]
        held += last
        yield from (held[i : i + size] for i in range(0, len(held), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for i, text in enumerate(b.column(1)):
                for n, part in enumerate(parted(text.as_py() or b"")):
                    of.append(i)
                    rows.append((n, n * capacity, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4")] if ids else [])))
            n, start, length, crc, *more = zip(*rows, strict=True) if rows else ((),) * (5 if ids else 4)
            cells = [b.column(0).take(pa.array(of, pa.int64())), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                cells.append(pa.array(list(more[0]), pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cells, names)

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return plain.mapInArrow(tidy(run), PIECES + (", ids array<long>" if ids else ""))


class Capacities:
    """A segment tree over remaining capacities; a leaf is true while a sequence with that much room is open."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, open_: bool) -> None:
        at = room + self.leaves
        self.any[at] = open_
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of ``length`` or more among open sequences: up to the first right neighbour that has any, then down its left side."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


class Run(NamedTuple):
    """Pieces of ``length`` from number ``first`` on: ``each`` a sequence, side by side from ``offset``, into sequences from ``into`` on."""

    length: int
    first: int
    each: int
    into: int
    offset: int


def best_fit(counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing of ``counts[length]`` pieces, longest first, as runs of equal pieces.

    A length opens at most two new kinds of sequences and splits one of those that are open in at most three, and
    whenever a kind is filled its room falls below half, so there are at most 4 * 12 * ``capacity`` runs or so.
    """
    tree, alike, runs, opened = Capacities(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            alike[room].append((first, n))
            if len(alike[room]) == 1:
                tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:  # as many new sequences as the rest needs
                room, n = capacity, -(-(total - done) // (capacity // length))
                first, opened = opened, opened + n
            else:
                first, n = alike[room].pop()
                if not alike[room]:
                    tree.set(room, False)
            each = room // length
            whole, rest = divmod(min(n * each, total - done), each)
            runs.append(Run(length, done, each, first, capacity - room))
            put(room - each * length, first, whole)
            put(room - rest * length, first + whole, int(rest > 0))
            put(room, first + whole + (rest > 0), n - whole - (rest > 0))
            done += whole * each + rest
    return runs


def place(numbered: DataFrame, runs: list[Run]) -> DataFrame:
    """``numbered`` pieces (with ``length`` and ``number`` among those) with ``sequence_id`` and ``offset``."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    length, first, each, into, offset = table.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = length << 48 | first
        for b in batches:
            number = np.asarray(b.column("number"))
            at = np.searchsorted(starts, np.asarray(b.column("length")) << 48 | number, "right") - 1
            skip, within = np.divmod(number - first[at], each[at])
            cells = [b.column(c) for c in b.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(into[at] + skip), pa.array(offset[at] + within * length[at])], [*(c for c in b.schema.names if c != "number"), "sequence_id", "offset"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "number"]
    return numbered.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """The documents' pieces with ``sequence_id`` and ``offset``; the pieces of a sequence lie side by side from 0 on."""
    made = cut(pieces(docs, path, capacity, end, id_col, text_col, ids))
    by_length = made.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs = best_fit({r["length"]: r["count"] for r in by_length}, capacity)
    if not runs:
        return made.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slices = max(SLICES, sum(r["count"] for r in by_length) // SLICE_ROWS)
    sliced = made.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    before = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n")).select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32", "start"))
    numbered = sliced.withColumn("_inside", inside).join(starts, ["length", "_slice"])
    return place(numbered.select(*made.columns, (F.col("_before") + F.col("_inside") - 1).alias("number")), runs)


def sequences(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(sequence_id, ids, doc_ids, offsets)``: what the sequences hold, in order. A sequence has at most ``capacity`` ids, so its group is bounded."""
    placed = pack(docs, path, capacity, end, id_col, text_col, ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts")
    return placed.groupBy("sequence_id").agg(parts).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
