"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary file.

Texts are split without a regular expression. A batch of texts becomes one array of code points; a table
gives each its class (letter, number, white space, other), and the classes next to it tell where white
space ends and which apostrophe begins a contraction. What is left to decide needs the state so far, so each
symbol stands for a transition function of a small automaton. Functions compose associatively and
their closure is small, so a composition is one table look-up, and the states at all places come from a
scan: inside blocks side by side, then over the blocks' totals. A token slice begins where the automaton says so.

Every distinct slice is merged once in a task and kept in a bounded cache. Offsets (the first
byte of each token) are kept: they place the bytes in decoding and tell which bytes a token covers.

A text longer than ``CHUNK_CHARS`` is encoded part by part. Parts end where no slice can reach across: before a
blank or line feed after something that is no white space, or between an ASCII letter and a digit. So a
huge text needs little memory beside its tokens, unless it is one run without any such place.

Edge cases: a null text is encoded as the empty one, which has no tokens; texts are never cut short;
repeated rows are encoded each; further columns pass through, but one that is named like a result is
replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.llm.common import free, tidy

#: Code points that a task splits at a time, but whole texts always.
CHUNK_CHARS = 1 << 18
#: Slices that the cache of a task holds before it starts anew, and the bytes of the longest one in it.
CACHE_SLICES, CACHE_BYTES = 60_000, 64
#: Where a long text may be parted.
_GAP = re.compile(r"(?<=\S)[ \n]|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

# symbols: letter, number, other, apostrophe before a contraction of one or two letters,
# a space or another white space before something else, other white space
L, N, O, Q1, Q2, P, V, S = range(8)  # noqa: E741
# states: between tokens, in letters, in numbers, in others, in white space, after a space that
# belongs to what follows, two letters or one letter before a contraction's end
NONE, IN_L, IN_N, IN_O, IN_S, JOIN, TWO, ONE = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``to[state, symbol]`` and whether a token begins at the symbol."""
    to, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for symbol, inside in ((L, IN_L), (N, IN_N), (O, IN_O), (Q1, IN_O), (Q2, IN_O)):
        to[:, symbol] = {Q1: ONE, Q2: TWO}.get(symbol, inside)
        for state in (inside, JOIN):
            to[state, symbol], begins[state, symbol] = inside, False
    to[TWO, L], to[ONE, L], begins[TWO, L], begins[ONE, L] = ONE, NONE, False, False
    to[:, P], to[:, V], to[:, S], begins[IN_S, S] = JOIN, NONE, IN_S, False
    return to, begins


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions of symbols 0 to 7, and of a text's first symbol as 8 to 15, closed under composition.

    Returns each symbol's function, ``compose[f, g]`` (f first), each function's state after
    starting between tokens, and ``begins[state, symbol]``.
    """
    to, begins = _automaton()
    symbols = [tuple(map(int, to[:, s])) for s in range(8)] + [(int(to[NONE, s]),) * 8 for s in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *symbols]))}
    frontier = list(known)
    while frontier:
        new = []
        for f in frontier:
            for g in symbols:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    new.append(h)
        frontier = new
    every = np.array(list(known), np.uint8)
    index = {f: i for f, i in known.items()}
    compose = np.array([[index[tuple(map(int, g[f]))] for g in every] for f in every], np.uint16)
    return np.array([index[s] for s in symbols], np.uint16), compose, every[:, NONE].copy(), begins


def _scan(f: np.ndarray, compose: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive scan of composed functions."""
    n, flat, m = len(f), compose.ravel(), compose.shape[0]
    if n <= width:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, f.dtype)  # function 0 is the identity
    padded[:n] = f
    rows = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for i in range(1, width):
        rows[i] = flat[rows[i - 1].astype(np.int32) * m + rows[i]]
    before = np.concatenate([np.zeros(1, f.dtype), _scan(rows[-1], compose, width)[:-1]])
    rows = flat[before.astype(np.int32) * m + rows]
    return rows.T.reshape(-1)[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for each code point."""
    kinds = np.full(sys.maxunicode + 1, 2, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kinds[c] = "LN".index(major)
    # the code points with Unicode's property White_Space
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[spaces] = 3
    return kinds


def token_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points at which slices begin. ``first``: indices at which texts begin, ascending."""
    if not len(code):
        return np.empty(0, np.int64)
    kind = _classes()[code]
    ends = np.zeros(len(code), bool)  # last of its text
    ends[first[1:] - 1] = True
    ends[-1] = True
    after = np.append(kind[1:], 3)
    after[ends] = 3
    symbol = np.where(kind == 3, S, kind).astype(np.uint8)
    closes = (kind == 3) & (after != 3)
    symbol[closes] = np.where(code[closes] == 32, P, V)
    quotes = np.flatnonzero(code == 39)
    if len(quotes):
        text = np.searchsorted(first, quotes, "right")
        last = np.append(first[1:], len(code))[text - 1]
        one = np.where(quotes + 1 < last, code[np.minimum(quotes + 1, len(code) - 1)], 0)
        two = np.where(quotes + 2 < last, code[np.minimum(quotes + 2, len(code) - 1)], 0)
        # fixed values: the contractions 's 't 'm 'd and 're 've 'll
        symbol[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = Q1
        symbol[quotes[np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = Q2
    functions, compose, state_after, begins = _functions()
    start = np.zeros(len(code), bool)
    start[first] = True
    states = state_after[_scan(functions[symbol + np.where(start, 8, 0)], compose)]
    before = np.append(np.uint8(NONE), states[:-1])
    before[start] = NONE
    return np.flatnonzero(begins[before, symbol])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the adjacent pair of lowest rank is merged, the leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        if not parts[i] or (j := right[i]) >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, b""
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(both + parts[k])) is not None:
                heapq.heappush(heap, (r, i, both + parts[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(parts[h] + both)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + both))
    return [ranks[p] for p in parts if p]


class _Slices(dict):
    """Slice to its ids as little-endian 32-bit bytes, for the slices met so far.

    ``pairs`` are the sorted pairs of ids (first id times 65536 plus second) that merge, ``merged`` the
    ids they merge into; ids are ranks, so the lower id merges first.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.long = ranks, []
        found = {(x << 16) | y: i for t, i in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None}
        self.pairs = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.pairs.tolist()], np.int32)
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.many = max(ranks.values(), default=0) < 1 << 16 and bool((self.byte >= 0).all())

    def add(self, pieces: list[bytes]) -> None:
        """Merges the slices that are new; all of ``pieces`` are known then."""
        new = [p for p in set(pieces) if p not in self]
        if len(self) + len(new) > CACHE_SLICES:
            self.clear()
            new = list(set(pieces))
        self.long += [p for p in new if len(p) > CACHE_BYTES]
        whole, ranks = [p for p in new if p in self.ranks], self.ranks
        self.update((p, ranks[p].to_bytes(4, "little")) for p in whole)
        rest: dict[int, list[bytes]] = {}
        for p in new:
            if p not in ranks:
                rest.setdefault(len(p) if self.many and len(p) <= 48 else 0, []).append(p)
        for n, some in rest.items():
            self.update(self._one_by_one(some) if not n or len(some) < 8 else self._together(some, n))

    def forget_long(self) -> None:
        """Slices too long to be met again leave the cache."""
        for p in self.long:
            self.pop(p, None)
        self.long.clear()

    def _one_by_one(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        return ((p, np.array(merge(p, self.ranks), "<u4").tobytes()) for p in pieces)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 16) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.merged[at], 1 << 30)

    def _together(self, pieces: list[bytes], n: int) -> Iterator[tuple[bytes, bytes]]:
        """The same for slices of ``n`` bytes side by side: each round merges one pair in every slice."""
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)]
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            at = rank.argmin(1)
            here = np.arange(len(row))
            low = rank[here, at]
            if (ended := low >= 1 << 30).any():
                done.append((row[ended], ids[ended]))
                going = ~ended
                row, ids, rank, at, low, here = row[going], ids[going], rank[going], at[going], low[going], here[: going.sum()]
                if not len(row):
                    break
            column = np.arange(ids.shape[1] - 1)
            ids[here, at] = low
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            if ids.shape[1] == 1:
                done.append((row, ids))
                break
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] > at[:, None]), 1)
            left, right = at > 0, at < ids.shape[1] - 1
            rank[here[left], at[left] - 1] = self._rank(ids[here[left], at[left] - 1], ids[here[left], at[left]])
            rank[here[right], at[right]] = self._rank(ids[here[right], at[right]], ids[here[right], at[right] + 1])
        for rows, found in done:
            width, data = 4 * found.shape[1], found.astype("<u4").tobytes()
            yield from ((pieces[r], data[i * width : (i + 1) * width]) for i, r in enumerate(rows.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(2)
def _slices(path: str) -> _Slices:
    """The cache; one a task process that encodes."""
    return _Slices(load_ranks(path))


@lru_cache(2)
def _words(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's bytes in one array, and each id's start and length."""
    by_id = {i: t for t, i in load_ranks(path).items()}
    words = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    length = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts, each token's first byte in its text, and the number of tokens of each text."""
    slices, (_, _, length) = _slices(path), _words(path)
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    n_chars = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n_chars)
    first = (ends - n_chars)[n_chars > 0]
    starts = token_starts(code, first)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    edges = np.append(at[starts], at[-1]).tolist()
    data = joined.encode()
    pieces = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    slices.add(pieces)
    of_pieces = list(map(slices.__getitem__, pieces))
    slices.forget_long()
    ids = np.frombuffer(b"".join(of_pieces), "<i4")
    in_slice = np.fromiter(map(len, of_pieces), np.int64, len(of_pieces)) // 4
    tokens_before = np.concatenate([[0], np.cumsum(in_slice)])
    cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
    counts = np.diff(tokens_before[cuts])
    begin = np.cumsum(length[ids]) - length[ids]
    text_at = at[ends - n_chars]
    return ids, (begin - np.repeat(text_at, counts)).astype(np.int32), counts


def decode_tokens(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The bytes of each text, its tokens placed by their starts."""
    data, where, length = _words(path)
    n = length[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    token = np.concatenate([[0], np.cumsum(counts)])
    base = np.repeat(total[token[:-1]], counts)
    out = np.empty(total[-1], np.uint8)
    within = np.arange(total[-1]) - np.repeat(total[:-1], n)
    out[np.repeat(base + starts, n) + within] = data[np.repeat(where[ids], n) + within]
    flat, cuts = out.tobytes(), total[token].tolist()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def parts(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A text in parts of about ``size`` code points that are encoded alone as they are within the whole."""
    start = 0
    while start < len(text):
        found = _GAP.search(text, start + size) if len(text) - start > size else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, int, Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]]]:
    """Groups of rows ``(from, to)``, each with what its texts are encoded to: one piece of work, or one a part of a long text."""
    for a, b in _groups([x.as_py() or 0 for x in pc.binary_length(texts)], CHUNK_CHARS):
        some = [t or "" for t in texts[a:b].to_pylist()]
        if b - a > 1 or len(some[0]) <= CHUNK_CHARS:
            yield a, b, iter([(some, *encode_texts(some, path))])
        else:
            yield a, b, (([part], *encode_texts([part], path)) for part in parts(some[0]))


def _gathered(work: Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]], many: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, starts and counts of a group; the parts of one text are put together again."""
    if many:
        return next(work)[1:]
    ids, starts, at = [], [], 0
    for (part,), i, s, _ in work:
        ids.append(i), starts.append(s + np.int32(at))
        at += len(part.encode())
    ids, starts = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (ids, starts))
    return ids, starts, np.array([len(ids)])


def _lists(counts: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(c.astype(np.int32, copy=False))) for c in columns]


def _rows(docs: DataFrame, text_col: str, keep: list[str] | None, made: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """The columns to keep, but for those named like results, and the text as the last column; and the result's schema."""
    taken = {f.name.lower() for f in made}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    rows = docs.select(*(docs[c] for c in kept), F.coalesce(docs[text_col], F.lit("")).alias(free("whole_text", kept)))
    return rows, T.StructType([docs.schema[c] for c in kept] + made)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", starts_col: str = "token_starts", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if not given) and the ids and first bytes of each text's tokens, as arrays of int."""
    rows, schema = _rows(docs, text_col, keep, [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in (ids_col, starts_col)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, work in encoded(batch.column(batch.num_columns - 1), path):
                ids, starts, counts = _gathered(work, b - a > 1)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *_lists(counts, ids, starts)], names)

    return rows.mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", starts_col: str = "token_starts", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if not given) and the bytes that the tokens stand for."""
    kept = [c for c in (tokens.columns if keep is None else keep) if c.lower() != bytes_col.lower()]
    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField(bytes_col, T.BinaryType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            counts = np.diff(np.asarray(ids.offsets))
            for a, b in _groups(counts.tolist(), CHUNK_CHARS):
                found = decode_tokens(np.asarray(ids[a:b].flatten()), np.asarray(starts[a:b].flatten()), counts[a:b], path)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-2], pa.array(found, pa.binary())], names)

    at, ids = free("ids", kept), free("starts", kept)
    return tokens.select(*(tokens[c] for c in kept), tokens[ids_col].alias(ids), tokens[starts_col].alias(at)).mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, tokens: bool = True) -> DataFrame:
    """Encodes and decodes in one pass, so that each task has one process and one vocabulary, and compares.

    Returns ``keep`` columns (all, if not given), ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers), ``decoded_sha256``, and with ``tokens`` the arrays ``token_ids`` and ``token_starts``. A
    text whose tokens do not decode to itself is an error that ends the job.
    """
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in ("token_ids", "token_starts")] if tokens else []
    rows, schema = _rows(docs, text_col, keep, made)
    names = schema.fieldNames()

    def digests(texts: list[str], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, so_far: list) -> None:
        decoded = decode_tokens(ids, starts, counts, path)
        data, at = ids.astype("<u4").tobytes(), (4 * np.cumsum(np.append(0, counts))).tolist()
        for i, (text, back) in enumerate(zip(texts, decoded, strict=True)):
            if text.encode() != back:
                raise ValueError(f"a text of {len(text)} characters is not what its tokens decode to")
            so_far[i][0].update(data[at[i] : at[i + 1]])
            so_far[i][1].update(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, work in encoded(batch.column(batch.num_columns - 1), path):
                sums, held, n, at = [(hashlib.sha256(), hashlib.sha256()) for _ in range(a, b)], [], np.zeros(b - a, np.int64), 0
                for texts, ids, starts, counts in work:
                    digests(texts, ids, starts, counts, sums)
                    n += counts
                    if tokens:
                        held.append((ids, starts + np.int32(at)))
                        at += sum(len(t.encode()) for t in texts) if b - a == 1 else 0
                columns = [pa.array(n, pa.int64()), *(pa.array([s[k].hexdigest() for s in sums], pa.string()) for k in (0, 1))]
                if tokens:
                    columns += _lists(n, *(np.concatenate(x) for x in zip(*held, strict=True))) if held else _lists(n, *[np.empty(0, np.int32)] * 2)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *columns], names)

    return rows.mapInArrow(tidy(run), schema)
