"""Alignment, packing and vector codes against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from gleanframe.llm import alignment, codes, merges, packing, registry
from gleanframe.llm.registry import tokenizer
from tests.llm.test_operators import none, odd  # noqa: F401
from tests.oracle import compare

BYTE, PIECE, WORD = (lambda n=n: tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
STRANGE = ["<|endoftext|> and <s>", " leading", "trailing  ", "a  b   c ", "\n\nx \n y", "▁x", "a ▁b", "tab\tand nbsp  em", "<0x41>\x00\x1c y", "é é ﬁ ½", "don't I'll", "中文 字符。 无", "😀 👩‍👩‍👧 ok", "\r\n a\r b", "…—“x” y", "123 4567 8", " ", "  ", "▁", "x" * 300]


# --- 11


def slow_alignment(texts):
    """Whole texts by the libraries, all overlaps by comparing ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTE())
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECE())
    names = {i: t for t, i in a_side.get_vocab().items()}
    kept = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    of = {chr(x): x for x in kept}
    for x in range(256):
        if x not in kept:
            of[chr(256 + len([y for y in range(x) if y not in kept]))] = x

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    done, counts = [], Counter()
    for text in texts:
        if not text:
            done.append(None)
            continue
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        bytes_a = [bytes(of[c] for c in names[i]) for i in a]
        pieces = [b_side.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            done.append(None)
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links = []
        first = 0
        for i, (s, e) in enumerate(at_a):
            while at_b[first][1] <= s:
                first += 1
            j = first
            while j < len(at_b) and at_b[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        group_of = {e: k for k, e in enumerate(sorted({e for _, e in at_a} & {e for _, e in at_b}))}
        groups = [([], []) for _ in group_of]
        for side, (ids, at) in enumerate(((a, at_a), (b, at_b))):
            k = 0
            for x, (_, e) in zip(ids, at, strict=True):
                groups[k][side].append(str(x))
                k += e in group_of
        groups = [(",".join(x), ",".join(y)) for x, y in groups]
        counts.update(links)
        done.append((a, b, groups, links))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest()))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found_alignment(df):
    return Counter((r["doc_id"], *(r[c] for c in ALIGNED)) for r in df.collect())


def test_alignment_equals_whole_texts(spark, sf001):
    docs = [(r.doc_id, r.text[:3000] if r.text else r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000 + i, t) for i, t in enumerate(STRANGE)] + [(2000 + i, f"{x} {y}") for i, (x, y) in enumerate((x, y) for x in STRANGE for y in STRANGE)]
    want = Counter((i, *x) for (i, _), x in zip(docs, slow_alignment([t for _, t in docs]), strict=True))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found_alignment(alignment.align_documents(table, BYTE(), PIECE(), block=20_000)) == want  # small blocks, so that many meet the same pairs


def test_alignment_odd(spark, odd, none):  # noqa: F811
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, slow_alignment([r.text for r in rows]), strict=True))
    assert found_alignment(alignment.align_documents(odd, BYTE(), PIECE())) == want
    empty = alignment.align_documents(none, BYTE(), PIECE())
    assert empty.count() == 0 and set(empty.columns) == {"doc_id", *ALIGNED}


def test_long_texts_in_slices():
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "▁", ".", " c", "é", "12"]) for _ in range(5000)) + " "
    for size in (1, 7, 100, 10_000):
        assert " ".join(alignment.slices(text, size)) == text
    clean = text.replace("▁", "x")
    slow, fast = alignment.Aligner(BYTE(), PIECE(), False), alignment.Aligner(BYTE(), PIECE(), True)
    whole = alignment.measured([clean, "", text], slow)
    assert whole[2] is None
    for aligner in (slow, fast):
        for size in (9, 64, 1 << 20):
            found = alignment.measured([clean, "", text], aligner, size)
            assert found[0][:2] == whole[0][:2] and found[2] is None
            assert all((x == y).all() for x, y in zip(found[0][2:], whole[0][2:], strict=True))


def test_ranks_give_the_same_ids_for_all_code_points():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a {c}b1{c}" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    slow, fast = alignment.First(BYTE(), False), alignment.First(BYTE(), True)
    assert merges.same(BYTE()) and not merges.same(WORD()) and merges.same_words(WORD()) and not merges.same_words(BYTE())
    for a, b in zip(slow.encode(texts), fast.encode(texts), strict=True):
        assert (a == b).all()


def test_ranks_refuse_files_on_which_the_libraries_differ(tmp_path):
    import json

    with open(BYTE(), encoding="utf-8") as f:
        whole = json.load(f)
    known = merges.byte_level()
    vocab = {c: i for i, c in enumerate(known)}
    # "abc" is made of "ab" and "c" only, but "bc" goes first
    pairs = [["b", "c"], ["a", "b"], ["ab", "c"]]
    vocab |= {"".join(p): len(vocab) + i for i, p in enumerate(pairs)}
    (tmp_path / "odd.json").write_text(json.dumps(whole | {"model": whole["model"] | {"vocab": vocab, "merges": pairs}}))
    assert merges.ranks(str(tmp_path / "odd.json")) is None
    (tmp_path / "even.json").write_text(json.dumps(whole | {"model": whole["model"] | {"vocab": vocab, "merges": [pairs[1], pairs[2], pairs[0]]}}))
    assert merges.ranks(str(tmp_path / "even.json")) is not None


def test_words_by_ranks_equal_the_library():
    rng = random.Random(7)
    parts = ["Don't", "x'll've", "it's!!", "A1b22", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "ÀÉîßÿ", "naïve's", "·x", "½", "ſ", "İ", "é", "'s't", "''", "'S", "_a_", "$5.00", "§", "ñandú,", "x" * 300]
    letters = "abzAZ019'.,-_<|>$éÉñßøÿÀ·½İ中"
    parts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    fast, slow = packing._Ids(WORD(), True), packing._Ids(WORD(), False)
    fast._learn([p.encode() for p in parts])
    slow._learn([p.encode() for p in parts])
    assert fast == slow


def test_hot_copies_count_each(spark):
    """A third of all rows is one text; pairs count as often as it occurs, and its measures reach all of them."""
    texts = ["the same old words"] * 400 + [f"other words {i} here" for i in range(800)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *x) for i, x in enumerate(slow_alignment(texts)))
    assert found_alignment(alignment.align_documents(table, BYTE(), PIECE(), block=1000)) == want


# --- 12


def plain_best_fit(lengths, capacity):
    """Each piece on its own into the fullest sequence with room."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return Counter(room)


def laid(runs, counts, capacity):
    """All pieces placed by the runs, checked to lie side by side; the rooms left."""
    by_length, held = {}, {}
    for r in runs:
        by_length.setdefault(r.length, []).append(r)
    for length, n in counts.items():
        for k in range(n):
            r = [r for r in by_length[length] if r.first <= k][-1]
            skip, within = divmod(k - r.first, r.each)
            held.setdefault(r.into + skip, []).append((r.offset + within * length, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return Counter(capacity - sum(n for _, n in parts) for parts in held.values())


def test_runs_equal_piece_after_piece():
    rng = random.Random(8)
    for capacity in (1, 7, 10, 64, 100):
        for _ in range(40):
            lengths = [min(capacity, max(1, int(rng.expovariate(4 / capacity)) + 1)) if rng.random() < 0.7 else rng.choice([1, capacity // 2 + 1, capacity]) for _ in range(rng.randrange(1, 150))]
            counts = Counter(lengths)
            assert laid(packing.best_fit(counts, capacity), counts, capacity) == plain_best_fit(lengths, capacity)
    assert packing.best_fit({}, 8) == []
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, 8)


def test_work_does_not_grow_with_counts():
    rng = random.Random(2)
    some = {n: rng.randrange(1, 50) for n in range(1, 257)}
    few, many = packing.best_fit(some, 256), packing.best_fit({k: v * 10**9 for k, v in some.items()}, 256)
    assert len(many) < 4 * len(few) < 4 * 48 * 256


def slow_pieces(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD())
    out = []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc, n, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out


def check_packing(df, rows, capacity):
    found = df.collect()
    want = slow_pieces(rows, capacity)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == Counter(want)
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(capacity - sum(n for _, n in p) for p in held.values()) == plain_best_fit([w[3] for w in want], capacity)


def test_packing_equals_plain(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_packing(registry.op12_packing(spark, sf001), rows, 4096)
    check_packing(packing.pack(docs, WORD(), capacity=100), rows, 100)


def test_packing_odd(spark, odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_packing(packing.pack(odd, WORD(), 4096), rows, 4096)
    empty = packing.pack(none, WORD())
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    strange = list(enumerate(STRANGE))
    check_packing(packing.pack(spark.createDataFrame(strange, "doc_id long, text string"), WORD(), 7), strange, 7)


def test_sequences_hold_their_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD())
    rows = [(i, "some words of text " * (i % 7)) for i in range(40)]
    found = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string"), WORD(), capacity=64).collect()
    assert all(len(r.ids) <= 64 for r in found)
    of = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in rows}
    parts = Counter((d, tuple(r.ids[a:b])) for r in found for d, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], len(r.ids)], strict=True))
    assert parts == Counter((i, tuple(ids[s : s + 64])) for i, ids in of.items() for s in range(0, len(ids), 64))


# --- 13


def test_codes_equal_sql(spark, sf01):
    compare(spark, sf01, "op13_codes", registry.op13_codes, registry.ORACLE_SQL["op13_codes"])


def slow_codes(rows, parts=8, words=16, rounds=6):
    """``rows``: usable ``(vec_id, label, x)`` of whole numbers; everything evaluated."""
    width = len(rows[0][2]) // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:words]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def nearest(book, y):
        return min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, x in rows:
                y = x[p * width : (p + 1) * width]
                of.setdefault(nearest(books[p], y)[1], []).append(y)
            for j, ys in of.items():
                books[p][j] = [sum(c) // len(ys) for c in zip(*ys, strict=True)]
    out = []
    for v, label, x in rows:
        found = [nearest(books[p], x[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((v, label, bytes(j for _, j in found), sum(d for d, _ in found)))
    by = Counter()
    for _, label, _, e in out:
        by[label] += e
    return Counter((*o, by[o[1]]) for o in out), books


def test_codes_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (i % 3) or None, rng.normal(size=16).tolist(), "x") for i in range(60)]
    rows += [rows[5], rows[5], (None, 1, rng.normal(size=16).tolist(), "x"), (70, None, [0.0] * 16, None), (71, 2, [0.25, -0.25] * 8, None)]
    bad = [(80, 1, None, ""), (81, 1, [None] * 16, ""), (82, 1, [float("nan")] * 16, ""), (83, 1, [float("inf")] * 16, ""), (84, 1, [], ""), (85, 1, [1.0] * 8, "")]
    table = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>, code string")
    coded, books = codes.compress(table)
    whole = [(v, label, [int(np.floor(4096 * c)) for c in x]) for v, label, x, _ in rows]
    want, plain = slow_codes(whole)
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in coded.collect()) == want
    assert books.tolist() == plain
    assert codes.digest(books) == hashlib.sha256(",".join(str(c) for b in plain for w in b for c in w).encode()).hexdigest()
    few, books = codes.compress(table.where("vec_id < 3"))
    assert books.shape == (8, 3, 2) and few.count() == 3 and {r.error for r in few.collect()} == {0}
    assert codes.compress(table.where("false"))[0].count() == 0
    assert codes.compress(spark.createDataFrame(bad[:5], table.schema))[0].count() == 0
    for wrong in ([1.0] * 12, [1e30] * 16):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame([(1, 1, wrong, "")], table.schema))


def test_label_errors_beyond_a_long_are_null(spark):
    rows = [(i, int(i > 18), [0.0] * 8) for i in range(20)] + [(20 + i, 0, [1.2e5] * 8) for i in range(5)]
    found = codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), words=1, rounds=0)[0].collect()
    assert {r.error for r in found} == {0, 8 * 491520000**2}
    assert {(r.label, r.label_error) for r in found} == {(0, None), (1, 0)}


def test_grid_changes_nothing_and_spares_work():
    rng = np.random.default_rng(1)
    book = rng.integers(-3000, 3000, (16, 4))
    parts = book[rng.integers(0, 16, 20_000)] + rng.normal(0, 60, (20_000, 4)).astype(np.int64)
    d = ((parts[:, None, :] - book) ** 2).sum(2)
    for shift in (None, 0, 3, 9, 14):
        for most in (1 << 16, 10):
            grid = codes.Grid(book, shift, most)
            for half in (parts[:10_000], parts[10_000:]):
                at, best = grid.nearest(half)
                want = d[:10_000] if half is not None and np.shares_memory(half, parts[:10_000]) else d[10_000:]
                assert (at == want.argmin(1)).all() and (best == want.min(1)).all()
            if shift is None:
                assert grid.evaluated < 0.5 * len(parts) * len(book)


def test_cells_whose_hashes_meet_stay_apart(monkeypatch):
    rng = np.random.default_rng(2)
    book, parts = rng.integers(-500, 500, (16, 4)), rng.integers(-600, 600, (3000, 4))
    monkeypatch.setattr(codes.Grid, "_hash", lambda self, cells: (cells[:, 0] % 2).astype(np.uint64))
    at, best = codes.Grid(book, 6).nearest(parts)
    d = ((parts[:, None, :] - book) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, 0, rng.normal(size=16).tolist()) for i in range(200)], "vec_id long, label int, embedding array<double>")
    coded, books = codes.compress(table)
    found = codes.decode(coded, books).join(table.withColumnRenamed("label", "l"), "vec_id").select("error", "x", "embedding").collect()
    for r in found:
        apart = ((np.array(r.x) - np.array(r.embedding)) ** 2).sum() * 4096**2
        assert abs(apart - r.error) <= 0.1 * r.error + 16 * 4096
