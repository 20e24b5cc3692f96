"""BPE files of the ``tokenizers`` library, run by ``tiktoken``'s faster merging where that is sure to give the same ids.

``tokenizers`` merges listed pairs in their order; ``tiktoken`` merges whatever neighbours make a known token, the lowest rank first. With
ranks in the order of the merges, both agree on all texts if every token, taken alone, is merged into itself by the listed pairs:
were two neighbours inside some text to make a token in another way than its pair does, the same neighbours would stand
inside that token taken alone and stay apart there. :func:`ranks` holds a file against that, and refuses it otherwise; then
the library itself encodes.
"""

from __future__ import annotations

import json
from functools import lru_cache

#: Fixed value: how byte-level vocabularies of this kind part texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A byte that no UTF-8 text holds stands for the end of a word.
END = b"\xff"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _alone(token: bytes, pairs: dict[tuple[bytes, bytes], int]) -> bool:
    """Whether the listed pairs merge a token's bytes into the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = min(((pairs.get(p, len(pairs)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(len(pairs), 0))
        if best == len(pairs):
            return False
        pair, out, i = (parts[at], parts[at + 1]), [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return True


@lru_cache(4)
def ranks(path: str, held: bool = False) -> tuple[dict[bytes, int], dict[int, int]] | None:
    """Ranks by bytes, and the file's id of each rank; None if the two libraries might differ. Words' ends are :data:`END`.

    ``held`` says that the file was held against that already.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, of = model.get("end_of_word_suffix") or "", byte_level()
    if model["type"] != "BPE" or any(model.get(x) for x in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout")):
        return None

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(of[c] for c in (token[: -len(suffix)] if ends else token)) + (END if ends else b"")

    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = [bytes([b]) for b in range(256)]
    ends = [b + END for b in single] if suffix else []
    order = [*ends, *single, *(a + b for a, b in merges)]
    ids = {raw(t): i for t, i in model["vocab"].items()}
    rank = {t: i for i, t in enumerate(order)}
    pairs = {(b, END): i for i, b in enumerate(single)} if suffix else {}
    pairs |= {m: i + len(pairs) for i, m in enumerate(merges)}
    # a token that two pairs make would have two ranks; a known one without a rank could never be made here
    if len(rank) != len(order) or len(pairs) != len(ends) + len(merges) or set(ids) - set(rank) or not (held or all(_alone(t, pairs) for t in rank)):
        return None
    return rank, {r: ids[t] for t, r in rank.items() if t in ids}


def _whole(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(4)
def same(path: str) -> bool:
    """Whether a file parts texts by :data:`PATTERN`, as they are, and :func:`ranks` holds for it; the driver asks once, so that tasks need not."""
    whole = _whole(path)
    first = whole.get("pre_tokenizer") or {}
    return whole.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and ranks(path) is not None


#: Fixed value: how the word-level vocabulary's file finds words in texts that it has lower-cased.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(4)
def same_words(path: str) -> bool:
    """Whether a file lower-cases texts and parts them by :data:`WORDS`, and :func:`ranks` holds for it."""
    whole = _whole(path)
    kinds = [n["type"] for n in (whole.get("normalizer") or {}).get("normalizers", [])]
    first = ((whole.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    found = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first.get("pattern") == {"Regex": WORDS}
    return kinds == ["NFC", "Replace", "Lowercase"] and bool(found) and ranks(path) is not None


def encoding(path: str, rank: dict[bytes, int]):
    """A ``tiktoken`` encoding by some ranks."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=rank, special_tokens={})
