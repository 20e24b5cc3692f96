"""Identity of URLs, requests and items, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_key(url: Column) -> Column:
    """Lower-cased authority of a URL, with port and user; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _form(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """The URL without its fragment, its query's decoded pairs sorted and encoded as a form. Blank values stay."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    pair = lambda p: F.struct(decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair))
    encoded = F.array_join(F.transform(pairs, lambda p: F.concat(_form(p["k"]), F.lit("="), _form(p["v"]))), "&")
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), encoded)).otherwise(base)


def request_fingerprint(method: Column, url: Column, body: Column | None = None) -> Column:
    """MD5 of method, canonical URL and body; headers and cookies don't count."""
    return F.md5(F.concat_ws("|", F.upper(method), canonical_url(url), F.coalesce(body, F.lit("")) if body is not None else F.lit("")))


def item_fingerprint(table: str, fields: Sequence[str], key: Sequence[str] = (), update: bool = False) -> Column:
    """MD5 of the table's name and the key fields in order of name.

    Null and empty key fields are left out; if all are, or without a key, or for an update, every field counts.
    Values carry their type's name, so that 1 and '1' differ.
    """
    shown = lambda c, keep: F.when(F.lit(keep) | (F.col(c).isNotNull() & (F.col(c).cast("string") != "")), F.concat(F.lit(c + "="), F.typeof(F.col(c)), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))))
    every = F.array(*(shown(c, True) for c in sorted(fields)))
    some = F.array_compact(F.array(*(shown(c, False) for c in sorted(key or fields))))
    parts = every if update else F.when(F.size(some) > 0, some).otherwise(every)
    return F.md5(F.concat_ws("|", F.lit(table), parts))


def join_url(base: Column, link: Column) -> Column:
    """A link resolved against a page's http(s) URL as ``urllib.parse.urljoin`` does it.

    An empty link is the page itself, and links of another scheme stay as they are. Others lose blanks before them, tabs and line
    ends inside them, and an empty query or fragment. Dot segments are resolved in paths, not in links that name a host;
    relative paths lose empty segments.
    """
    pattern = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda url, i: F.regexp_extract(url, pattern, i)
    bare = F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme, host = F.lower(part(base, 1)), part(base, 2)
    own, path, query, fragment = part(bare, 2), part(bare, 3), part(bare, 4), part(bare, 5)
    mark = lambda sign, text: F.when(text != "", F.concat(F.lit(sign), text)).otherwise("")
    rooted = lambda p: F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    url = lambda at, p, q: F.concat(scheme, F.lit("://"), at, rooted(p), mark("?", q), mark("#", fragment))
    # the page's folder, then the link's segments; only the first and the last may be empty
    folder = F.filter(F.split(F.regexp_replace(part(base, 3), "[^/]+$", ""), "/"), lambda x: x != "")
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    inner = F.filter(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda x: x != "")
    segments = F.when(path.startswith("/"), steps).otherwise(F.concat(F.array(F.lit("")), folder, inner, F.array(last)))
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    walk = lambda kept, x: F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x)))
    walked = F.aggregate(segments, F.array().cast("array<string>"), walk)
    closed = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(closed, "/")
    foreign = (part(bare, 1) != "") & (F.lower(part(bare, 1)) != scheme)
    return (
        F.when(link == "", base)
        .when(foreign, link)
        .when(own != "", url(own, path, query))
        .when(path == "", url(host, part(base, 3), F.when(query != "", query).otherwise(part(base, 4))))
        .otherwise(url(host, F.when(joined == "", "/").otherwise(joined), query))
    )


def links(html: Column) -> Column:
    """The ``href`` values of a page's anchors: in any case, in either quotes or none, with entities decoded."""
    quoted = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?(?<=[\s"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(quoted, lambda q: unescape(F.trim(F.regexp_replace(q, "^[\"']|[\"']$", ""))))


def unescape(text: Column) -> Column:
    """Numeric entities and HTML's named ones as the characters they stand for; other names stay."""
    code = lambda e: F.when(F.lower(F.left(e, F.lit(1))) == "x", F.substring(e, 2, 8)).otherwise(F.conv(e, 10, 16))
    char = lambda e: F.decode(F.unhex(F.lpad(code(e), 8, "0")), "UTF-32")
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))
    out = F.aggregate(numbers, text, lambda t, e: F.replace(t, F.concat(F.lit("&#"), e, F.lit(";")), char(e)))
    known = F.create_map(*[F.lit(x) for name, code_ in (name2codepoint | {"apos": 39}).items() if name != "amp" for x in (name, chr(code_))])
    names = F.array_distinct(F.regexp_extract_all(out, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    out = F.aggregate(F.filter(names, lambda e: known[e].isNotNull()), out, lambda t, e: F.replace(t, F.concat(F.lit("&"), e, F.lit(";")), known[e]))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))  # last, so that nothing is decoded twice


def request_body(data: Column, json: Column, params: Column) -> Column:
    """What stands for a request's body in its fingerprint: ``data`` if there is any, else ``json``, else ``params``.

    Both maps become JSON in order of key, written as ``{"a": "1", "b": "2"}``.
    """
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    pair = lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))
    joined = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), pair), ", ")
    sorted_json = lambda m: F.when(F.size(m) > 0, F.concat(F.lit("{"), joined(m), F.lit("}")))
    return F.coalesce(F.when(data != "", data), sorted_json(json), sorted_json(params), F.lit(""))


def table_name(class_name: str) -> str:
    """Snake case of a class's name, every capital beginning a word, without a trailing ``_item``."""
    words = "".join(f" {c}" if c.isupper() else c for c in class_name).split()
    return "_".join(words).lower().removesuffix("_item")
