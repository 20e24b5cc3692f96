"""Getting text, values and rows out of responses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"article", "aside", "blockquote", "div", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Open elements that a new one ends, where their end tags may be left out.
ENDS = {**dict.fromkeys(BLOCKS, {"p"}), "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}}


def decode_text(content: Column, encoding: Column) -> Column:
    """Text of a body: the forced encoding, else a byte order mark or a declared charset, else UTF-8; bad bytes are replaced.

    Bodies in valid UTF-8 that name no other encoding never leave the JVM; only the others are sent to Python's codecs.
    """
    @F.pandas_udf("string")
    def run(bodies: pd.Series, forced: pd.Series) -> pd.Series:
        def one(body: bytes | None, name: str | None) -> str | None:
            if body is None:
                return None
            found = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", body[:2048])
            for codec in (name, "utf-8-sig" if body.startswith(b"\xef\xbb\xbf") else None, found and found[1].decode(), "utf-8"):
                try:
                    if codec:
                        return body.decode(codec, "replace")
                except LookupError:
                    continue

        return pd.Series([one(b, e) for b, e in zip(bodies, forced, strict=True)])

    body = content.cast("binary")
    declared = F.lower(F.regexp_extract(F.substring(body, 1, 2048).cast("string"), "charset=[\"']?([A-Za-z0-9_-]+)", 1))
    marked = F.substring(body, 1, 3) == F.lit(b"\xef\xbb\xbf")
    free = F.coalesce(encoding == "", F.lit(True))
    plain = free & (marked | declared.isin("", "utf-8", "utf8")) & F.is_valid_utf8(body.cast("string"))
    text = F.when(marked, F.substring(body, 4, 1 << 30)).otherwise(body).cast("string")
    return F.when(plain, text).otherwise(run(F.when(~plain, body), encoding))


class Step(NamedTuple):
    """One element of a selector: below the one before, or right below it; ``tests`` are ``(kind, name, value)``."""

    child: bool
    tag: str
    tests: tuple[tuple[str, str, str | int], ...]


class Path(NamedTuple):
    """Steps, and what is wanted of the elements at their end: ``text``, ``texts`` (at any depth) or ``@name``."""

    steps: tuple[Step, ...]
    want: str


#: How an attribute's value is compared.
COMPARE = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": lambda have, value: value in have.split()}


class _Open:
    """An open element: the steps it and those above it end, the wanted it is part of, and its children counted."""

    def __init__(self, tag: str, here: list[set[int]], above: list[set[int]], hits: set[str]) -> None:
        self.tag, self.here, self.above, self.hits, self.children, self.twins = tag, here, above, hits, 0, Counter()


class _Select(HTMLParser):
    """Texts and attributes, in the page's order, of the elements that some paths lead to; one pass, a set of steps a level."""

    def __init__(self, paths: list[Path]) -> None:
        super().__init__(convert_charrefs=True)
        self.paths, self.found = paths, []
        self.open = [_Open("", [{-1} for _ in paths], [set() for _ in paths], set())]

    @staticmethod
    def _fits(step: Step, tag: str, attrs: dict[str, str], place: int, twin: int) -> bool:
        def holds(kind: str, name: str, value: str | int) -> bool:
            if kind in ("place", "twin"):
                return value == (place if kind == "place" else twin)
            return name in attrs and (kind == "has" or COMPARE[kind](attrs[name], value))

        return step.tag in ("*", tag) and all(holds(*t) for t in step.tests)

    def handle_starttag(self, tag: str, given: list) -> None:
        while self.open[-1].tag in ENDS.get(tag, ()):
            self.open.pop()
        attrs = {k: v or "" for k, v in reversed(given)}
        parent = self.open[-1]
        parent.children += 1
        parent.twins[tag] += 1
        here, hits = [], set()
        above = [a | h for a, h in zip(parent.above, parent.here, strict=True)]
        for n, (steps, want) in enumerate(self.paths):
            ended = {i for i, s in enumerate(steps) if i - 1 in (parent.here[n] if s.child else above[n]) and self._fits(s, tag, attrs, parent.children, parent.twins[tag])}
            here.append(ended)
            if len(steps) - 1 in ended:
                hits.add(want)
        self.found += [attrs[w[1:]] for w in dict.fromkeys(p.want for p in self.paths) if w in hits and w[1:] in attrs and w[0] == "@"]
        if tag not in VOID:
            self.open.append(_Open(tag, here, above, hits | (parent.hits & {"texts"})))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open[-1].hits & {"text", "texts"}:
            self.found.append(data)


CSS_PART = re.compile(
    r"""\s*(?P<child>>)\s*|(?P<below>\s+)|(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[\w-]+)\s*)?\]|:nth-child\(\s*(?P<place>\d+)\s*\)|(?P<first>:first-child)""",
    re.X,
)
XPATH_STEP = re.compile(r"(?P<axis>//?)(?P<tag>[A-Za-z][\w-]*|\*)(?P<tests>(?:\[[^\]]*\])*)")
XPATH_TEST = re.compile(r"""\[\s*(?:(?P<place>\d+)|@(?P<attr>[\w:-]+)(?:\s*=\s*(?P<value>"[^"]*"|'[^']*'))?|contains\(\s*@(?P<part>[\w:-]+)\s*,\s*(?P<inside>"[^"]*"|'[^']*')\s*\))\s*\]""")


def parse_selector(css: str) -> list[Path]:
    """The paths of ``a.b#c > d[e="f"]:nth-child(2) g::text, h::attr(i)``; anything else is refused."""
    paths = []
    for one in re.findall(r"""(?:[^,"']|"[^"]*"|'[^']*')+""", css):
        body, _, pseudo = one.strip().partition("::")
        attr = re.fullmatch(r"attr\(\s*([\w:-]+)\s*\)", pseudo)
        if pseudo not in ("", "text") and not attr:
            raise ValueError(f"cannot select by {one!r}")
        steps, at, child, tag, tests = [], 0, False, None, []
        while at < len(body):
            m = CSS_PART.match(body, at)
            if not m or (m["tag"] and (tag or tests)) or ((m["child"] or m["below"]) and not (tag or tests)):
                raise ValueError(f"cannot select by {one!r}")
            at = m.end()
            if m["child"] or m["below"]:
                steps.append(Step(child, tag or "*", tuple(tests)))
                child, tag, tests = bool(m["child"]), None, []
            elif m["tag"]:
                tag = m["tag"].lower()
            elif m["id"] or m["class"]:
                tests.append(("=", "id", m["id"]) if m["id"] else ("~=", "class", m["class"]))
            elif m["attr"]:
                tests.append((m["op"] or "has", m["attr"].lower(), (m["value"] or "").strip("\"'")))
            else:
                tests.append(("place", "", int(m["place"] or 1)))
        if not (tag or tests):
            raise ValueError(f"cannot select by {one!r}")
        paths.append(Path((*steps, Step(child, tag or "*", tuple(tests))), f"@{attr[1].lower()}" if attr else "text"))
    if not paths:
        raise ValueError("an empty selector")
    return paths


def parse_xpath(xpath: str) -> list[Path]:
    """The paths of ``//a[@b="c"]/d[2]/text() | //e[contains(@f, "g")]/@h``, with ``//text()`` for all depths; anything else is refused."""
    paths = []
    for one in re.findall(r"""(?:[^|"']|"[^"]*"|'[^']*')+""", xpath):
        body = one.strip()
        end = re.search(r"(/text\(\)|//text\(\)|//?@([\w:-]+))$", body)
        want = "text" if not end else f"@{end[2].lower()}" if end[2] else "texts" if end[1].startswith("//") else "text"
        body = body[: end.start()] if end else body
        if end and end[1].startswith("//@"):
            body = body or "//*"
            if body != "//*":
                raise ValueError(f"cannot select by {one!r}")
        steps, at = [], 0
        while at < len(body):
            m = XPATH_STEP.match(body, at)
            if not m:
                raise ValueError(f"cannot select by {one!r}")
            at, tests, asked = m.end(), [], m["tests"]
            while asked:
                t = XPATH_TEST.match(asked)
                if not t or (t["place"] and tests):  # a place counted among those that pass other tests
                    raise ValueError(f"cannot select by {one!r}")
                if t["place"]:
                    tests.append(("place" if m["tag"] == "*" else "twin", "", int(t["place"])))
                elif t["attr"]:
                    tests.append(("has" if t["value"] is None else "=", t["attr"].lower(), (t["value"] or "")[1:-1]))
                else:
                    tests.append(("*=", t["part"].lower(), t["inside"][1:-1]))
                asked = asked[t.end() :]
            steps.append(Step(m["axis"] == "/", m["tag"].lower(), tuple(tests)))
        if not steps:
            raise ValueError(f"cannot select by {one!r}")
        paths.append(Path(tuple(steps), want))
    if not paths:
        raise ValueError("an empty selector")
    return paths


def _select(html: Column, paths: list[Path], references: Sequence[str] | None = None) -> Column:
    left = None if references is None else re.compile(rf"&(?!(?:{'|'.join(map(re.escape, references))});)" if references else "&")

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[str] | None:
            if page is None:
                return None
            parser = _Select(paths)
            if left is None:
                parser.feed(page)
                parser.close()
                return parser.found
            mark = next(m for m in map(chr, range(0xF0000, 0x10FFFF)) if m not in page)  # stands for an ampersand that stays
            parser.feed(left.sub(mark, page))
            parser.close()
            return [x.replace(mark, "&") for x in parser.found]

        return pages.map(one)

    return run(html)


def css(html: Column, selector: str) -> Column:
    """All matches in the page's order; without ``::text`` or ``::attr(name)`` the elements' own texts. Null for a null page."""
    return _select(html, parse_selector(selector))


def xpath(html: Column, path: str, references: Sequence[str] | None = None) -> Column:
    """All matches in the page's order; a path to elements gives their own texts. Null for a null page.

    Character references are taken as HTML has them, unless ``references`` names those (``amp``, with their semicolon)
    that are; all others then stay as they are written.
    """
    return _select(html, parse_xpath(path), references)


def regex_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def regex_first(text: Column, pattern: str, default: str | None = None, group: int = 1) -> Column:
    return F.coalesce(F.get(regex_all(text, pattern, group), 0), F.lit(default))


def callbacks(responses: DataFrame, parse: Callable[[dict], Iterator[tuple[str, str, str | None]]]) -> DataFrame:
    """``(url, kind, target, payload)``: what ``parse(row)`` yields, ``kind`` being request, item or error.

    An exception becomes an ``error`` row, so nothing vanishes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out += [(row["url"], *x) for x in parse(row)]
                except Exception as e:  # noqa: BLE001
                    out.append((row["url"], "error", type(e).__name__, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["url", "kind", "target", "payload"])

    return responses.mapInArrow(run, "url string, kind string, target string, payload string")


def fetch(requests: DataFrame, fetcher: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The one place for live input: ``fetcher`` maps batches of requests to batches of responses."""
    return requests.mapInPandas(fetcher, schema)
