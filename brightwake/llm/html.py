"""Main text of HTML pages, by the distribution of text over blocks of lines.

Markup is stripped to lines, one for each block of the page. The distribution gives each
line the characters it adds to the text: none if the line belongs to a menu, header,
footer, sidebar, notice, advert, form or comment, and only those outside links otherwise.
Sums over sliding windows of lines surge where the text begins and dive where it ends;
what lies between is kept, short lines included. Parts of the page that say what they are
set the walls: an article, or failing that the main part, is the only place where sums are
taken, and in it any text is a surge. A page that says nothing needs a window of
``SURGE`` characters, or half of its greatest one if that is less.

What a part is follows from its element, its role and the words of its class and id.
Articles within an article are comments on it. A header in an article has its headings
only.

Defined results: null or empty html, and pages without text, give an empty text; markup
that is cut off or never closed ends with the page; unknown elements are inline; a page of
any size is taken in one pass, in time linear in its length; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a window, and the characters it needs where no part of the page is named.
LINES, SURGE = 3, 90
#: An article besides the longest is part of the text from this share of it on.
SHARE = 0.5

# Names of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section "
    "select summary table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_PHRASES = frozenset("abbr b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe label legend math menu nav noembed noframes noscript "
    "object optgroup option script select style svg template textarea title video".split()
)
#: What a block closes that cannot hold it.
_CLOSES = {
    "li": {"p", "li"},
    "dt": {"p", "dt", "dd"},
    "dd": {"p", "dt", "dd"},
    "tr": {"p", "tr", "td", "th"},
    "td": {"p", "td", "th"},
    "th": {"p", "td", "th"},
    "option": {"option"},
}

# Words of classes, ids and roles.
_OTHER_WORDS = frozenset(
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs crumbs topbar toolbar tabs masthead banner footer colophon "
    "sidebar sidebars sidenav aside rail complementary contentinfo widget widgets ad ads adv advert adverts advertisement advertisements advertising adsense "
    "adbox adslot adunit sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts alertdialog popup modal overlay lightbox toast subscribe subscription newsletter signup signin login "
    "comment comments commentlist disqus respond reply replies discussion responses share sharing social related recommended "
    "recommendations trending pagination pager paging search searchbox searchform form copyright legal privacy disclaimer tagcloud skip "
    "skiplink hidden poll survey feedback".split()
)
_HEADER_WORDS = frozenset(["header"])
#: A class with one of these tells how the page is laid out around a part, not what the part is.
_LAYOUT_WORDS = frozenset("with has no without open closed enabled disabled".split())
_MAIN_NAMES = frozenset(
    "main content article story entry post maincontent main-content content-main article-body articlebody article-content article-text "
    "post-body post-content entry-content entry-body story-body story-content page-content body-content body-text".split()
)
#: Wrong nesting or a wrapper around the page: a main part in one of these is still the main part.
_WRAPPERS = frozenset("form nav header footer".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CASED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUOTED = re.compile(r"[^>\"']*")
_STOPS = re.compile(r"[.!?…:;\"”»)\]]$")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line(NamedTuple):
    text: str
    linked: int
    heading: bool
    #: Left out: of a menu, an advert and the like.
    other: bool
    #: Innermost article, negative within another, and innermost main part, by number; 0 is none.
    article: int
    main: int


class _Part(NamedTuple):
    name: str
    other: bool
    #: Left out only because of an element that may wrap the page.
    wrapped: bool
    header: bool
    heading: bool
    link: bool
    article: int
    main: int


def _tag_end(html: str, at: int, quotes: dict[str, int]) -> int:
    """Where the tag that begins before ``at`` ends, its ``>`` excluded; quotes without an end are plain characters."""
    while True:
        at = _QUOTED.match(html, at).end()
        if at >= len(html) or html[at] == ">":
            return at
        mark = html[at]
        close = html.find(mark, at + 1) if quotes.get(mark) is None else -1
        if close < 0:
            quotes[mark] = at
            at += 1
        else:
            at = close + 1


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(value.strip("\"'")))
    return found


def _named(attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether classes, id and role tell of a part that is left out, of a header, and of the main part."""
    other = header = main = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split():
        words = {w.lower() for w in _CASED.findall(name)}
        if words & _LAYOUT_WORDS:
            continue
        main |= name.lower().replace("_", "-") in _MAIN_NAMES
        header |= not words.isdisjoint(_HEADER_WORDS)
        other |= not words.isdisjoint(_OTHER_WORDS)
    other |= "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDES.search(attributes.get("style", "")))
    return other, header, main or attributes.get("itemprop", "").lower() == "articlebody"


_PAGE = _Part("", False, False, False, False, False, 0, 0)


class _Stripper:
    """Turns a page into lines."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self._open: list[_Part] = [_PAGE]
        self._count: dict[str, int] = {}
        self._held: list[str] = []
        self._linked = 0
        self._dropped = False
        self._parts = 0

    def _end_line(self) -> None:
        if self._held or self._dropped:
            text = " ".join("".join(self._held).split())
            if text or self._dropped:
                part = self._open[-1]
                self.lines.append(Line(text, min(self._linked, len(text)), part.heading, not text, part.article, part.main))
        self._held, self._linked, self._dropped = [], 0, False

    def _text(self, raw: str) -> None:
        part = self._open[-1]
        text = unescape(raw) if "&" in raw else raw
        if part.other or part.header and not part.heading:
            self._dropped |= not text.isspace()
            return
        self._held.append(text)
        if part.link:
            self._linked += len(" ".join(text.split()))

    def _pop(self) -> None:
        part = self._open.pop()
        self._count[part.name] -= 1

    def _push(self, name: str, source: str) -> None:
        up = self._open[-1]
        attributes = _attributes(source) if source else {}
        named, header, main = _named(attributes) if attributes else (False, False, False)
        if name in ("html", "body", "main"):
            named = header = False
        elif name in _HEADINGS:
            header = False
        main |= name == "main"
        article, kept_main = up.article, up.main
        other, wrapped = up.other, up.wrapped
        own = name in _LEFT_OUT or named or (name == "header" or header) and not (article or kept_main)
        if (name in ("main", "article") and not named) and up.other and up.wrapped:
            other = wrapped = False
        if own and not other:
            other, wrapped = True, name in _WRAPPERS
        elif own and name not in _WRAPPERS:
            wrapped = False
        if name == "article" and not other:
            self._parts += 1
            article = -self._parts if article else self._parts
        elif main and not other:
            self._parts += 1
            kept_main = self._parts
        inner_header = up.header or bool(article or kept_main) and (name == "header" or header) and name not in ("article", "main")
        self._open.append(_Part(name, other, wrapped, inner_header, up.heading or name in _HEADINGS, up.link or name == "a", article, kept_main))
        self._count[name] = self._count.get(name, 0) + 1

    def _start(self, name: str, source: str) -> None:
        if name in _BLOCKS:
            self._end_line()
            closes = _CLOSES.get(name, {"p"})
            # Up to the nearest other block; a paragraph in a list item goes before the item.
            at = len(self._open) - 1
            while at > 0 and (self._open[at].name in closes or self._open[at].name not in _BLOCKS):
                if self._open[at].name in closes:
                    while len(self._open) > at:
                        self._pop()
                at -= 1
        elif name == "br":
            self._text(" ")
        if name not in _VOID and name not in _PHRASES:
            self._push(name, source)

    def _end(self, name: str) -> None:
        if name in _BLOCKS:
            self._end_line()
        if name in ("html", "body") or not self._count.get(name):
            return
        while self._open[-1].name != name:
            self._pop()
        self._pop()

    def strip(self, html: str) -> list[Line]:
        at, n, quotes = 0, len(html), {}
        low = html.lower()
        if len(low) != n:
            low = html
        missing: set[str] = set()
        while at < n:
            begin = html.find("<", at)
            if begin < 0:
                begin = n
            if begin > at:
                self._text(html[at:begin])
            if begin + 1 >= n:
                if begin < n:
                    self._text("<")
                break
            following = html[begin + 1]
            name_at = begin + 2 if following == "/" else begin + 1
            name = _NAME.match(html, name_at)
            if name:
                end = _tag_end(html, name.end(), quotes)
                tag, source = name.group().lower(), html[name.end() : end]
                at = end + 1
                if following == "/":
                    self._end(tag)
                    continue
                if end >= n:
                    break
                self._start(tag, source)
                if tag in _RAW:
                    close = -1 if tag in missing else low.find(f"</{tag}", at)
                    if close >= 0:
                        at = close
                    else:
                        missing.add(tag)
                        self._end(tag)
                        if tag in ("script", "style"):
                            break
            elif html.startswith("<!--", begin):
                close = html.find("-->", begin + 4) if not html.startswith("<!-->", begin) else begin + 2
                at = n if close < 0 else close + 3
            elif following in "!?/":
                close = html.find(">", begin)
                at = n if close < 0 else close + 1
            else:
                self._text("<")
                at = begin + 1
        self._end_line()
        return self.lines


def _weights(lines: list[Line], inside: list[bool]) -> list[int]:
    return [0 if line.other or not scope else len(line.text) - (0 if line.heading else line.linked) for line, scope in zip(lines, inside, strict=True)]


def surges(weights: list[int], least: int, window: int = LINES) -> list[tuple[int, int]]:
    """First and last line of each part between a surge and a dive: the sum of a window of lines from there on is ``least`` or more until it falls below.

    A surge is put on the first line with weight of its window, a dive on the last one before it.
    """
    out, at, n = [], 0, len(weights)
    total = sum(weights[:window])
    begin = None
    for at in range(n + 1):
        high = at < n and total >= least
        if high and begin is None:
            begin = at
        elif not high and begin is not None:
            last = min(n - 1, at - 1 + window - 1)
            while weights[last] == 0:
                last -= 1
            while weights[begin] == 0:
                begin += 1
            if out and begin <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(last, out[-1][1]))
            else:
                out.append((begin, last))
            begin = None
        if at < n:
            total += (weights[at + window] if at + window < n else 0) - weights[at]
    return out


def _scope(lines: list[Line]) -> tuple[list[bool], bool]:
    """Which lines sums are taken over, and whether the page named them."""
    for kind, sign in (("article", 1), ("article", -1), ("main", 1)):
        sizes: dict[int, int] = {}
        for line in lines:
            part = getattr(line, kind)
            if part * sign > 0 and not line.other:
                sizes[part] = sizes.get(part, 0) + len(line.text) - line.linked
        most = max(sizes.values(), default=0)
        if most:
            chosen = {p for p, size in sizes.items() if size >= SHARE * most}
            return [getattr(line, kind) in chosen for line in lines], True
    return [True] * len(lines), False


def main_lines(html: str | None) -> list[str]:
    """Blocks of the main text in page order."""
    lines = _Stripper().strip(html or "")
    inside, named = _scope(lines)
    weights = _weights(lines, inside)
    if named:
        found = surges(weights, 1)
        keep = [(found[0][0], found[-1][1])] if found else []
    else:
        keep = _unnamed(lines, weights)
    return [line.text for a, b in keep for line, scope in zip(lines[a : b + 1], inside[a : b + 1], strict=True) if scope and not line.other and line.text]


def _unnamed(lines: list[Line], weights: list[int]) -> list[tuple[int, int]]:
    """The part with most text; parts with no wall and little but text between them are one."""
    parts: list[list[int]] = []
    highest = max((sum(weights[i : i + LINES]) for i in range(len(weights))), default=0)
    for a, b in surges(weights, max(1, min(SURGE, highest // 2))):
        # A window reaches over lines next to the text: what is mostly links, or short and no heading, is not of it.
        while a < b and not lines[a].heading and weights[a] < max(25, len(lines[a].text) // 2):
            a += 1
        while b > a and (weights[b] < len(lines[b].text) / 2 or len(lines[b].text) < 25 and not _STOPS.search(lines[b].text)):
            b -= 1
        gap = range(parts[-1][1] + 1, a) if parts else range(0)
        joined = parts and not any(lines[i].other for i in gap) and sum(weights[i] for i in gap) * 2 >= sum(len(lines[i].text) for i in gap)
        if joined:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    if not parts:
        return []
    best = max(parts, key=lambda p: (sum(weights[p[0] : p[1] + 1]), -p[0]))
    return [(best[0], best[1])]


RESULT = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One page at a time, from the buffers of the batch.
            texts = ["\n".join(main_lines(html.as_py())) for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS LONG) page_id", "CAST(url AS STRING) url", "html").mapInArrow(run, RESULT)
