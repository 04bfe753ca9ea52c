"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block of the page. Where a wrapper that holds several lines (a div, a section) begins or
ends, and where something stands that is no article by its element or its name (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments), there are empty lines. Text lengths are summed over a window of ``WINDOW``
lines. A surge is where this sum rises to the page's threshold, together with the lines that lead up to it; a dive is where
it next falls to nothing. The text between a surge and its dive is kept.

The threshold is ``MOST``, the value published with the method for windows of three lines; between the dives where most of
the text is, a ``SHARE`` of the mean of all sums over text where that is less, as the page is one of short blocks then. All
text of article elements stays; where they hold less than half of the page's, the distribution is that of all lines, else of
those beside them. So text that no rule marks goes where it is short and stands apart, outside of article elements only.

Names are whole class names and ids, never parts of them. A form, or an element that is clutter by its name or role, is none
if it holds an article element, or, on pages without one, the first heading or most of the text. Elements that are clutter
by themselves are so in any case. Within an article element, class words count only as names of a menu, an advert, a form, a
notice, a sidebar or of readers' comments. White space inside a block becomes one space; a line break element is white
space; blocks are joined by two newlines.

Defined results: null, empty or textless html gives an empty text; unclosed elements end where HTML lets them end or
with the page; a tag without an end is no text; pages of any length and depth are read in time linear in their length;
repeated rows are extracted each; equal sums at the threshold are surges; an empty table gives no rows; other columns of
the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window that are a surge on any page, and the share of the page's mean that is one where that is less.
MOST, SHARE = 86, 0.25

# Element names of HTML, and words that name what is no article.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
_UNSEEN = frozenset("script style template textarea iframe title desc metadata noembed noframes".split())
_CLUTTER = frozenset("nav header footer aside form menu dialog button select option input label fieldset legend".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Wrappers; where one with several lines begins or ends, the lines are apart.
_WRAPPERS = frozenset("div section main".split())
#: Whole class names and ids that are clutter, within an article element as well.
_NAMED_INSIDE = re.compile(
    r"(?:^|\s)(?:(?:google-|side-)?ads?(?:-box|-slot|-unit|-container|vert|vertisement)?|advertisements?|adverts?|advertising|adsense|sponsored|promo|banner|menu|nav|navbar|navigation|breadcrumbs?"
    r"|sidebar|(?:cookie-|site-)?notices?|cookies?|cookie-(?:banner|consent)|(?:newsletter|signup|subscribe|login|search)(?:-form|-box)?|(?:user-|reader-)?comments?(?:-list|-section|-area|-thread)?"
    r"|respond|disqus_thread)(?:$|\s)",
    re.I,
)
#: Those that are clutter outside of article elements only.
_NAMED_OUTSIDE = re.compile(
    r"(?:^|\s)(?:(?:site-|page-|global-)?(?:header|footer|masthead)|(?:site-|main-|top-|primary-|footer-)(?:nav|navigation|menu)|nav-?bar|menu-?bar|side-?bar|(?:left-|right-)sidebar|sidebar-(?:left|right)|toolbar"
    r"|widgets?|(?:cookie|consent|notice)-?bar|popup|modal|overlay|pagination|pager|breadcrumb|copyright|legal|disclaimer|related(?:-posts|-articles)?|recommended|sharing|share(?:-buttons|-links|-bar)?"
    r"|social(?:-links|-icons|-media|-share)|newsletter|subscribe|subscription|signup|login|search(?:bar)?|replies|reply|discussion)(?:$|\s)",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_SPACE = re.compile(r"\s+")
_BODY = re.compile(r"<body[\s>]", re.I)
#: Elements that an opening one of the second kind ends.
_ENDED = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


#: What an element is: no clutter, clutter if it holds no article, clutter in any case.
NONE, NAMED, ALWAYS = 0, 1, 2


def _clutter(name: str, attributes: str, inside: bool) -> int:
    if name in _CLUTTER and name != "form":
        return ALWAYS
    found = NAMED if name == "form" else NONE
    if not attributes or name in ("html", "body", "article", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "aria-hidden" and value == "true" or key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return ALWAYS
        if key in ("class", "id") and (_NAMED_INSIDE.search(value) or not inside and _NAMED_OUTSIDE.search(value)) or key == "role" and value.strip().lower() in _ROLES:
            found = NAMED
    return found


class _Tags:
    """Where tags and unseen elements end, each place of the page looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.quotes, self.open_ended = html, True, set()

    def end(self, at: int) -> int:
        """Behind the '>' of a tag whose name ends at ``at``. Once quotes don't pair, they no longer count."""
        if self.quotes:
            if m := _QUOTED.match(self.html, at):
                return m.end()
            self.quotes = False
        found = self.html.find(">", at)
        return len(self.html) if found < 0 else found + 1

    def find(self, what: str, at: int) -> int:
        """The place of ``what``, or -1; what isn't found is not looked for again."""
        if what in self.open_ended:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.open_ended.add(what)
        return found

    def body(self, at: int) -> int:
        """Where the body begins, or -1."""
        if "<body" in self.open_ended:
            return -1
        if m := _BODY.search(self.html, at):
            return m.start()
        self.open_ended.add("<body")
        return -1

    def close(self, name: str, at: int) -> tuple[int, int] | None:
        """Where the end tag of an unseen element begins and ends."""
        if name in self.open_ended:
            return None
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(self.html, at)
        if m is None:
            self.open_ended.add(name)
            return None
        return m.span()


class _Box:
    """A clutter element: what kind, the one around it, and what it holds."""

    __slots__ = ("kind", "outer", "article", "heading", "size")

    def __init__(self, kind: int, outer: _Box | None):
        self.kind, self.outer, self.article, self.heading, self.size = kind, outer, False, False, 0


class _Open:
    """Open elements, with the places of each name and of blocks at hand; what a box holds is told to the one around it as
    it closes."""

    def __init__(self):
        self.stack: list[tuple[str, _Box | None, bool, list[int] | None]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.article = 0
        self.boxes: list[_Box] = []
        self.box: _Box | None = None
        self.lines = 0
        #: Line numbers before which a wrapper of several lines begins or ends.
        self.edges: set[int] = set()

    def push(self, name: str, clutter: int, article: bool) -> None:
        at = len(self.stack)
        self.places.setdefault(name, []).append(at)
        if name in _BLOCKS:
            self.blocks.append(at)
        if self.box and article:
            self.box.article = True
        if self.box and name == "h1":
            self.box.heading = True
        own = None
        if clutter:
            own = self.box = _Box(clutter, self.box)
            self.boxes.append(own)
        self.stack.append((name, own, article, self.lines if name in _WRAPPERS else None))
        self.article += article

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name, own, article, lines = self.stack.pop()
            self.places[name].pop()
            if name in _BLOCKS:
                self.blocks.pop()
            if own:
                self.box = own.outer
                if own.outer:
                    own.outer.article |= own.article
                    own.outer.heading |= own.heading
                    own.outer.size += own.size
            if lines is not None and self.lines > lines + 1:
                self.edges |= {lines, self.lines}
            self.article -= article

    def end(self, name: str) -> None:
        """An end tag; an inline one doesn't end the blocks around it."""
        if places := self.places.get(name):
            if name in _BLOCKS or not self.blocks or self.blocks[-1] < places[-1]:
                self.cut(places[-1])

    def begin(self, name: str) -> None:
        """What the start tag of a block ends."""
        if self.blocks and name in _ENDED.get(self.stack[self.blocks[-1]][0], ()):
            self.cut(self.blocks[-1])

    def settled(self, total: int, article: bool) -> set[_Box]:
        """After the page: the boxes that are clutter, of themselves or by one around them."""
        out: set[_Box] = set()
        for box in self.boxes:  # outer ones first
            spared = box.article or not article and (box.heading or 2 * box.size > total)
            if box.kind == ALWAYS or not spared or box.outer in out:
                out.add(box)
        return out


def page_lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, clutter, in an article element) of each block of a page, in order; blocks without text are left out.

    Clutter within a block goes from its text; the blocks of one clutter element that follow each other are one line.
    Lines of no text stand where wrappers begin or end.
    """
    blocks: list[tuple[list[tuple[str, _Box | None]], bool, bool]] = []
    part: list[tuple[str, _Box | None]] = []
    tags, open_ = _Tags(html), _Open()
    article = False  # whether an article element that isn't within clutter holds text
    total = 0

    def end_line() -> None:
        nonlocal article, total
        if any(t and not t.isspace() for t, _ in part):
            heading = bool(open_.blocks) and open_.stack[open_.blocks[-1]][0] in _HEADINGS
            blocks.append((part.copy(), open_.article > 0, heading))
            open_.lines += 1
            for t, box in part:
                size = len(t.strip())
                if box:
                    box.size += size
                total += size
                article |= size > 0 and open_.article > 0 and box is None
        part.clear()

    def add(text: str) -> None:
        part.append((text, open_.box))

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        add(html[at:start])
        at = start + 1
        if html.startswith("!--", at):
            end = tags.find("-->", at + 1)
            at = n if end < 0 else end + 3
            continue
        if html.startswith("![CDATA[", at):
            end = tags.find("]]>", at)
            add(html[at + 8 : n if end < 0 else end].replace("&", "&amp;"))
            at = n if end < 0 else end + 3
            continue
        if html[at : at + 1] in ("!", "?"):
            end = tags.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(html, at)
        if m is None:
            add("<")
            continue
        name, closing = m[1].lower(), html[at] == "/"
        at = tags.end(m.end())
        attributes = html[m.end() : at - 1]
        if name in _UNSEEN and not closing:
            close = tags.close(name, at)
            at = close[1] if close else n if name in ("script", "style") else at
            continue
        if name == "head" and not closing:
            close, body = tags.close(name, at), tags.body(at)
            if close and not 0 <= body < close[0]:
                at = close[1]
            elif body >= 0:
                at = body
            continue
        if name in _BLOCKS:
            end_line()
        elif name == "br":
            add(" ")
        if name == "xmp" and not closing:
            close = tags.close(name, at)
            add(html[at : close[0] if close else n].replace("&", "&amp;"))
            end_line()
            at = close[1] if close else n
        if name in _VOID or name == "xmp":
            continue
        if closing:
            open_.end(name)
            continue
        if name in _BLOCKS:
            open_.begin(name)
        elif attributes.endswith("/"):
            continue
        open_.push(name, _clutter(name, attributes, open_.article > 0), name in ("article", "main"))
    end_line()
    open_.cut(0)
    clutter = open_.settled(total, article)
    lines: list[tuple[str, bool, bool]] = []
    last = None  # the clutter element of the last line
    for k, (own, inside, _) in enumerate(blocks):
        if k in open_.edges and not (k and blocks[k - 1][2]):  # a heading leads up to what follows it
            lines += [("", False, False)] * WINDOW
        for unwanted in (False, True):
            text = _SPACE.sub(" ", unescape("".join(t for t, box in own if (box in clutter) == unwanted))).strip()
            if text:
                box = next(box for t, box in own if (box in clutter) == unwanted) if unwanted else None
                while box and box.outer in clutter:
                    box = box.outer
                if not (unwanted and box is last):
                    lines.append((text, unwanted, inside))
                last = box
                break
    return lines


def _between(sums: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which lines stand between a surge and its dive, or lead up to a surge without an empty line between."""
    keep, at = np.zeros(len(sizes), bool), 0
    while at < len(sizes):
        if sizes[at] and sums[at] >= least:  # surge
            start = end = at
            while start and sizes[start - 1] and not keep[start - 1]:
                start -= 1
            while end < len(sizes) and sums[end]:
                end += 1
            keep[start:end] = True  # dive: nothing for a whole window
            at = end
        else:
            at += 1
    return keep & (sizes > 0)


def chosen_lines(sizes: np.ndarray, inside: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which lines to keep, by their lengths (0 for clutter and empty ones) and whether they are in an article element."""
    mine = np.where(inside, sizes, 0)
    known = mine.any() and 2 * mine.sum() >= sizes.sum()  # article elements hold the article
    rest = sizes - mine if known else sizes
    sums = np.convolve(rest, np.ones(window, np.int64))[window - 1 :]  # one window for each line: the line and those after it
    keep = (mine > 0) | _between(sums, rest, MOST)
    if not known and sums.any():
        stretch = np.cumsum(sums == 0)  # numbers of what lies between dives
        most = int(np.argmax(np.bincount(stretch, rest)))
        keep |= _between(sums, rest, min(MOST, SHARE * sums[sums > 0].mean())) & (stretch == most)
    return keep


def main_text(html: str | None, window: int = WINDOW) -> str:
    """The blocks of the page between surges and dives of the line-block distribution."""
    lines = page_lines(html or "")
    sizes = np.array([0 if clutter else len(text) for text, clutter, _ in lines], np.int64)
    inside = np.array([a for _, _, a in lines], bool)
    if not sizes.any():
        return ""
    return "\n\n".join(lines[k][0] for k in np.flatnonzero(chosen_lines(sizes, inside, window)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
