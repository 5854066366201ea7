"""Main text of web pages by tree scoring.

A page becomes a tree of elements and blocks of text.  Each paragraph gives
points, for its length and its commas, to its parent and half as many to the
next ancestor, and so on.  An element's points are discounted by the share of
its text that is in links.  The best element, and those of its siblings that
score well too, hold the main text.  Elements that are never part of it, by tag
or role, are left out beforehand.  A section whose class or id names such a part
is left out too, unless it holds most of the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, text_buffer, trimmed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg object".split())
#: Elements that are never main text.
LEFT_OUT = RAW | frozenset("head nav header footer aside button select option dialog canvas audio video menu input label fieldset".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption "
    "address center hr details summary form".split()
) | (LEFT_OUT - {"label", "option", "input"})
PARAGRAPH = frozenset("p pre blockquote td li dd div section article main body".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first kind ends an open element of the second kinds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body main td th blockquote nav aside header footer form".split())
#: What a form asks with; a form is left out unless its paragraphs have more points than it has of these.
CONTROLS = frozenset("input select textarea button".split())
#: Words of a section's class or id that name menus, headers, footers, sidebars, notices, adverts, forms or reader comments.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar aside footer header masthead comment comments respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sharing widget widgets pager pagination toolbar".split()
)
#: Those of reader comments, which are never the main text of a page that has another one.
COMMENTS = frozenset("comment comments respond disqus".split())
#: Words that may stand beside them in a name; beside any other (``menu-history``, ``ad-hoc-networks``) they are part of a subject.
BESIDE = frozenset(
    "area author bar block body bottom box btn close col column container content desktop fixed form global group holder id inline inner item items js left link links "
    "list main mobile module new old outer overlay page panel policy popup post posts primary reader readers region reply right row secondary section site slot space sticky "
    "strip text thread title top unit user users wrap wrapper zone".split()
)
#: Elements that a class or id can mark.
SECTION = frozenset("div section ul ol dl table center details span".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME, _WORD = re.compile(r"[^\s]+"), re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Points of a paragraph: one, one a comma, one for every so many characters up to a most.
PER_CHARS, MOST_FOR_LENGTH, LEAST_CHARS = 100, 3, 25
#: A sibling is kept from this share of the best element's points and so many points, a plain paragraph from so many
#: characters or if it ends like a sentence.
SIBLING_SHARE, SIBLING_POINTS, SIBLING_CHARS = 0.2, 10, 80
#: Points that an element has for its tag, if it has text at all; characters over which a marked section may be the main one.
TAG_POINTS, MARKED_CHARS = {"article": 10, "main": 10, "div": 1, "section": 1, "td": 1, "blockquote": 1}, 250
#: Lists and sections with a larger share of linked text are left out.
MOST_LINKED = 0.5


class Element:
    __slots__ = ("tag", "parent", "parts", "chars", "linked", "points", "order", "marked", "name", "controls")

    def __init__(self, tag: str, parent: Element | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.parts: list[Element | str] = []
        self.chars = self.linked = 0
        self.points = 0.0
        self.marked = ""  # why it is left out: section, comments or form
        self.name = ""  # its class
        self.controls = 0


def _left_out(tag: str, attributes: str, inside: Element) -> bool:
    if tag in LEFT_OUT:
        return tag != "header" or not _within(inside, ("article", "main"))
    if not attributes or tag in ("body", "html", "main", "article"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and _UNSEEN.search(value):
            return True
    return False


def _mark(tag: str, attributes: str) -> tuple[str, str]:
    """What a section's class and id say it is (``section`` of what is left out, ``comments``, or nothing), and its class."""
    if tag == "form":
        return "form", ""
    said, class_ = "", ""
    if attributes and tag in SECTION:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "class":
                class_ = value
            if name not in ("class", "id"):
                continue
            for token in _NAME.findall(value):
                words = set(_WORD.findall(token))
                found = words & MARKED
                if found and all(w in MARKED or w in BESIDE or len(w) <= 2 for w in words):
                    said = "comments" if found & COMMENTS else said or "section"
    return said, class_


def _nearest(at: Element | None, tag: str) -> Element | None:
    while at is not None and at.tag != tag:
        at = at.parent
    return at


def _within(at: Element | None, tags: tuple[str, ...]) -> bool:
    while at is not None:
        if at.tag in tags:
            return True
        at = at.parent
    return False


def parsed(page: str) -> tuple[Element, list[Element]]:
    """The tree of a page without what is left out, and its elements in page order.  Text is one string per block."""
    root = Element("#root", None, 0)
    elements, at, links, position = [root], root, 0, 0
    text: list[str] = []
    skip: list[str] = []  # open elements inside one that is left out

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                at.parts.append(block)
                at.chars += len(block)

    def close(to: Element) -> None:
        nonlocal at
        flush()
        at = to

    while True:
        m = _TAG.search(page, position)
        if not skip:
            piece = page[position : m.start()] if m else page[position:]
            if piece:
                piece = html.unescape(piece)  # a reference does not go on after markup
                text.append(piece)
                if links:
                    at.linked += len(" ".join(piece.split()))
        if not m:
            break
        position = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] if m[2] else m[6]
        if not closing and tag in CONTROLS and "hidden" not in attributes.lower():
            form = _nearest(at, "form")
            if form is not None:
                form.controls += 1
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, position)
            position = end.end() if end else len(page)
            if not skip and tag in BLOCK:
                flush()
            continue
        if skip:
            if closing:
                if tag in skip:
                    while skip and skip.pop() != tag:
                        pass
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in ("p", "li", "option", "td", "tr", "th", "dt", "dd"):
                    if skip[-1] == tag and len(skip) > 1:
                        skip.pop()
                skip.append(tag)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            continue
        if closing:
            if tag in BLOCK:
                up = at
                while up.parent is not None and up.tag != tag:
                    if tag == "p" and up.tag in _SCOPE:
                        break
                    up = up.parent
                flush()
                if up.tag == tag and up.parent is not None:
                    close(up.parent)
                    links = 0
            continue
        if _left_out(tag, attributes, at):
            if tag in BLOCK or tag in LEFT_OUT:
                flush()
            if not attributes.endswith("/"):
                skip.append(tag)
            continue
        marked, class_ = _mark(tag, attributes)
        if tag not in BLOCK:
            if marked and tag == "span" and not attributes.endswith("/"):
                skip.append(tag)
            continue
        flush()
        links = 0
        if at.tag == "p" or at.tag in _HEADING:
            close(at.parent)
        ends = _CLOSES.get(tag)
        if ends:
            up = at
            while up.parent is not None and up.tag not in ends and up.tag not in ("ul", "ol", "dl", "table"):
                up = up.parent
            if up.tag in ends:
                close(up.parent)
        at = Element(tag, at, len(elements))
        at.marked, at.name = marked, class_
        at.parent.parts.append(at)
        elements.append(at)
    flush()
    return root, elements


def _totals(elements: list[Element]) -> None:
    for e in reversed(elements):  # children first
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked


def _paragraph_points(e: Element) -> float:
    """Points of an element's own text, less what is linked of it; none if it is short."""
    blocks = [x for x in e.parts if isinstance(x, str)]
    own = sum(map(len, blocks))
    if e.tag not in PARAGRAPH or own < LEAST_CHARS:
        return 0.0
    inner = sum(x.linked for x in e.parts if not isinstance(x, str))
    return (1 + sum(b.count(",") for b in blocks) + min(own / PER_CHARS, MOST_FOR_LENGTH)) * (1 - min(1.0, max(0, e.linked - inner) / own))


def _without_marked(root: Element, elements: list[Element]) -> list[Element]:
    """The elements outside marked ones.

    A form whose paragraphs have more points than it has controls wraps what is
    written.  A section that holds most of the page's text is not marked;
    comments are, however long, if paragraphs outside marked ones have points.
    """
    asked: dict[Element, float] = {}
    inside: set[Element] = set()
    outside = 0.0
    for e in elements:  # parents first
        if e.parent is not None and (e.parent.marked in ("section", "comments") or e.parent in inside):
            inside.add(e)
        points = _paragraph_points(e)
        if not points:
            continue
        form = _nearest(e, "form")
        if form is not None:
            asked[form] = asked.get(form, 0.0) + points
        elif e not in inside and e.marked in ("", "form"):
            outside += points
    for e in elements:
        if e.marked == "form" and asked.get(e, 0.0) > e.controls:
            e.marked = ""
            outside += asked[e]
    out, gone = [], set()
    for e in elements:
        if (e.marked == "section" or e.marked == "comments" and not outside) and e.chars - e.linked > max(MARKED_CHARS, (root.chars - root.linked) / 2):
            e.marked = ""
        if e.marked or e.parent in gone:
            gone.add(e)
        else:
            out.append(e)
    for e in out:
        e.parts = [x for x in e.parts if isinstance(x, str) or x not in gone]
    for e in reversed(elements):
        if e.marked and e.parent not in gone:
            up = e.parent
            while up is not None:
                up.chars, up.linked, up = up.chars - e.chars, up.linked - e.linked, up.parent
    return out


def _score(elements: list[Element]) -> None:
    for e in elements:
        if e.chars:
            e.points += TAG_POINTS.get(e.tag, 0)
        points = _paragraph_points(e)
        if not points:
            continue
        share, up = 1.0, (e.parent if e.tag in ("p", "pre", "blockquote", "td", "li", "dd") and e.parent is not None else e)
        while up is not None and share > 0.05:
            up.points += points * share
            share, up = share / 2, up.parent


def _linked(e: Element) -> float:
    return min(1.0, e.linked / e.chars) if e.chars else 0.0


def _collect(e: Element, out: list[str], top: bool = True) -> None:
    stack = [iter([e])]
    first = top
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
        elif isinstance(item, str):
            out.append(item)
        else:
            if not first and item.tag in ("ul", "ol", "dl", "div", "section", "table") and item.chars and _linked(item) > MOST_LINKED:
                continue
            first = False
            stack.append(iter(item.parts))


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    root, elements = parsed(page)
    _totals(elements)
    elements = _without_marked(root, elements)
    _score(elements)
    worth = lambda e: e.points * (1 - _linked(e))
    best = max(elements, key=lambda e: (worth(e), -e.order))
    if best.points <= 0:
        best = root
    out: list[str] = []
    siblings = [best] if best.parent is None else [x for x in best.parent.parts if isinstance(x, Element)]
    least = max(SIBLING_POINTS, SIBLING_SHARE * worth(best))
    for x in siblings:
        alike = x.tag == best.tag and (x.tag == "section" or x.name and x.name == best.name) and _linked(x) <= MOST_LINKED  # another part of the same text
        good = x is best or worth(x) >= least or alike or (x.tag in ("h1", "h2") and _linked(x) == 0)
        if x.tag == "p" and not good:
            good = (x.chars > SIBLING_CHARS and _linked(x) < 0.25) or (x.linked == 0 and _ends(x))
        if good:
            _collect(x, out)
    return "\n\n".join(out)


def _ends(e: Element) -> bool:
    """Whether the element's own text ends like a sentence."""
    last = e.parts[-1] if e.parts else ""
    return isinstance(last, str) and last.endswith((".", "!", "?", "…", "。"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of each row.

    Null, empty and markup-only pages have the empty text.  Repeated rows and
    null ids are kept; an empty table gives an empty table; other columns are
    not read.  Of elements that score alike the first in the page is taken.
    Any string parses; nothing is dropped for its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = text_buffer(batch.column(2))
            for i, j in pieces(off):
                part = batch.slice(i, j - i)
                texts = [main_text(cell.as_py()) for cell in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    fields = [T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)]).mapInArrow(trimmed(run), T.StructType(fields))
