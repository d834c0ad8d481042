"""Main text of web pages by tree scoring (operator 6).

A page is read into a tree of elements and the blocks of text in them. Each block passes points
for its length and commas to its container and, halved and then divided by depth, to the further
ancestors; a container's points are discounted by its link density. The best container is
widened to the ``article`` or ``main`` around it, siblings with enough points (further
``article`` elements among them) or plain paragraph siblings are kept with it, and menus, page
headers, footers, sidebars, notices, adverts, forms and reader comments are left out.

Elements that never hold main text go by their tag or role. A class or id is weaker evidence: a
whole name such as ``comments`` leaves its element out unless nothing would remain; a name that
only begins with such a word (``share-price-news``) does so unless the element holds most of the
page's text, or an ``article`` or ``main``. Neither applies to ``main`` itself, and to an
``article`` only where another article remains. Lists and boxes made of links go too, but not
inside an ``article`` or ``main``: its references belong to it.

Pages are independent rows: no shuffle; a page of any length is read whole, in time
proportional to its length: open elements are counted as they come and go, sums run once from
the leaves to the root, and a block's points reach its nearest ``REACH`` ancestors.

Cases: null or empty html, or html without text, gives an empty text; tags that are never
closed, unknown tags and a page that breaks off inside a tag, comment or script lose no text
before it; equal pages give equal texts, one row each; an empty table gives an empty table; other
columns stay, whatever they hold, and a column called as the result is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HEAD = re.compile(r"[a-z]+")

_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
           "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
           "tt", "u", "var", "img", "wbr"}
#: Elements that never hold main text.
_ASIDE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
#: Words of a class or id that mark an element as something beside the text.
_ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
                "breadcrumbs", "comment", "comments", "respond", "disqus", "consent", "cookie", "cookies", "gdpr",
                "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
                "notices", "pagination", "pager", "popup", "promo", "promoted", "recommended", "related", "share",
                "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored", "subscribe", "subscription",
                "toolbar", "topbar", "widget"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
#: An open element of the key set ends when one of the value set begins, up to a boundary.
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
             "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p",
             "pre", "section", "table", "ul"}
_BOUNDARY = {"article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "section", "table", "td",
             "th", "button", "html", "blockquote"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SAME_STOP = {"ul", "ol", "dl", "table", "body", "menu"}
_PLAIN = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}

SIBLING_SHARE = 0.2
LINKY = 0.6
#: Ancestors that a block's points reach.
REACH = 8
#: Share of a page's text that only the container of the article holds.
MOST = 0.5
#: How an element is beside the text: for certain, by a whole name, by the head of a name.
_SURE, _NAMED_SO, _LIKELY = 3, 2, 1


class Page:
    """Elements (parent, tag, evidence against them) and blocks (element, text, link characters)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.beside = [-1], ["#root"], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack = [0]
        #: The open elements that are no inline ones, and how many of each tag are open.
        self._block_stack = [0]
        self._open_tags: Counter[str] = Counter()
        self._pieces: list[str] = []
        self._linked = 0
        self._read(html)

    def _flush(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            self.blocks.append((self._block, text, self._linked))
        self._pieces, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if not self._pieces:
            self._block = self._block_stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self._open_tags["a"]:
            self._linked += len(" ".join(text.split()))

    def _close_to(self, at: int) -> None:
        if self._block_stack[-1] >= self._stack[at]:
            self._flush()
        for element in self._stack[at:]:
            self._open_tags[self.tag[element]] -= 1
        while self._block_stack[-1] >= self._stack[at]:
            self._block_stack.pop()
        del self._stack[at:]

    def _last(self, tags: set[str], stop: set[str]) -> int | None:
        if not any(self._open_tags[t] for t in tags):
            return None
        for i in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[i]] in tags:
                return i
            if self.tag[self._stack[i]] in stop:
                return None
        return None

    def _evidence(self, tag: str, attributes: str) -> int:
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMED.finditer(attributes)}
        if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role") in _ASIDE_ROLES:
            return _SURE
        if tag in _ASIDE or tag == "header" and not (self._open_tags["article"] or self._open_tags["main"]):
            return _SURE
        if tag in ("html", "body", "main"):
            return 0
        names = f"{named.get('class', '')} {named.get('id', '')}".split()
        if not _ASIDE_WORDS.isdisjoint(names):
            return _NAMED_SO
        heads = {m[0] for m in map(_HEAD.match, names) if m}
        return _LIKELY if tag != "article" and not _ASIDE_WORDS.isdisjoint(heads) else 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P and (at := self._last({"p"}, _BOUNDARY)) is not None:
            self._close_to(at)
        if tag in _SAME and (at := self._last(_SAME[tag], _SAME_STOP)) is not None:
            self._close_to(at)
        if tag == "body" and (at := self._last({"head"}, set())) is not None:
            self._close_to(at)
        if tag not in _INLINE:
            if tag == "br":
                self._text(" ")
                return
            self._flush()
        if tag in _VOID:
            return
        element = len(self.tag)
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.beside.append(self._evidence(tag, attributes))
        self._stack.append(element)
        self._open_tags[tag] += 1
        if tag not in _INLINE:
            self._block_stack.append(element)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = _TAG.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and self._last({"p"}, _BOUNDARY) is None:
                    continue
                found = self._last({tag}, set())
                if found is not None:
                    self._close_to(found)
            elif tag in _RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else len(html)
            else:
                self._open(tag, m[3])
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _below(self, marked: list[bool]) -> list[bool]:
        """Whether an element, or one around it, is marked (parents come before their children)."""
        out = list(marked)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def _upward(self, amounts: list[int]) -> list[int]:
        """Sums over everything inside each element."""
        out = list(amounts)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def _left_out(self) -> list[bool]:
        """What stands beside the main text, from the evidence and what is left without it."""
        n = len(self.tag)
        sure = self._below([b == _SURE for b in self.beside])
        chars = [0] * n
        for element, text, _ in self.blocks:
            if not sure[element]:
                chars[element] += len(text)
        chars = self._upward(chars)
        holds = self._upward([int(t in ("article", "main")) for t in self.tag])
        plain_article = any(t in ("article", "main") and b == 0 and not s for t, b, s in zip(self.tag, self.beside, sure, strict=True))
        likely = [b == _LIKELY and not holds[e] and chars[e] < MOST * chars[0] for e, b in enumerate(self.beside)]
        named = [b == _NAMED_SO and (t != "article" or plain_article) for b, t in zip(self.beside, self.tag, strict=True)]
        for marks in ([a or b for a, b in zip(named, likely, strict=True)], likely):
            out = self._below([s or m for s, m in zip(sure, marks, strict=True)])
            if any(not out[element] for element, _, _ in self.blocks):
                return out
        return sure

    def main_text(self) -> str:
        n = len(self.tag)
        out = self._left_out()
        blocks = [b for b in self.blocks if not out[b[0]]]
        if not blocks:
            return ""
        score, chars, linked = [0.0] * n, [0] * n, [0] * n
        for element, text, links in blocks:
            points = min(len(text) / 100, 3) + text.count(",") + (len(text) >= 25)
            above = self.parent[element] if self.tag[element] in _PLAIN | {"li", "td"} else element
            for depth in range(REACH):
                if above < 0:
                    break
                score[above] += points / (1, 2)[depth] if depth < 2 else points / (3 * depth)
                above = self.parent[above]
            chars[element] += len(text)
            linked[element] += links
        chars, linked = self._upward(chars), self._upward(linked)
        density = [link / c if c else 0.0 for link, c in zip(linked, chars, strict=True)]
        own = [s * (1 - d) for s, d in zip(score, density, strict=True)]
        value = [v + 25 * (t in ("article", "main") and c > 0) for v, t, c in zip(own, self.tag, chars, strict=True)]
        best = max(range(n), key=lambda e: (value[e], e))
        line = [best]
        while self.parent[line[-1]] >= 0:
            line.append(self.parent[line[-1]])
        wider = [e for e in line if self.tag[e] == "article"] or [e for e in line if self.tag[e] == "main"]
        best = wider[0] if wider else best
        kept = {best}
        for e in range(n):
            if self.parent[e] != self.parent[best] or e == best or out[e]:
                continue
            if wider:
                if self.tag[e] == "article" and own[e] >= max(1.0, SIBLING_SHARE * own[best]):
                    kept.add(e)
            elif self.tag[e] != "body":
                plain = self.tag[e] in _PLAIN and density[e] < 0.25
                if plain or value[e] >= max(1.0, SIBLING_SHARE * value[best]):
                    kept.add(e)
        inside = self._below([e in kept for e in range(n)])
        # below the kept elements, boxes of links go, unless they belong to an article
        linky = self._below([not wider and inside[e] and e not in kept and density[e] > LINKY
                             and self.tag[e] in ("ul", "ol", "div", "section", "table") for e in range(n)])
        return "\n".join(text for element, text, _ in blocks if inside[element] and not linky[element])


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(df: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """``df`` with the main text of each page as column ``into``."""
    held = tb.fresh(df, "_main")

    def work(column: pa.Array):
        return [[main_text(page) for page in column.to_pylist()]]

    return tb.map_text(df, html, held, "text string", lambda: work).withColumn(into, F.col(f"{held}.text")).drop(held)
