"""A plain parser for HTML text, to compare the native expression with."""

from collections import Counter
from html.parser import HTMLParser

HIDDEN = {"script", "style", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Collector(HTMLParser):
    """Text up to the next tag or comment is one piece; an element left open ends with the one around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.piece, self.stack, self.open = [], [], [], Counter()

    def end_piece(self):
        text = "".join(self.piece).strip()
        if text:
            self.parts.append(text)
        self.piece = []

    def handle_starttag(self, tag, attrs):
        self.end_piece()
        if tag not in VOID:
            self.stack.append(tag)
            self.open[tag] += 1

    def handle_endtag(self, tag):
        self.end_piece()
        while self.open[tag]:
            last = self.stack.pop()
            self.open[last] -= 1
            if last == tag:
                break

    def handle_comment(self, data):
        self.end_piece()

    def handle_data(self, data):
        if not any(self.open[tag] for tag in HIDDEN):
            self.piece.append(data)

    def close(self):
        super().close()
        self.end_piece()


def html_to_text(html, sep="\n"):
    if not isinstance(html, str):
        return ""
    p = Collector()
    p.feed(html)
    p.close()
    return sep.join(p.parts)
