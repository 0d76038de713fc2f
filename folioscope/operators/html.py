"""Text of one page, by the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .corpus import DROPPED

_MARK = re.compile(r"menu|header|footer|nav", re.IGNORECASE)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        marked = any(v and _MARK.search(v) for k, v in attrs if k in ("class", "id"))
        hidden = bool(self.open) and self.open[-1][1]
        self.open.append((tag, hidden or marked or tag in DROPPED))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)


def page_text(html: str, least: int = 3) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"[ \t\n\r\f\v]+", " ", x).strip() for x in "\n".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if len(x) >= least)
