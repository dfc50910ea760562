"""One forward scan over the markup of a page, for the operators that read pages.

What is sought in vain once isn't sought again, so that no input takes more than one scan: tags without an
end, unclosed comments and quotes end at the next sign that can end them, or at the page's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Elements whose content is code or plain text, not markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ENDS = {name: re.compile(f"</{name}", re.I) for name in RAW}

TEXT, OPEN, CLOSE, CODE = range(4)


class Scan:
    """The pieces of a page in order, each (kind, name, rest).

    ``rest`` is the raw text of TEXT, the attributes of OPEN, and the content of CODE, an element of RAW
    with its end tag. ``at`` is the place behind the current piece.
    """

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self._missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self._missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self._missing.add(what)
        return found

    def _after(self, at: int) -> int:
        end = self.find(">", at)
        return len(self.page) if end < 0 else end + 1

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag; those in closed quotes don't. -1 where there is none."""
        page, end, start = self.page, self.find(">", at), at
        while end >= 0:
            opened = None
            while opened is None:
                quotes = [q for q in (page.find('"', start, end), page.find("'", start, end)) if q >= 0]
                if not quotes:
                    return end
                closed = page.find(page[min(quotes)], min(quotes) + 1, end)
                if closed < 0:
                    opened = page[min(quotes)]
                else:
                    start = closed + 1
            closed = self.find(opened, end)
            if closed < 0:
                return end
            start = closed + 1
            end = self.find(">", start)
        return -1

    def __iter__(self) -> Iterator[tuple[int, str, str]]:
        page = self.page
        while self.at < len(page):
            mark = self.find("<", self.at)
            if mark < 0:
                start, self.at = self.at, len(page)
                yield TEXT, "", page[start:]
                return
            if mark > self.at:
                start, self.at = self.at, mark
                yield TEXT, "", page[start:mark]
            tag = _TAG.match(page, mark)
            if page.startswith("<!--", mark):
                end = self.find("-->", mark + 2)
                self.at = self._after(mark) if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), mark):
                self.at = self._after(mark)
            elif not tag:
                self.at = mark + 1
                yield TEXT, "", "<"
            else:
                end = self._tag_end(tag.end())
                if end < 0:
                    return
                name, self.at = tag[1].lower(), end + 1
                if page[mark + 1] == "/":
                    yield CLOSE, name, ""
                elif name in RAW:
                    yield CODE, name, self._code(name)
                else:
                    yield OPEN, name, page[tag.end() : end]

    def _code(self, name: str) -> str:
        """What lies before the end of an element of RAW; without an end, code goes on to the page's end."""
        start = self.at
        stop = None if name in self._missing else _ENDS[name].search(self.page, start)
        if stop:
            self.at = self._after(stop.end())
            return self.page[start : stop.start()]
        self._missing.add(name)
        if name in ("script", "style"):
            self.at = len(self.page)
        return ""
