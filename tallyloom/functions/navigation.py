"""Nested navigation lists flattened by a stack of open lists."""

from __future__ import annotations

import posixpath
from html.parser import HTMLParser
from urllib.parse import unquote


class _Lists(HTMLParser):
    """Collects (depth, parent, label, href) of the items of the lists inside <nav>, or of all lists where there is none."""

    def __init__(self, inside: bool):
        super().__init__(convert_charrefs=True)
        self.inside, self.navs = inside, 0
        self.units: list[list] = []
        #: For each open list, the item that is open in it.
        self.lists: list[int | None] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "nav":
            self.navs += 1
        if self.inside and not self.navs:
            return
        if tag in ("ol", "ul"):
            self._say()
            self.lists.append(None)
        elif tag == "li" and self.lists:
            self._say()
            parent = next((x for x in reversed(self.lists[:-1]) if x is not None), None)
            self.units.append([len(self.lists), parent, "", None])
            self.lists[-1] = len(self.units) - 1
            self.text = []
        elif tag == "a" and self.lists and self.lists[-1] is not None and self.units[self.lists[-1]][3] is None:
            self.units[self.lists[-1]][3] = dict(attrs).get("href")

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "nav":
            self.navs = max(0, self.navs - 1)
        if tag in ("ol", "ul") and self.lists:
            self._say()
            self.lists.pop()
        elif tag == "li" and self.lists:
            self._say()
            self.lists[-1] = None

    def _say(self) -> None:
        """The text up to here is the label of the item that is open."""
        if self.text is not None and self.lists and self.lists[-1] is not None:
            self.units[self.lists[-1]][2] = " ".join("".join(self.text).split())
        self.text = None


def units(html: str, base: str = "") -> list[tuple[int, int, int | None, str, str | None, str]]:
    """(position, depth, parent, label, target, path) of the items of a navigation; positions start at 0, depths at 1.

    parent is the position of the item that holds the list, path the labels from the top joined by ` / `, target the href from the folder
    of base, without `#...`. An item without a link has no target; lists need no closing tags.
    """
    reader = _Lists("<nav" in html.lower())
    reader.feed(html)
    reader.close()
    reader._say()
    out: list[tuple[int, int, int | None, str, str | None, str]] = []
    for k, (depth, parent, label, href) in enumerate(reader.units):
        target = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0]))) if href and href.partition("#")[0] else None
        out.append((k, depth, parent, label, target, f"{out[parent][5]} / {label}" if parent is not None else label))
    return out
