"""Front matter: the block subset of YAML, read line by line with a stack of open blocks.

Read are block mappings and sequences (also one in the line of the other), plain, quoted and block scalars over several lines, flow
sequences and mappings, comments, anchors, aliases and tags. Complex keys (`? `) and directives are beyond it.
"""

from __future__ import annotations

import re

CLOSE = re.compile(r"^---[ \t]*\r?$", re.M)
COLON = re.compile(r":(?=[ \t]|$)")
COMMENT = re.compile(r"(?:^|[ \t])#")
BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:[ \t]#.*)?$")
#: Anchors and tags before a value, and an alias in place of one.
PROPERTY, ALIAS = re.compile(r"[&!]\S*[ \t]*"), re.compile(r"\*[^\s,\[\]{}]+[ \t]*$")
DOUBLE, SINGLE = re.compile(r'[^"\\]+|\\.?|"'), re.compile(r"[^']+|''|'")
FLOW = re.compile(r"""[ \t]+|[\[\]{},"']|:(?=[ \t,\[\]{}]|$)|(?::(?![ \t,\[\]{}]|$)|[^ \t\[\]{},"':])[^\[\]{},:]*""")
ESCAPES = set('0abt\tnvfre "/\\N_LPxuU')


class Unreadable(ValueError):
    """Why no parser reads the lines."""


def split_front(text: str) -> tuple[str | None, str]:
    """(front matter, body) of a text; None and the text where it isn't between two fences."""
    text = text.removeprefix("\ufeff")
    first, _, rest = text.partition("\n")
    m = CLOSE.search(rest) if first.rstrip(" \t\r") == "---" else None
    return (rest[: m.start()], rest[m.end() + 1 :]) if m else (None, text)


class _Front:
    def __init__(self, text: str):
        self.lines = [x.removesuffix("\r") for x in text.split("\n")]
        self.k = 0
        #: Open blocks: indent, "map" or "seq", keys so far.
        self.open: list[tuple[int, str, set[str]]] = []
        #: The indent of an entry that still waits for a value below it.
        self.waits: int | None = None
        #: Where that value is kept if its key is at the top.
        self.place: int | None = None
        self.found: list[tuple[str, str]] = []

    def read(self) -> None:
        while self.k < len(self.lines):
            line = self.lines[self.k]
            bare = line.lstrip(" ")
            self.k += 1
            if not bare.strip() or bare[0] == "#":
                continue
            if bare[0] == "\t":
                raise Unreadable("tab in the indent")
            self.entry(len(line) - len(bare), bare.rstrip())

    def entry(self, indent: int, text: str) -> None:
        item = text == "-" or text.startswith(("- ", "-\t"))
        kind = "seq" if item else "map"
        while self.open and (self.open[-1][0] > indent or (self.open[-1][0] == indent and self.open[-1][1] == "seq" and not item)):
            self.open.pop()
        inside = self.open[-1] if self.open else None
        end = None if item else self.key_end(text)
        if inside and not item and end is None and self.waits is not None and self.waits < indent:
            # a scalar on a line of its own
            place, waits, self.waits, self.place = self.place, self.waits, None, None
            said = self.value(text, waits)
            if place is not None:
                self.found[place] = (self.found[place][0], said)
            return
        if inside is None:
            if self.found or self.k > 1 and self.waits is not None:
                raise Unreadable("indent of no open block")
            self.open.append((indent, kind, set()))
        elif inside[0] < indent or (inside[1] == "map" and item):
            if self.waits is None or self.waits > indent:
                raise Unreadable("indent of no open block")
            self.open.append((indent, kind, set()))
        self.waits = self.place = None
        if item:
            rest = text[1:].lstrip(" \t")
            if not rest or rest[0] == "#":
                self.waits = indent
            elif rest == "-" or rest.startswith("- ") or self.key_end(rest) is not None:
                self.waits = indent
                self.entry(indent + len(text) - len(rest), rest)
            else:
                self.value(rest, indent)
            return
        if end is None:
            raise Unreadable("a line that is no key, item or comment")
        key = text[:end].rstrip()
        key = key[1:-1] if key[0] in "\"'" else key
        if key in self.open[-1][2]:
            raise Unreadable("a key twice")
        self.open[-1][2].add(key)
        top = len(self.open) == 1
        place = len(self.found)
        if top:
            self.found.append((key, ""))
        said = self.value(text[end + 1 :].lstrip(" \t"), indent)
        if top:
            self.found[place] = (key, said)
            self.place = place if self.waits is not None else None

    def key_end(self, text: str) -> int | None:
        """Where the colon of a key stands; None where the text doesn't start with a key."""
        if text[0] in "\"'":
            at, end = 1, None
            for m in (DOUBLE if text[0] == '"' else SINGLE).finditer(text, 1):
                at = m.end()
                if m[0] == text[0]:
                    end = at
                    break
            m = re.compile(r"[ \t]*:(?=[ \t]|$)").match(text, at) if end else None
            return m.end() - 1 if m else None
        if text[0] in "[{|>@%`,]}#" or text.startswith("? ") or text == "?":
            return None
        m = COLON.search(text)
        hidden = COMMENT.search(text)
        return m.start() if m and m.start() and not (hidden and hidden.start() < m.start()) else None

    def value(self, text: str, indent: int) -> str:
        """The scalar that starts with text in an entry of this indent, with the lines that go on with it; empty for other values."""
        while m := PROPERTY.match(text):
            text = text[m.end() :]
        if not text or text[0] == "#":
            self.waits = indent
            return ""
        if text[0] in "|>":
            if not BLOCK.match(text):
                raise Unreadable("text after a block mark")
            return self.block(indent)
        if text[0] in "\"'":
            return self.quoted(text, indent)
        if text[0] in "[{":
            self.flow(text)
            return ""
        if text[0] == "*":
            if not ALIAS.match(COMMENT.split(text)[0]):
                raise Unreadable("text after an alias")
            return ""
        if text[0] in "@`%,]}" or text[:2] in ("- ", "? ", ": ") or text in ("-", "?", ":"):
            raise Unreadable("a mark that starts no plain value")
        return self.plain(text, indent)

    def below(self, indent: int) -> str | None:
        """The next line if it belongs to a scalar of an entry of this indent."""
        if self.k < len(self.lines):
            line = self.lines[self.k]
            if not line.strip() or len(line) - len(line.lstrip(" ")) > indent:
                self.k += 1
                return line
        return None

    def block(self, indent: int) -> str:
        held = []
        while (line := self.below(indent)) is not None:
            held.append(line)
        return "\n".join(held)

    def plain(self, text: str, indent: int) -> str:
        held = []
        line: str | None = text
        while line is not None:
            m = COMMENT.search(line.strip())
            said = line.strip()[: m.start()] if m else line.strip()
            if COLON.search(said):
                raise Unreadable("a colon in a plain value")
            held.append(said)
            line = None if m else self.below(indent)
        return " ".join(x for x in held if x)

    def quoted(self, text: str, indent: int) -> str:
        mark, at, held = text[0], 1, []
        pattern = DOUBLE if mark == '"' else SINGLE
        while True:
            for m in pattern.finditer(text, at):
                if m[0] == mark:
                    if not re.match(r"[ \t]*$|[ \t]+#", text[m.end() :]):
                        raise Unreadable("text after a quote")
                    return "".join(held)
                if m[0][0] == "\\" and m[0][1:] and m[0][1] not in ESCAPES:
                    raise Unreadable("unknown escape")
                held.append("'" if m[0] == "''" else m[0][1:] if m[0][0] == "\\" else m[0])
            line = self.below(indent)
            if line is None:
                raise Unreadable("open quote")
            held.append(" ")
            text, at = line.strip(), 0

    def flow(self, text: str) -> None:
        stack: list[str] = []
        ended = False  # a quoted value or a bracket, after which only a comma, a colon or a bracket may stand
        line: str | None = text
        while line is not None:
            at = 0
            while at < len(line):
                m = FLOW.match(line, at)
                if not m or (m[0][0] == "#" and (at == 0 or line[at - 1] in " \t")):
                    break
                found, at = m[0], m.end()
                if found[0] in " \t":
                    continue
                if found in "[{":
                    if ended:
                        raise Unreadable("text after a value")
                    stack.append("]" if found == "[" else "}")
                elif found in "]}":
                    if stack.pop() != found:
                        raise Unreadable("brackets that don't match")
                    ended = True
                    if not stack:
                        if not re.match(r"[ \t]*$|[ \t]+#", line[at:]):
                            raise Unreadable("text after a bracket")
                        return
                elif found in ",:":
                    ended = False
                elif ended or found[0] in "@`%":
                    raise Unreadable("text after a value" if ended else "a mark that starts no plain value")
                elif found in "\"'":
                    line, at = self.flow_quote(line, at, found)
                    ended = True
            line = self.lines[self.k] if self.k < len(self.lines) else None
            self.k += 1
        raise Unreadable("open bracket")

    def flow_quote(self, line: str, at: int, mark: str) -> tuple[str, int]:
        """The line and place after a quote inside brackets."""
        while True:
            for m in (DOUBLE if mark == '"' else SINGLE).finditer(line, at):
                if m[0] == mark:
                    return line, m.end()
            if self.k >= len(self.lines):
                raise Unreadable("open quote")
            line, at = self.lines[self.k], 0
            self.k += 1


def read_front(text: str) -> tuple[list[tuple[str, str]], str | None]:
    """The keys at the top with their scalars (empty for other values), as far as they can be read, and why the rest can't."""
    front = _Front(text)
    try:
        front.read()
    except Unreadable as e:
        return front.found, str(e)
    return front.found, None
