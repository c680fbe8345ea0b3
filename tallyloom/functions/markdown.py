"""Links of a Markdown text, found in one pass from left to right, and the paths that they name.

No pattern here repeats an alternation, and what is left after a failed attempt is never long, so time follows the length of the text
whatever stands in it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
TOKEN = re.compile(r"[`]+|[\[]|[\]][(]?|[\\][^\n]?")
DEFINITION = re.compile(r"\[[^\[\]\n]+\]:[ \t]*")
SPACES = re.compile(r"\s*")
ANGLED = re.compile(r"<([^<>\n]*)>")
PLAIN = re.compile(r"[^\s()<>\\]+|\\\S?|[()]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:|//")
BARE = re.compile(r"\S*")


def paragraphs(text: str) -> Iterator[str]:
    """Runs of lines that no blank line and no fenced block interrupts."""
    fence, held = "", []
    for line in text.split("\n"):
        if fence:
            bare = line.strip(" \t\r")
            if len(bare) >= len(fence) and not bare.strip(fence[0]):
                fence = ""
            continue
        m = FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in line[m.end() :]):
            fence = m[1]
        elif not line.isspace() and line:
            held.append(line)
            continue
        if held:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


class _Runs:
    """Where the bracket of a link closes; each run of a text without spaces and angle brackets is read once."""

    def __init__(self, text: str):
        self.text, self.end, self.close, self.last = text, -1, {}, None

    def target(self, opened: int) -> tuple[str | None, int]:
        """The target after the bracket at `opened`, and where it ends; None where brackets in it are open or neither a bracket nor a title follows."""
        text = self.text
        at = SPACES.match(text, opened + 1).end()
        if text.startswith("<", at):
            m = ANGLED.match(text, at)
            to, end = (m[1], m.end()) if m else (None, at)
        else:
            if at > self.end or (opened not in self.close and opened != self.last and at > opened + 1):
                self._read(opened, at)
            end = self.close.get(opened, self.end if opened == self.last else -1)
            to = text[at:end] if end >= 0 else None
        after = SPACES.match(text, end).end() if to is not None else at
        return (to if text[after : after + 1] in {")", '"', "'", "("} else None), end

    def _read(self, opened: int, at: int) -> None:
        """Notes for the brackets of the run from `at` on where they close, and which one is the innermost that doesn't."""
        self.close, stack = {}, [opened]
        while m := PLAIN.match(self.text, at):
            if m[0] == "(":
                stack.append(at)
            elif m[0] == ")" and stack:
                self.close[stack.pop()] = at
            at = m.end()
        self.end, self.last = at, stack[-1] if stack else None


def targets(text: str) -> Iterator[str]:
    """The targets of inline links and images and of definitions of references, as they stand; code holds none.

    Brackets are counted: `](` ends a link only where a bracket is open. A backslash takes the meaning from what follows it. A
    code span reaches to the next run of just as many backticks of its paragraph; fenced blocks are left out.
    """
    for part in paragraphs(text):
        if "](" not in part and "]:" not in part:
            continue
        ticks: dict[int, deque[int]] = {}
        for m in re.finditer("[`]+", part):
            ticks.setdefault(len(m[0]), deque()).append(m.start())
        depth = at = 0
        runs = _Runs(part)
        while m := TOKEN.search(part, at):
            found, at = m[0], m.end()
            to = None
            if found[0] == "`":
                same = ticks.get(len(found), ())
                while same and same[0] < at:
                    same.popleft()
                if same:
                    at = same.popleft() + len(found)
            elif found == "[":
                depth += 1
                line = part.rfind("\n", max(0, m.start() - 4), m.start()) + 1 or max(0, m.start() - 3)
                d = DEFINITION.match(part, m.start()) if not part[line : m.start()].strip(" ") and (line == 0 or part[line - 1] == "\n") else None
                if d:
                    depth -= 1
                    m = ANGLED.match(part, d.end()) or BARE.match(part, d.end())
                    to, at = m[m.lastindex or 0], m.end()
            elif found[0] == "]" and depth:
                depth -= 1
                if found == "](":
                    to, end = runs.target(at - 1)
                    at = at if to is None else end
            if to:
                yield to


def resolved(rel: str, to: str) -> str | None:
    """The path in the tree that a link of the file rel names; None for other sites and for places in the same file.

    `#...` is cut off and percent signs are decoded. `..` above the root stays, so it names no file.
    """
    if SCHEME.match(to):
        return None
    to = to.partition("#")[0]
    if not to:
        return None
    try:
        to = unquote_to_bytes(to).decode() if "%" in to else to
    except UnicodeDecodeError:
        pass
    path: list[str] = [] if to.startswith("/") else rel.split("/")[:-1]
    for x in to.split("/"):
        if x == ".." and path and path[-1] != "..":
            path.pop()
        elif x not in ("", "."):
            path.append(x)
    return "/".join(path)
