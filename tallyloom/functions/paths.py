"""Columns over relative paths and file modes."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column, separator: str = "\\") -> Column:
    """path with `/` between its parts."""
    return F.array_join(F.split(path, "\\" + separator if separator == "\\" else separator), "/")


def basename(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def top_name(rel: Column) -> Column:
    return F.split(rel, "/")[0]


def is_named(rel: Column, name: str) -> Column:
    """Whether the file itself, at any depth, has this name."""
    return basename(rel) == name


def in_list(rel: Column, names: Sequence[str]) -> Column:
    """Whether the first part of the path is on an allow-list."""
    return top_name(rel).isin(list(names))


def executable(mode: Column) -> Column:
    """Whether any of the three execute bits is set."""
    return mode.bitwiseAND(F.lit(0o111)) != 0


def utf16_order(rel: Column) -> Column:
    """A sort key: order by UTF-16 code unit, which differs from UTF-8 order beyond U+D7FF."""
    return F.encode(rel, "UTF-16BE")


def labelled(rel: Column, kind: Column) -> Column:
    """A drift entry as text: deleted paths say so."""
    return F.when(kind == "deleted", F.concat(rel, F.lit(" (deleted)"))).otherwise(rel)


def comment_text(line: Column) -> Column:
    """The text of a `//` comment that starts a line; null for any other line."""
    return F.when(F.startswith(line, F.lit("//")), F.regexp_replace(line, r"^//\s?", ""))


def safe(rel: str) -> bool:
    """Whether a path from a manifest stays inside the folder it is joined to."""
    parts = rel.replace("\\", "/").split("/")
    return bool(rel) and not posixpath.isabs(rel) and ".." not in parts and "\0" not in rel
