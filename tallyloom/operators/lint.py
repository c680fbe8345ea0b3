"""Rules over a tree (rel, content) of Markdown packages: front matter, links, coverage and trigger sets.

Null contents break no rule and hold no links; repeated rows are reported as often as they stand; an empty tree
gives empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.byte_pairs import Ranks, count_tokens
from ..functions.front_matter import read_front, split_front
from ..functions.markdown import resolved, targets
from ..functions.paths import basename

ENTRY = "SKILL.md"


def _text(cell: bytes | None) -> str:
    return (cell or b"").decode(errors="replace")


_CELLS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))


#: Bytes of contents that are read at a time.
SLICE = 1 << 20


def _with_front(files: DataFrame, bodies: bool = False) -> DataFrame:
    """files with fenced, reason, entries and, if bodies, body in place of content, whose place is last.

    Rows leave once about SLICE bytes are read, so a worker holds them besides the batch that came, never what a whole batch becomes.
    """
    kept = len(files.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, kept):
                fenced, reasons, cells, rests = [], [], [], []
                for content in part.column(kept):
                    front, body = split_front(_text(content.as_py()))
                    entries, reason = read_front(front) if front is not None else ([], "no front matter between two fences")
                    fenced.append(front is not None)
                    reasons.append(reason)
                    cells.append([{"key": key, "value": " ".join(value.split())} for key, value in entries])
                    if bodies:
                        rests.append(body)
                made = [pa.array(fenced, pa.bool_()), pa.array(reasons, pa.string()), pa.array(cells, _CELLS), *([pa.array(rests, pa.large_string())] if bodies else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(kept)), *made], [*part.schema.names[:kept], *MADE[: len(made)]])

    had = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields[:kept])
    return files.mapInArrow(run, f"{had}, fenced boolean, reason string, entries array<struct<key:string,value:string>>" + ", body string" * bodies)


MADE = ["fenced", "reason", "entries", "body"]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about SLICE bytes of a binary column, or one longer cell."""
    start = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= SLICE:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def front_matter(tree: DataFrame, entry: str = ENTRY, bodies: bool = True) -> DataFrame:
    """(rel, fenced, reason, entries (key, value), body) of the entry files that have a content; without body unless bodies.

    fenced: front matter stands between two fences at the start, after a byte-order mark or not. entries are its keys at the top, as
    far as they can be read, with their scalars in one line (empty for lists and the like); reason says why the rest can't be
    read, or is null. body is what follows, or the whole text without fences.
    """
    found = tree.filter((basename(F.col("rel")) == entry) & F.col("content").isNotNull())
    return _with_front(found.select(F.col("rel").cast("string"), F.col("content").cast("binary").alias("content")), bodies)


def _value(key: str) -> Column:
    """The scalar of a key at the top; null without that key."""
    return F.get(F.filter("entries", lambda x: x["key"] == key), F.lit(0)).getField("value")


def byte_order_marks(tree: DataFrame) -> DataFrame:
    """(rel): files that start with a byte-order mark."""
    return tree.filter(F.substring(F.col("content").cast("binary"), 1, 3) == F.lit(b"\xef\xbb\xbf")).select("rel")


def wrong_case(tree: DataFrame, entry: str = ENTRY) -> DataFrame:
    """(rel): files called like the entry file but for upper and lower case."""
    base = basename(F.col("rel"))
    return tree.filter((F.lower(base) == entry.lower()) & (base != entry)).select("rel")


def mismatched_names(tree: DataFrame, entry: str = ENTRY) -> DataFrame:
    """(rel, name, folder): entry files whose name in the front matter isn't that of their folder.

    Files at the top have no folder to compare with, and files without a name are left to other rules.
    """
    return _named(front_matter(tree, entry, bodies=False))


def _named(parsed: DataFrame) -> DataFrame:
    parts = F.split("rel", "/")
    return parsed.select("rel", _value("name").alias("name"), F.get(parts, F.size(parts) - 2).alias("folder")).filter("name <> '' and name <> folder")


def unreadable_front_matter(tree: DataFrame, entry: str = ENTRY) -> DataFrame:
    """(rel): entry files without both fences, or whose front matter is beyond the YAML subset of `functions.front_matter`."""
    return front_matter(tree, entry, bodies=False).filter("reason is not null").select("rel")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rel = batch.column(0)[k].as_py()
            found = [y for x in targets(_text(batch.column(1)[k].as_py())) if (y := resolved(rel or "", x)) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rel] * len(found), pa.string()), pa.array(found, pa.string())], ["rel", "target"])


def links(tree: DataFrame) -> DataFrame:
    """(rel, target): each Markdown link of a file to another file of the tree, resolved from the file's folder.

    Inline links, in angle brackets or plain, and definitions of references count; code does not. `#...` is cut off and
    percent signs are decoded. Links to other sites and to a place in the same file are left out. Texts without `](` and `]:` are passed
    over before they reach the scanner; the others are read in one pass, in time that follows their length.
    """
    text = F.col("content").cast("binary")
    some = tree.filter(F.contains(text, F.lit(b"](")) | F.contains(text, F.lit(b"]:")))
    return some.select(F.col("rel").cast("string"), text).mapInArrow(_linked, "rel string, target string")


def broken_links(tree: DataFrame) -> DataFrame:
    """(rel, target): links that meet neither a file nor a folder of the tree."""
    parts = F.split("rel", "/")
    known = tree.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("target"))
    return links(tree).filter("target <> ''").join(known, "target", "left_anti").select("rel", "target")


def unlinked(tree: DataFrame, entry: str = ENTRY, suffix: str = ".md", body_only: bool = True) -> DataFrame:
    """(rel): documents other than entry files that no entry file links to; with body_only false, that no other file does."""
    source = tree.filter(basename(F.col("rel")) == entry) if body_only else tree
    used = links(source).filter("rel <> target").select(F.col("target").alias("rel"))
    return tree.filter(F.endswith("rel", F.lit(suffix)) & (basename(F.col("rel")) != entry)).select("rel").join(used, "rel", "left_anti")


def description_lengths(tree: DataFrame, most: int, entry: str = ENTRY) -> DataFrame:
    """(rel, length): entry files with readable fences whose description is missing (length 0) or has more than `most` characters.

    Quotes and block marks around it don't count, and a description over several lines is one of single spaces.
    """
    return _described(front_matter(tree, entry, bodies=False), most)


def _described(parsed: DataFrame, most: int) -> DataFrame:
    length = F.coalesce(F.length(_value("description")), F.lit(0)).cast("long")
    return parsed.filter("fenced").select("rel", length.alias("length")).filter((F.col("length") == 0) | (F.col("length") > most))


def unknown_keys(tree: DataFrame, allowed: Sequence[str], entry: str = ENTRY) -> DataFrame:
    """(rel, key): keys at the top of an entry file's front matter that are not allowed."""
    return _unknown(front_matter(tree, entry, bodies=False), allowed)


def _unknown(parsed: DataFrame, allowed: Sequence[str]) -> DataFrame:
    other = F.array_except(F.transform("entries", lambda x: x["key"]), F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>"))
    return parsed.select("rel", F.explode(other).alias("key"))


def long_bodies(tree: DataFrame, most: int = 5000, characters: float = 4.0, entry: str = ENTRY, ranks: Ranks | None = None) -> DataFrame:
    """(rel, tokens): entry files whose text after the front matter has more than `most` tokens.

    Tokens are those of a merge table (ranks, as `merge_ranks` gives them); without one, so many characters count as one.
    """
    bodies = front_matter(tree, entry).filter("fenced").select("rel", "body")
    if ranks is None:
        found = bodies.select("rel", F.ceil(F.length("body") / characters).cast("long").alias("tokens"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, int] = {}
            for batch in batches:
                counts = [count_tokens(x.as_py().encode(), ranks, known) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["rel", "tokens"])

        found = bodies.mapInArrow(run, "rel string, tokens long")
    return found.filter(F.col("tokens") > most)


def doctor(tree: DataFrame, most: int | None = None, allowed: Sequence[str] | None = None, entry: str = ENTRY) -> DataFrame:
    """(rel, cause): why an entry file may not load, all rules in one report; description and keys only where limits are given."""
    parsed = front_matter(tree, entry, bodies=False)
    found = [(byte_order_marks(tree), "byte-order mark"), (wrong_case(tree, entry), "wrong case"), (_named(parsed), "name is not its folder"), (parsed.filter("reason is not null"), "unreadable front matter")]
    if most is not None:
        found.append((_described(parsed, most), "description"))
    if allowed is not None:
        found.append((_unknown(parsed, allowed).select("rel").distinct(), "unknown key"))
    return functools.reduce(DataFrame.unionByName, [df.select("rel", F.lit(cause).alias("cause")) for df, cause in found])


def doctor_roots(trees: DataFrame, roots: DataFrame, most: int, allowed: Sequence[str], entry: str = ENTRY) -> DataFrame:
    """(root, rank, name, rel, cause, loads, winner): every discovery root, what is in it, why it may not load and which copy wins.

    trees (root, rel, content) is the union of the scans of all roots, roots (root, rank) names them; a smaller rank comes first.
    A package is a folder at the top of a root, its entry file the one directly in it that is called like `entry` but for
    upper and lower case. A copy has a row for each cause (rel is null where there is no entry file) or one with a null cause; it
    loads without any. winner is the root of the first copy of its name that loads, null where none does, so a copy that is
    skipped hides no other. A root without packages has one row of nulls; files at the top are no packages. Names and causes of each
    file are found in one pass over the texts.
    """
    parts = F.split("rel", "/")
    inside = trees.filter(F.size(parts) > 1).select("root", F.get(parts, F.lit(0)).alias("name"), "rel", "content")
    base = F.lower(F.substring("rel", F.length("name") + 2, F.length("rel")))
    entries = inside.filter(base == entry.lower())
    copies = inside.select("root", "name").distinct()
    text = F.col("content").cast("binary")
    marked = F.coalesce(F.substring(text, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.lit(False))
    judged = _with_front(entries.select("root", "name", "rel", basename(F.col("rel")).alias("base"), marked.alias("marked"), text.alias("content")))
    length = F.coalesce(F.length(_value("description")), F.lit(0))
    other = F.array_except(F.transform("entries", lambda x: x["key"]), F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>"))
    rules = [
        (F.col("base") != entry, "wrong case"), (F.col("marked"), "byte-order mark"), (F.col("reason").isNotNull(), "unreadable front matter"),
        ((_value("name") != "") & (_value("name") != F.col("name")), "name is not its folder"), (F.col("fenced") & ((length == 0) | (length > most)), "description"), (F.size(other) > 0, "unknown key"),
    ]
    causes = F.array_compact(F.array(*[F.when(rule, F.lit(cause)) for rule, cause in rules]))
    known = copies.join(judged.select("root", "name", "rel", causes.alias("causes")), ["root", "name"], "left")
    known = known.withColumn("causes", F.coalesce("causes", F.array(F.lit("no entry file"))))
    every = roots.select("root", "rank").join(known, "root", "left").withColumn("loads", F.size("causes") == 0)
    first = Window.partitionBy("name").orderBy("rank", "root", "rel")
    best = every.filter("loads").withColumn("r", F.row_number().over(first)).filter("r = 1").select("name", F.col("root").alias("winner"))
    return every.join(best, "name", "left").select("root", "rank", "name", "rel", F.explode_outer("causes").alias("cause"), "loads", "winner")


def trigger_sets(evals: DataFrame, least: int = 8, most: int = 10) -> DataFrame:
    """(name, positive, near_miss, enough) of each name in evals (name, triggers): whether both counts are in bounds."""
    out = evals.groupBy("name").agg(F.count_if("triggers").alias("positive"), F.count_if(~F.col("triggers")).alias("near_miss"))
    return out.withColumn("enough", F.col("positive").between(least, most) & F.col("near_miss").between(least, most))


def untraced(statements: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """The statements that no location answers for; a null key is answered for by none."""
    return statements.join(locations.select(key), key, "left_anti")


def coverage(units: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(enumerated, covered, ratio): how many of the distinct units are covered; the ratio of no units is null."""
    seen = covered.select(key).distinct().withColumn("__seen", F.lit(1))
    out = units.select(key).distinct().join(seen, key, "left").agg(F.count(key).alias("enumerated"), F.count("__seen").alias("covered"))
    return out.withColumn("ratio", F.try_divide(F.col("covered").cast("double"), F.col("enumerated")))
