"""From books to a checked store: enumerated units, chunks, constraints and a certificate.

The rules here are this library's own; every function takes null and repeated rows and empty tables.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.navigation import units

#: Where a text is cut, the strongest first.
BOUNDARIES = ("\n\n", "\n", ". ", " ")


def enumerate_units(members: DataFrame) -> DataFrame:
    """(book, unit, depth, parent, label, target, path): the items of the navigation of each book, of members as `ingest` gives them.

    unit is the place of the item, parent that of the item above it (null at the top). The number of rows of a book is what its
    coverage is measured against. Books without a navigation have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(book, *x) for book, member, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for x in units(content.decode(errors="replace"), member or "")]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["book", "unit", "depth", "parent", "label", "target", "path"])

    ready = members.filter("nav and content is not null").select("book", "member", "content")
    return ready.mapInArrow(run, "book string, unit long, depth long, parent long, label string, target string, path string")


def pieces(text: str, most: int, boundaries: Sequence[str] = BOUNDARIES) -> Iterator[tuple[int, str]]:
    """(start, piece) of a text: pieces of at most `most` characters that join to the text.

    Each takes as much as it may up to the last boundary of the strongest kind in reach; without any it is cut at `most`. A text that
    fits is one piece, an empty one has none.
    """
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            found = ((text.rfind(x, at, end), len(x)) for x in boundaries)
            end = next((k + n for k, n in found if k >= 0), end)
        yield at, text[at:end]
        at = end


def chunk(docs: DataFrame, most: int = 2000, boundaries: Sequence[str] = BOUNDARIES) -> DataFrame:
    """(doc_id, no, chunk_id, start, length, piece) of docs (doc_id, text): the pieces of each text, in code points.

    chunk_id is made from the piece and its number among equal ones of the text, so it survives edits elsewhere in the text. A null
    text has no pieces; other columns are ignored.
    """
    cell = pa.list_(pa.struct([("start", pa.int64()), ("nth", pa.int64()), ("piece", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seen: dict[str, int] = {}
                rows = []
                for start, piece in pieces(batch.column(1)[k].as_py() or "", most, boundaries):
                    seen[piece] = seen.get(piece, 0) + 1
                    rows.append({"start": start, "nth": seen[piece] - 1, "piece": piece})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([rows], cell)], ["doc_id", "x"])

    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<struct<start:long,nth:long,piece:string>>")
    found = found.select("doc_id", F.posexplode("x").alias("no", "x"))
    name = F.concat_ws("-", F.substring(F.sha2("x.piece", 256), 1, 16), F.col("x.nth").cast("string"))
    return found.select("doc_id", F.col("no").cast("long").alias("no"), name.alias("chunk_id"), "x.start", F.length("x.piece").cast("long").alias("length"), "x.piece")


@dataclasses.dataclass(frozen=True)
class Key:
    """Columns of a table that no two rows share and that are never null."""

    name: str
    table: str
    columns: tuple[str, ...]


@dataclasses.dataclass(frozen=True)
class Reference:
    """Columns of a table that name a row of another one; with `both`, each row there is named too."""

    name: str
    table: str
    columns: tuple[str, ...]
    to: str
    to_columns: tuple[str, ...]
    both: bool = False


@dataclasses.dataclass(frozen=True)
class Located:
    """Rows (document, start, length, digest) whose digest is the SHA-256 of that part of the text of the document."""

    name: str
    table: str
    document: str
    start: str
    length: str
    digest: str
    to: str
    to_key: str
    text: str


def _fact(name: str, role: str, columns: Sequence[str]) -> Column:
    key = F.when(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]))
    return F.struct(F.lit(name).alias("name"), F.lit(role).alias("role"), key.alias("key"))


def check_store(tables: dict[str, DataFrame], constraints: Sequence[Key | Reference | Located]) -> DataFrame:
    """(constraint, kind, key, n): what breaks the constraints, n rows each.

    kinds: `null key`, `repeated key`, `no target` (a reference or place without its row), `no source` (a row that nothing refers to),
    `wrong digest`. All keys and references of a table are read in one scan, and all tables meet in one aggregation by
    constraint and key, with partial counts, so a key that many rows share costs no more than others. Digests take one
    join each, of places with the texts they lie in. Keys of several columns are joined by U+001F.
    """
    facts: dict[str, list[Column]] = {}
    for c in constraints:
        if isinstance(c, Key):
            facts.setdefault(c.table, []).append(_fact(c.name, "key", c.columns))
        elif isinstance(c, Reference):
            facts.setdefault(c.table, []).append(_fact(c.name, "source", c.columns))
            facts.setdefault(c.to, []).append(_fact(c.name, "both" if c.both else "target", c.to_columns))
    out = []
    if facts:
        every = [tables[t].select(F.explode(F.array(*own)).alias("x")).select("x.name", "x.role", "x.key") for t, own in facts.items()]
        count = lambda *roles: F.count_if(F.col("role").isin(*roles)).alias(roles[0])
        per = functools.reduce(DataFrame.unionByName, every).groupBy("name", "key").agg(count("key").alias("keys"), count("source"), count("target", "both"), count("both"))
        kind = (
            F.when(F.col("key").isNull() & (F.col("keys") + F.col("source") > 0), "null key")
            .when(F.col("keys") > 1, "repeated key")
            .when((F.col("source") > 0) & (F.col("target") == 0), "no target")
            .when((F.col("both") > 0) & (F.col("source") == 0) & F.col("key").isNotNull(), "no source")
        )
        n = F.when(F.col("keys") > 0, F.col("keys")).when(F.col("source") > 0, F.col("source")).otherwise(F.col("both"))
        out.append(per.select(F.col("name").alias("constraint"), kind.alias("kind"), "key", n.alias("n")).filter("kind is not null"))
    for c in constraints:
        if isinstance(c, Located):
            places = tables[c.table].select(F.col(c.document).alias("__to"), F.col(c.start).alias("__start"), F.col(c.length).alias("__length"), F.col(c.digest).alias("__digest"))
            texts = tables[c.to].select(F.col(c.to_key).alias("__to"), F.col(c.text).alias("__text"), F.lit(True).alias("__there"))
            both = places.join(texts, "__to", "left")
            part = F.substring("__text", (F.col("__start") + 1).cast("int"), F.col("__length").cast("int"))
            kind = F.when(F.col("__there").isNull(), "no target").when(~F.sha2(part, 256).eqNullSafe(F.col("__digest")), "wrong digest")
            told = both.select(kind.alias("kind"), F.col("__to").cast("string").alias("key")).filter("kind is not null")
            out.append(told.groupBy("kind", "key").agg(F.count("*").alias("n")).select(F.lit(c.name).alias("constraint"), "kind", "key", "n"))
    return functools.reduce(DataFrame.unionByName, out)


#: Verdicts of a report, the best first: the verdict over several reports is the worst of theirs.
VERDICTS = ("certified", "qualified", "incomplete", "refused")


def certify(reports: DataFrame) -> DataFrame:
    """(unit, state, exit_code, reports, failing, reason) over reports (unit, place, report, state, reason).

    The states are those of VERDICTS; any other, or null, counts as refused. A unit's state is the worst of its reports', so the order
    of reports and repeated ones change nothing. reason is `report: reason` of the first report, by place and name, that has
    that state, null if certified; failing counts the reports that aren't certified. exit_code is 0 up to qualified,
    1 if incomplete, 2 if refused. A unit without reports has no row.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("state")), F.lit(0)).cast("int")
    rank = F.when(rank == 0, len(VERDICTS)).otherwise(rank) - 1
    ranked = reports.select("unit", "place", "report", rank.alias("rank"), F.concat_ws(": ", "report", F.coalesce("reason", F.lit("no reason given"))).alias("said"))
    # the least of (-rank, place, report) is the first of the worst
    first = F.min(F.struct((-F.col("rank")).alias("r"), "place", "report", "said"))
    out = ranked.groupBy("unit").agg(F.count("*").alias("reports"), F.count_if(F.col("rank") > 0).alias("failing"), first.alias("first"))
    worst = -F.col("first.r")
    state = F.element_at(F.array(*map(F.lit, VERDICTS)), worst + 1)
    return out.select("unit", state.alias("state"), F.greatest(worst - 1, F.lit(0)).alias("exit_code"), "reports", "failing", F.when(worst > 0, F.col("first.said")).alias("reason"))
