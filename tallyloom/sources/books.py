"""Books: zip archives whose members stand in the reading order of a spine, read to rows in tasks.

The format is that of EPUB: META-INF/container.xml names a package file, whose manifest lists the members and whose spine orders them.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "book string, position long, member string, media_type string, nav boolean, content binary, problem string"
#: Members beyond so many bytes are reported instead of read, and bytes of a batch.
MOST_BYTES, BATCH_BYTES = 1 << 30, 16 << 20
CONTAINER = "META-INF/container.xml"

Row = tuple[int | None, str | None, str | None, bool, bytes | None, str | None]


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    """The elements of a name, of whatever namespace."""
    return [x for x in root.iter() if x.tag.rpartition("}")[2] == name]


def _spine(archive: zipfile.ZipFile) -> list[tuple[str, str | None, bool]]:
    """(member, media type, whether it is the navigation) in reading order; a navigation outside the spine comes last."""
    found = [x.get("full-path") for x in _all(ElementTree.fromstring(archive.read(CONTAINER)), "rootfile")]
    if not found or not found[0]:
        raise ValueError("container without a package file")
    package = ElementTree.fromstring(archive.read(found[0]))
    folder = posixpath.dirname(found[0])
    items = {}
    for x in _all(package, "item"):
        to = posixpath.normpath(posixpath.join(folder, unquote(x.get("href") or "")))
        items[x.get("id")] = (to, x.get("media-type"), "nav" in (x.get("properties") or "").split())
    order = [x.get("idref") for x in _all(package, "itemref")]
    unknown = [x for x in order if x not in items]
    if unknown:
        raise ValueError(f"spine names no item of the manifest: {unknown[0]}")
    return [items[x] for x in order] + [x for k, x in items.items() if x[2] and k not in order]


def read_book(data: bytes, most_bytes: int = MOST_BYTES) -> Iterator[Row]:
    """(position, member, media type, nav, content, problem) of one archive; a broken one has a row that only says why."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        order = _spine(archive)
    except KeyError as e:
        yield None, None, None, False, None, str(e.args[0])
        return
    except (zipfile.BadZipFile, ValueError, ElementTree.ParseError, RuntimeError, NotImplementedError) as e:
        yield None, None, None, False, None, f"{type(e).__name__}: {e}"
        return
    with archive:
        for k, (member, kind, nav) in enumerate(order):
            content = problem = None
            try:
                info = archive.getinfo(member)
                if info.file_size > most_bytes:
                    problem = f"{info.file_size} bytes"
                else:
                    content = archive.read(info)
            except (KeyError, zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
                problem = str(e.args[0] if e.args else e)
            yield k, member, kind, nav, content, problem


def ingest(archives: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(book, position, member, media_type, nav, content, problem) of archives (book, content): a row for each member of the spine.

    A task holds one archive and the rows of about BATCH_BYTES. An archive that can't be read has one row, with a null position and
    its problem; so has a member that is missing, damaged, encrypted or larger than most_bytes, in its place. A null content is a
    problem; repeated rows are read as often as they stand; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                book, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for row in read_book(data or b"", most_bytes):
                    rows.append((book, *row))
                    size += len(row[4] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select(F.col("book").cast("string"), F.col("content").cast("binary")).mapInArrow(run, SCHEMA)


def read_books(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """The members of all archives under path, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return ingest(files.select(F.col("path").alias("book"), "content"))


def write_book(members: list[tuple[str, bytes]], nav: str) -> bytes:
    """An archive with these members in their order as its spine, and a navigation (the list as HTML)."""
    out = io.BytesIO()
    items = "".join(f'<item id="m{k}" href="{name}" media-type="application/xhtml+xml"/>' for k, (name, _) in enumerate(members))
    spine = "".join(f'<itemref idref="m{k}"/>' for k in range(len(members)))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("mimetype", "application/epub+zip")
        archive.writestr(CONTAINER, '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="text/book.opf"/></rootfiles></container>')
        archive.writestr("text/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{spine}</spine></package>')
        archive.writestr("text/nav.xhtml", f"<html><body><nav>{nav}</nav></body></html>")
        for name, data in members:
            archive.writestr(f"text/{name}", data)
    return out.getvalue()
