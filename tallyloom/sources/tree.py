"""A file tree as a table that lists hidden, underscore and empty files too, listed and read in tasks.

Spark's own file sources skip names that start with `.` or `_`, drop empty files and read `a=b` as a partition. Here tasks list
the folders level by level: only the names of folders come to the driver. Files are then packed by their bytes and read in tasks.
The folder must be one that the driver and all executors see under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import safe

SCHEMA = "rel string, content binary, mode int"
#: Folders that a task lists at least, bytes and files that a task reads at most (or one file), and bytes of a batch.
FOLDERS, PACK_BYTES, PACK_FILES, BATCH_BYTES = 16, 64 << 20, 4096, 16 << 20


def _joined(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, os.stat_result | None]]:
    """(rel, whether it is a folder, its state) of what a folder holds; a folder that has gone holds nothing.

    A link is a file, also one to a folder; a broken one counts as absent.
    """
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for x in found:
                rel = _joined(folder, x.name).replace(os.sep, "/")
                if x.is_dir(follow_symlinks=False):
                    yield rel, True, None
                elif os.path.exists(x.path):
                    yield rel, False, x.stat()
    except (FileNotFoundError, NotADirectoryError):
        return


def _dealt(spark: SparkSession, folders: list[str]) -> DataFrame:
    tasks = min(max(1, len(folders) // FOLDERS), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(x,) for x in folders], "folder string").repartition(tasks)


def _folders(spark: SparkSession, root: str, tops: list[str]) -> list[str]:
    """All folders under tops, themselves included: each level is listed in tasks, which send back folders only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rel for folder in batch.column(0).to_pylist() for rel, inside, _ in _entries(root, folder) if inside]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["folder"])

    out, level = list(tops), list(tops)
    while level:
        level = [r[0] for r in _dealt(spark, level).mapInArrow(run, "folder string").collect()]
        out += level
    return out


def list_tree(spark: SparkSession, root: str, skip: str = "", only: list[str] | None = None) -> DataFrame:
    """(rel, bytes, mode) of the files under root, paths with `/`, but those called `skip`; with only, of the named tops.

    A top named in only is taken whatever it is called, a link to a folder is followed there; missing ones are passed over.
    """
    root = os.path.abspath(root)
    tops = [x for x in dict.fromkeys(only or []) if os.path.exists(os.path.join(root, x))] if only else [""]
    single = [x for x in tops if x and not os.path.isdir(os.path.join(root, x))]
    folders = _folders(spark, root, [x for x in tops if x not in single] if os.path.isdir(root) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [(rel, s.st_size, s.st_mode & 0o7777) for rel, inside, s in _entries(root, folder) if not inside and rel.rpartition("/")[2] != skip]
                cols = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["rel", "bytes", "mode"])

    out = _dealt(spark, folders).mapInArrow(run, "rel string, bytes long, mode int")
    if single:
        stats = [(x, os.stat(os.path.join(root, x))) for x in single]
        out = out.unionByName(spark.createDataFrame([(x, s.st_size, s.st_mode & 0o7777) for x, s in stats], "rel string, bytes long, mode int"))
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rel, bytes, mode) to rows (files) of as many files as a task should read."""
    held, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.struct([("rel", pa.string()), ("mode", pa.int32())])))], ["files"])
    for batch in batches:
        for rel, n, mode in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and (size + n > PACK_BYTES or len(held) == PACK_FILES):
                yield out()
                held, size = [], 0
            held.append({"rel": rel, "mode": mode})
            size += n
    if held:
        yield out()


def read_tree(spark: SparkSession, root: str, content: bool = True, skip: str = "", only: list[str] | None = None) -> DataFrame:
    """(rel, content, mode) of the files of list_tree; content is null where it isn't asked for and for links to folders.

    A missing root or listed name gives no rows. A file that goes between listing and reading gives none either.
    """
    root = os.path.abspath(root)
    found = list_tree(spark, root, skip, only)
    if not content:
        return found.select("rel", F.lit(None).cast("binary").alias("content"), "mode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for x in (x for files in batch.column(0).to_pylist() for x in files):
                full = os.path.join(root, x["rel"])
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                except IsADirectoryError:
                    data = None
                rows.append((x["rel"], data, x["mode"]))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    total = found.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    tasks = 1 + max(total[0] // PACK_BYTES, total[1] // PACK_FILES)
    packs = found.mapInArrow(_packed, "files array<struct<rel:string,mode:int>>")
    return packs.repartition(int(tasks)).mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32()), strict=True)], ["rel", "content", "mode"])


def scan_roots(spark: SparkSession, roots: dict[str, str], skip: str = "") -> DataFrame:
    """(root, rel, content): the union of the scans of several roots (name to folder)."""
    out = None
    for name, folder in roots.items():
        one = read_tree(spark, folder, skip=skip).select(F.lit(name).alias("root"), "rel", "content")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "root string, rel string, content binary")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (rel, content, mode) under root in tasks: each beside its place and then renamed, so a repeated task does no harm.

    With an execute bit a file gets mode 0755, else 0644. A path that is absolute or holds `..` is an error, before anything is written by
    its task.
    """
    root = os.path.abspath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rels = batch.column(0).to_pylist()
            wrong = [x for x in rels if not x or not safe(x)]
            if wrong:
                raise ValueError(f"unsafe path {wrong[0]!r}")
            for k, rel in enumerate(rels):
                to = os.path.join(root, rel)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.new"
                with open(part, "wb") as f:
                    f.write(batch.column(1)[k].as_py() or b"")
                os.chmod(part, 0o755 if (batch.column(2)[k].as_py() or 0) & 0o111 else 0o644)
                os.replace(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([len(rels)], pa.int64())], ["n"])

    ready = files.select(F.col("rel").cast("string"), F.col("content").cast("binary"), F.col("mode").cast("int"))
    ready.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
