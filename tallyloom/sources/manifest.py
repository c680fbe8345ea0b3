"""The manifest: one JSON document that names an installed tree and the digest of each of its files."""

from __future__ import annotations

import dataclasses
import datetime
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import as_maps

SCHEMA = "rel string, digest string"


@dataclasses.dataclass(frozen=True)
class Manifest:
    name: str | None
    version: str | None
    installed_at: str | None
    files: dict[str, str | None] | None


def _no_constant(text: str):
    raise ValueError(text)


def parse_manifest(text: str) -> Manifest | None:
    """The manifest in text, or None where it isn't strict JSON or not an object.

    Duplicate keys: the last counts. Single quotes, trailing text, NaN and a byte-order mark make it unreadable.
    A digest that isn't a string can equal none, so it is kept as null. files that aren't an object count as missing.
    """
    try:
        got = json.loads(text, parse_constant=_no_constant)
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    text_of = lambda k: got[k] if isinstance(got.get(k), str) else None
    files = got.get("files")
    files = {k: v if isinstance(v, str) else None for k, v in files.items()} if isinstance(files, dict) else None
    return Manifest(text_of("name"), text_of("version"), text_of("installed_at"), files)


def read_manifest(path: str) -> Manifest | None:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_manifest(f.read())
    except (OSError, UnicodeDecodeError):
        return None


def manifest_rows(spark: SparkSession, manifest: Manifest | None) -> DataFrame:
    """(rel, digest) of the manifest's files; none for a missing one."""
    files = (manifest.files or {}) if manifest else {}
    return spark.createDataFrame(list(files.items()), SCHEMA)


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def write_manifest_shards(rows: DataFrame, folder: str, name: str, version: str, most: int = 10_000) -> None:
    """Writes the entries (rel, digest) of a manifest too long for the driver: a line for each shard of about `most` entries, itself a manifest."""
    now = _now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [json.dumps({"name": name, "version": version, "installed_at": now, "files": dict(x)}, ensure_ascii=False) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    as_maps(rows, most).select("files").mapInArrow(run, "value string").write.text(folder)


def read_manifest_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(rel, digest, readable) of the lines that write_manifest_shards has written; an unreadable line is a row of nulls with readable false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0).to_pylist():
                found = parse_manifest(line)
                files = list((found.files or {}).items()) if found else [(None, None)]
                cols = zip(*files, strict=True) if files else ([], [])
                yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.string()) for c in cols), pa.array([found is not None] * len(files), pa.bool_())], ["rel", "digest", "readable"])

    return spark.read.text(folder).select(F.col("value")).mapInArrow(run, "rel string, digest string, readable boolean")


def write_manifest(path: str, name: str, version: str, files: dict[str, str]) -> None:
    """Writes the document beside its place and renames it, so a reader sees the old or the new one."""
    body = {"name": name, "version": version, "installed_at": _now(), "files": dict(sorted(files.items()))}
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(json.dumps(body, indent=2, ensure_ascii=False) + "\n")
    os.replace(f"{path}.new", path)
