"""Drift of items as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.integrity import digests


def arriving_edits(stream: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel): items of a stream (rel, content) whose digest is not the one in the static manifest (rel, digest).

    A stateless stream-static join, so late and repeated items need no watermark. Items the manifest doesn't name are no drift.
    """
    now = digests(stream).withColumnRenamed("digest", "now")
    both = now.join(manifest, "rel")
    return both.filter(~both["now"].eqNullSafe(both["digest"])).select("rel")
