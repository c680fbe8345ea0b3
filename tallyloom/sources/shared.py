"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_location(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for Spark's own readers and writers; a local session without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="tree-")
        sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The path of that folder for files written with the file system's own calls: it has to be mounted under the same path everywhere."""
    at = urlparse(folder := shared_location(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"a tree of files needs a mounted folder, not {folder!r}")
    return at.path
