"""Integrity of a tree against a manifest: digests, drift, stale entries, shadowed copies and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import labelled, utf16_order


#: Rows of each side in a cell of a join that lists pairs, and pairs that a task lists, about.
CELL, TASK = 1024, 1 << 23


def digests(tree: DataFrame) -> DataFrame:
    """(rel, digest): the SHA-256 of content, in lower-case hex."""
    return tree.select("rel", F.sha2("content", 256).alias("digest"))


def digests_of(tree: DataFrame, files: DataFrame) -> DataFrame:
    """The digests of those files (rel) that the tree has."""
    return digests(tree.join(files, "rel", "left_semi"))


def drift(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(rel, kind): manifest entries (rel, digest) that found (rel, digest) lacks or has changed.

    Only manifest entries are visited: files that were added are no drift. A null digest equals none but null.
    """
    found = found.select("rel", F.col("digest").alias("now"), F.lit(True).alias("there"))
    both = manifest.join(found, "rel", "left")
    kind = F.when(F.col("there").isNull(), F.lit("deleted")).when(~F.col("now").eqNullSafe(F.col("digest")), F.lit("edited"))
    return both.select("rel", kind.alias("kind")).filter("kind is not null")


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(rel): manifest entries that are not among files."""
    return manifest.select("rel").join(files.select("rel"), "rel", "left_anti")


def present(files: DataFrame, tree: DataFrame) -> DataFrame:
    """files with a column present: whether the tree has them."""
    there = tree.select("rel").distinct().withColumn("present", F.lit(True))
    return files.join(there, "rel", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def shadowed(targets: DataFrame, cell: int = CELL, task: int = TASK) -> DataFrame:
    """Project copies (name, scope, path) that a global copy of the same name at another path hides.

    The result has a row for each such pair, so it grows with the square of a name's copies. Both sides of a name are dealt
    to cells of about `cell` rows of each, and the cells to so many tasks that each lists about `task` pairs, however many copies
    a name has; the tasks are counted first. Fewer pairs are joined as they are.
    """
    per = targets.groupBy("name").agg(F.count_if(F.col("scope") == "project").alias("ours"), F.count_if(F.col("scope") == "global").alias("tops"))
    pairs = per.agg(F.sum(F.col("ours").cast("double") * F.col("tops"))).first()[0] or 0
    ours, tops = targets.filter("scope = 'project'"), targets.filter("scope = 'global'").select("name", F.col("path").alias("winner"))
    if pairs <= task:
        return ours.join(tops, "name").filter("path <> winner")
    parts, tasks = lambda n: F.ceil(F.col(n) / cell).cast("int"), math.ceil(pairs / task)
    grid = per.filter("ours > 0 and tops > 0").select("name", parts("ours").alias("across"), parts("tops").alias("down"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        # by number, as copies may be equal in all they hold
        own_part = F.pmod(F.xxhash64("no"), F.col(own)).cast("int")
        both = rows.withColumn("no", F.monotonically_increasing_id()).join(grid, "name").withColumn(own, own_part)
        return both.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("no").repartition(tasks, "name", "across", "down")

    found = dealt(ours, "across", "down").join(dealt(tops, "down", "across"), ["name", "across", "down"]).filter("path <> winner")
    return found.select(*targets.columns, "winner")


def winners(targets: DataFrame) -> DataFrame:
    """The copy of each name that counts: global before project, then by path."""
    rank = F.when(F.col("scope") == "global", 0).otherwise(1)
    w = Window.partitionBy("name").orderBy(rank, "path")
    return targets.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def capped(found: DataFrame, most: int = 20) -> DataFrame:
    """(rel, kind, label, total, more): the first entries by path, the number of all and of those not shown."""
    total = found.agg(F.count("*").alias("total")).withColumn("more", F.greatest(F.col("total") - most, F.lit(0)))
    first = found.orderBy(utf16_order(F.col("rel"))).limit(most)
    return first.withColumn("label", labelled(F.col("rel"), F.col("kind"))).crossJoin(F.broadcast(total))


def as_maps(manifest: DataFrame, most: int = 10_000) -> DataFrame:
    """(shard, files): the map rel to digest in shards of about `most` entries by a hash of rel, so no row holds a whole manifest."""
    shards = manifest.agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).alias("shards"))
    shard = F.pmod(F.xxhash64("rel"), F.col("shards")).alias("shard")
    dealt = manifest.select("rel", "digest").crossJoin(F.broadcast(shards))
    return dealt.groupBy(shard).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rel", "digest")))).alias("files"))


def rows_of(files: DataFrame) -> DataFrame:
    """(rel, digest) of every entry of a map column files."""
    return files.select(F.explode("files").alias("rel", "digest"))
