"""Distributed union-find: connected components by local contraction and pointer jumping."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Links that a task contracts at a time.
LINKS = 1 << 19


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id reachable) of the ends of the links a[i] - b[i]."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        m = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], m)
        np.minimum.at(new, root[y], m)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if n >= LINKS or (batch is None and n):
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
            held, n = [], 0
            u, r = roots_of(a, b)
            far = u != r
            yield pa.RecordBatch.from_arrays([pa.array(u[far]), pa.array(r[far])], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of edges (a, b); component is the smallest id reachable.

    Each round contracts LINKS links of a task at a time to stars and brings equal ones together. Once no more than LINKS are
    left, one task contracts them all, which settles them. Else a round brings the stars of a vertex
    together (at most one of each such lot), links their centres to the least of them, and lets every vertex point to the
    centre of its centre. Links always point to a smaller id, so a vertex has as many links here as lots held it, never
    as it has neighbours. A star is settled once none of its vertices has another centre and its centre has none; only the others go on
    to the next round. It ends once all are. Only counts and that answer reach
    the driver. The result is a table in the shared folder. Null ends and loops are ignored; an empty input gives an empty result.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    settled: list[DataFrame] = []
    kept: list[DataFrame] = []
    for _ in range(most_rounds):
        stars = cut(e.mapInArrow(_contract, "u long, v long").distinct())
        if stars.count() <= LINKS:
            kept.append(stars)
            settled.append(stars.repartition(1).mapInArrow(_contract, "u long, v long"))
            break
        own = Window.partitionBy("u")
        least = F.min("v").over(own)
        links = cut(stars.select(F.when(F.col("v") == least, F.col("u")).otherwise(F.col("v")).alias("u"), least.alias("v"), (F.max("v").over(own) > least).alias("several")))
        up = links.groupBy("u").agg(F.min("v").alias("top")).withColumnRenamed("u", "c")
        jumped = links.join(up, links["v"] == up["c"], "left")
        now = cut(jumped.select("u", F.coalesce("top", "v").alias("v"), (F.col("several") | F.col("top").isNotNull()).alias("open")))
        discard(stars, links)
        # a vertex may have been linked as a centre, besides the one that it has as a vertex
        several = F.max("open").over(own) | (F.min("v").over(own) < F.max("v").over(own))
        going = cut(now.select("v", several.alias("several")).filter("several").select("v").distinct())
        kept += [now, going]
        settled.append(now.join(going, "v", "left_anti").select("u", "v"))
        if going.isEmpty():
            break
        e = now.join(going, "v", "left_semi").select("u", "v")
    else:
        raise RuntimeError("components did not settle")
    e = functools.reduce(DataFrame.unionByName, settled)
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("x")
    out = cut(e.select(ends).select("x.id", "x.component").distinct())
    discard(*kept)
    return out
