"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, list_column, mix64, seeded
from .components import components, roots_of

TABLES, POLYTOPES, PROBES, LEAST, BLOCK = 14, 2, 3, 0.95, 8192
#: Pairs of vectors whose products a task holds at a time.
PAIRS = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def bucket_keys(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Rows x tables x probes: the numbers of a vector's own bucket and of the next likely ones of each table.

    A table concatenates two cross-polytope hashes: the signed axis nearest to the vector after three rounds of random
    signs and a Hadamard transform. The next likely buckets change the axis that is beaten by least.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    every = np.arange(len(x))
    for t in range(tables):
        axis, value = [], []
        for c in range(POLYTOPES):
            y = padded
            for r in range(3):
                signs = np.where(seeded(1000 + (t * POLYTOPES + c) * 3 + r, width) >> np.uint64(63), 1.0, -1.0)
                y = hadamard(y * signs) / np.sqrt(width)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, : min(probes, width)]
            axis.append(2 * best + (y[every[:, None], best] < 0))
            value.append(np.take_along_axis(size, best, axis=1))
        loss, code = [], []
        for i in range(axis[0].shape[1]):
            for j in range(axis[1].shape[1]):
                loss.append((value[0][:, 0] - value[0][:, i]) + (value[1][:, 0] - value[1][:, j]))
                code.append(axis[0][:, i] * 2 * width + axis[1][:, j])
        order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")[:, :probes]
        got = np.take_along_axis(np.stack(code, axis=1), order, axis=1)
        out[:, t] = np.pad(got, ((0, 0), (0, probes - got.shape[1])), mode="edge")
    return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, flat values, offsets) of the rows of a list column that are finite and not zero."""
    lens = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten().fill_null(np.nan).cast(pa.float64()))
    at = np.concatenate([[0], np.cumsum(lens)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    ok = (lens > 0) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    return np.flatnonzero(ok), flat, at


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, print, vector of length 1, keys); vectors that link with nothing are left out."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            rows, flat, at = _vectors(part.column(1))
            for width in np.unique(at[rows + 1] - at[rows]):
                own = rows[at[rows + 1] - at[rows] == width]
                x = flat[at[own][:, None] + np.arange(width)]
                bits = (x + 0.0).view(np.uint64) * (seeded(71, width) | np.uint64(1))
                prints = mix64(mix64(bits).sum(axis=1, dtype=np.uint64) + np.uint64(width))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                # vectors of another width are another space: the width is part of each key
                keys = (bucket_keys(x).reshape(len(x), -1) * np.int64(1 << 20) + np.int64(width)).astype(np.int64)
                lists = lambda v, k: list_column(v.ravel(), np.arange(len(own) + 1) * v.shape[1], k)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(prints.view(np.int64)), lists(x, pa.float64()), lists(keys, pa.int64())], ["vec_id", "print", "x", "keys"])


def _block(group: pa.RecordBatch, least: float, probes: int) -> tuple[np.ndarray, ...]:
    """(ids, linked vectors, smallest id reachable here) of the links of one bucket or pair of blocks found here first.

    group has columns rank (place of the bucket in the table), b1, b2, block, id, n, x, keys. Pairs that an earlier
    table already brings together are left to that table, so each pair counts once.
    """
    t, cross = int(group.column(0)[0].as_py()), group.column(1)[0].as_py() != group.column(2)[0].as_py()
    ids, n = group.column(4).to_numpy(), group.column(5).to_numpy()
    x = np.asarray(group.column(6).flatten()).reshape(len(ids), -1)
    keys = np.asarray(group.column(7).flatten()).reshape(len(ids), -1, probes)
    block, key = group.column(3).to_numpy(), group.column(8)[0].as_py()
    main = keys[:, t, 0] == key
    m = len(ids)
    links, ends = np.zeros(m, dtype=np.int64), []
    step = max(1, PAIRS // m)
    for a in range(0, m, step):
        # some rows against all: the products of a group never stand in memory together
        part = slice(a, a + step)
        near = x[part] @ x.T >= least
        near &= main[part, None] | main[None, :]
        near &= ids[part, None] < ids[None, :]
        if cross:
            near &= block[part, None] != block[None, :]
        i, j = np.nonzero(near)
        i += a
        fresh = np.ones(len(i), dtype=bool)
        for s in range(t):
            fresh &= ~((keys[j, s] == keys[i, s, :1]).any(axis=1) | (keys[i, s] == keys[j, s, :1]).any(axis=1))
        # in one table two vectors may meet in each other's own bucket too: the smaller number of the two counts
        both = (keys[i, t] == keys[j, t, :1]).any(axis=1) & (keys[j, t] == keys[i, t, :1]).any(axis=1)
        fresh &= ~both | (np.minimum(keys[i, t, 0], keys[j, t, 0]) == key)
        i, j = i[fresh], j[fresh]
        if len(i):
            links += np.bincount(i, n[j], minlength=m).astype(np.int64) + np.bincount(j, n[i], minlength=m).astype(np.int64)
            ends.append(roots_of(ids[i], ids[j]))
    if not ends:
        return ids[:0], n[:0], ids[:0]
    own, root = roots_of(*(np.concatenate(e) for e in zip(*ends, strict=True)))
    at = np.argsort(ids)
    return own, links[at[np.searchsorted(ids[at], own)]], root


def _compare(least: float, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            if group.num_rows > 1:
                ids, links, roots = _block(group, least, probes)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["id", "links", "root"])

        for batch in batches:
            # t, b1, b2 and key name a group; the partition is sorted by them
            names = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1, 2, 8)], axis=1)
            if not len(names):
                continue
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(names)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                name = tuple(names[a])
                if held and name != last:
                    yield from done()
                    held.clear()
                last = name
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Vectors with a cosine of at least `least` in double precision are linked. Equal vectors become one class, hashed once; n_links
    counts the linked vectors, copies included. Candidates share a bucket of one of 14 tables of two cross-polytope hashes,
    where a vector stands in its own bucket and in the 2 next likely ones, and meets those that own it. Each is
    confirmed by its cosine. A bucket of more than `block` vectors is split into blocks by a hash, and pairs of blocks are
    compared in tasks of their own, by matrix products of some rows at a time that give counts and local roots instead of pairs. So
    a vector is sent once for each `block` vectors of its bucket.

    Edge cases: vectors that are null, empty, zero or hold null or non-finite values link with nothing (n_links 0, their
    own component); vectors of different lengths never link; a null vec_id comes back with component_id null and kept false
    and is linked with nothing; rows that repeat a vec_id are one vector, the one whose print is smallest; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    hashed = rows.filter("vec_id is not null").mapInArrow(_hashed, "vec_id long, print long, x array<double>, keys array<long>")
    hashed = cut(hashed)
    ids = hashed.groupBy("vec_id").agg(F.min("print").alias("print"))
    ids = cut(ids)
    classes = ids.groupBy("print").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    members = ids.join(classes, "print").select("vec_id", "id", "n")
    reps = hashed.join(classes.withColumnRenamed("id", "vec_id"), ["vec_id", "print"]).select(F.col("vec_id").alias("id"), "n", "x", "keys").dropDuplicates(["id"])
    reps = cut(reps)
    placed = reps.select("id", F.posexplode("keys").alias("p", "key")).select(F.floor(F.col("p") / PROBES).cast("int").alias("t"), "key", "id", (F.col("p") % PROBES == 0).alias("own"))
    # buckets that no vector owns or that hold one vector bring nobody together
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("size"), F.max("own").alias("owned")).filter("size > 1 and owned")
    sizes = sizes.select("t", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = placed.select("t", "key", "id").distinct().join(sizes, ["t", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "t", "key", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    rows = rows.join(reps, "id").select("t", "b1", "b2", "block", "id", "n", "x", "keys", "key")
    dealt = rows.repartition("t", "key", "b1", "b2").sortWithinPartitions("t", "b1", "b2", "key")
    found = cut(dealt.mapInArrow(_compare(least, PROBES), "id long, links long, root long"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = members.join(links, "id", "left").join(comp, "id", "left")
    per = per.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(per, "vec_id", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("vec_id"), F.lit(False)).alias("kept"))
