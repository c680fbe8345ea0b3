"""Repeated byte strings across documents, removed from all but the document with the smallest id.

Suffixes are sorted in shards that hash their content, with content-chosen anchors in place of induced sorting:
see the README for why. Every stage is an Arrow map over buckets whose number follows the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _INVERSE, LAST, _powers, cut, list_column, mix64, seeded, text_slices

LENGTH, GRAM, BUCKET_BYTES, MOST_TASKS = 50, 24, 8 << 20, 20_000
PACKED = "b int, key array<int>, ctx array<long>, doc array<long>, t array<int>, pos array<int>, len array<int>"
SPOTS = "b int, kind int, doc array<long>, t array<int>, start array<int>, end array<int>"


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i with a whole window."""
    have, step = x, 1
    while 2 * step <= width:
        have, step = op(have[:-step], have[step:]), 2 * step
    rest = width - step
    return op(have[: len(have) - rest], have[rest:]) if rest else have


def _anchors(data: np.ndarray, rows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Positions of the grams with the least hash of any string of length bytes that lies in one row (all of them, if equal)."""
    n, span = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, dtype=np.int64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n)[: n - gram + 1]) | np.uint64(1)
    least = _slide(h, span, np.minimum)
    # strings that cross rows choose nothing
    for r in rows[1:-1]:
        least[max(0, r - length + 1) : min(r, len(least))] = 0
    zero = np.zeros(span - 1, dtype=np.uint64)
    most = _slide(np.concatenate([zero, least, zero]), span, np.maximum)
    return np.flatnonzero(most == h)


def _pack(bucket: np.ndarray, columns: list[tuple[np.ndarray, pa.DataType]]) -> list[pa.Array]:
    """The columns as lists, one for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    some, at = np.unique(bucket[order], return_index=True)
    offsets = np.append(at, len(bucket))
    return [pa.array(some.astype(np.int32)), *(list_column(c[order], offsets, k) for c, k in columns)]


def _flat(batches: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([np.asarray(b.column(column).flatten()) for b in batches])


def _doc_bucket(doc: np.ndarray, t: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64) + t.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each place of the sorted keys starts a group."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, t, runs (start, end): the byte runs to remove of each row of docs (doc, t, text) that has any."""
    width = 2 * (length - gram) + gram
    side = length - gram
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a task takes several buckets, one after another, once there are more than MOST_TASKS
    buckets = min(max(8, total // BUCKET_BYTES), (1 << 31) - 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, hi, data, rows in text_slices(batch, 2):
                pos = _anchors(data, rows, length, gram)
                row = np.searchsorted(rows, pos, side="right") - 1
                a, b = np.maximum(pos - side, rows[row]), np.minimum(pos + width - side, rows[row + 1])
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
                inv = _powers(_INVERSE, len(data) + 1)
                key = mix64((sums[pos + gram] - sums[pos]) * inv[pos])
                ctx = mix64((sums[b] - sums[a]) * inv[a] + (pos - a).astype(np.uint64) * np.uint64(77) + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                cols = [((key >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()), (ctx.view(np.int64), pa.int64()), (doc[lo + row], pa.int64()), (t[lo + row], pa.int32()), ((pos - rows[row]).astype(np.int32), pa.int32()), ((rows[row + 1] - rows[row]).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(_pack((key % np.uint64(buckets)).astype(np.int64), cols), ["b", "key", "ctx", "doc", "t", "pos", "len"])

    def settle(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ctx, doc, t, pos, size = (_flat(group, c) for c in range(1, 7))
        order = np.lexsort((doc, ctx, key))
        key, ctx, doc, t, pos, size = (x[order] for x in (key, ctx, doc, t, pos, size))
        if not len(key):
            return
        new_key, new_ctx = _group_starts(key), _group_starts(key, ctx)
        at = np.flatnonzero(new_ctx)
        first = np.repeat(doc[at], np.diff(np.append(at, len(doc))))
        start, end = np.maximum(pos - side, 0), np.minimum(pos + width - side, size)
        # the same surroundings stand in an earlier document: all its strings do
        whole = (doc > first) & (end - start >= length)
        k = np.flatnonzero(new_key)
        lens = np.diff(np.append(k, len(key)))
        several = np.repeat((np.add.reduceat(new_ctx.astype(np.int64), k) > 1) & (np.minimum.reduceat(doc, k) < np.maximum.reduceat(doc, k)), lens)
        fine = several & (doc == first)
        for kind, take, a, b in ((0, whole, start, end), (1, fine, pos, pos)):
            i = np.flatnonzero(take)
            if len(i):
                cols = [(doc[i], pa.int64()), (t[i], pa.int32()), (a[i].astype(np.int32), pa.int32()), (b[i].astype(np.int32), pa.int32())]
                b_, *rest = _pack(_doc_bucket(doc[i], t[i], buckets), cols)
                yield pa.RecordBatch.from_arrays([b_, pa.array(np.full(len(b_), kind, dtype=np.int32)), *rest], ["b", "kind", "doc", "t", "start", "end"])

    def merged(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.concatenate([np.repeat(b.column(1).to_numpy(), np.asarray(b.column(2).value_lengths())) for b in group])
        doc, t, start, end = (_flat(group, c) for c in (2, 3, 4, 5))
        order = np.lexsort((end, start, kind, t, doc))
        kind, doc, t, start, end = (x[order] for x in (kind, doc, t, start, end))
        new = _group_starts(doc, t, kind)
        # a run goes on while strings overlap or touch; the running end is taken within a group by raising each group
        lift = np.cumsum(new) * np.int64(1 << 33)
        reach = np.maximum.accumulate(end + lift)
        # anchors, kind 1, are only told apart
        same = np.concatenate([[False], (start[1:] + lift[1:] <= reach[:-1]) & (kind[1:] == 0)]) | np.concatenate([[False], (kind[1:] == 1) & (start[1:] == start[:-1])])
        runs = np.flatnonzero(~same | new)
        ends = (np.maximum.reduceat(end + lift, runs) - lift[runs]) if len(runs) else end
        heads = np.flatnonzero(new[runs])
        offsets = np.append(heads, len(runs)).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(start[runs].astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"])
        r = runs[heads]
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(t[r]), pa.array(kind[r]), pa.ListArray.from_arrays(pa.array(offsets), cells)], ["doc", "t", "kind", "spots"])

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            spots = batch.column(3)
            for lo, hi, data, rows in text_slices(batch, 2):
                part = spots.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                pos = np.asarray(part.flatten().field("start")).astype(np.int64)
                padded = np.concatenate([np.zeros(width, dtype=np.uint8), data, np.zeros(width, dtype=np.uint8)])
                for a in range(0, len(pos), 100_000):
                    p, r = pos[a : a + 100_000], row[a : a + 100_000]
                    at = (rows[r] + p - side)[:, None] + np.arange(width)
                    own = padded[at + width]
                    gap = (at < rows[r][:, None]) | (at >= rows[r + 1][:, None])
                    own[gap] = 0
                    key = own[:, side : side + gram].astype(np.uint64) @ (seeded(91, gram) | np.uint64(1))
                    key = mix64(key)
                    before, after = np.minimum(p, side), np.minimum(rows[r + 1] - rows[r] - p, width - side)
                    bucket = (key % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    cols = [(key.view(np.int64), pa.int64()), (doc[lo + r], pa.int64()), (t[lo + r], pa.int32()), (p.astype(np.int32), pa.int32()), ((side - before).astype(np.int32), pa.int32()), ((side + after).astype(np.int32), pa.int32())]
                    packed = _pack(bucket, cols)
                    some = np.asarray(packed[0])
                    n = np.asarray(packed[1].value_lengths())
                    bounds = np.concatenate([[0], np.cumsum(n)]) * width
                    blob = own[order].tobytes()
                    bytes_ = pa.array([blob[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(some), *packed[1:], bytes_], ["b", "key", "doc", "t", "pos", "lo", "hi", "ctx"])

    def compare(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, t, pos, lo, hi = (_flat(group, c) for c in range(1, 7))
        own = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint8) for b in group for x in b.column(7)]).reshape(-1, width)
        docs_, ts, starts = [], [], []
        factors = _powers(_BASE, length)
        for o in range(width - length + 1):
            i = np.flatnonzero((lo <= o) & (hi >= o + length))
            h = np.empty(len(i), dtype=np.uint64)
            for a in range(0, len(i), 50_000):
                h[a : a + 50_000] = (_BYTE[own[i[a : a + 50_000], o : o + length]] * factors).sum(axis=1, dtype=np.uint64)
            order = np.lexsort((doc[i], h))
            i, h = i[order], h[order]
            if not len(i):
                continue
            at = np.flatnonzero(_group_starts(h))
            first = np.repeat(doc[i[at]], np.diff(np.append(at, len(i))))
            hit = i[doc[i] > first]
            docs_.append(doc[hit])
            ts.append(t[hit])
            starts.append(pos[hit] - side + o)
        if not docs_:
            return
        doc, t, start = np.concatenate(docs_), np.concatenate(ts), np.concatenate(starts)
        # neighbouring strings of one document make one run
        order = np.lexsort((start, t, doc))
        doc, t, start = doc[order], t[order], start[order]
        new = _group_starts(doc, t) | np.concatenate([[True], np.diff(start) > length])[: len(start)]
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(start)) - 1
        if not len(a):
            return
        cols = [(doc[a], pa.int64()), (t[a], pa.int32()), (start[a].astype(np.int32), pa.int32()), ((start[b] + length).astype(np.int32), pa.int32())]
        b_, *rest = _pack(_doc_bucket(doc[a], t[a], buckets), cols)
        yield pa.RecordBatch.from_arrays([b_, pa.array(np.zeros(len(b_), dtype=np.int32)), *rest], ["b", "kind", "doc", "t", "start", "end"])

    def by_bucket(df: DataFrame, work, schema: str) -> DataFrame:
        """Applies work to all rows of each bucket; a partition is sorted by bucket and holds one at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                b = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)] if len(b) else [0]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and held[0].column(0)[0].as_py() != b[x]:
                        yield from work(held)
                        held = []
                    held.append(batch.slice(x, y - x))
            if held:
                yield from work(held)

        return df.repartition(min(buckets, MOST_TASKS), "b").sortWithinPartitions("b").mapInArrow(run, schema)

    packed = docs.select("doc", "t", "text").mapInArrow(find, PACKED)
    spots = cut(by_bucket(packed, settle, SPOTS))
    fine = by_bucket(spots.filter("kind = 1"), merged, "doc long, t int, kind int, spots array<struct<start:int,end:int>>").drop("kind")
    with_text = docs.join(fine, ["doc", "t"]).select("doc", "t", "text", "spots")
    around = with_text.mapInArrow(surroundings, "b int, key array<long>, doc array<long>, t array<int>, pos array<int>, lo array<int>, hi array<int>, ctx binary")
    partly = by_bucket(around, compare, SPOTS)
    return by_bucket(spots.filter("kind = 0").unionByName(partly), merged, "doc long, t int, kind int, spots array<struct<start:int,end:int>>").select("doc", "t", F.col("spots").alias("runs"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end) for every row of docs (doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts in a document of a smaller doc_id. Strings are
    UTF-8 bytes of whole input texts and never cross documents. Any such string holds an anchor, the
    24-byte gram with the least hash among its own, so equal strings meet in the bucket of their anchor. Where the 26 bytes on
    both sides of an anchor agree too, all strings around it do; else the surroundings are fetched and their strings
    compared one by one. Strings are compared by 64-bit hashes.

    Edge cases: null and empty texts have 0 bytes and nothing removed; a null doc_id counts as larger than every other; rows
    that repeat a doc_id are not smaller than each other, so they take nothing from each other; other columns are ignored;
    an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), (F.xxhash64("text") % (1 << 30)).cast("int").alias("t"), "text")
    runs = cut(repeated_runs(texts.select("doc", "t", "text"), length))
    both = texts.join(runs, ["doc", "t"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in text_slices(batch, 1):
                part = batch.column(2).slice(lo, hi - lo)
                n = np.asarray(part.value_lengths().fill_null(0)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                flat = part.flatten()
                a, b = (np.asarray(flat.field(f)).astype(np.int64) for f in ("start", "end"))
                gone, sha = [], []
                for i in range(hi - lo):
                    own = data[rows[i] : rows[i + 1]].tobytes()
                    x, y = a[at[i] : at[i + 1]], b[at[i] : at[i + 1]]
                    left = b"".join(own[p:q] for p, q in zip([0, *y.tolist()], [*x.tolist(), len(own)], strict=True))
                    gone.append(int((y - x).sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(rows)), pa.array(gone, type=pa.int64()), pa.array(n), pa.array(sha, type=pa.string()), spans], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
