"""Periodic runs of words: harmonic grid probing and chunked extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, words

#: The fewest words of a run, and the fewest periods.
LEAST, TIMES = 24, 3
#: Bytes of words that are copied at a time, and the first chunk of an extension.
COPY_BYTES, CHUNK = 1 << 20, 64


def _stretch(v: np.ndarray, i: int, p: int, lo: int, hi: int) -> tuple[int, int]:
    """The longest stretch (start, end) inside lo..hi around i whose words p apart are equal; those at i and i + p are."""
    end, step = i, CHUNK
    while end + p < hi:
        to = min(end + step, hi - p)
        odd = v[end:to] != v[end + p : to + p]
        k = int(odd.argmax())
        if odd[k]:
            end += k
            break
        end, step = to, step * 2
    start, step = i, CHUNK
    while start > lo:
        to = max(start - step, lo)
        odd = (v[to:start] != v[to + p : start + p])[::-1]
        k = int(odd.argmax())
        if odd[k]:
            start -= k
            break
        start, step = to, step * 2
    return start, end + p


def find_runs(hashes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of the runs in rows of word hashes, by row, start and period; first has one entry more than rows.

    A run has its smallest period p, at least max(least, times * p) words (times is 3 or more), and no neighbour extends it. So
    it holds that many over p points of any grid with step p: all rows together are probed at jp and (j+1)p, and where enough
    probes in a row agree the stretch is extended. Grid points inside one found run are left out: a stretch
    there is that run, or has its smaller period too. Rows stand by falling length, so the grid of p covers only those with room for a run of p.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    sizes = count[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    v = hashes[np.arange(at[-1]) + np.repeat(first[:-1][order] - at[:-1], sizes)]
    hi = np.repeat(at[1:], sizes)
    covered = np.zeros(len(v), dtype=np.int64)  # the end of the found run here that reaches farthest
    found = []
    for p in range(1, int(sizes[0]) // times + 1 if len(sizes) else 0):
        need = max(least, times * p)
        rows = int(np.searchsorted(-sizes, -need, side="right"))
        if not rows:
            break
        grid = v[: at[rows] : p]
        same = grid[1:] == grid[:-1]
        probes = need // p - 1
        if probes == 2:
            hit = np.flatnonzero(same[1:] & same[:-1])
        else:
            sums = np.concatenate([[0], np.cumsum(same)])
            hit = np.flatnonzero(sums[probes:] - sums[:-probes] == probes) if len(same) >= probes else same[:0]
        if not len(hit):
            continue
        i = hit * p
        last = i + probes * p
        i = i[(hi[i] > last) & (covered[i] <= last)]
        for off in {1, p // 3, p // 2, p - 1} - {0}:
            i = i[v[i + off] == v[i + off + p]]
        done = -1
        for x in i.tolist():
            if x < done or covered[x] > x + probes * p:
                continue
            row = int(np.searchsorted(at, x, side="right")) - 1
            start, end = _stretch(v, x, p, int(at[row]), int(at[row + 1]))
            done = end - p
            # one that a found run holds has that run's smaller period
            if end - start >= need and covered[start] < end:
                found.append((int(order[row]), start - int(at[row]), end - start, p))
                np.maximum(covered[start:end], end, out=covered[start:end])
    out = np.array(sorted(found, key=lambda x: (x[0], x[1], x[3])), dtype=np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, rows: int) -> pa.Array:
    """The words of each row (own tells which) joined by one space."""
    size = ends - starts + 1
    sums = np.concatenate([[0], np.cumsum(size)])
    buffer = np.empty(sums[-1], dtype=np.uint8)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + COPY_BYTES, side="right")) - 1)
        n = size[a:b]
        at = np.arange(sums[a], sums[b])
        buffer[at] = data.take(at + np.repeat(starts[a:b] - sums[a:b], n), mode="clip")
        buffer[sums[a + 1 : b + 1] - 1] = 32
        a = b
    # the last space of a row goes
    bounds = sums[np.searchsorted(own, np.arange(rows + 1))]
    full = np.diff(bounds) > 0
    kept = np.ones(len(buffer), dtype=bool)
    kept[bounds[1:][full] - 1] = False
    offsets = bounds - np.concatenate([[0], np.cumsum(full)])
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(buffer[kept].tobytes())])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed for every row of docs (doc_id, text).

    Words are runs of bytes other than space and \\x09-\\x0D, numbered from 0 and told apart by 64-bit hashes, upper and lower case
    too. runs are all stretches of at least `least` words and `times` periods, with their smallest period, that no neighbouring
    word extends, by start and period. collapsed holds the words that no run has after its first period, joined by one space.

    One pass over the texts, without a shuffle; a task holds slices of about 2 MB, or the longest single text.

    Edge cases: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed; rows are judged one
    by one, with a null or repeated doc_id too; other columns are ignored; an empty table gives an empty result.
    """
    if times < 3 or least < times:
        raise ValueError("a run needs three periods and as many words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in text_slices(batch, 1):
                h, starts, ends, first = words(data, rows, fold=False)
                row, start, length, period = find_runs(h, first, least, times)
                gone = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(gone, first[row] + start + period, 1)
                np.add.at(gone, first[row] + start + length, -1)
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                own = np.searchsorted(first, keep, side="right") - 1
                cells = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
                per = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                text = _joined(data, starts[keep], ends[keep], own, hi - lo)
                for a, b in _string_parts(text):
                    part = text.slice(a, b - a).cast(pa.string())
                    runs = pa.ListArray.from_arrays(pa.array(per[a : b + 1] - per[a]), cells.slice(per[a], per[b] - per[a]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), pa.array(np.diff(first[a : b + 1])), runs, part], ["doc_id", "n_words", "runs", "collapsed"])

    ready = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ready.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _string_parts(text: pa.Array, most: int = 1 << 30) -> list[tuple[int, int]]:
    """Ranges of rows whose texts together stay within Arrow's 32-bit offsets."""
    return [(0, len(text))] if len(text) < 2 or text.nbytes < most else [(k, k + 1) for k in range(len(text))]
