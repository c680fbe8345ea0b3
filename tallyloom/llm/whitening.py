"""Embedding whitening: counts, means and centred scatters of partitions, merged pairwise by Chan's formula."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: A coordinate c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT, COMPONENTS, ROWS = 64, 1_000_000, 16, 4096


@dataclasses.dataclass
class Moments:
    """Number, exact sums and centred scatter of some points."""

    n: int
    total: np.ndarray  # Python integers for points on the lattice, else doubles
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, and so does what the distance of the two means brings."""
        both = self.n + other.n
        apart = ((other.total * self.n - self.total * other.n) / (self.n * other.n)).astype(float)
        return Moments(both, self.total + other.total, self.scatter + other.scatter + np.outer(apart, apart) * (self.n / both * other.n))


@dataclasses.dataclass
class Space:
    """What whitens vectors of one width."""

    n: int
    total: np.ndarray  # exact sums, Python integers
    values: np.ndarray  # eigenvalues by size, of the components
    axes: np.ndarray  # width x components
    explained: np.ndarray
    error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - total, exactly: as 64-bit integers where these and the sum of their squares fit, else as Python's."""
        far = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.total.tolist()))
        if far * far * x.shape[1] < 1 << 63:
            return x * self.n - self.total.astype(np.int64)
        return x.astype(object) * self.n - self.total

    def project(self, far: np.ndarray) -> np.ndarray:
        """Whitened coordinates from deviations; NaN along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (far / self.n).astype(float) @ self.axes / np.sqrt(self.values), np.nan)


def _integer_sums(x: np.ndarray) -> np.ndarray:
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def _points(column: pa.Array, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, lattice points) of the vectors of each width; those with an entry that is null, not finite or beyond 64 bits are left out."""
    lens = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.floor(np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan)) * scale) + 0.0
    at = np.concatenate([[0], np.cumsum(lens)])
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**62))])
    rows = np.flatnonzero((lens > 0) & (bad[at[1:]] == bad[at[:-1]]))
    for width in np.unique(lens[rows]):
        own = rows[lens[rows] == width]
        yield own, flat[at[own][:, None] + np.arange(width)].astype(np.int64) + shift


def _lattice(scale: int, shift: int):
    """(embedding) to (width, point): the bytes of each vector's lattice point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                for own, x in _points(batch.column(0).slice(a, ROWS), scale, shift):
                    ends = (np.arange(len(own) + 1) * x.shape[1] * 8).astype(np.int32)
                    point = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x.shape[1], dtype=np.int32)), point], ["width", "point"])

    return run


def _moments(points: DataFrame, of) -> dict[int, Moments]:
    """By width, the moments of of(width, points): each partition's own ones, merged pairwise in a tree."""

    def local(rows: Iterator) -> Iterator[dict[int, Moments]]:
        own: dict[int, Moments] = {}
        held: dict[int, list[bytes]] = {}

        def add(width: int) -> None:
            x = of(width, np.frombuffer(b"".join(held.pop(width)), dtype=np.int64).reshape(-1, width))
            total = _integer_sums(x) if x.dtype == np.int64 else x.sum(axis=0)
            far = x - (total / len(x)).astype(float)
            got = Moments(len(x), total, far.T @ far)
            own[width] = own[width].merged(got) if width in own else got

        for width, point in rows:
            held.setdefault(width, []).append(bytes(point))
            if len(held[width]) == ROWS:
                add(width)
        for width in list(held):
            add(width)
        yield own

    def both(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return a | {w: a[w].merged(m) if w in a else m for w, m in b.items()}

    parts = points.select("width", "point").rdd.mapPartitions(local)
    return parts.treeReduce(both) if parts.getNumPartitions() else {}


def _space(m: Moments, components: int) -> Space:
    cov = m.scatter / m.n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    whole = float(np.trace(cov))
    # what rounding leaves of a variance of nothing counts as none
    values = np.where(values > whole * len(cov) * np.finfo(float).eps, values, 0.0)
    return Space(m.n, m.total, values, axes, values / whole if whole > 0 else np.full(len(values), np.nan))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> dict[int, Space]:
    """By width of vectors (embedding), the space that whitens their lattice points, each distinct point counting once.

    Points are floor(scale * c) + shift for each coordinate c. Each partition has the count, the sums and the scatter of its
    points about their own mean; treeReduce merges them pairwise by Chan's formula, so only some matrices of
    width x width reach the driver, where their eigenvectors are found. A second pass over the points
    measures how far the covariance of the whitened ones is from the identity (`error`, over components with variance).
    """
    points = vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(_lattice(scale, shift), "width int, point binary")
    points = cut(points.distinct())
    spaces = {w: _space(m, components) for w, m in _moments(points, lambda w, x: x).items()}

    def whitened(width: int, x: np.ndarray) -> np.ndarray:
        space = spaces[width]
        return space.project(space.deviations(x))[:, space.values > 0]

    for w, m in _moments(points, whitened).items():
        if len(m.total):
            spaces[w].error = float(np.abs(m.scatter / m.n - np.eye(len(m.total))).max())
    discard(points)
    return spaces


def whiten(vectors: DataFrame, spaces: dict[int, Space], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error for every row of vectors (vec_id, embedding) that has a point.

    n is the number of distinct points, deviation the exact sum over the dimensions of (n * x - sum of the points)^2; whitened holds the
    coordinate along each component, by falling eigenvalue, over the root of that, and explained each eigenvalue's share
    of the variance. The sign of a component makes its largest entry positive.

    Edge cases: rows whose vector is null, empty or holds entries that are null, not finite or beyond 64 bits on the lattice are left
    out; vectors of each width are a space of their own; a component without variance whitens to null (its explained is 0, or null
    where nothing varies); a deviation beyond 64 bits is null; rows are judged one by one, with a null or repeated vec_id
    too, but equal points count once in the fit; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                for own, x in _points(part.column(1), scale, shift):
                    s = spaces[x.shape[1]]
                    far = s.deviations(x)
                    square = (far * far).sum(axis=1)
                    square = pa.array(square) if square.dtype == np.int64 else pa.array([v if v < 1 << 63 else None for v in square.tolist()], type=pa.int64())
                    k = len(s.values)
                    lists = lambda v: pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * k).astype(np.int32)), pa.array(v.ravel(), from_pandas=True))  # noqa: B023, E731
                    cols = [part.column(0).take(pa.array(own)), pa.array(np.full(len(own), s.n)), square, lists(s.project(far)), lists(np.tile(s.explained, len(own))), pa.array([s.error] * len(own), type=pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    ready = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return ready.mapInArrow(run, "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
