"""What the operators of this subpackage share: tables, lineage cuts and vectorised text kernels.

The kernels run inside Spark tasks on slices of an Arrow batch of a few MB, so a worker's memory
follows the slice (or the longest single text) and not the batch or the partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
#: Bytes of whole rows that are hashed at a time: the tables of a kernel are 8 bytes and more for each of them.
PIECE = 1 << 18
#: Stands for a null doc_id, so that it comes last.
LAST = (1 << 63) - 1
#: Shuffle files go when the execution that made them ends, and not whenever the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of this very name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in have:
        out += "_"
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names (or one set on the context): all executors and the driver see it.

    Only a local session without either, as in tests, gets a temporary one; a cluster has to name its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: a lost executor costs no recomputation before it.

    Shuffle files of the writing are removed with its end, so the disk holds those of one such step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyloom-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    discard(*getattr(df, "tallyloom_needs", ()))
    out = spark.read.schema(df.schema).parquet(path)
    out.tallyloom_table = path
    return out


def needing(df: DataFrame, *tables: DataFrame | None) -> DataFrame:
    """df, which reads these tables of cut: they go once cut has written df itself."""
    more = [y for x in tables if x is not None for y in getattr(x, "tallyloom_needs", ())]
    df.tallyloom_needs = [*getattr(df, "tallyloom_needs", ()), *(x for x in tables if x is not None), *more]
    return df


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that cut has written and nothing reads any more."""
    for df in tables:
        path = getattr(df, "tallyloom_table", None) if df is not None else None
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = seeded(11, 256) | np.uint64(1)
#: The same with the factors of a-z for A-Z.
_FOLDED = _BYTE[LOWER]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _POWERS[str(base)] = have = out
    return have[:n]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes) of slices of about limit bytes.

    Null texts are empty. A text longer than limit is a slice of its own: no text is ever cut.
    """
    col = batch.column(column)
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind, wide = np.int32, 4
    else:
        kind, wide = np.int64, 8
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        empty = "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b""
        col = col.fill_null(empty)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=kind, count=n + 1, offset=col.offset * wide).astype(np.int64)
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, every[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, rows: np.ndarray, gap: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, end byte) of every word and, per row, the index of its first word.

    Words are maximal runs of bytes outside gap, A-Z lower-cased if fold; they never cross rows. The hash
    is a polynomial over random byte values, read off one running sum, so no word is looked at twice. It is the
    same wherever the word stands, so rows are hashed PIECE bytes at a time (or one longer row): memory follows
    the words and not the bytes of data.
    """
    found = []
    a, last = 0, len(rows) - 1
    while a < last:
        b = min(max(int(np.searchsorted(rows, rows[a] + PIECE, side="right")) - 1, a + 1), last)
        lo = rows[a]
        h, starts, ends = _words(data[lo : rows[b]], rows[a : b + 1] - lo, gap, fold)
        found.append((h, starts + lo, ends + lo))
        a = b
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(rows), dtype=np.int64)
    hashes, starts, ends = found[0] if len(found) == 1 else map(np.concatenate, zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, rows)


def _words(data: np.ndarray, rows: np.ndarray, gap: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, first and end bytes of words, of one piece."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    out = gap[data]
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = out[:-1]
    before[inner] = True
    starts = np.flatnonzero(before & ~out)
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = out[1:]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~out) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _powers(_BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, starts, ends


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words of each row, and per row the index of its first shingle.

    first has one entry more than there are rows. A row with fewer words has its whole sequence
    as one shingle, a row without words has none.
    """
    count = np.diff(first)
    many = np.maximum(count - width + 1, 0)
    out_first = np.zeros(len(first), dtype=np.int64)
    np.cumsum(np.where(many > 0, many, (count > 0).astype(np.int64)), out=out_first[1:])
    out = np.zeros(out_first[-1], dtype=np.uint64)
    factors = seeded(23, width) | np.uint64(1)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        run = hashes[:n] * factors[0]
        for k in range(1, width):
            run += hashes[k : k + n] * factors[k]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(out_first[:-1], many) + at] = mix64(run[np.repeat(first[:-1], many) + at])
    for i in np.flatnonzero((count > 0) & (many == 0)):
        seq = hashes[first[i] : first[i + 1]]
        out[out_first[i]] = mix64((seq * factors[: len(seq)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(seq)))[0]
    return out, out_first


def running_sums(data: np.ndarray) -> np.ndarray:
    """The sums from which char_runs and words read the hash of any stretch of data (A-Z lower-cased)."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_FOLDED[data] * _powers(_BASE, len(data)), out=sums[1:])
    return sums


def stretches(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes that words gives of the stretches of the data of sums."""
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def char_runs(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, lo, hi): an unmixed hash for each UTF-8 character of data that width - 1 others follow, and the characters of each piece."""
    inverse = _powers(_INVERSE, len(sums))
    if len(data) and data.max() >= 0x80:
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
        sums, inverse = sums[at], inverse[at]
    else:
        lo, hi = starts, ends
    run = sums[width:] - sums[:-width]
    run *= inverse[: len(run)]
    return run, lo, hi


def char_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width UTF-8 characters in each piece of data (A-Z lower-cased), and per piece its first.

    Every piece has at least one: a shorter piece is one shingle as a whole. Pieces are in order.
    """
    sums = running_sums(data)
    run, lo, hi = char_runs(data, sums, starts, ends, width)
    many = np.maximum(hi - lo - width + 1, 1)
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - lo, many)
    short = np.flatnonzero(hi - lo < width)
    out = run.take(at, mode="clip") if len(run) else np.zeros(len(at), dtype=np.uint64)
    out[first[short]] = (sums[ends[short]] - sums[starts[short]]) * _powers(_INVERSE, len(sums))[starts[short]]
    return mix64(out), first


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
