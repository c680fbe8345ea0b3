"""Near-duplicate documents: MinHash signatures under a multi-index Hamming join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import SPREAD, connect, shared_members, signature_test, spread
from .common import LAST, cut, discard, mix64, needing, quoted, seeded, shingles, text_slices, unused, words
from .components import components

#: 12 chunks of 4 minima with one error each: all pairs of signatures with at most 12 * 2 - 1 = 23 differences share a key.
CHUNKS, CHUNK, ERRORS, WIDTH, PERCENT = 12, 4, 1, 5, 75
MOST = CHUNKS * (ERRORS + 1) - 1
#: What a text with words holds.
WORD = r"[^\x20\x09-\x0D]"


def signature(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """size minima of 16 bits each per row (rows without shingles must not be given)."""
    a, b = seeded(31, size) | np.uint64(1), seeded(37, size)
    out = np.empty((len(first) - 1, size), dtype=np.uint64)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(hashes * a[k] + b[k], first[:-1])
    return (mix64(out) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS, width: int = CHUNK, errors: int = ERRORS) -> np.ndarray:
    """Per row, a 64-bit key for each chunk and each choice of `errors` positions left out of it.

    Two signatures of chunks * width positions that differ in fewer than chunks * (errors + 1)
    positions have, by pigeonhole, a chunk with at most `errors` differences; leaving out a set
    that holds these gives both the same key. So every such pair shares a key.
    """
    cols = []
    for c in range(chunks):
        for j, out in enumerate(itertools.combinations(range(width), errors)):
            key = np.full(len(sig), mix64(np.array([c * 1009 + j + 1], dtype=np.uint64))[0], dtype=np.uint64)
            for p in range(width):
                if p not in out:
                    key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + sig[:, c * width + p].astype(np.uint64) + np.uint64(1))
            cols.append(key)
    return np.stack(cols, axis=1)


def row_key(text: str = "text") -> Column:
    """With doc_id, what names a row: a hash of its text."""
    return F.xxhash64(F.col(text).cast("string"))


def _distinct_sets(data: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row by row, and the first of each row)."""
    h, _, _, first = words(data, rows)
    s, at = shingles(h, first, width)
    sets = [np.unique(s[a:b]) for a, b in itertools.pairwise(at)]
    return (np.concatenate(sets) if sets else s), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, n_shingles, p1, p2, sig, low): row key, set size, a 128-bit print of the set, its signature of 16-bit minima and their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = CHUNKS * CHUNK
        for batch in batches:
            for lo, hi, data, rows in text_slices(batch, 2):
                flat, at = _distinct_sets(data, rows, width)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                p1, p2 = np.zeros(hi - lo, dtype=np.uint64), np.zeros(hi - lo, dtype=np.uint64)
                sig = np.zeros(0, dtype=np.uint16)
                if len(full):
                    starts = at[:-1][full]
                    p1[full] = np.add.reduceat(mix64(flat ^ np.uint64(0xA5A5A5A5)), starts)
                    p2[full] = np.add.reduceat(mix64(flat + np.uint64(0x1234567)), starts)
                    sig = signature(flat, np.append(starts, len(flat)), size)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, size, 0))]).astype(np.int32)
                packed = lambda x: pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends * x.itemsize).tobytes()), pa.py_buffer(x.tobytes())])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), packed(sig), packed(sig.astype(np.uint8))],
                    ["doc_id", "h", "n_shingles", "p1", "p2", "sig", "low"],
                )

    ready = docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string"))
    return ready.mapInArrow(run, "doc_id long, h long, n_shingles long, p1 long, p2 long, sig binary, low binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig) to rows of spread."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(part.num_rows, -1)
            yield spread(chunk_keys(sig), part.column(0).to_numpy())


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept for every row of docs: near_duplicates row by row, h being row_key.

    Here kept holds for one row of each group, whether it has a doc_id or not, and for each row without words;
    only rows that are equal in doc_id and text have it in common.
    """
    # rows have numbers from here on: doc_id may repeat or be null
    prof = cut(profiles(docs, width).withColumn("id", F.monotonically_increasing_id()))
    known = prof.filter("n_shingles > 0")
    classes = cut(known.groupBy("n_shingles", "p1", "p2").agg(F.min("id").alias("rep")))
    member = cut(known.join(classes, ["n_shingles", "p1", "p2"]).select("id", "rep", "doc_id"))
    reps = cut(prof.join(classes.select(F.col("rep").alias("id")), "id").select("id", "doc_id", "h", F.col("n_shingles").alias("n"), "sig", "low"))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = reps.join(ids, "id").select("id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), "h")
        own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), row_key().alias("h"), F.col("text").cast("string").alias("text"))
        return own.join(wanted, ["d", "h"]).select("id", "text")

    shared = shared_members(reps.select("id", "sig").mapInArrow(_keys, SPREAD))
    members = cut(shared.join(reps, "id").select(F.col("key").alias("g"), "id", F.lit(1).alias("w"), "n", "low"))
    comp = connect(members, signature_test(6, MOST, 5, percent), texts, lambda data, rows: _distinct_sets(data, rows, width), percent)
    placed = cut(member.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", "doc_id", F.coalesce("component", "rep").alias("c")))
    # rows of one doc_id are one document: they join their components
    same = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b")
    merged = components(placed.filter("doc_id is not null").join(same.select("doc_id", "a"), "doc_id").select("a", F.col("c").alias("b")))
    first = placed
    placed = placed.join(merged.select(F.col("id").alias("c"), "component"), "c", "left").select("id", "doc_id", F.coalesce("component", "c").alias("c"))
    placed = cut(placed)
    least = cut(placed.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "id")).getField("id").alias("first")))
    per = placed.join(least, "c").select("id", "component_id", (F.col("id") == F.col("first")).alias("one"))
    out = prof.select("id", "doc_id", "h", "n_shingles").join(per, "id", "left")
    discard(classes, member, comp, merged, reps, first, members)
    out = out.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("one", F.lit(True)).alias("kept"))
    return needing(out, prof, placed, least)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents whose sets of distinct `width`-word shingles have a Jaccard similarity of at
    least `percent` / 100 are linked; component_id is the smallest doc_id reachable and kept tells
    whether it is the document's own. Words are runs of bytes other than space and \\x09-\\x0D, A-Z
    lower-cased; a shorter text is one shingle as a whole.

    Equal sets become one class before anything is compared. A signature has 48 minima of 16
    bits in 12 chunks of 4. All pairs of signatures with at most 23 differences share a key (`chunk_keys`) and
    pass; a pair at similarity 0.75 differs in 12 +- 3, so it is lost with a probability of about 1 in 10,000.
    Candidates are confirmed on the full sets (64-bit shingle hashes).

    Edge cases: null and empty texts, and texts of white space, have n_shingles 0 and are linked with
    nothing. Rows with a null doc_id are compared like all others; their component_id is the smallest doc_id they
    reach (null if there is none) and kept is false. doc_id names a document: rows that repeat it are one, linked with whatever
    any of their texts is linked with. Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    found = near_groups(docs, width, percent)
    return needing(found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept")), found)


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (null last).

    Rows without words stay, each of them; of rows equal in doc_id and text one does, if it has words.
    """
    d, h = unused("d", docs), unused("h", docs)
    groups = near_groups(docs, width, percent)
    found = groups.filter("kept and n_shingles > 0").select(F.coalesce("doc_id", F.lit(LAST)).alias(d), F.col("h").alias(h)).distinct()
    some = F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(WORD)), F.lit(False))
    keyed = docs.filter(some).withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: row_key()}).join(found, [d, h])
    kept = keyed.dropDuplicates([d, h]).select(*[quoted(c) for c in docs.columns])
    return needing(kept.unionByName(docs.filter(~some)), groups)
